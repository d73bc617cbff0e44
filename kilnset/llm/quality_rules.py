"""Quality rules: counts of each whole text, then a trained n-gram verdict.

Documents below the base rules are refused; the others are judged by a hashed
word and character n-gram logistic regression, trained on labelled rows,
calibrated to probabilities, and scored in Arrow batches against a fixed
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.features import Linear, fit_rows
from kilnset.llm.words import Words, as_strings, mix, slices, span_hashes, window_hashes

#: Labelled rows the model is fitted on (on average), a share of the hashes of their ids.
FIT_ROWS = 4000
#: Probability of good quality from which a document is kept.
THRESHOLD = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many positions of the mask each text holds."""
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is there an equal one before it, is there any equal one."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    if len(key):
        same[1:] = key[order][1:] == key[order][:-1]
    earlier = np.zeros(len(key), dtype=bool)
    earlier[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    some = np.zeros(len(key), dtype=bool)
    some[order] = either
    return earlier, some


def text_counts(words: Words) -> dict[str, np.ndarray]:
    """The base counts of each document."""
    data, offsets, n = words.data, words.offsets, len(words.n)
    letters = np.zeros(len(data) + 1, dtype=bool)
    if len(words.start):
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[words.start] += 1
        edge[words.end] -= 1
        letters = np.cumsum(edge, dtype=np.int8) > 0
    solid = letters[:-1]
    out = {"n_words": words.n.astype(np.int64),
           "word_chars": _per_text(solid & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": _per_text(SYMBOL[data], offsets)}
    # lines with a word: spans between newlines and text edges
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(
        np.append(cut, len(data))[np.searchsorted(cut, begin)],
        offsets[np.minimum(np.searchsorted(offsets, begin, "right"), n)])
    filled = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    line = np.flatnonzero(filled[stop] > filled[begin])
    doc = np.searchsorted(offsets, begin[line], "right") - 1
    key = mix(span_hashes(data, begin[line], stop[line], seed=3) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["n_dup_lines"] = np.bincount(doc[_again(key)[0]], minlength=n).astype(np.int64)
    # words inside windows that the document holds twice
    found = window_hashes(words.hashes(), REPEAT_WINDOW, seed=4)
    inside = np.flatnonzero(words.doc[:len(found)] == words.doc[REPEAT_WINDOW - 1:]) if len(found) else np.zeros(0, int)
    key = mix(found[inside] + words.doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = inside[_again(key)[1]]
    cover = np.zeros(len(words.start) + 1, dtype=np.int64)
    cover[at] += 1
    cover[at + REPEAT_WINDOW] -= 1
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(words.doc[covered], minlength=n).astype(np.int64)
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows_bound: int = FIT_ROWS) -> Linear:
    """Model of ``labels.quality`` from a bounded sample of labelled documents.

    Labelled rows without an id or label are left out; several rows of one id
    count as one label (the smallest); without both classes everything passes.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").cast("double").alias("target"))
    # a share of the hashes that holds ``fit_rows_bound`` ids on average
    share = min(1.0, fit_rows_bound / max(1, known.count()))
    chosen = known.withColumn("__h", F.xxhash64("doc_id")).where(
        F.pmod(F.col("__h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    text = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # about ``fit_rows_bound`` rows of two numbers
    sample = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("target").alias("target"), F.min("__h").alias("h"))

    def train(table: pa.Table) -> pa.Table:
        model = fit_rows(table, "text", "target", "h")
        return pa.table({"weights": [model.weights.tobytes()], "slope": [model.slope], "shift": [model.shift]})

    found = sample.groupBy(F.lit(1).alias("one")).applyInArrow(
        train, "weights binary, slope double, shift double").first()
    if found is None:
        from kilnset.llm.features import BINS

        return Linear(np.zeros(BINS), 1.0, 40.0)
    return Linear(np.frombuffer(found["weights"]), found["slope"], found["shift"])


def quality_rules(docs: DataFrame, model: Linear, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: key, counts, base_failed, quality (the
    probability, null where the base rules fail), kept, and the columns in
    ``carry``.

    A null text counts as empty and fails the base rules; null and repeated keys
    are judged row by row; an empty table gives an empty one.
    """
    carried = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)]
    source = docs.select(docs[text].cast("string").alias("__text"), docs[key].alias(key), *carried)
    from pyspark.sql import types as T

    added = [T.StructField(c, T.LongType()) for c in COUNTS] + [
        T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()),
        T.StructField("kept", T.BooleanType())]
    schema = T.StructType([*source.schema.fields[1:], *added])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_strings(batch.column(0))
            parts = []
            for a, b in slices(column):
                some = column.slice(a, b - a)
                words = Words(some)
                counts = text_counts(words)
                failed = (counts["n_words"] < MIN_WORDS) | (
                    100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                parts.append([*[counts[c] for c in COUNTS], failed, model.probability(some, words)])
            cells = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, int)] * len(COUNTS) + [
                np.zeros(0, bool), np.zeros(0)]
            failed, chance = cells[-2], cells[-1]
            columns = [pa.array(x) for x in cells[:len(COUNTS)]] + [
                pa.array(failed), pa.array(chance, mask=failed), pa.array(~failed & (chance >= threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names)

    out = source.mapInArrow(run, schema)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"__c{i}", c)
    return out
