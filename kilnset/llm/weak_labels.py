"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every whole text. How often each
of them is right is estimated without labels: expectation-maximisation over all
documents, which only needs the number of documents of each vote pattern (at most
``3 ** labellers``). The posteriors of a bounded sample train a hashed linear
scorer, which then judges every document by its words and characters, also those
no labeller speaks about.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnset.llm.features import BINS, Linear, fit_rows
from kilnset.llm.quality_rules import SYMBOL, _again, _per_text, text_counts
from kilnset.llm.words import SPACE, Words, as_strings, mix, slices

#: Documents the scorer is fitted on (on average), a share of the hashes of id and text.
FIT_ROWS = 4000
THRESHOLD = 0.5
LABELLERS = ["symbols", "marked", "letters", "repeats", "capitals", "shouting", "variety", "sentences", "lines", "lengths"]
ABSTAIN, BAD, GOOD = 0, 1, 2


def votes(words: Words) -> np.ndarray:
    """One vote of each labeller for each document (n x labellers, uint8)."""
    counts = text_counts(words)
    data, offsets = words.data, words.offsets
    n = np.maximum(counts["n_words"], 1)
    upper = _per_text((data >= 65) & (data <= 90), offsets)
    lower = _per_text((data >= 97) & (data <= 122), offsets)
    bangs, stops = _per_text(data == 33, offsets), _per_text(data == 46, offsets)
    key = mix(words.hashes() + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(words.doc[~_again(key)[0]], minlength=len(n))
    spoken = counts["n_words"] >= 10
    odd = np.concatenate([[0], np.cumsum(SYMBOL[data], dtype=np.int64)])
    marked = np.bincount(words.doc[odd[words.end] > odd[words.start]], minlength=len(n)) / n
    alpha = _per_text(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128), offsets)
    letters = alpha / np.maximum(_per_text(~SPACE[data], offsets), 1)

    def vote(bad, good, known=True):
        return np.where(spoken & known, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)), ABSTAIN).astype(np.uint8)

    symbols, repeats = counts["n_symbols"] / n, counts["n_repeat_words"] / n
    capitals = upper / np.maximum(upper + lower, 1)
    shouting, variety = bangs / n, distinct / n
    span, length = n / np.maximum(stops, 1), counts["word_chars"] / n
    return np.stack([
        vote(symbols > 0.05, symbols < 0.02),
        vote(marked > 0.1, marked < 0.03),
        vote(letters < 0.9, letters > 0.94),
        vote(repeats > 0.2, repeats < 0.05),
        vote(capitals > 0.3, capitals < 0.15),
        vote(shouting > 0.1, shouting < 0.05),
        vote(variety < 0.15, variety > 0.4, n >= 20),
        vote((stops == 0) | (span > 80), (span > 2) & (span < 40), n >= 30),
        vote(counts["n_dup_lines"] > 3, counts["n_dup_lines"] == 0),
        vote((length > 12) | (length < 2), (length > 3) & (length < 9)),
    ], axis=1)


def _code(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _uncode(code: np.ndarray, n: int) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(n)) % 3


def estimate(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (m x labellers) seen ``weight`` times: the posterior
    of good for each pattern, ``table[class, labeller, vote]``, and the share of
    good documents. Starts from the majority of the votes."""
    m, k = patterns.shape
    good = (patterns == GOOD).sum(axis=1)
    bad = (patterns == BAD).sum(axis=1)
    posterior = np.where(good + bad > 0, (good + 0.5) / (good + bad + 1.0), 0.5)
    # two objections outweigh many labellers that see nothing wrong
    posterior = np.where(bad >= 2, 0.05, posterior)
    hot = np.stack([(patterns == v) for v in (ABSTAIN, BAD, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        share = np.clip((weight @ posterior) / max(weight.sum(), 1e-12), 1e-4, 1 - 1e-4)
        table = np.zeros((2, k, 3))
        for c, p in enumerate((1 - posterior, posterior)):
            table[c] = np.einsum("m,mkv->kv", weight * p, hot) + 0.5
            table[c] /= table[c].sum(axis=1, keepdims=True)
        # abstaining says nothing about the class
        silent = np.einsum("m,mk->k", weight, hot[:, :, 0]) / max(weight.sum(), 1e-12)
        table[:, :, 0] = np.clip(silent, 1e-6, 1)
        ratio = np.einsum("mkv,kv->m", hot[:, :, 1:], np.log(table[1, :, 1:]) - np.log(table[0, :, 1:]))
        after = 1.0 / (1.0 + np.exp(-np.clip(ratio + np.log(share / (1 - share)), -40, 40)))
        moved = np.abs(after - posterior).max() if m else 0.0
        posterior = after
        if moved < 1e-9:
            break
    return posterior, table, float(share)


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", fit_rows_bound: int = FIT_ROWS,
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, the votes (0 none, 1 bad, 2 good), posterior
    of good from the votes, score of the scorer, kept.

    Null and empty texts get no vote and the prior; null and repeated keys are
    judged row by row; an empty table gives an empty one; where all posteriors
    agree the scorer keeps everything.
    """
    source = docs.select(docs[text].cast("string").alias("text"), docs[key].alias(key))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_strings(batch.column(0))
            for a, b in slices(column):
                code, n = np.unique(_code(votes(Words(column.slice(a, b - a)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    seen = source.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = sorted((r.code, r.n) for r in seen.collect())  # at most 3 ** labellers rows
    codes = np.array([c for c, _ in found], dtype=np.int64)
    posterior, _, _ = estimate(_uncode(codes, len(LABELLERS)), np.array([n for _, n in found], dtype=float))

    def judged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
        words = Words(column)
        v = votes(words)
        return v, posterior[np.searchsorted(codes, _code(v))], words

    named = source.withColumn("h", F.xxhash64(F.col(key), "text"))
    # a share of the hashes that holds ``fit_rows_bound`` rows on average; rows alike count once
    share = min(1.0, fit_rows_bound / max(1, sum(n for _, n in found)))
    sample = named.where("text is not null").where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sample.groupBy("h").agg(F.min("text").alias("text"))

    def train(table: pa.Table) -> pa.Table:
        column = as_strings(table["text"])
        target = np.concatenate([judged(column.slice(a, b - a))[1] for a, b in slices(column)])
        model = fit_rows(table.append_column("target", pa.array(target)), "text", "target", "h")
        return pa.table({"weights": [model.weights.tobytes()], "slope": [model.slope], "shift": [model.shift]})

    got = sample.groupBy(F.lit(1).alias("one")).applyInArrow(train, "weights binary, slope double, shift double").first()
    model = Linear(np.zeros(BINS), 1.0, 40.0) if got is None else Linear(
        np.frombuffer(got["weights"]), got["slope"], got["shift"])

    names = [key, *[f"vote_{x}" for x in LABELLERS], "posterior", "score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_strings(batch.column(0))
            for a, b in slices(column):
                some = column.slice(a, b - a)
                v, p, words = judged(some)
                score = model.probability(some, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), *[pa.array(v[:, j].astype(np.int32)) for j in range(v.shape[1])],
                     pa.array(p), pa.array(score), pa.array(score >= threshold)], names)

    schema = T.StructType([source.schema[key], *[T.StructField(x, T.IntegerType()) for x in names[1:-3]],
                           T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])
    return source.mapInArrow(run, schema)
