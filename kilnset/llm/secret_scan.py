"""Secrets by patterns, and by the guess cost of what stands where credentials do.

The base spans come from three patterns. Beside them, every value that follows a
credential's name (a wider list than the base has), a bearer scheme or a user name
in an address is priced in guesses (``guess_cost``), and spans of kind ``guess`` are
added for those that take ``LEAST_BITS`` bits of guesses or more, whether or not a
base span covers them: they tell values that are hard to guess from names,
examples and words.

The dictionary is the corpus: occurrences of the runs of letters in all texts
outside such values, so that a secret that thousands of copies repeat does not
become a word. Words are counted once a slice, travel as hashes by range, and meet
there the substrings of the distinct values; only words that some value holds come
back, in joins that adaptive execution can split. Values are priced once each,
however often they occur. Nothing is broadcast or collected but the number of words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.guess_cost import LONGEST, SHORTEST, guess_bits, letters, lowered, word_spans
from kilnset.llm.repeats import range_count
from kilnset.llm.scratch import Scratch, text_column
from kilnset.llm.words import as_strings, slices, span_hashes, text_bytes

#: Bits of guesses from which a value counts as a secret: 10^10 guesses.
LEAST_BITS = 33.2
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a whole run
CONTEXTS = (
    re.compile(r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|"""
               r"""credentials?|authorization)["'\])]*\x20*(?::=|=>|[:=])\x20*(?:(?:basic|bearer)\x20+)?["'(]?([^\s"'<>()\[\]{},;]+)"""),
    re.compile(r"(?ai)\bbearer\x20+([a-z0-9._~+/=-]+)"),
    re.compile(r"://[^\s:/@]+:([^\s/@]+)@"),
)
#: What a text must have for any of these, for the scan by the vectorised matcher.
ANY = (r"""(?i)(pass|pwd|secret|token|key|credentials?|authorization)[a-z]*["'\])]*\x20*[:=]|bearer\x20|"""
       r"""://[^\s:/@]+:""")
ANY_BASE = r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
TRAILING = ".,;:!?"

FOUND_SCHEMA = ("doc_id long, base array<struct<start: long, kind: int, end: long>>, "
                "vals array<struct<start: long, end: long, value: string>>")
ENTRY_SCHEMA = "bucket long, asks boolean, keys binary, counts binary"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values in credential contexts, without what ends a sentence."""
    spans = set()
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            size = len(m[1].rstrip(TRAILING))
            if size:
                spans.add((m.start(1), m.start(1) + size))
    return sorted(spans)


def _suspects(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may have values, and rows that may have anything."""
    values = pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False)
    return values, values | pc.match_substring_regex(texts, ANY_BASE).to_numpy(zero_copy_only=False)


def _scan(batches):
    kinds = [pa.field("doc_id", pa.int64()),
             pa.field("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
             pa.field("vals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])))]
    for batch in batches:
        texts = as_strings(batch.column("text"))
        has_values, has_any = _suspects(texts)
        base: list[list] = [[]] * len(batch)
        vals: list[list] = [[]] * len(batch)
        for i in np.flatnonzero(has_any).tolist():
            text = texts[i].as_py()
            base[i] = [dict(zip(("start", "kind", "end"), s)) for s in base_spans(text)]
            if has_values[i]:
                vals[i] = [{"start": a, "end": b, "value": text[a:b]} for a, b in context_values(text)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(base, kinds[1].type), pa.array(vals, kinds[2].type)], schema=pa.schema(kinds))


def _entries(keys: np.ndarray, counts: np.ndarray, asks: bool, ranges: int) -> pa.RecordBatch:
    """Sorted hashes with their counts by hash range."""
    target = (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(target)) + 1
    parts = [] if not len(keys) else list(zip(np.split(target, edge), np.split(keys, edge), np.split(counts, edge)))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(t[0]) for t, _, _ in parts], pa.int64()), pa.array([asks] * len(parts), pa.bool_()),
         pa.array([k.tobytes() for _, k, _ in parts], pa.binary()),
         pa.array([c.astype(np.int32).tobytes() for _, _, c in parts], pa.binary())], ["bucket", "asks", "keys", "counts"])


def _words(ranges: int):
    """Runs of letters of each slice outside values, counted."""
    def run(batches):
        for batch in batches:
            texts = as_strings(batch.column("text"))
            for begin, stop in slices(texts):
                part = texts.slice(begin, stop - begin)
                data, offsets = text_bytes(part)
                inside = letters(data)
                for i in np.flatnonzero(_suspects(part)[0]).tolist():
                    text = part[i].as_py()
                    for a, b in context_values(text):
                        at = int(offsets[i]) + len(text[:a].encode())
                        inside[at:at + len(text[a:b].encode())] = False
                fresh = np.zeros(len(data) + 1, dtype=bool)
                fresh[offsets] = True
                first, last = inside.copy(), inside.copy()
                first[1:] &= ~inside[:-1] | fresh[1:len(data)]
                last[:-1] &= ~inside[1:] | fresh[1:len(data)]
                start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
                some = (end - start >= SHORTEST) & (end - start <= LONGEST)
                keys, counts = np.unique(span_hashes(lowered(data), start[some], end[some]), return_counts=True)
                yield _entries(keys, counts, False, ranges)
    return run


def _asked(ranges: int):
    """Hashes of the substrings that may be words, of some values at once."""
    def run(batches):
        for batch in batches:
            keys = [word_spans(v)[2] for v in batch["value"].to_pylist()]
            keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            yield _entries(keys, np.zeros(len(keys), np.int64), True, ranges)
    return run


def _judge(table: pa.Table) -> pa.Table:
    """Occurrences of the words that a value asks for, and (without a key) of all."""
    asks = table["asks"].to_numpy()
    keys = [np.frombuffer(k.as_py(), np.uint64) for k in table["keys"]]
    counts = [np.frombuffer(c.as_py(), np.int32).astype(np.int64) for c in table["counts"]]
    none = np.zeros(0, np.uint64)
    wanted = np.unique(np.concatenate([none, *[k for k, a in zip(keys, asks) if a]]))
    total, n = 0, np.zeros(len(wanted), np.int64)
    for k, c, a in zip(keys, counts, asks):
        if not a:
            total += int(c.sum())
            at = np.minimum(np.searchsorted(wanted, k), max(0, len(wanted) - 1))
            hit = wanted[at] == k if len(wanted) else np.zeros(len(k), dtype=bool)
            n[at[hit]] += c[hit]  # hashes of an entry are distinct
    found = n > 0
    return pa.table({"key": pa.concat_arrays([pa.array(wanted[found].view(np.int64)), pa.nulls(1, pa.int64())]),
                     "n": pa.array(np.append(n[found], total))})


def _substrings(batches):
    for batch in batches:
        for name, value in zip(batch["name"].to_pylist(), batch["value"].to_pylist()):
            keys = np.unique(word_spans(value)[2])
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.view(np.int64))], ["name", "key"])


def _priced(total: int):
    def run(batches):
        for batch in batches:
            bits = []
            for value, words in zip(batch["value"].to_pylist(), batch["words"].to_pylist()):
                counts = {w["key"] & (1 << 64) - 1: w["n"] for w in words or ()}
                bits.append(guess_bits(value, counts, total))
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(bits, pa.float64())], ["name", "bits"])
    return run


def priced_values(docs: DataFrame, values: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """name (md5), bits of each distinct ``value``, with the corpus as dictionary."""
    distinct = scratch.write(values.select("value").distinct().select(
        F.md5(F.col("value").cast("binary")).alias("name"), "value"))
    ranges = range_count(docs, text)
    words = docs.select(text_column(docs, text).alias("text")).mapInArrow(_words(ranges), ENTRY_SCHEMA)
    asked = distinct.select("value").mapInArrow(_asked(ranges), ENTRY_SCHEMA)
    counts = scratch.write(words.unionByName(asked).groupBy("bucket").applyInArrow(_judge, "key long, n long"))
    total = counts.where("key is null").agg(F.sum("n")).first()[0] or 0
    held = distinct.mapInArrow(_substrings, "name string, key long").join(counts.where("key is not null"), "key")
    held = held.groupBy("name").agg(F.collect_list(F.struct("key", "n")).alias("words"))
    return distinct.join(held, "name", "left").select("name", "value", "words").mapInArrow(
        _priced(total), "name string, bits double")


def secrets(docs: DataFrame, least_bits: float = LEAST_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256,
    spans. A span is ``kind:start:end`` of the whole match (base kinds) or of the
    value (``guess``), in code points, by start and kind.

    A null text is empty; rows of one id, and equal rows, have a row each. Values of
    any length are priced whole. An empty table gives no rows. Other columns do not
    matter.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text"))
    found = scratch.write(rows.mapInArrow(_scan, FOUND_SCHEMA).withColumn("id", F.monotonically_increasing_id()))
    values = scratch.write(found.where("size(vals) > 0").select("id", F.explode("vals").alias("v")).select(
        "id", "v.*", F.md5(F.col("v.value").cast("binary")).alias("name")))
    bits = priced_values(docs, values, text, scratch).where(F.col("bits") >= least_bits)
    span = F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")
    added = values.drop("value").join(bits, "name").groupBy("id").agg(F.collect_list(span).alias("added"))
    out = found.join(added, "id", "left")
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
            ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    added = F.coalesce("added", none)
    return out.select(
        "doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.size(added).cast("long").alias("n_guess"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", added)).alias("spans"))
