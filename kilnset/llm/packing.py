"""Packing: non-negative least squares over shallow length combinations.

Documents are tokenised, closed by id 0 and cut into full windows and a rest.
The lengths of all pieces are counted in a histogram of ``window`` bins. All
combinations of one to three lengths that fill a window exactly are columns of a
least-squares problem against that histogram; its non-negative solution, rounded
within what the histogram holds, says how often each combination is used. What
is left is packed greedily, longest piece first. The plan has at most one row per
combination, whatever the corpus; pieces find their sequence by their length and
their number among the pieces of that length. Full windows are sequences of their own:
they are counted where they are cut, and nothing is sorted for them.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnset.llm.scratch import Scratch
from kilnset.llm.words import as_strings

WINDOW = 1024
#: Pieces of one length that are numbered together, about: a length has as many hash
#: ranges as its number of pieces asks for.
RANGE_PIECES = 1 << 16
_ENCODERS: dict = {}


def byte_bpe(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Encoder of a public byte-level BPE. The rank file holds the vocabulary of
    ``<name>.json``; both libraries give the same ids (see the tests), this one
    four times as fast. Special tokens in a text are ordinary text, so this is
    for text between them (see ``encoder``)."""
    if name not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[name] = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _ENCODERS[name]


@cache
def added_tokens(name: str) -> dict[str, int]:
    """Ids of the tokens that ``<name>.json`` adds to its vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path(f"{name}.json")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as lines:
        tokens = json.load(lines).get("added_tokens") or []
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: added tokens that are not matched as they stand")
    return {t["content"]: t["id"] for t in tokens}


def encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Ids of ``<name>.json`` in its default state, without added special tokens
    at the ends: an added token in running text is its id, and the text on either
    side of it is encoded on its own."""
    ordinary, added = byte_bpe(name), added_tokens(name)
    if not added:
        return ordinary
    cut = re.compile("(%s)" % "|".join(map(re.escape, sorted(added, key=len, reverse=True))))

    def encode(text: str) -> list[int]:
        parts = cut.split(text)
        ids = ordinary(parts[0])
        for token, rest in zip(parts[1::2], parts[2::2]):
            ids.append(added[token])
            ids += ordinary(rest)
        return ids

    return encode


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                  tokenizer: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: key, start, length, ids_crc32, doc_tokens
    (and the ids), the task that cut it and, for full windows, their number in that task. A
    null text is empty and has the end id alone; an added token of the tokenizer in a
    text is one id."""
    schema = f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, __task long, __full long"
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "__task", "__full"]
    if with_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, full = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, keys = as_strings(batch.column(1)), batch.column(0)
            owner, rows, ids = [], [], []
            for i in range(len(texts)):
                tokens = np.array([*encode(texts[i].as_py()), end_id], dtype="<u4")
                for start in range(0, len(tokens), window):
                    part = tokens[start:start + window]
                    owner.append(i)
                    rows.append((start, len(part), zlib.crc32(part), len(tokens)))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            cells = np.array(rows, dtype=np.int64).reshape(-1, 4)
            whole = cells[:, 1] == window
            number = full + np.cumsum(whole) - 1
            full += int(whole.sum())
            columns = [keys.take(pa.array(owner, pa.int32())), *[pa.array(cells[:, j]) for j in range(4)],
                       pa.array(np.full(len(cells), task)), pa.array(number, mask=~whole)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    return docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text)).mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All multisets of one to three of the lengths that sum to the window,
    one per row, zero padded, longest first."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    rows = [np.array([[window, 0, 0]])] if have[window] else []
    short = lengths[lengths < window]
    pair = short[(short * 2 >= window) & have[window - short]]
    rows.append(np.stack([pair, window - pair, np.zeros_like(pair)], axis=1))
    for a in short[short * 3 >= window]:
        rest = window - a
        b = short[(short <= a) & (short * 2 >= rest) & (short < rest)]
        b = b[have[rest - b]]
        rows.append(np.stack([np.full_like(b, a), b, rest - b], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x with A x close to the histogram in least squares, where
    A holds how often a combination uses a length (accelerated projected
    gradient; the step comes from a bound on the largest eigenvalue)."""
    if not len(combos):
        return np.zeros(0)
    window = len(histogram) - 1
    target = histogram.astype(float).copy()
    target[0] = 0.0

    def times(x):
        out = np.zeros(window + 1)
        for j in range(3):
            out += np.bincount(combos[:, j], weights=x, minlength=window + 1)
        out[0] = 0.0
        return out

    def back(r):
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.ones(len(combos))
    for _ in range(20):
        v = back(times(v))
        bound = float(np.linalg.norm(v))
        v /= bound
    rate = 1.0 / (1.1 * bound)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0.0, y - rate * back(times(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan_sequences(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) so that every piece is used once."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    combos = combinations(np.flatnonzero(left[1:]) + 1, window)
    x = solve_counts(combos, left)
    plan = []
    for c in np.argsort(-x, kind="stable"):
        parts = combos[c][combos[c] > 0]
        want = int(np.rint(x[c]))
        if want < 1:
            break
        lengths, uses = np.unique(parts, return_counts=True)
        n = min(want, int((left[lengths] // uses).min()))
        if n > 0:
            left[lengths] -= n * uses
            plan.append((tuple(int(p) for p in parts), n))
    # greedy rest: the longest piece, then again and again the longest that fits
    while left[1:].any():
        room, parts, use = window, [], np.zeros_like(left)
        while True:
            fits = np.flatnonzero(left[1:room + 1] - use[1:room + 1] > 0)
            if not len(fits):
                break
            size = int(fits[-1]) + 1
            parts.append(size)
            use[size] += 1
            room -= size
        used = np.flatnonzero(use)
        n = int((left[used] // use[used]).min())
        left -= n * use
        plan.append((tuple(parts), n))
    return plan


def plan_ranges(plan) -> np.ndarray:
    """Rows (length, first number, sequence of that number, offset), sorted."""
    next_number: dict[int, int] = {}
    rows, sequence = [], 0
    for parts, n in plan:
        offset = 0
        for size in parts:
            # a length used twice in a combination takes two ranges of numbers
            begin = next_number.get(size, 0)
            rows.append((size, begin, sequence, offset))
            next_number[size] = begin + n
            offset += size
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         tokenizer: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = False,
         range_pieces: int = RANGE_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Empty and null texts are one piece of one id, rows with the same or a null
    key are packed one by one, an empty table gives no piece; other columns of
    ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.write(cut_documents(docs, key, text, window, tokenizer, end_id, with_ids))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for size, n in pieces.where("__full is null").groupBy("length").count().collect():  # at most ``window`` rows
        histogram[size] = n
    plan = plan_sequences(histogram)
    planned = sum(n for _, n in plan)
    plan = plan_ranges(plan)

    # full windows come after the planned sequences, task by task
    fulls = pieces.where("__full is not null")
    tasks = fulls.groupBy("__task").agg((F.max("__full") + 1).alias("__n"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    tasks = tasks.select("__task", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    names = [c for c in pieces.columns if c not in ("__task", "__full")]
    fulls = fulls.join(tasks, "__task").select(
        *names, (F.lit(planned) + F.col("__first") + F.col("__full")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    ranges = F.array(*[F.lit(int(max(1, -(-n // range_pieces)))) for n in histogram])
    marked = pieces.where("__full is null").withColumn("__range", F.pmod(
        F.xxhash64(key, "start", "ids_crc32"), F.get(ranges, F.col("length").cast("int"))).cast("int"))
    counts = marked.groupBy("length", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("length", "__range").orderBy(key, "start", "ids_crc32", "doc_tokens")
    ranked = marked.withColumn("__rank", F.row_number().over(inside) - 1).join(counts, ["length", "__range"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first"))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length, rank):
        import pandas as pd

        size, number = length.to_numpy(), rank.to_numpy()
        # rows of the plan sort by (length, first number): one search on both
        key_of = plan[:, 0].astype(np.uint64) << np.uint64(48) | plan[:, 1].astype(np.uint64)
        at = np.searchsorted(key_of, size.astype(np.uint64) << np.uint64(48) | number.astype(np.uint64), "right") - 1
        row = plan[at]
        return pd.DataFrame({"sequence_id": row[:, 2] + number - row[:, 1], "offset": row[:, 3]})

    out = ranked.withColumn("__place", place("length", "__rank"))
    return out.select(*names, "__place.sequence_id", "__place.offset").unionByName(fulls)
