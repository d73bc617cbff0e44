"""Substring dedup: level-wise doubling of repeated word windows.

The first level has windows of half the length (7 words for 13). Those that start in
more than one document survive. At each further level two surviving windows that
together reach the next length - 13 words, with one word shared, then 26, 52, .. -
make a candidate, named by the hashes of its halves, and those that repeat survive
again, until no candidate is left. A window of 13 words that repeats has halves that
do, so only survivors of the first level are looked at. Text is read three times, for
the first level, to pair its survivors and to cut; later levels carry positions and
hashes of candidates only.

A word goes when a surviving candidate of 13 words covers it whose words also start in
a document with a smaller id; windows are judged on the input. How far a repeat
reaches is told by ``longest_repeat``, the largest length from 13 on at which a
window of the document is also in another one (0: none).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.repeats import (
    ENTRY_SCHEMA, NO_ID, emit, exchange, join_binary, named, range_count, split_binary)
from kilnset.llm.scratch import Scratch
from kilnset.llm.words import Words, as_strings, mix, slices, window_hashes

WINDOW = 13
#: Text bytes whose windows a task holds at once, and bytes that it gets in one batch.
SLICE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word (of all words) of each window."""
    found = window_hashes(words.hashes(), width)
    inside = np.flatnonzero(words.doc[:len(found)] == words.doc[width - 1:]) if len(found) else np.zeros(0, int)
    return found[inside], words.doc[inside], inside


def _first_level(width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            rank, row, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_strings(batch.column(2))
            for a, b in slices(column, SLICE_BYTES):
                words = Words(column.slice(a, b - a))
                keys, doc, at = _windows(words, width)
                yield emit(keys, doc, at - words.first[doc], rank[a:b], row[a:b], ranges)

    return run


def _next_level(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            rank, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pos, counts = split_binary(batch.column(2), np.int32)
            keys, _ = split_binary(batch.column(3), np.uint64)
            doc = np.repeat(np.arange(len(rank)), counts)
            yield emit(keys, doc, pos.astype(np.int64), rank, row, ranges)

    return run


def _spread(keys: np.ndarray, doc: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mask of all items that equal a marked item of their document."""
    if not mask.any():
        return mask
    some = np.zeros(int(doc.max()) + 1, dtype=bool)
    some[doc[mask]] = True
    near = np.flatnonzero(some[doc])
    own = mix(keys[near] + doc[near].astype(np.uint64) * _ODD)
    twice = np.sort(own)
    twice = twice[1:][twice[1:] == twice[:-1]]
    if len(twice):
        among = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
        near, own = near[among], own[among]
        mask[near] = np.isin(own, own[mask[near]])
    return mask


def _paired(keys, doc, cell, total: int, repeated, step: int, width: int):
    """Candidates of ``width`` words: pairs of surviving windows ``step`` apart, as
    the index of the left one and the hash of both. ``cell`` is the place of
    a window's first word among the ``total`` words of all documents."""
    at = np.flatnonzero(repeated)
    place = np.full(total + step, -1, dtype=np.int64)
    place[cell[at]] = at
    right = place[cell[at] + step]
    fits = (right >= 0) & (doc[right] == doc[at])
    left, right = at[fits], right[fits]
    return left, mix(keys[left] * _ODD + keys[right] + np.uint64(width))


def _candidates(half: int, width: int):
    """Windows of ``width`` words whose halves both repeat, from texts and marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(2))
            for a, b in slices(texts, SLICE_BYTES):
                words = Words(texts.slice(a, b - a))
                keys, doc, cell = _windows(words, half)
                marks, each = split_binary(batch.column(3).slice(a, b - a), np.int32)
                marked = np.zeros(len(words.start), dtype=bool)
                marked[np.repeat(words.first[:-1], each) + (marks >> 1)] = True
                left, k2 = _paired(keys, doc, cell, len(marked), _spread(keys, doc, marked[cell]), width - half, width)
                d2 = doc[left]
                p2 = cell[left] - words.first[d2]
                counts = np.bincount(d2, minlength=b - a)
                some = pa.array(np.flatnonzero(counts))
                out = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                       join_binary(p2.astype(np.int32), counts).cast(pa.binary()), join_binary(k2, counts).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([x.take(some) for x in out], ["rank", "row", "pos", "keys"])

    return run


def _cut(with_text: bool):
    """Texts without the words that the ``cover`` of their document names."""
    names = ["rank", "row", "n_words", "n_removed", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(2))
            for a, b in slices(texts, SLICE_BYTES):
                words = Words(texts.slice(a, b - a))
                spans, each = split_binary(batch.column(3).slice(a, b - a), np.int32)
                spans = (spans + np.repeat(words.first[:-1], each)).reshape(-1, 2)
                cover = np.zeros(len(words.start) + 1, dtype=np.int8)
                cover[spans[:, 0]] += 1  # spans are apart, so each place comes once
                cover[spans[:, 1]] -= 1
                gone = np.cumsum(cover[:-1], dtype=np.int8) > 0
                removed = np.bincount(words.doc[gone], minlength=b - a)
                data, offsets = _joined(words, np.flatnonzero(~gone))
                raw = memoryview(data)
                places = offsets.tolist()
                out = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words.n.astype(np.int64)),
                       pa.array(removed.astype(np.int64)),
                       pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(places, places[1:])], pa.string())]
                if with_text:
                    out.append(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names[:len(out)])

    return run


def _joined(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space, as bytes and offsets."""
    edge = np.zeros(len(words.data) + 1, dtype=np.int8)
    edge[words.start[kept]] += 1
    edge[words.end[kept]] -= 1
    stays = np.cumsum(edge[:-1], dtype=np.int8) > 0
    doc = words.doc[kept]
    gap = words.end[kept[:-1][doc[1:] == doc[:-1]]]  # a word follows in the text, so this byte is between words
    stays[gap] = True
    data = words.data.copy()
    data[gap] = 0x20
    total = np.concatenate([[0], np.cumsum(stays, dtype=np.int64)])
    return data[stays], total[words.offsets]


def _covered(doc: np.ndarray, pos: np.ndarray, width: int, n: int) -> pa.Array:
    """Words that windows cover, as first word and end of spans that lie apart."""
    fresh, last = np.ones(len(doc), dtype=bool), np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + width)
    last[:-1] = fresh[1:]
    spans = np.column_stack([pos[fresh], pos[last] + width]).astype(np.int32)
    return join_binary(spans.ravel(), 2 * np.bincount(doc[fresh], minlength=n)).cast(pa.binary())


def _double(width: int, cover: bool):
    """Which candidates repeat, and those of twice the length; with ``cover`` also
    what candidates that start in an earlier document cover."""
    names = ["rank", "row", "pos", "keys", "repeats", "cover"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            pos, counts = split_binary(batch.column(2), np.int32)
            keys, _ = split_binary(batch.column(3), np.uint64)
            marks, each = split_binary(batch.column(4), np.int32)
            doc = np.repeat(np.arange(n), counts)
            # positions rise, so the last one tells how many cells a document needs
            room = np.zeros(n, dtype=np.int64)
            room[counts > 0] = pos[np.cumsum(counts)[counts > 0] - 1] + 1
            first, total = np.cumsum(room) - room, int(room.sum())
            cell, wanted = np.repeat(first, counts) + pos, np.repeat(first, each) + (marks >> 1)
            marked = np.zeros(total, dtype=bool)
            marked[wanted] = True
            repeated = _spread(keys, doc, marked[cell])
            left, k2 = _paired(keys, doc, cell, total, repeated, width, 2 * width)
            made = np.bincount(doc[left], minlength=n)
            out = [batch.column(0), batch.column(1), join_binary(pos[left], made).cast(pa.binary()),
                   join_binary(k2, made).cast(pa.binary()), pa.array(np.bincount(doc[repeated], minlength=n) > 0)]
            if cover:
                marked[:] = False
                marked[wanted[(marks & 1).astype(bool)]] = True
                again = _spread(keys, doc, marked[cell])
                out.append(_covered(doc[again], pos[again], width, n))
            yield pa.RecordBatch.from_arrays(out, names[:len(out)])

    return run


def _gathered(marks: DataFrame) -> DataFrame:
    """One marks column per document (as long as its text at most)."""
    return marks.groupBy("rank", "row").agg(F.listagg("marks").alias("marks"))


def _kept(source: DataFrame, cover: DataFrame, scratch: Scratch, with_text: bool) -> DataFrame:
    """All documents without the covered words."""
    cover = cover.dropDuplicates(["rank", "row"])  # equal rows have equal candidates
    rows = source.join(cover, ["rank", "row"], "left").select(
        "rank", "row", "text", F.coalesce("cover", F.lit(b"")).alias("cover"))
    schema = "rank long, row long, n_words long, n_removed long, kept_sha256 string"
    return scratch.write(rows.mapInArrow(_cut(with_text), schema + ", kept_text string" * with_text))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    with_text: bool = False) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256,
    longest_repeat (and the kept words as ``kept_text``).

    Null texts have no words. Documents with a null id come after all others and
    are no source for each other; rows that share an id don't remove each other's
    words. Texts shorter than a window stay whole. An empty table gives an empty
    one; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup", BATCH_BYTES)
    ranges = range_count(docs, text)
    source = named(docs, key, text)
    half = (window + 1) // 2
    marks = scratch.write(exchange(source.mapInArrow(_first_level(half, ranges), ENTRY_SCHEMA)))
    both = source.join(_gathered(marks), ["rank", "row"]).select("rank", "row", "text", "marks")
    state = scratch.write(both.mapInArrow(_candidates(half, window), "rank long, row long, pos binary, keys binary"))
    scratch.drop(marks)
    lengths, width, out, made = [], window, None, state
    while not state.isEmpty():
        marks = scratch.write(exchange(state.mapInArrow(_next_level(ranges), ENTRY_SCHEMA)))
        both = state.join(_gathered(marks), ["rank", "row"]).select("rank", "row", "pos", "keys", "marks")
        schema = "rank long, row long, pos binary, keys binary, repeats boolean"
        after = scratch.write(both.mapInArrow(_double(width, out is None), schema + ", cover binary" * (out is None)))
        if out is None:
            out = _kept(source, after.where(F.length("cover") > 0).select("rank", "row", "cover"), scratch, with_text)
        lengths.append(scratch.write(after.where("repeats").select("rank", "row", F.lit(width).cast("long").alias("reach"))))
        scratch.drop(marks, made)
        made = after
        state = after.where(F.length("pos") > 0).select("rank", "row", "pos", "keys")
        width *= 2
    if out is None:
        out = _kept(source, state.select("rank", "row", F.lit(b"").alias("cover")), scratch, with_text)
        lengths = [state.select("rank", "row", F.lit(window).cast("long").alias("reach"))]
    every = lengths[0]
    for more in lengths[1:]:
        every = every.unionByName(more)
    longest = every.groupBy("rank", "row").agg(F.max("reach").alias("longest_repeat"))
    out = out.join(longest, ["rank", "row"], "left")
    names = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    return out.select(F.when(F.col("rank") != NO_ID, F.col("rank")).alias(key), *names,
                      F.coalesce("longest_repeat", F.lit(0)).cast("long").alias("longest_repeat"))
