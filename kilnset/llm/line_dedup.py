"""Line dedup: exact set-similarity join of lines.

A line is the set of its distinct words. It goes when an earlier line (smaller
document id, or further up in the same document) has Jaccard similarity of
``percent`` or more; lines are judged on the input. Lines without a word stay.

Equal sets are settled first, with one packed exchange of set hashes, so that
only the first line of each set goes on. Its words are ordered by rarity in the
whole corpus (a fixed-size count sketch, equal counts by hash), and the prefix of
``n - ceil(t n) + 1`` rarest words is sent to hash ranges, with the set size, the
position of the word and a 128-bit parity bitmap of the set. These prefixes are
written once, line by line, for both rounds below. Inside a word's list
pairs pass the length filter, the positional filter and the bitmap bound (each
odd bit of two xored bitmaps needs a word that only one line has). What passes is
verified on the words themselves. A line needs one earlier match only: the
candidates with the nearest bitmaps are verified first, and lines that have more
and no match yet go round again with all of them (other lines only join in where
they share a prefix word of such a line). Long lists are split into
blocks that meet pairwise in tasks of their own. Texts are shuffled for the words
of lines that are compared, where documents without one are left out before that,
and for the cut; prefixes are made where the texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnset.llm.groups import block_pairs, by_key, runs
from kilnset.llm.jaccard_join import enough, least_overlap
from kilnset.llm.repeats import (
    ENTRY_SCHEMA, MARK_SCHEMA, NO_ID, decided, emit, join_binary, judge, named, range_count, split_binary)
from kilnset.llm.scratch import Scratch
from kilnset.llm.words import Words, as_strings, mix, slices, text_bytes

PERCENT = 80
#: Slots of the word counts (their size is the bound on what the driver holds).
SLOTS = 1 << 20
#: Text bytes whose lines a task holds at once.
SLICE_BYTES = 2 << 20
#: Rows that a table of fixed size travels in.
PIECES = 64
#: Candidates of a line that are verified first.
FIRST_CANDIDATES = 8
#: Size of the filter that the second round looks words up in.
FILTER_BITS = 1 << 23
#: Share of that filter up to which lines without a wanted word are left out before a join (beyond it few lines have none).
FEW_WANTED = 1 / 8
#: Documents whose marks or line numbers a task gathers before it sorts.
GATHERED = 10_000
#: Members of a word's list that are compared in one task.
LIST_BLOCK = 4096
LOW_HALF = np.uint64((1 << 32) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
ENTRY = np.dtype([("key", "<u8"), ("rank", "<i8"), ("row", "<i8"), ("s0", "<u8"), ("s1", "<u8"),
                  ("line", "<i4"), ("n", "<i4"), ("at", "<i4"), ("asks", "<i4")])
#: Lines of a document by number: set sizes, both halves of their bitmaps, the words of their prefixes.
PREFIX_SCHEMA = "rank long, row long, numbers binary, sizes binary, parity binary, words binary"
PAIR_SCHEMA = "rank long, row long, line int, y_rank long, y_row long, y_line int, more boolean"


class Lines:
    """Lines of some documents as word sets. ``doc`` and ``number`` place each
    line with a word; ``word``/``line`` list its distinct words, line by line, by
    rising ``rarity`` class (a table over the low bits of the hash) and hash.
    ``gone`` and ``only`` are places (document << 32 | number) of lines that are
    left out and of the only ones that are kept."""

    def __init__(self, words: Words, rarity: np.ndarray | None = None, gone: np.ndarray | None = None,
                 only: np.ndarray | None = None):
        self.words = words
        cut = np.flatnonzero(words.data == 10)
        before = np.searchsorted(cut, words.offsets[:-1])
        number = np.searchsorted(cut, words.start) - before[words.doc]
        place = words.doc.astype(np.int64) << 32 | number
        fresh = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
        line = np.cumsum(fresh) - 1
        self.doc, self.number = words.doc[fresh], number[fresh].astype(np.int64)
        hashes = self.hashes = words.hashes()
        if only is not None or gone is not None:
            hit = np.full(len(self.doc), only is None)
            if only is not None:
                hit[_at(self, only)] = True
            if gone is not None:
                hit[_at(self, gone)] = False
            self.doc, self.number = self.doc[hit], self.number[hit]
            inside = hit[line]
            hashes, line = hashes[inside], (np.cumsum(hit) - 1)[line[inside]]
        # one sort on line, class and the high half of the hash
        value = line.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(32)
        if rarity is not None:
            value |= rarity[(hashes & np.uint64(len(rarity) - 1)).astype(np.int64)] << np.uint64(32)
        order = np.argsort(value)
        v, h = value[order], hashes[order]
        same = v[1:] == v[:-1]
        if len(self.doc) >= 1 << 24 or (same & (h[1:] != h[:-1])).any():
            high = value & np.uint64((1 << 40) - 1)
            order = np.lexsort((hashes, high, line))
            h = hashes[order]
            same = line[order][1:] == line[order][:-1]
        once = np.ones(len(h), dtype=bool)
        once[1:] = ~same | (h[1:] != h[:-1])
        self.word, self.line = h[once], line[order[once]]
        self.n = np.bincount(self.line, minlength=len(self.doc))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each line's whole set, and whether its document has the
        set further up."""
        begin = np.cumsum(self.n) - self.n
        total = np.add.reduceat(mix(self.word + np.uint64(7)), begin) if len(begin) else np.zeros(0, np.uint64)
        key = mix(total + self.n.astype(np.uint64) * _ODD)
        first = np.argsort(mix(key + self.doc.astype(np.uint64) * _ODD), kind="stable")
        k, d = key[first], self.doc[first]
        same = np.zeros(len(k), dtype=bool)
        same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        again = np.zeros(len(k), dtype=bool)
        again[first] = same
        return key, again


def _ranked(batch: pa.RecordBatch) -> pa.RecordBatch:
    rank = batch.column(0).to_numpy()
    if (rank[1:] >= rank[:-1]).all():
        return batch
    return batch.take(pa.array(np.argsort(rank, kind="stable")))


def _parts(batches: Iterator[pa.RecordBatch], rarity: np.ndarray | None = None, chosen: bool = False):
    """Rows and lines of each slice of each batch, by rising rank; with ``chosen``
    only lines that the numbers in the fourth column name."""
    for batch in batches:
        batch = _ranked(batch)
        column = as_strings(batch.column(2))
        for a, b in slices(column, SLICE_BYTES):
            rows = batch.slice(a, b - a)
            yield rows, Lines(Words(column.slice(a, b - a)), rarity, only=_places(rows.column(3)) if chosen else None)


def _same_sets(ranges: int, slots: int):
    """Entries of the set hashes; at the end of a task, how many of its words fall
    into each slot, as rows of buckets below zero."""
    def run(batches):
        total = np.zeros(slots, dtype=np.int64)
        held, size = [], 0
        for rows, lines in _parts(batches):
            held.append((lines.hashes & np.uint64(slots - 1)).astype(np.int32))
            size += len(held[-1])
            if size >= slots:
                total += np.bincount(np.concatenate(held), minlength=slots)
                held, size = [], 0
            key, again = lines.keys()
            at, rank, row = np.flatnonzero(~again), rows.column(0).to_numpy(), rows.column(1).to_numpy()
            yield emit(key[at], lines.doc[at], lines.number[at], rank, row, ranges)
            at = np.flatnonzero(again)
            if len(at):
                yield decided(lines.doc[at], lines.number[at], rank, row, ranges)
        if held:
            total += np.bincount(np.concatenate(held), minlength=slots)
        width = slots // PIECES
        for i in range(PIECES):
            part = total[i * width:(i + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                blob = np.int64(len(at)).tobytes() + part[at].tobytes() + at.astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([-1 - i], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    return run


def _later(table: pa.Table) -> pa.Table:
    """Marks of one hash range, those of later lines only."""
    found = judge(table)
    marks, counts = split_binary(found["marks"], np.int32)
    keep = (marks & 1).astype(bool)
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
    some = np.flatnonzero(counts)
    found = found.take(pa.array(some))
    return found.set_column(2, "marks", join_binary(marks[keep], counts[some]).cast(pa.binary()))


def word_counts(entries: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How many words of the corpus fall into each slot, from the rows below zero."""
    width = slots // PIECES

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.int64)
        for blob in table["blob"]:
            raw = blob.as_py()
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            total[np.frombuffer(raw, np.int32, n, 8 + 8 * n)] += np.frombuffer(raw, np.int64, n, 8)
        return pa.table({"bucket": table["bucket"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(slots, dtype=np.int64)
    parts = entries.where("bucket < 0").groupBy("bucket").applyInArrow(add, "bucket long, n binary")
    for bucket, n in parts.collect():  # ``slots`` numbers
        out[(-1 - bucket) * width:-bucket * width] = np.frombuffer(n, np.int64)
    return out


def _places(column) -> np.ndarray:
    """Places of the lines that a column of line numbers names."""
    numbers, counts = split_binary(column, np.int32)
    return np.repeat(np.arange(len(counts)), counts).astype(np.int64) << 32 | numbers


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """Quarter powers of two, frequent words last."""
    return np.minimum(np.floor(4 * np.log2(counts + 1.0)), 255).astype(np.uint64)


def _or_bits(width: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=bool)
        for at in table["at"]:
            total[np.frombuffer(at.as_py(), np.int32)] = True
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([np.packbits(total).tobytes()], pa.binary())})

    return run


def asked_words(asks: DataFrame, rarity: np.ndarray, percent: int, bits: int = FILTER_BITS) -> np.ndarray:
    """Filter of fixed size that knows the prefix words of the asking lines, whose
    ``words`` it gets (it may take other words for them, which costs time only)."""
    width = bits // PIECES

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            classes = rarity[(words & np.uint64(len(rarity) - 1)).astype(np.int64)]
            order = np.lexsort((words, classes, np.repeat(np.arange(len(n)), n)))  # as in Lines
            size = n - least_overlap(n, percent) + 1
            first = np.cumsum(n) - n
            take = order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            place = np.unique(words[take] & np.uint64(bits - 1)).astype(np.int64)
            for i in np.unique(place // width).tolist():
                part = (place[place // width == i] - i * width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["piece", "at"])

    found = asks.select("words").mapInArrow(run, "piece int, at binary").groupBy("piece").applyInArrow(
        _or_bits(width), "piece int, bits binary")
    out = np.zeros(bits, dtype=bool)
    for piece, packed in found.collect():  # ``bits`` bits
        out[piece * width:(piece + 1) * width] = np.unpackbits(np.frombuffer(packed, np.uint8))
    return out


class Prefixes:
    """Lines of some documents without their texts. ``doc`` and ``number`` place each
    line, ``n`` is the size of its set; ``word`` lists the ``size`` prefix words of
    each, line by line and rarest first, ``parity`` has its two bitmaps."""

    def __init__(self, doc: np.ndarray, number: np.ndarray, n: np.ndarray, parity: np.ndarray, word: np.ndarray, percent: int):
        self.doc, self.number, self.n, self.parity, self.word, self.percent = doc, number, n, parity, word, percent
        self.size = n - least_overlap(n, percent) + 1

    @classmethod
    def of(cls, lines: Lines, percent: int) -> Prefixes:
        first = np.cumsum(lines.n) - lines.n
        bit = mix(lines.word + np.uint64(13))
        one = np.uint64(1) << ((bit >> np.uint64(1)) & np.uint64(63))
        parity = [np.bitwise_xor.reduceat(x, first) if len(first) else x for x in (one, one * (bit & np.uint64(1)))]
        size = lines.n - least_overlap(lines.n, percent) + 1
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return cls(lines.doc, lines.number, lines.n, np.stack([parity[0] ^ parity[1], parity[1]], 1), lines.word[place], percent)

    @classmethod
    def read(cls, rows: pa.RecordBatch, percent: int) -> Prefixes:
        (number, each), (n, _), (parity, _), (word, _) = (
            split_binary(rows.column(i), kind) for i, kind in ((2, np.int32), (3, np.int32), (4, np.uint64), (5, np.uint64)))
        return cls(np.repeat(np.arange(len(each)), each), number, n.astype(np.int64), parity.reshape(-1, 2), word, percent)

    def only(self, lines: np.ndarray) -> Prefixes:
        """The lines that a mask says."""
        return Prefixes(self.doc[lines], self.number[lines], self.n[lines], self.parity[lines],
                        self.word[np.repeat(lines, self.size)], self.percent)

    def table(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """One row for each document that has a line."""
        each = np.bincount(self.doc, minlength=len(rows))
        some = np.flatnonzero(each)
        words = np.bincount(np.repeat(self.doc, self.size), minlength=len(rows))[some]
        each = each[some]
        blobs = [join_binary(x, counts).cast(pa.binary()) for x, counts in (
            (self.number.astype(np.int32), each), (self.n.astype(np.int32), each), (self.parity.ravel(), 2 * each), (self.word, words))]
        names = [rows.column(i).take(pa.array(some)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(names + blobs, ["rank", "row", "numbers", "sizes", "parity", "words"])


def _prefix_lines(rarity: np.ndarray, percent: int):
    """The prefixes of all lines, as rows of their documents."""
    def run(batches):
        for rows, lines in _parts(batches, rarity):
            yield Prefixes.of(lines, percent).table(rows)

    return run


def _read(batches: Iterator[pa.RecordBatch], percent: int):
    """Rows and prefixes of each slice of each batch."""
    for batch in batches:
        for a, b in slices(batch.column(5).cast(pa.large_binary()), SLICE_BYTES):
            rows = batch.slice(a, b - a)
            yield rows, Prefixes.read(rows, percent)


def _leads(percent: int):
    """Only lines that ``marks`` doesn't name: the first of their set."""
    def run(batches):
        for rows, lines in _read(batches, percent):
            keep = np.ones(len(lines.doc), dtype=bool)
            keep[_at(lines, _marked(*split_binary(rows.column(6), np.int32)))] = False
            yield lines.only(keep).table(rows)

    return run


def _holding(percent: int, wanted: np.ndarray):
    """Only lines that have a ``wanted`` word in their prefix."""
    packed = np.packbits(wanted)

    def run(batches):
        known = np.unpackbits(packed).astype(bool)
        for rows, lines in _read(batches, percent):
            hit = known[(lines.word & np.uint64(len(known) - 1)).astype(np.int64)]
            keep = np.zeros(len(lines.doc), dtype=bool)
            keep[np.repeat(np.arange(len(keep)), lines.size)[hit]] = True
            yield lines.only(keep).table(rows)

    return run


def _prefix_entries(percent: int, ranges: int, wanted: np.ndarray | None = None):
    """Packed entries of the prefixes; the range and the low half of a word stand
    for it. ``asks`` (if there) names the only lines that look for a match;
    ``wanted`` words alone are sent then."""
    packed = None if wanted is None else np.packbits(wanted)

    def run(batches):
        known = None if packed is None else np.unpackbits(packed).astype(bool)
        for rows, lines in _read(batches, percent):
            asks = np.ones(len(lines.doc), dtype=np.int32)
            if rows.num_columns > 6:
                asks[:] = 0
                asks[_at(lines, _places(rows.column(6)))] = 1
            sent, key = np.repeat(np.arange(len(lines.doc)), lines.size), lines.word
            spot = np.arange(len(sent)) - np.repeat(np.cumsum(lines.size) - lines.size, lines.size)
            if known is not None:
                some = known[(key & np.uint64(len(known) - 1)).astype(np.int64)]
                sent, spot, key = sent[some], spot[some], key[some]
            target = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            target = target.astype(np.uint16 if ranges <= 1 << 16 else np.int64)  # two bytes are sorted digit by digit
            by = np.argsort(target, kind="stable")
            target, sent = target[by], sent[by]
            rank, row = rows.column(0).to_numpy()[lines.doc], rows.column(1).to_numpy()[lines.doc]
            columns = {"key": key[by] & LOW_HALF, "rank": rank[sent], "row": row[sent], "s0": lines.parity[sent, 0],
                       "s1": lines.parity[sent, 1], "line": lines.number[sent], "n": lines.n[sent], "at": spot[by], "asks": asks[sent]}
            begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(sent) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [pa.array(target[begin].astype(np.int64)), pa.array(_columns(columns, begin), pa.binary())], ["bucket", "blob"])

    return run


def _columns(entries: dict[str, np.ndarray], begin: np.ndarray) -> list[bytes]:
    """Entries of each part, field by field; small numbers take 1, 2 or 4 bytes (the head says which)."""
    fields = []
    for f in ENTRY.names:
        x, kind = entries[f], ENTRY[f]
        if f not in ("s0", "s1") and len(x) and x.min() >= 0:
            kind = next((k for k in map(np.dtype, ("<u1", "<u2", "<u4")) if k.itemsize < kind.itemsize and x.max() <= np.iinfo(k).max), kind)
        fields.append(x.astype(kind, copy=False))
    head = bytes(x.itemsize for x in fields)
    end = np.append(begin[1:], len(entries["key"])) if len(begin) else begin
    return [head + b"".join(x[a:b].tobytes() for x in fields) for a, b in zip(begin.tolist(), end.tolist())]


def _entries(blobs: list) -> dict[str, np.ndarray]:
    """All entries of some blobs, field by field."""
    parts = {f: [np.zeros(0, ENTRY[f])] for f in ENTRY.names}
    for blob in blobs:
        head = bytes(blob[:len(ENTRY.names)])
        n, at = (len(blob) - len(head)) // sum(head), len(head)
        for f, width in zip(ENTRY.names, head):
            kind = ENTRY[f] if width == ENTRY[f].itemsize else np.dtype(f"<u{width}")
            parts[f].append(np.frombuffer(blob, kind, n, at))
            at += n * width
    return {f: np.concatenate(x, dtype=ENTRY[f], casting="unsafe") for f, x in parts.items()}


def _marked(marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of lines of which an earlier document, or their own further up, has an equal one."""
    later = (marks & 1).astype(bool)
    doc = np.repeat(np.arange(len(counts)), counts)[later]
    return doc.astype(np.int64) << 32 | (marks[later] >> 1)


def _at(lines: Lines | Prefixes, wanted: np.ndarray) -> np.ndarray:
    place = lines.doc.astype(np.int64) << 32 | lines.number
    at = np.searchsorted(place, wanted)
    return at[place[np.minimum(at, len(place) - 1)] == wanted] if len(place) else at[:0]


def _passing(e: np.ndarray | dict[str, np.ndarray], percent: int, side: np.ndarray | None = None):
    """Pairs of entries of one word that pass the filters, as (later, earlier)
    entry indices, and how many bits their bitmaps differ in. ``e`` is sorted by (key, n); with ``side``, both sides of a
    pair must differ in it."""
    left, right, differ = [], [], []
    key, rank, row, s0, s1, line, asks = (np.ascontiguousarray(e[f]) for f in ("key", "rank", "row", "s0", "s1", "line", "asks"))
    n, at = e["n"].astype(np.int64), e["at"].astype(np.int64)
    # n rises inside a list, so whoever is too short stays so
    word = np.zeros(len(key), dtype=np.int64)
    word[1:] = np.cumsum(key[1:] != key[:-1])
    longest = np.minimum(100 * n // percent, (1 << 32) - 1)
    end = np.searchsorted(word << 32 | n, word << 32 | longest, "right")
    active, step = np.arange(len(key)), 0
    while len(active):
        step += 1
        active = active[active + step < end[active]]
        other = active + step
        a, b = n[active], n[other]
        need = -(-percent * (a + b) // (100 + percent))
        ok = 1 + np.minimum(a - at[active] - 1, b - at[other] - 1) >= need
        ok &= (asks[active] | asks[other]) > 0
        if side is not None:
            ok &= side[active] != side[other]
        x, y = active[ok], other[ok]
        odd = np.bitwise_count(s0[x] ^ s0[y]).astype(np.int64) + np.bitwise_count(s1[x] ^ s1[y])
        ok2 = odd <= (a + b - 2 * need)[ok]
        left.append(x[ok2])
        right.append(y[ok2])
        differ.append(odd[ok2])
    x = np.concatenate(left) if left else np.zeros(0, int)
    y = np.concatenate(right) if right else np.zeros(0, int)
    swap = (rank[x] < rank[y]) | ((rank[x] == rank[y]) & (line[x] < line[y]))
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    right_order = (rank[x] > rank[y]) | ((row[x] == row[y]) & (line[x] > line[y]))
    ok = right_order & (asks[x] > 0)
    return x[ok], y[ok], (np.concatenate(differ) if differ else x)[ok]


def _pair_table(e: np.ndarray | dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, differ: np.ndarray, first: int | None) -> pa.Table:
    """Distinct pairs, the ``first`` partners of each line with the nearest
    bitmaps."""
    # lines by number, so that a pair and its distance are one number to sort by
    held = np.zeros(len(e["key"]), dtype=bool)
    held[x] = held[y] = True
    held = np.flatnonzero(held)
    parts = [e[f][held] for f in ("line", "row", "rank")]
    order = np.lexsort(parts)
    fresh = np.ones(len(held), dtype=bool)
    fresh[1:] = np.logical_or.reduce([v[order][1:] != v[order][:-1] for v in parts])
    number = np.zeros(len(e["key"]), dtype=np.int64)
    number[held[order]] = np.cumsum(fresh) - 1
    lead = held[order][fresh]
    bits = len(lead).bit_length()
    pairs = np.sort(number[x] << (bits + 8) | differ.astype(np.int64) << bits | number[y])  # they differ in 128 bits at most
    once = np.ones(len(pairs), dtype=bool)
    once[1:] = pairs[1:] != pairs[:-1]
    pairs = pairs[once]
    lines = np.ones(len(pairs), dtype=bool)
    lines[1:] = (pairs[1:] >> (bits + 8)) != (pairs[:-1] >> (bits + 8))
    x, y = lead[pairs >> (bits + 8)], lead[pairs & ((1 << bits) - 1)]
    begin = np.flatnonzero(lines)
    size = np.diff(np.append(begin, len(x)))
    spot = np.arange(len(x)) - np.repeat(begin, size)
    more = np.zeros(len(x), dtype=bool)
    if first is not None:
        more = np.repeat(size > first, size)
        keep = spot < first
        x, y, more = x[keep], y[keep], more[keep]
    return pa.table([pa.array(e[f][i]) for i in (x, y) for f in ("rank", "row", "line")] + [pa.array(more)],
                    ["rank", "row", "line", "y_rank", "y_row", "y_line", "more"])


def _judge_lists(percent: int, first: int | None):
    """Pairs of one hash range; members of lists that are too long for one task
    come back as they are (with the word in ``key``)."""
    def run(table: pa.Table) -> pa.Table:
        e = _entries([memoryview(b.as_buffer()) for b in table["blob"]])
        e["key"] |= np.uint64(table["bucket"][0].as_py()) << np.uint64(32)  # a word of another range is another one
        order = np.argsort(e["key"])
        k = e["key"][order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(k)))
        order, size = order[np.repeat(size > 1, size)], size[size > 1]  # nobody meets a word alone
        word, size = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
        order = order[np.argsort(word << 32 | e["n"][order])]
        some, many = order[size <= LIST_BLOCK], order[size > LIST_BLOCK]
        long = np.zeros(len(many), ENTRY)
        for f in ENTRY.names:
            long[f] = e[f][many]
        some = {f: x[some] for f, x in e.items()}
        pairs = _pair_table(some, *_passing(some, percent), first)
        pairs = pairs.append_column("key", pa.nulls(len(pairs), pa.int64())).append_column(
            "entry", pa.nulls(len(pairs), pa.binary()))
        blank = [pa.nulls(len(long), t) for t in (pa.int64(), pa.int64(), pa.int32()) * 2] + [pa.nulls(len(long), pa.bool_())]
        rows = pa.table(blank + [pa.array(long["key"].view(np.int64) if len(long) else np.zeros(0, np.int64)),
                                 pa.array([x.tobytes() for x in long], pa.binary())], pairs.column_names)
        return pa.concat_tables([pairs, rows])

    return run


def _judge_blocks(percent: int, first: int | None):
    def run(batches):
        for group in runs(batches, 3):
            i, j = int(group["i"][0].as_py()), int(group["j"][0].as_py())
            e = np.frombuffer(b"".join(x.as_py() for x in group["entry"]), dtype=ENTRY)
            block = group["block"].to_numpy()
            order = np.argsort(e["n"], kind="stable")
            e, block = e[order], block[order]
            found = _pair_table(e, *_passing(e, percent, None if i == j else block), first)
            yield from found.combine_chunks().to_batches()

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose rank and row are not those of the row before."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        rank, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.ones(len(batch), dtype=bool)
        fresh[1:] = (rank[1:] != rank[:-1]) | (row[1:] != row[:-1])
        fresh[0] = (rank[0], row[0]) != last
        last = rank[-1], row[-1]
        yield batch if fresh.all() else batch.filter(pa.array(fresh))


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank, row, line, words of the named lines; rows come by rank and row, repeated ones count once."""
    for rows, lines in _parts(_once(batches), chosen=True):
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(lines.n)]).astype(np.int32)), pa.array(lines.word.view(np.int64)))
        doc = pa.array(lines.doc)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(doc), rows.column(1).take(doc), pa.array(lines.number.astype(np.int32)), lists],
            ["rank", "row", "line", "words"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the marked lines (as numbers, the words aren't needed)."""
    for rows in batches:
        column = as_strings(rows.column(2))
        data, offsets = text_bytes(column)
        breaks = np.searchsorted(np.flatnonzero(data == 10), offsets)
        marks, each = split_binary(rows.column(3), np.int32)
        near, some = split_binary(rows.column(4), np.int32)
        # 2 * number + 1 says that an equal line is further up
        keep = (marks & 1).astype(bool)
        ends, near_ends = np.cumsum(each), np.cumsum(some)
        removed, similar = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        raw = memoryview(data)
        kept = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        for i in np.flatnonzero(each + some).tolist():
            part = slice(ends[i] - each[i], ends[i])
            alike = set(near[near_ends[i] - some[i]:near_ends[i]].tolist())
            lost = set((marks[part][keep[part]] >> 1).tolist()) | alike
            removed[i], similar[i] = len(lost), len(alike)
            if lost:
                kept[i] = b"\n".join(x for j, x in enumerate(bytes(kept[i]).split(b"\n")) if j not in lost)
        length = np.fromiter(map(len, kept), np.int64, len(kept))
        out = pa.LargeStringArray.from_buffers(
            len(kept), pa.py_buffer(np.append(0, np.cumsum(length)).tobytes()), pa.py_buffer(b"".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(np.diff(breaks) + 1, pa.int64()), pa.array(removed),
             pa.array(similar), out.cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
            ["rank", "row", "n_lines", "n_removed", "n_similar", "kept_text", "kept_sha256"])


def _numbers(lines: DataFrame, name: str) -> DataFrame:
    """Line numbers of each document as packed 4-byte integers, little endian."""
    text = F.lpad(F.hex("line"), 8, "0")
    swapped = F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)])
    return lines.select("rank", "row", "line").distinct().groupBy("rank", "row").agg(
        F.listagg(F.unhex(swapped)).alias(name))


def _only(source: DataFrame, rows: DataFrame) -> DataFrame:
    """``source`` without most documents that ``rows`` doesn't name: bits of a fixed
    size, by the row's hash, go to every task."""
    place = F.pmod("row", F.lit(FILTER_BITS)) + 1
    bits = rows.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = source.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("part"))
    return known.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*source.columns)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: rank-free key, row (a hash of key and text),
    n_lines, n_removed, n_similar (removed for a set that is alike, not equal),
    kept_text, kept_sha256.

    A null text is empty and has one line without a word. Documents with a null
    key come after all others; lines of rows that share a key don't remove each
    other across rows. An empty table gives an empty one; other columns of
    ``docs`` are not looked at. The texts are cut when the table is read.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    scratch.settings["spark.sql.objectHashAggregate.sortBased.fallbackThreshold"] = str(GATHERED)
    ranges = range_count(docs, text)
    source = named(docs, key, text)
    entries = scratch.write(source.mapInArrow(_same_sets(ranges, SLOTS), ENTRY_SCHEMA))
    found = scratch.write(entries.where("bucket >= 0").groupBy("bucket").applyInArrow(_later, MARK_SCHEMA))
    marks = scratch.write(found.groupBy("rank", "row").agg(F.listagg("marks").alias("marks")))
    rarity = rarity_classes(word_counts(entries, SLOTS))
    scratch.drop(found, entries)
    empty = F.lit(b"")

    def marked(rows: DataFrame) -> DataFrame:
        # small tables are looked up, the texts needn't be sorted
        return rows.join(marks.hint("shuffle_hash"), ["rank", "row"], "left").withColumn("marks", F.coalesce("marks", empty))

    def candidates(rows: DataFrame, first: int | None, wanted: np.ndarray | None = None) -> DataFrame:
        entries = rows.mapInArrow(_prefix_entries(percent, ranges, wanted), ENTRY_SCHEMA)
        judged = scratch.write(entries.groupBy("bucket").applyInArrow(
            _judge_lists(percent, first), PAIR_SCHEMA + ", key long, entry binary"))
        pairs = judged.where("key is null").drop("key", "entry")
        long = judged.where("key is not null").select("key", "entry")
        sizes = long.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).alias("blocks"))
        blocks = long.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
        blocks = by_key(block_pairs(blocks, "blocks", "block").drop("blocks"), "key", "i", "j")
        more = blocks.select("key", "i", "j", "block", "entry").mapInArrow(_judge_blocks(percent, first), PAIR_SCHEMA)
        return pairs.unionByName(more).groupBy("rank", "row", "line", "y_rank", "y_row", "y_line").agg(
            F.max("more").alias("more"))

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lines of the pairs, and whether a partner matches; the words of all these lines."""
        both = pairs.select("rank", "row", "line").union(pairs.select("y_rank", "y_row", "y_line"))
        # sorted, so that rows that repeat are side by side
        sets = scratch.write(_only(source, both).join(_numbers(both, "lines").hint("merge"), ["rank", "row"]).select(
            "rank", "row", "text", "lines").mapInArrow(_line_sets, "rank long, row long, line int, words array<long>"))
        other = sets.select(*[F.col(c).alias(f"y_{c}") for c in sets.columns])
        joined = pairs.join(sets, ["rank", "row", "line"]).join(other, ["y_rank", "y_row", "y_line"])
        inter = F.size(F.array_intersect("words", "y_words"))
        match = enough(inter, F.size("words"), F.size("y_words"), percent)
        out = joined.groupBy("rank", "row", "line").agg(F.max(match).alias("match"), F.max("more").alias("more"))
        return scratch.write(out), sets

    prefixes = scratch.write(marked(source.mapInArrow(_prefix_lines(rarity, percent), PREFIX_SCHEMA)).mapInArrow(
        _leads(percent), PREFIX_SCHEMA))
    some = scratch.write(candidates(prefixes, FIRST_CANDIDATES))
    seen, sets = verified(some)
    lost = seen.where("match")
    asking = seen.where("not match and more")
    if not asking.isEmpty():
        numbers = scratch.write(_numbers(asking, "asks"))
        wanted = asked_words(sets.join(asking, ["rank", "row", "line"], "left_semi"), rarity, percent)
        held = prefixes
        if wanted.mean() <= FEW_WANTED:
            held = prefixes.mapInArrow(_holding(percent, wanted), PREFIX_SCHEMA)
        asks = held.join(numbers, ["rank", "row"], "left").withColumn("asks", F.coalesce("asks", empty))
        rest = scratch.write(candidates(asks.select(*prefixes.columns, "asks"), None, wanted))
        lost = lost.unionByName(verified(rest)[0].where("match"))
    near = scratch.write(_numbers(lost, "near"))
    scratch.drop(prefixes)
    out = marked(source).join(near.hint("shuffle_hash"), ["rank", "row"], "left").withColumn("near", F.coalesce("near", empty))
    out = out.select("rank", "row", "text", "marks", "near").mapInArrow(
        _cut, "rank long, row long, n_lines long, n_removed long, n_similar long, kept_text string, kept_sha256 string")
    return out.select(F.when(F.col("rank") != NO_ID, F.col("rank")).alias(key), "row", "n_lines", "n_removed",
                      "n_similar", "kept_text", "kept_sha256")
