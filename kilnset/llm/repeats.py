"""Which hashed items occur in more than one document, without a row per item.

Items (windows, shingles) of some megabytes of text are deduplicated where they
are made: a document that shares an item with an earlier one of the same slice is
decided on the spot, and one entry per item travels. An item that a third of all
documents hold therefore sends one entry for each slice, not for each document.
Entries go to hash ranges as packed arrays, a range is judged with one sort, and
the marks go back to their documents. The number of ranges follows the text, so
a range has a bounded number of entries.

Documents are named by ``rank`` (what "earlier" means) and ``row`` (a hash that
tells apart rows of one rank).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes deduplicated together, and text bytes behind one hash range.
LOCAL_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
LEAST_RANGES = 64
NO_ID = (1 << 63) - 1
ENTRY_SCHEMA = "bucket long, blob binary"
MARK_SCHEMA = "rank long, row long, marks binary"


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """rank, row, text: a null id ranks last, a null text is empty."""
    words = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("rank"),
                       F.xxhash64(docs[key].cast("long"), words).alias("row"), words.alias("text"))


def range_count(docs: DataFrame, text: str, range_bytes: int = RANGE_BYTES) -> int:
    size = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    return max(LEAST_RANGES, -(-int(size) // range_bytes))


def split_binary(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column as one array, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    width = np.dtype(dtype).itemsize
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype=dtype), np.zeros(len(column), dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=dtype), np.diff(offsets) // width


def join_binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The inverse of ``split_binary``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _pack(kind: int, rank, row, counts, pos, keys) -> bytes:
    head = np.array([kind, len(rank), len(pos), len(keys)], dtype=np.int64)
    return b"".join(x.tobytes() for x in (
        head, rank, row, counts.astype(np.int32), pos.astype(np.int32), keys))


def _unpack(blob: bytes):
    kind, docs, n, m = (int(x) for x in np.frombuffer(blob, np.int64, 4))
    at = 32
    rank = np.frombuffer(blob, np.int64, docs, at)
    row = np.frombuffer(blob, np.int64, docs, at + 8 * docs)
    counts = np.frombuffer(blob, np.int32, docs, at + 16 * docs)
    at += 20 * docs
    pos = np.frombuffer(blob, np.int32, n, at)
    keys = np.frombuffer(blob, np.uint64, m, at + 4 * n)
    return kind, rank, row, counts, pos, keys


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
    return doc[begin], np.diff(np.append(begin, len(doc)))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in their order (equal ones as they come), and which key is new there."""
    n = len(keys)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    packed = keys & ~low
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    fresh = np.ones(n, dtype=bool)
    k = keys[order]
    fresh[1:] = k[1:] != k[:-1]
    packed &= ~low
    if (fresh[1:] & (packed[1:] == packed[:-1])).any():  # keys that differ in the low bits only
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        fresh[1:] = k[1:] != k[:-1]
    return order, fresh


def _by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by hash range, and the ranges in that order."""
    target = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    target = target.astype(np.uint16 if ranges <= 1 << 16 else np.int64)  # two bytes are sorted digit by digit
    by = np.argsort(target, kind="stable")
    return by, target[by]


def emit(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, rank: np.ndarray, row: np.ndarray,
         ranges: int) -> pa.RecordBatch:
    """Entries of one slice. ``doc`` indexes ``rank`` and ``row``, which must
    rise by rank; items are listed document by document."""
    order, fresh = _grouped(keys)
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(keys)))
    sent, here, later = (np.zeros(len(keys), dtype=bool) for _ in range(3))
    sent[order[begin]] = True
    if len(begin) < len(keys):  # the rest is about items that occur more than once
        many = size > 1
        at, size = order[np.repeat(many, size)], size[many]
        begin = np.cumsum(size) - size
        d = doc[at]
        r = rank[d]
        least, most = (np.repeat(x, size) for x in (r[begin], np.maximum.reduceat(r, begin)))
        once = np.ones(len(at), dtype=bool)
        once[1:] = d[1:] != d[:-1]
        once[begin] = True
        sent[at[once & (r == least)]] = True
        here[at[once & (most > least)]] = True
        later[at] = r > least
    buckets, blobs = [], []
    # decided here: the lowest bit tells the later ones from the first
    at = np.flatnonzero(here)
    if len(at):
        names, counts = _runs(doc[at])
        blobs.append(_pack(1, rank[names], row[names], counts, pos[at] * 2 + later[at], keys[:0]))
        buckets.append(int((int(rank[names[0]]) * 0x9E3779B1 + int(len(at))) % ranges))
    at = np.flatnonzero(sent)
    if len(at):
        by, target = _by_range(keys[at], ranges)
        at = at[by]
        found, counts = _runs(target)
        for bucket, part in zip(found.tolist(), np.split(at, np.cumsum(counts)[:-1])):
            names, each = _runs(doc[part])
            blobs.append(_pack(0, rank[names], row[names], each, pos[part], keys[part]))
            buckets.append(bucket)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def decided(doc: np.ndarray, pos: np.ndarray, rank: np.ndarray, row: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Marks (as of later items) that need no exchange, listed by document."""
    names, counts = _runs(doc)
    blob = _pack(1, rank[names], row[names], counts, pos * 2 + 1, np.zeros(0, np.uint64))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(pos.sum()) % ranges], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def emit_sets(keys: np.ndarray, doc: np.ndarray, sizes: np.ndarray, prints: np.ndarray, rank: np.ndarray,
              row: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Entries of one slice that bring the items themselves back, and the size
    and fingerprint of every document's set. Of equal sets only the first sends
    items; documents without an id send none."""
    carrier = np.zeros(len(rank), dtype=bool)
    carrier[np.unique(prints, return_index=True)[1]] = True
    sends = carrier & (rank != NO_ID)
    sent = sends[doc]
    keys, doc = keys[sent], doc[sent]
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], doc[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    least = rank[d[fresh]][group] if len(k) else rank[:0]
    most = np.maximum.reduceat(rank[d], np.flatnonzero(fresh))[group] if len(k) else rank[:0]
    none = np.zeros(0, dtype=np.int32)
    at = int(sizes.sum()) % ranges
    buckets, blobs = [at], [_pack(2, rank, row, sizes.astype(np.int32), none, prints)]
    some = np.sort(order[most > least])
    if len(some):
        names, counts = _runs(doc[some])
        blobs.append(_pack(1, rank[names], row[names], counts, none, keys[some]))
        buckets.append(at)
    some = np.sort(order[(rank[d] == least)])
    if len(some):
        by, target = _by_range(keys[some], ranges)
        some = some[by]
        found, counts = _runs(target)
        for bucket, part in zip(found.tolist(), np.split(some, np.cumsum(counts)[:-1])):
            names, each = _runs(doc[part])
            blobs.append(_pack(0, rank[names], row[names], each, none, keys[part]))
            buckets.append(bucket)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def judge_sets(table: pa.Table) -> pa.Table:
    """rank, row, n, copies, cls, keys of one hash range: the items that another
    rank holds too, and the set sizes that came along."""
    held, done, sizes = [], [], []
    for blob in table["blob"]:
        kind, rank, row, each, _, key = _unpack(blob.as_py())
        if kind == 2:
            sizes.append((rank, row, each, key))
        else:
            (done if kind else held).append((np.repeat(rank, each), np.repeat(row, each), key))
    if held:
        rank, row, key = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        k, r = key[order], rank[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(begin, len(k)))
        at = order[np.repeat(np.maximum.reduceat(r, begin) > np.minimum.reduceat(r, begin), size)]
        done.append((rank[at], row[at], key[at]))
    out = []
    if done:
        rank, row, key = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((row, rank))
        rank, row, key = rank[order], row[order], key[order]
        change = np.ones(len(rank), dtype=bool)
        change[1:] = (rank[1:] != rank[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(change)
        none = np.zeros(len(begin), np.int64)
        out.append((rank[begin], row[begin], none, none, pa.nulls(len(begin), pa.int64()),
                    join_binary(key, np.diff(np.append(begin, len(rank))))))
    for rank, row, n, cls in sizes:
        classed = pa.array(cls.view(np.int64), mask=(n == 0) | (rank == NO_ID))
        out.append((rank, row, n.astype(np.int64), np.ones(len(n), np.int64), classed,
                    pa.array([b""] * len(n), pa.large_binary())))
    names = ["rank", "row", "n", "copies", "cls", "keys"]
    parts = [pa.table([pa.array(x) for x in o[:5]] + [o[5].cast(pa.binary())], names) for o in out]
    if not parts:
        return pa.table([pa.array([], pa.int64())] * 5 + [pa.array([], pa.binary())], names)
    return pa.concat_tables(parts)


SET_SCHEMA = "rank long, row long, n long, copies long, cls long, keys binary"


def exchange_sets(entries: DataFrame, scratch) -> DataFrame:
    """rank, row, n, copies, cls, keys: one row per document; keys may repeat,
    cls (null without a set) is the same for equal sets. What
    the hash ranges say is written, so that their shuffle is gone before the next."""
    found = scratch.write(entries.groupBy("bucket").applyInArrow(judge_sets, SET_SCHEMA))
    return found.groupBy("rank", "row").agg(
        F.max("n").alias("n"), F.sum("copies").alias("copies"), F.max("cls").alias("cls"), F.listagg("keys").alias("keys"))


def judge(table: pa.Table) -> pa.Table:
    """Marks of one hash range: ``2 * position + later`` for every entry whose
    item another rank holds too."""
    held, done = [], []
    for blob in table["blob"]:
        kind, rank, row, each, pos, key = _unpack(blob.as_buffer())
        if kind:
            done.append((rank, row, each, pos))
        else:
            held.append((rank, row, each, pos, key))
    if held:
        rank, row, each, pos, key = (np.concatenate(x) for x in zip(*held))
        doc = np.repeat(np.arange(len(each), dtype=np.int32), each)
        order = np.argsort(key)
        k = key[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(begin, len(k)))
        many = size > 1
        at, size = order[np.repeat(many, size)], size[many]
        if len(at):
            r = rank[doc[at]]
            begin = np.cumsum(size) - size
            least, most = (np.repeat(f.reduceat(r, begin), size) for f in (np.minimum, np.maximum))
            marked, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
            marked[at[most > least]] = True
            later[at] = r > least
            at = np.flatnonzero(marked)  # still document by document
            counts = np.bincount(doc[at], minlength=len(each))
            some = np.flatnonzero(counts)
            done.append((rank[some], row[some], counts[some], pos[at] * 2 + later[at]))
    if not done:
        done = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    rank, row, counts, marks = (np.concatenate(x) for x in zip(*done))
    return pa.table({"rank": pa.array(rank), "row": pa.array(row),
                     "marks": join_binary(marks.astype(np.int32), counts).cast(pa.binary())})


def exchange(entries: DataFrame) -> DataFrame:
    """rank, row, marks from packed entries: several rows for one document, and
    a mark may come twice."""
    return entries.groupBy("bucket").applyInArrow(judge, MARK_SCHEMA)
