"""Collocations: frequent phrases of two to five words, by direct-address tiles.

Texts are cut into slices of some megabytes of one language, whose words become
streams of numbers (-1 where a piece ends). Words that occur often enough are
ranked by frequency and the streams rewritten in these ranks. Then every level
does the same: neighbouring numbers of a stream are a pair, pairs are counted,
frequent pairs are ranked by frequency, and the streams rewritten in the ranks of
the pairs. Two neighbouring pairs share a word, so their pair is a phrase of
three, and so on: a phrase is frequent only if both phrases one word shorter are.

Counting: ranks are split into tiles of ``TILE``. Pairs of the first ``HEAD``
tiles, where most occurrences are, are cells of a dense tile and counted with
``bincount``, in the slice and again where slices are summed, for ``FAN`` slices
at once and then for their sums, so that the hottest tile is a tree and not a
task. All other pairs travel as sorted coordinates with counts, by hash range;
the number of ranges follows the text. A task adds up its slices first, so a pair is
sent once for each task.

Rewriting and naming: up to ``FEW`` frequent words or pairs (of all languages, counted
first) go to every task. More of them meet what the slices ask for by tile or range, in a join
that adaptive execution can split, and what a slice gets back is bounded by the slice.

Words are 64-bit hashes until frequent ones are named (by one slice each).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnset.llm.repeats import range_count
from kilnset.llm.scratch import Scratch, text_column
from kilnset.llm.words import as_strings, span_hashes, text_bytes
from kilnset.operators.ranking import positions

#: Text bytes of a slice; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes that Python gets at once while streams and entries are worked on.
BATCH_BYTES = 16 << 20
#: Ranks of a tile, and tiles on either side that are dense.
TILE = 1 << 10
HEAD = 4
#: Slices (or sums of slices) that one task adds up for one dense tile.
FAN = 256
#: Words or pairs that a task holds before it adds them up and sends them.
HELD = 1 << 19
#: Pairs that are held while entries are summed.
SUMMED = 2 << 20
#: Frequent words or pairs that are sent to every task (24 bytes each).
FEW = 1 << 20
LONGEST = 5

BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

#: floor(1000 a n / (l r)), exact while 1000 a n has 38 digits.
SCORE = """(cast(a * 1000L as decimal(19, 0)) * cast(n as decimal(19, 0)))
           div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0)))"""

SLICE_SCHEMA = "slice long, lang string, n long, stream binary, keys binary, counts binary, lengths binary, letters binary"
ENTRY_SCHEMA = "lang string, ta long, tb long, slice long, keys binary, counts binary, tellers binary"
COUNT_SCHEMA = "lang string, ta long, tb long, a long, b long, n long, teller long"


def _numbers(cell, dtype) -> np.ndarray:
    raw = cell.as_buffer() if cell.is_valid else None
    return np.frombuffer(raw, dtype=dtype) if raw else np.zeros(0, dtype)


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _narrow(values: np.ndarray) -> bytes:
    """Eight bytes that tell the width of the numbers, then the numbers, none below 0."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(k).max)
    return np.int64(np.dtype(kind).itemsize).tobytes() + values.astype(kind).tobytes()


def _widened(raw, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """``n`` numbers from place ``at``, and the place after them."""
    size = int(np.frombuffer(raw, np.int64, 1, at)[0])
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[size]
    return np.frombuffer(raw, kind, n, at + 8).astype(np.int64), at + 8 + n * size


def _pack_pairs(a: np.ndarray, b: np.ndarray) -> bytes:
    """Sorted pairs: the steps between the left numbers, how many pairs each has, and
    the steps between the right numbers of each."""
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    left = a[begin]
    steps = b.copy()
    steps[1:] -= np.where(a[1:] == a[:-1], b[:-1], 0)
    head = np.array([len(left), len(a)], np.int64).tobytes()
    return head + b"".join(_narrow(x) for x in (np.diff(left, prepend=0), np.diff(np.append(begin, len(a))), steps))


def _unpack_pairs(cell) -> tuple[np.ndarray, np.ndarray]:
    raw = cell.as_buffer()
    rows, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    left, at = _widened(raw, rows, 16)
    sizes, at = _widened(raw, rows, at)
    steps, _ = _widened(raw, n, at)
    total = np.cumsum(steps)
    begin = np.cumsum(sizes) - sizes
    before = np.where(begin > 0, total[begin - 1], 0)
    return np.repeat(np.cumsum(left), sizes), total - np.repeat(before, sizes)


def _stream_blob(stream: np.ndarray) -> bytes:
    """Eight bytes that tell the width of the numbers, then four or eight bytes each."""
    kind = np.int32 if not len(stream) or int(stream.max()) < 1 << 31 else np.int64
    return np.int64(np.dtype(kind).itemsize).tobytes() + stream.astype(kind).tobytes()


def _stream(cell) -> np.ndarray:
    raw = cell.as_buffer()
    kind = {4: np.int32, 8: np.int64}[int(np.frombuffer(raw, np.int64, 1)[0])]
    return np.frombuffer(raw, dtype=kind, offset=8)


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return data[np.arange(total) + shift] if total else data[:0]


def _slice(texts: pa.Array) -> tuple | None:
    """n, stream, keys, counts, lengths and letters of the words of some texts."""
    data, offsets = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    size = len(data)
    solid = ~GAP[data]
    fresh = np.zeros(size + 1, dtype=bool)
    fresh[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | fresh[1:size]
    stop[:-1] &= ~solid[1:] | fresh[1:size]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(start):
        return None
    piece = np.cumsum(BREAK[data] | fresh[:size])[start]
    keys, first, index, counts = np.unique(
        span_hashes(data, start, end), return_index=True, return_inverse=True, return_counts=True)
    cut = np.zeros(len(start), dtype=np.int64)
    cut[1:] = piece[1:] != piece[:-1]
    stream = np.full(len(start) + int(cut.sum()), -1, dtype=np.int64)
    stream[np.arange(len(start)) + np.cumsum(cut)] = index
    length = (end - start)[first]
    return (len(start), _stream_blob(stream), _blob(keys), _blob(counts.astype(np.int64)), _blob(length.astype(np.int64)),
            _blob(_gather(data, start[first], length)))


def _slices(slice_bytes: int):
    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def cut(tables):
            nonlocal serial
            table = pa.Table.from_batches(tables).combine_chunks()
            langs = table["lang"].combine_chunks().dictionary_encode()
            if isinstance(langs, pa.ChunkedArray):
                langs = langs.combine_chunks()
            code = langs.indices.to_numpy(zero_copy_only=False)
            texts = as_strings(table["text"])
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                found = _slice(texts.take(pa.array(np.flatnonzero(code == k))))
                if found:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(names, (serial, lang, *found)))], schema)
                serial += 1

        names = ["slice", "lang", "n", "stream", "keys", "counts", "lengths", "letters"]
        kinds = [pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * 5
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            begin = 0
            while begin < len(batch):
                ends = np.cumsum(pa.compute.binary_length(batch.column("text").cast(pa.large_string())).to_numpy(
                    zero_copy_only=False)[begin:])
                take = max(1, int(np.searchsorted(ends, slice_bytes - size, "right")))
                held.append(batch.slice(begin, take))
                size += int(ends[min(take, len(ends)) - 1])
                begin += take
                if size >= slice_bytes or begin < len(batch):
                    yield from cut(held)
                    held, size = [], 0
        if held:
            yield from cut(held)
    return run


def _entry_batch(lang: str, slice_id: int, rows: list) -> pa.RecordBatch:
    ta, tb, keys, counts, tellers = zip(*rows)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(ta, pa.int64()), pa.array(tb, pa.int64()), pa.array([slice_id] * n, pa.int64()),
         pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(tellers, pa.binary())],
        ["lang", "ta", "tb", "slice", "keys", "counts", "tellers"])


def _word_counts(batch, i: int):
    keys = _numbers(batch["keys"][i], np.uint64).view(np.int64)
    return keys, np.zeros(len(keys), np.int64), _numbers(batch["counts"][i], np.int64)


def _pair_counts(batch, i: int):
    """A slice's pairs: cells of dense tiles by bincount, the rest sorted."""
    stream = _stream(batch["stream"][i])
    both = (stream[:-1] >= 0) & (stream[1:] >= 0)
    a, b = stream[:-1][both].astype(np.int64), stream[1:][both].astype(np.int64)
    inner = (a < HEAD * TILE) & (b < HEAD * TILE)
    parts = [_sorted_pairs(a[~inner], b[~inner])]  # and cells by tile, out of order
    x, y = a[inner], b[inner]
    tile = (x // TILE) * HEAD + y // TILE
    order = np.argsort(tile, kind="stable")
    cell = ((x % TILE) * TILE + y % TILE)[order]
    edge = np.searchsorted(tile[order], np.arange(HEAD * HEAD + 1))
    for t in np.flatnonzero(np.diff(edge)).tolist():
        part = cell[edge[t]:edge[t + 1]]
        if len(part) > TILE * TILE // 8:
            dense = np.bincount(part, minlength=TILE * TILE)
            cells = np.flatnonzero(dense)
            counts = dense[cells]
        else:
            cells, counts = np.unique(part, return_counts=True)
        parts.append(((t // HEAD) * TILE + cells // TILE, (t % HEAD) * TILE + cells % TILE, counts.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _split(a, b, n, who, words: bool, ranges: int) -> list:
    """(ta, tb, keys, counts, tellers) by tile or hash range of the pairs."""
    if words:
        ta = np.full(len(a), -1, np.int64)
        tb = (((a.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    else:
        ta, tb = _home(a, b, ranges)
    order = np.lexsort((tb, ta))  # stable: pairs stay in order inside a range
    a, b, n, who, ta, tb = (x[order] for x in (a, b, n, who, ta, tb))
    edge = np.flatnonzero((ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1
    rows = []
    for begin, end in zip([0, *edge.tolist()], [*edge.tolist(), len(a)]):
        x, y, t = a[begin:end], b[begin:end], int(ta[begin])
        if words:
            keys = _blob(x)
        elif t >= 0:
            keys = _blob(((x % TILE) * TILE + y % TILE).astype(np.int32))
        else:
            keys = _pack_pairs(x, y)
        counts = _narrow(n[begin:end])
        tellers = _tellers(who[begin:end]) if words else b""
        rows.append((t, int(tb[begin]), keys, counts, tellers))
    return rows


def _tellers(who: np.ndarray) -> bytes:
    """Slices by number, then two bytes (four, if there are many) for each word."""
    names, index = np.unique(who, return_inverse=True)
    kind = np.uint16 if len(names) < 1 << 16 else np.uint32
    return np.array([len(names)], np.int64).tobytes() + names.tobytes() + index.astype(kind).tobytes()


def _told_by(cell, n: int) -> np.ndarray:
    raw = cell.as_buffer()
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    names = np.frombuffer(raw, np.int64, size, 8)
    kind = np.uint16 if size < 1 << 16 else np.uint32
    return names[np.frombuffer(raw, kind, n, 8 + 8 * size)]


def _merged(parts: list) -> tuple:
    """Sums of the counts of equal pairs, and the smallest teller."""
    a, b, n, who = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b, n, who = a[order], b[order], n[order], who[order]
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[begin], b[begin], np.add.reduceat(n, begin), np.minimum.reduceat(who, begin)


def _entries(words: bool, ranges: int):
    """Counts of a task's words or pairs by language, added up over its slices as
    far as they fit, by tile or range."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for i in range(len(batch)):
                a, b, n = _word_counts(batch, i) if words else _pair_counts(batch, i)
                if not len(a):
                    continue
                who = np.full(len(a), batch["slice"][i].as_py(), np.int64)
                held.setdefault(batch["lang"][i].as_py(), []).append((a, b, n, who))
                size += len(a)
                if size > HELD:
                    held = {lang: [_merged(parts)] for lang, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:
                        for lang, parts in held.items():
                            yield _entry_batch(lang, 0, _split(*parts[0], words, ranges))
                        held, size = {}, 0
        for lang, parts in held.items():
            yield _entry_batch(lang, 0, _split(*_merged(parts), words, ranges))
    return run


def _asks(words: bool, ranges: int):
    """The words or pairs of each slice by tile or range."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                a, b, n = _word_counts(batch, i) if words else _pair_counts(batch, i)
                if len(a):
                    rows = _split(a, b, n, np.zeros(len(a), np.int64), words, ranges)
                    yield _entry_batch(batch["lang"][i].as_py(), batch["slice"][i].as_py(), rows)
    return run


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _home(a: np.ndarray, b: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile of each pair, or (-1, hash range) beyond the dense ones. Pairs of one left
    number go to one range, those of a frequent one to several."""
    ta, tb = a // TILE, b // TILE
    dense = (ta < HEAD) & (tb < HEAD)
    mixed = _mix(a, np.where(ta < HEAD, tb // HEAD, 0))
    part = (((mixed >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    return np.where(dense, ta, -1), np.where(dense, tb, part)


def _sorted_pairs(a: np.ndarray, b: np.ndarray):
    """Distinct pairs in order with their numbers of occurrences."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    if int(a.max()) < 1 << 31 and int(b.max()) < 1 << 31:
        order = np.argsort((a << 32) | b, kind="stable")
    else:
        order = np.lexsort((b, a))
    a, b = a[order], b[order]
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[begin], b[begin], np.diff(np.append(begin, len(a))).astype(np.int64)


class _Sum:
    """Counts of one tile or range while entries stream by."""

    def __init__(self, dense: bool, words: bool):
        self.dense = np.zeros(TILE * TILE, np.int64) if dense else None
        self.words, self.parts, self.held = words, [], 0

    def add(self, keys, counts, tellers) -> None:
        if self.dense is not None:
            cells = _numbers(keys, np.int32)
            self.dense[cells] += _widened(counts.as_buffer(), len(cells))[0]  # cells of an entry are distinct
            return
        if self.words:
            a = _numbers(keys, np.int64)
            b, who = np.zeros(len(a), np.int64), _told_by(tellers, len(a))
        else:
            a, b = _unpack_pairs(keys)
            who = np.zeros(len(a), np.int64)
        self.parts.append((a, b, _widened(counts.as_buffer(), len(a))[0], who))
        self.held += len(a)
        if self.held > SUMMED and len(self.parts) > 1:
            self.parts = [_merged(self.parts)]
            self.held = len(self.parts[0][0])

    def result(self, ta: int, tb: int):
        if self.dense is not None:
            cells = np.flatnonzero(self.dense)
            return (ta * TILE + cells // TILE, tb * TILE + cells % TILE, self.dense[cells],
                    np.zeros(len(cells), np.int64))
        return _merged(self.parts)


def _summed(words: bool, least: int, again: bool):
    """Sums of entries that come in order of (lang, ta, tb, part): entries again,
    or the pairs with ``least`` occurrences."""
    def run(batches):
        key, state = None, None

        def close():
            lang, ta, tb, part = key
            a, b, n, who = state.result(ta, tb)
            if again:
                cells = ((a % TILE) * TILE + b % TILE).astype(np.int32)
                return _entry_batch(lang, part, [(ta, tb, _blob(cells), _narrow(n), b"")])
            some = n >= least
            a, b, n, who = a[some], b[some], n[some], who[some]
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(np.full(len(a), ta)), pa.array(np.full(len(a), tb)),
                 pa.array(a), pa.array(b), pa.array(n), pa.array(who)], ["lang", "ta", "tb", "a", "b", "n", "teller"])

        for batch in batches:
            names = list(zip(batch["lang"].to_pylist(), batch["ta"].to_pylist(), batch["tb"].to_pylist(),
                             batch["part"].to_pylist()))
            for i, now in enumerate(names):
                if now != key:
                    if key is not None:
                        yield close()
                    key, state = now, _Sum(now[1] >= 0, words)
                state.add(batch["keys"][i], batch["counts"][i], batch["tellers"][i])
        if key is not None:
            yield close()
    return run


def _by_part(entries: DataFrame, part) -> DataFrame:
    keys = ["lang", "ta", "tb", "part"]
    return entries.withColumn("part", part).repartition(*keys).sortWithinPartitions(*keys)


def _counted(entries: DataFrame, scratch: Scratch, words: bool, least: int, fan: int) -> DataFrame:
    """Pairs (words: a is the hash, b zero) that occur ``least`` times. Sums of
    dense tiles go through a tree of ``fan`` entries a task."""
    whole = F.lit(0).cast("long")
    if words:
        return scratch.write(_by_part(entries, whole).mapInArrow(_summed(words, least, False), COUNT_SCHEMA))
    entries = scratch.write(entries.withColumn("slice", F.monotonically_increasing_id()))
    made = [entries]
    sparse, dense = entries.where("ta < 0"), entries.where("ta >= 0")
    most = dense.groupBy("lang", "ta", "tb").count().agg(F.max("count")).first()[0] or 0
    groups = -(-most // fan)
    while groups > 1:
        dense = scratch.write(_by_part(dense, F.pmod(F.xxhash64("slice"), F.lit(groups)).cast("long")).mapInArrow(
            _summed(words, least, True), ENTRY_SCHEMA))
        made.append(dense)
        groups = -(-groups // fan)
    out = scratch.write(_by_part(sparse.unionByName(dense), whole).mapInArrow(_summed(words, least, False), COUNT_SCHEMA))
    scratch.drop(*made)
    return out


def _packed(table: pa.Table) -> pa.Table:
    """The words or pairs of one tile or range with their ranks, in one row."""
    cells = np.column_stack([table[c].to_numpy() for c in ("a", "b", "id")])
    return pa.table({"lang": table["lang"][:1], "ta": table["ta"][:1], "tb": table["tb"][:1],
                     "known": pa.array([_blob(cells)], pa.binary())})


def _matches(asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``asked`` (a, b) that ``known`` (a, b, id) has, and their ids."""
    if not len(asked) or not len(known):
        return asked[:0], np.zeros(0, np.int64)
    pairs = np.concatenate([known[:, :2], asked])
    order = np.lexsort((np.arange(len(pairs)), pairs[:, 1], pairs[:, 0]))
    ranked = pairs[order]
    change = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
    group = np.cumsum(change) - 1
    name = np.full(int(group[-1]) + 1, -1, np.int64)
    of = np.empty(len(pairs), np.int64)
    of[order] = group
    name[of[:len(known)]] = known[:, 2]
    ids = name[of[len(known):]]
    return asked[ids >= 0], ids[ids >= 0]


def _answers(words: bool):
    """What each entry's slice asked for and is frequent: (a, b, id) triples."""
    def run(batches):
        for batch in batches:
            slices, blobs = [], []
            for i in range(len(batch)):
                ta, tb = batch["ta"][i].as_py(), batch["tb"][i].as_py()
                if words:
                    a = _numbers(batch["keys"][i], np.int64)
                    asked = np.column_stack([a, np.zeros(len(a), np.int64)])
                elif ta >= 0:
                    cells = _numbers(batch["keys"][i], np.int32).astype(np.int64)
                    asked = np.column_stack([ta * TILE + cells // TILE, tb * TILE + cells % TILE])
                else:
                    asked = np.column_stack(_unpack_pairs(batch["keys"][i]))
                pairs, ids = _matches(asked, _numbers(batch["known"][i], np.int64).reshape(-1, 3))
                if len(ids):
                    slices.append(batch["slice"][i].as_py())
                    blobs.append(_blob(np.column_stack([pairs, ids])))
            if slices:
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(blobs, pa.binary())], ["slice", "told"])
    return run


def _rewritten(words: bool, few=None):
    """Streams in the new ranks; what is not frequent becomes one -1 a run. ``few`` has
    the frequent ones by language, else ``told`` has those of the slice."""
    def run(batches):
        none = np.zeros((0, 3), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                lang = batch["lang"][i].as_py()
                stream = _stream(batch["stream"][i])
                told = few.value.get(lang, none) if few else _numbers(batch["told"][i], np.int64).reshape(-1, 3)
                if words:
                    keys = _numbers(batch["keys"][i], np.uint64)
                    name = np.full(len(keys) + 1, -1, np.int64)  # the last one is the name of -1
                    asked = told[:, 0].view(np.uint64) if len(told) else keys[:0]
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    here = keys[at] == asked
                    name[at[here]] = told[here, 2]
                    fresh = name[stream]
                else:
                    fresh = np.full(max(0, len(stream) - 1), -1, np.int64)
                    at = np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0))
                    pairs = np.column_stack([stream[at], stream[at + 1]]).astype(np.int64)
                    if not few:  # from several tiles and ranges
                        told = told[np.lexsort((told[:, 1], told[:, 0]))]
                    fresh[at] = _looked_up(pairs, told[:, :2], told[:, 2])
                keep = np.ones(len(fresh), dtype=bool)
                keep[1:] = (fresh[1:] >= 0) | (fresh[:-1] >= 0)
                fresh = fresh[keep]
                if (fresh >= 0).any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch["slice"][i].as_py()], pa.int64()), pa.array([lang]),
                         pa.array([_stream_blob(fresh)], pa.binary())], ["slice", "lang", "stream"])
    return run


def _looked_up(pairs: np.ndarray, found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rank of each pair, -1 if it has none; ``found`` is in order."""
    if not len(found):
        return np.full(len(pairs), -1, np.int64)
    # places of the left numbers make codes that fit
    left = np.unique(found[:, 0])
    base = np.minimum(np.searchsorted(left, pairs[:, 0]), len(left) - 1)
    code = np.searchsorted(left, found[:, 0]) * (1 << 40) + found[:, 1]
    want = base * (1 << 40) + pairs[:, 1]
    at = np.minimum(np.searchsorted(code, want), len(code) - 1)
    return np.where((left[base] == pairs[:, 0]) & (code[at] == want), ids[at], -1)


STREAM_SCHEMA = "slice long, lang string, stream binary"


def _rewrite(streams: DataFrame, ranked: DataFrame, words: bool, ranges: int, few: int) -> DataFrame:
    if ranked.limit(few + 1).count() <= few:
        table = ranked.select("lang", "a", "b", "id").toArrow()
        cells = np.column_stack([table[c].to_numpy() for c in ("a", "b", "id")]).astype(np.int64)
        lang = np.array(table["lang"].to_pylist(), dtype=object)
        order = np.lexsort((cells[:, 1], cells[:, 0]))
        cells, lang = cells[order], lang[order]
        known = {name: np.ascontiguousarray(cells[lang == name]) for name in set(lang.tolist())}
        return streams.mapInArrow(_rewritten(words, streams.sparkSession.sparkContext.broadcast(known)), STREAM_SCHEMA)
    known = ranked.groupBy("lang", "ta", "tb").applyInArrow(_packed, "lang string, ta long, tb long, known binary")
    asked = streams.mapInArrow(_asks(words, ranges), ENTRY_SCHEMA).drop("counts", "tellers")
    told = asked.join(known, ["lang", "ta", "tb"]).mapInArrow(_answers(words), "slice long, told binary")
    told = told.groupBy("slice").agg(F.listagg("told").alias("told"))
    return streams.join(told, "slice").mapInArrow(_rewritten(words), STREAM_SCHEMA)


def _named(batches):
    """The words that a slice was asked to name."""
    for batch in batches:
        for i in range(len(batch)):
            keys = _numbers(batch["keys"][i], np.uint64)
            length = _numbers(batch["lengths"][i], np.int64)
            letters = batch["letters"][i].as_py()
            start = np.concatenate([[0], np.cumsum(length)])
            asked = np.array(batch["asked"][i].as_py(), np.int64).view(np.uint64)
            at = np.searchsorted(keys, asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch["lang"][i].as_py()] * len(at)), pa.array(asked.view(np.int64)),
                 pa.array([letters[start[k]:start[k + 1]].decode() for k in at.tolist()])], ["lang", "a", "word"])


def phrases(docs: DataFrame, least: int = 100, fan: int = FAN, slice_bytes: int = SLICE_BYTES, few: int = FEW,
            key: str = "lang", text: str = "text") -> DataFrame:
    """All phrases of two to five words with ``least`` occurrences: lang, words,
    a, cut (words before the weakest cut), l, r, n, score, covered (whether a longer phrase that
    holds it occurs as often).

    Texts are lower-cased (A-Z), a null text is empty, a null language is ``und``;
    languages without a frequent phrase have no rows. Copies and repeated rows
    count as often as they occur. An empty table gives no rows. Other columns do
    not matter.
    """
    scratch = Scratch(docs.sparkSession, "collocations", BATCH_BYTES)
    ranges = range_count(docs, text)
    rows = docs.select(F.coalesce(docs[key].cast("string"), F.lit("und")).alias("lang"), text_column(docs, text).alias("text"))
    slices = scratch.write(rows.mapInArrow(_slices(slice_bytes), SLICE_SCHEMA))
    total = scratch.write(slices.groupBy("lang").agg(F.sum("n").alias("n")))

    entries = slices.select("slice", "lang", "keys", "counts").mapInArrow(_entries(True, ranges), ENTRY_SCHEMA)
    found = _counted(entries, scratch, True, least, fan)
    ranked = scratch.write(positions(found.withColumn("less", -F.col("n")), ["less", "a"], ["lang"], name="id").drop("less"))
    asked = ranked.groupBy("lang", F.col("teller").alias("slice")).agg(F.collect_list("a").alias("asked")).drop("lang")
    if ranked.limit(few + 1).count() <= few:  # so that the letters of all slices stay where they are
        asked = F.broadcast(asked)
    words = slices.select("slice", "lang", "keys", "lengths", "letters").join(asked, "slice").mapInArrow(
        _named, "lang string, a long, word string")
    known = scratch.write(ranked.join(words, ["lang", "a"]).select(
        "lang", "id", F.array("word").alias("words"), F.array("n").alias("heads"), F.array("n").alias("tails")))
    streams = scratch.write(_rewrite(
        slices.select("slice", "lang", "stream", "keys", "counts"), ranked, True, ranges, few))
    scratch.drop(slices)

    levels = []
    for size in range(2, LONGEST + 1):
        entries = streams.mapInArrow(_entries(False, ranges), ENTRY_SCHEMA)
        found = _counted(entries, scratch, False, least, fan)
        ranked = scratch.write(positions(
            found.withColumn("less", -F.col("n")), ["less", "a", "b"], ["lang"], name="id").drop("less", "teller"))
        first = known.select("lang", F.col("id").alias("a"), F.col("words").alias("w"), F.col("heads").alias("h"))
        last = known.select("lang", F.col("id").alias("b"), F.element_at("words", -1).alias("x"), F.col("tails").alias("t"))
        known = scratch.write(ranked.join(first, ["lang", "a"]).join(last, ["lang", "b"]).select(
            "lang", "id", "a", "b", "n", F.concat("w", F.array("x")).alias("words"),
            F.concat("h", F.array("n")).alias("heads"), F.concat("t", F.array("n")).alias("tails")))
        levels.append(known)
        if size < LONGEST:
            before, streams = streams, scratch.write(_rewrite(streams, ranked, False, ranges, few))
            scratch.drop(before)

    out = None
    for level, above in zip(levels, [*levels[1:], None]):
        here = level.select("lang", "id", "words", F.col("n").alias("a"), "heads", "tails")
        if above is None:
            here = here.withColumn("most", F.lit(None).cast("long"))
        else:
            sides = above.select("lang", F.explode(F.array("a", "b")).alias("id"), "n")
            here = here.join(sides.groupBy("lang", "id").agg(F.max("n").alias("most")), ["lang", "id"], "left")
        out = here if out is None else out.unionByName(here)
    score = SCORE.format(left="heads[k - 1]", right="tails[size(words) - k - 1]")
    scored = out.join(total, "lang").withColumn("cut", F.expr(f"""
        array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
            'score', {score}, 'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))"""))
    return scored.select("lang", "words", "a", F.col("cut.k").alias("cut"), F.col("cut.l").alias("l"),
                         F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
                         F.coalesce(F.col("most") >= F.col("a"), F.lit(False)).alias("covered"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, **more) -> DataFrame:
    """Each language's ``top`` phrases that no longer phrase covers: lang, rank,
    phrase, a, l, r, n, score. Order: score, a (both falling), phrase in byte
    order; these cannot tie. See ``phrases`` for odd input."""
    rows = phrases(docs, least, **more).where("not covered").withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
