"""Stateful jobs on Spark's keyed state: meters, reassembly, mini-batch completion,
epoch closing, arrival batching.

Each job is a function from a stream to a stream; state lives in the engine's state
store, by key, and is checkpointed and recovered with the query. A key's rows of one
micro-batch are handled by one task, chunk by chunk; what a micro-batch may bring is
bounded by the trigger (``maxFilesPerTrigger``). Finished state is cleared, and what
only guards against late repeats expires.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kilnset.operators.telemetry import stragglers

DAY_MS = 24 * 3600 * 1000


class _Meters(StatefulProcessor):
    """Latest value, sum, count and moving average of a rank."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("meters", "step long, val double, sum double, count long, ema double")

    def handleInputRows(self, key, rows, timers):
        step, val, total, count, ema = self.state.get() if self.state.exists() else (-1, None, 0.0, 0, None)
        batch = pd.concat(list(rows)).sort_values("step", kind="stable")
        for x in batch["value"].tolist():
            ema = x if ema is None else 0.9 * ema + (1 - 0.9) * x
        last = batch.iloc[-1]
        if int(last["step"]) >= step:
            step, val = int(last["step"]), float(last["value"])
        total, count = total + float(batch["value"].sum()), count + len(batch)
        self.state.update((step, val, total, count, ema))
        yield pd.DataFrame({"rank": [key[0]], "step": [step], "val": [val], "sum": [total], "count": [count], "ema": [ema]})

    def close(self) -> None:
        pass


def meters(stream: DataFrame) -> DataFrame:
    """Rows (rank, step, value) to the meters of each rank that a micro-batch
    touches; the row with the largest ``count`` is the latest."""
    return stream.select("rank", "step", "value").groupBy("rank").transformWithStateInPandas(
        _Meters(), "rank long, step long, val double, sum double, count long, ema double", "Append", "None")


#: Items of a stream that wait as one value: each call to the state store is a trip to
#: the engine and back, so items go in blocks of neighbouring indexes.
BLOCK = 1024
#: Items of one micro-batch that are kept back before they go to the state store.
MOST_FRESH = 1 << 16
ITEM = np.dtype([("idx", "<i8"), ("payload", "<f8"), ("arrival", "<i8")])


class _Reassembly(StatefulProcessor):
    """Items wait until every smaller index of their stream has arrived."""

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "idx long, high long, blocks long")
        self.held = handle.getMapState("held", "block long", "items binary")

    def _waiting(self, block, fresh, stored):
        """Items of a block by index, the latest of each, and whether it is in the state."""
        found = self.held.getValue((block,)) if stored else None
        items = np.concatenate([np.frombuffer(found[0], ITEM) if found else np.empty(0, ITEM), *fresh])[::-1]
        return items[np.unique(items["idx"], return_index=True)[1]], found is not None

    def _hold(self, fresh, stored):
        """Put blocks into the state; the number of blocks there."""
        for block, parts in fresh.items():
            items, was = self._waiting(block, parts, stored)
            self.held.updateValue((block,), (items.tobytes(),))
            stored += not was
        return stored

    def handleInputRows(self, key, rows, timers):
        at, high, stored = self.next.get() or (0, -1, 0)
        fresh, n = {}, 0
        for chunk in rows:
            items = np.empty(len(chunk), ITEM)
            for name in ITEM.names:
                items[name] = chunk[name]
            items = items[items["idx"] >= at]  # else a repeat of what has left
            items = items[np.argsort(items["idx"], kind="stable")]
            for part in np.split(items, np.flatnonzero(np.diff(items["idx"] // BLOCK)) + 1) if len(items) else ():
                fresh.setdefault(int(part["idx"][0]) // BLOCK, []).append(part)
            n += len(items)
            if n >= MOST_FRESH:
                stored, fresh, n = self._hold(fresh, stored), {}, 0
        while stored or at // BLOCK in fresh:
            block = at // BLOCK
            items, was = self._waiting(block, fresh.pop(block, []), stored)
            gap = np.flatnonzero(items["idx"] != np.arange(at, at + len(items)))
            ready, left = np.split(items, gap[:1]) if len(gap) else (items, items[:0])
            if len(left):
                self.held.updateValue((block,), (left.tobytes(),))
                stored += not was
            elif was:
                self.held.removeKey((block,))
                stored -= 1
            if len(ready):
                latest = np.maximum(np.maximum.accumulate(ready["arrival"]), high)
                yield pd.DataFrame({"stream": [key[0]] * len(ready), "idx": ready["idx"], "payload": ready["payload"], "released_in": latest})
                at, high = at + len(ready), int(latest[-1])
            if len(left) or not len(ready) or at % BLOCK:
                break
        self.next.update((at, high, self._hold(fresh, stored)))

    def close(self) -> None:
        pass


def reassemble(stream: DataFrame) -> DataFrame:
    """Rows (stream, idx, payload, arrival) in order: an item leaves once every
    smaller index has arrived, in the latest arrival among them."""
    return stream.select("stream", "idx", "payload", "arrival").groupBy("stream").transformWithStateInPandas(
        _Reassembly(), "stream long, idx long, payload double, released_in long", "Append", "None")


class _Countdown(StatefulProcessor):
    """Samples that a mini-batch still waits for."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("left", "left long, micros long, samples long, bytes long, latest long")

    def handleInputRows(self, key, rows, timers):
        left, micros, samples, size, latest = self.state.get() if self.state.exists() else (None, 0, 0, 0, -1)
        for chunk in rows:
            if left is None:
                left = int(chunk["size"].iloc[0])
            left -= int(chunk["samples"].sum())
            micros, samples = micros + len(chunk), samples + int(chunk["samples"].sum())
            size, latest = size + int(chunk["bytes"].sum()), max(latest, int(chunk["arrival"].max()))
        if left > 0:
            self.state.update((left, micros, samples, size, latest))
            return
        if self.state.exists():
            self.state.clear()
        yield pd.DataFrame({"mini_batch": [key[0]], "micro_batches": [micros], "samples": [samples], "bytes": [size], "completed_in": [latest]})

    def close(self) -> None:
        pass


def complete_mini_batches(stream: DataFrame) -> DataFrame:
    """Micro-batches (mini_batch, samples, bytes, size, arrival) of mini-batches of
    ``size`` samples: a mini-batch is reported, and its state cleared, once its samples
    have arrived, in whatever order and pieces."""
    return stream.select("mini_batch", "samples", "bytes", "size", "arrival").groupBy("mini_batch").transformWithStateInPandas(
        _Countdown(), "mini_batch long, micro_batches long, samples long, bytes long, completed_in long", "Append", "None")


class _Epochs(StatefulProcessor):
    """Ranks that have flagged the end of an epoch."""

    def __init__(self, ranks: int, keep_ms: int):
        self.ranks, self.keep_ms = ranks, keep_ms

    def init(self, handle) -> None:
        self.flags = handle.getMapState("flags", "rank long", "arrival long")
        self.closed = handle.getValueState("closed", "arrival long", self.keep_ms)

    def handleInputRows(self, key, rows, timers):
        done = self.closed.exists()
        for chunk in rows:
            for rank, arrival in zip(chunk["rank"].tolist(), chunk["arrival"].tolist()):
                if not done:
                    first = min(arrival, self.flags.getValue((rank,))[0]) if self.flags.containsKey((rank,)) else arrival
                    self.flags.updateValue((rank,), (first,))
        arrivals = [] if done else [v[0] for v in self.flags.values()]
        if len(arrivals) == self.ranks:
            self.flags.clear()
            self.closed.update((max(arrivals),))
            yield pd.DataFrame({"epoch": [key[0]], "closed_in": [max(arrivals)]})

    def close(self) -> None:
        pass


def close_epochs(stream: DataFrame, ranks: int, keep_ms: int = DAY_MS) -> DataFrame:
    """Flags (epoch, rank, arrival): an epoch closes with the last rank's first flag.
    Its flags are dropped then, and its number is kept for ``keep_ms``, so that late
    repeats don't open it again; after that the state store forgets it."""
    return stream.select("epoch", "rank", "arrival").groupBy("epoch").transformWithStateInPandas(
        _Epochs(ranks, keep_ms), "epoch long, closed_in long", "Append", "ProcessingTime")


class _Batches(StatefulProcessor):
    """How many rows of a worker have arrived, and those of its open batch."""

    def __init__(self, size: int, drop_last: bool):
        self.size, self.drop_last = size, drop_last

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.open = handle.getListState("open", "sample_id long")

    def handleInputRows(self, key, rows, timers):
        n = self.count.get()[0] if self.count.exists() else 0
        held = [x[0] for x in self.open.get()] if self.drop_last and self.open.exists() else []
        ids = held + sorted(pd.concat(list(rows))["sample_id"].tolist())
        begin = n - len(held)
        total = begin + len(ids)
        ready = total // self.size * self.size - begin if self.drop_last else len(ids)
        self.count.update((total,))
        if self.drop_last:
            self.open.clear()
            if ids[ready:]:  # less than a batch
                self.open.put([(x,) for x in ids[ready:]])
        if ready > 0:
            place = pd.Series(range(begin, begin + ready))
            yield pd.DataFrame({"worker": key[0], "sample_id": ids[:ready], "batch_id": place // self.size, "pos_in_batch": place % self.size})

    def close(self) -> None:
        pass


def batch_arrivals(stream: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """Rows (worker, sample_id) in batches by order of arrival, by id inside a
    micro-batch (files of one micro-batch have no order). With ``drop_last`` rows wait
    until their batch is full, so an unfinished batch at the end is never written."""
    return stream.select("worker", "sample_id").groupBy("worker").transformWithStateInPandas(
        _Batches(size, drop_last), "worker long, sample_id long, batch_id long, pos_in_batch long", "Append", "None")


def progress_totals(stream: DataFrame, left, finished) -> DataFrame:
    """Running totals of each rank of a node (streaming aggregation)."""
    return stream.groupBy("node", "rank").agg(
        F.count(F.lit(1)).alias("batch_no"), F.sum(F.when(left, 1).otherwise(0)).alias("left_tasks"), F.max(finished).alias("finished"))


def straggler_report(totals: DataFrame, threshold: int) -> DataFrame:
    """The report over the totals of one micro-batch."""
    return stragglers(totals, "node", "rank", "batch_no", "left_tasks", "finished", threshold)


def summary(batch: DataFrame) -> dict:
    """What a reporter is told about a micro-batch."""
    return batch.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high")).first().asDict()
