"""Odd values and large inputs of queries that a review of the round named."""

import gzip
import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kilnset.functions import pixels
from kilnset.llm import features
from kilnset.operators import trials as R
from kilnset.plans import catalog
from kilnset.plans.images import _cells, _laid_out
from kilnset.sources import samples as SR
from kilnset.streaming import feeds as S
from kilnset.streaming import stateful as ST


def run(name, **tables):
    return catalog.QUERIES[name].run(SimpleNamespace(**tables))


def test_iterations_without_time_have_an_infinite_rate(spark):
    rows = [(u, i, x) for u, values in ((1, [1.0] * 3 + [0.0, 64.0]), (2, [1.0] * 3 + [0.0, 0.0]), (3, [1.0] * 3 + [128.0, None]))
            for i, x in enumerate(values)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, value double")
    got = {r.user_id: tuple(r)[1:] for r in run("iteration_throughput", events=events).collect()}
    assert got == {1: (2, math.inf, 8.0), 2: (2, math.inf, math.inf), 3: (2, 2.0, 4.0)}


def test_images_are_laid_out_a_piece_at_a_time():
    n = 3000
    values = np.linspace(-0.7, 0.7, n * 64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([0] * n), pa.FixedSizeListArray.from_arrays(pa.array(values), 64)], ["vec_id", "label", "embedding"])
    out = list(_laid_out(*_cells(32))([batch]))
    assert max(b.nbytes for b in out) < 2 * pixels.PIECE_BYTES
    place, ramp = _cells(32)
    q = np.clip(np.floor((values.reshape(n, 64) + 0.6) / 1.2 * 256), 0, 255).astype(int)
    want = (q[:, place] + ramp.astype(int)) % 256
    got = np.frombuffer(b"".join(x.as_py() for b in out for x in b["px"]), dtype=np.uint8).reshape(n, -1)
    assert (got == want).all()
    assert [x for b in out for x in b["vec_id"].to_pylist()] == list(range(n))


def test_chains_hand_on_large_images_as_they_go():
    n, side = 64, 8
    step = [{"op": "resize_whole", "args": [200.0, 200.0]}]
    raw = [bytes([i]) * side * side * 3 for i in range(n)]
    raw[5] = None
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(raw, pa.binary()), pa.array([side] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array([step] * n)],
        ["k", "px", "h", "w", "steps"])
    out = list(pixels.run_chains("px", "h", "w", "steps")([batch]))
    assert len(out) > 4 and max(b.nbytes for b in out) < 2 * pixels.PIECE_BYTES
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["k"] for r in rows] == list(range(n))
    assert all(r["px"] == bytes([r["k"]]) * 120000 and r["h"] == 200 for r in rows if r["k"] != 5)
    assert rows[5] == {"k": 5, "px": None, "h": side, "w": side}


def test_contents_leave_in_pieces(spark):
    column = pa.array([b"x" * 300000] * 20 + [None])
    out = list(SR.in_pieces([column, column.slice(0, 0)], lambda b: b.as_py()))
    assert [x for p in out for x in p.to_pylist()] == column.to_pylist()
    assert max(p.nbytes for p in out) < 2 * SR.PIECE_BYTES
    rows = [(i, bytearray(gzip.compress(b"%d" % i * 100000) if i % 2 else b"plain")) for i in range(30)] + [(30, None)]
    got = SR.decompress(spark.createDataFrame(rows, "k long, content binary").coalesce(1)).collect()
    assert {r.k: r.content and bytes(r.content) for r in got} == {
        i: None if i == 30 else b"%d" % i * 100000 if i % 2 else b"plain" for i in range(31)}


def test_trials_of_one_file_go_to_many_tasks(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = spark.range(10).coalesce(1)
    assert R.spread(one).rdd.getNumPartitions() == least
    assert R.spread(spark.range(R.ROWS_PER_TASK * 20).coalesce(1)).rdd.getNumPartitions() == max(least, 20)


def test_items_wait_in_blocks(spark, monkeypatch):
    # a long stream whose first item comes last, one with a gap inside a block, one without
    n = 3 * ST.BLOCK + 7
    rows = [(0, i, 2 if i == 0 else i % 2) for i in range(n)] + [(1, i, 1 if i == 1500 else 0) for i in range(2000)]
    rows += [(2, i, 0) for i in range(5)] + [(3, 9, 0), (3, 9, 1)]
    table = spark.createDataFrame(rows, "stream long, idx long, p int").withColumn("payload", F.col("idx").cast("double"))
    out = S.Arrivals(table, F.col("p"), "t").run(3, ST.reassemble).collect()
    got = {(r.stream, r.idx): (r.payload, r.released_in) for r in out}
    assert len(out) == len(got)
    want = {(0, i): 2 for i in range(n)} | {(1, i): int(i >= 1500) for i in range(2000)} | {(2, i): 0 for i in range(5)}
    assert got == {k: (float(k[1]), v) for k, v in want.items()}


class _Held:
    """A map state that counts calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]


def test_waiting_items_cost_calls_by_the_block():
    import pandas as pd

    job, n = ST._Reassembly(), 10 * ST.BLOCK
    job.held, state = _Held(), [None]
    job.next = SimpleNamespace(get=lambda: state[0], update=lambda x: state.__setitem__(0, x))
    chunk = lambda ids, a: pd.DataFrame({"idx": ids, "payload": 1.0, "arrival": a})
    assert not list(job.handleInputRows((7,), iter([chunk(range(1, n), 0)]), None))
    out = pd.concat(job.handleInputRows((7,), iter([chunk([0], 1)]), None))
    assert out["idx"].tolist() == list(range(n)) and set(out["released_in"]) == {1} and not job.held.rows
    assert job.held.calls < 50


def test_fitting_in_slices_is_the_same_sum_in_less_memory(monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    texts = pa.array([" ".join(rng.choice(words[:2000] if i % 3 else words[1000:], 400)) for i in range(400)], pa.large_string())
    target = np.array([float(i % 3 > 0) for i in range(400)])
    whole = features.fit(texts, target, steps=3)
    entries = len(features.vectors(texts)[0])
    monkeypatch.setattr(features, "slices", lambda column: ((a, min(a + 7, len(column))) for a in range(0, len(column), 7)))
    tracemalloc.start()
    parts = features.fit(texts, target, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(whole.weights, parts.weights, rtol=1e-9) and np.isclose(whole.shift, parts.shift)
    # 14 bytes an entry, and some tables of all bins
    assert peak < 16 * entries + 24 * 8 * features.BINS
