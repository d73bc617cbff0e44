"""Positions and scans: exactness, balance under skew, plans."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kilnset.functions.hashing import uniform
from kilnset.operators import ranking as R
from kilnset.operators.meters import loss_ema, warmup_ema


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows; one group holds two thirds of them."""
    g = F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
    return spark.range(30000).select("id", g.alias("g"), ((F.col("id") * 7919) % 30011).alias("k")).cache()


def test_positions_match_window(skewed):
    want = skewed.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    got = R.positions(want, ["k"], ["g"], buckets=32)
    assert got.count() == 30000
    assert got.where("pos <> want").isEmpty()


def test_global_positions_are_a_bijection(skewed):
    got = R.positions(skewed, ["k"], total="n", buckets=16)
    row = got.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.max("n")).first()
    assert tuple(row) == (0, 29999, 30000, 30000)
    assert got.orderBy("pos").limit(500).select("k").toPandas().k.is_monotonic_increasing


def test_hot_group_is_spread_over_buckets(skewed):
    sizes = R.with_buckets(skewed, ["k"], ["g"], buckets=32).groupBy("__g", "__b").count()
    assert sizes.agg(F.max("count")).first()[0] < 4 * 30000 / 32
    rows = skewed.withColumn("u", uniform("x", 1, 0, "id"))
    sizes = R.with_buckets(rows, ["u"], ["g"], uniform="u", buckets=32).groupBy("__g", "__b").count()
    assert sizes.agg(F.max("count")).first()[0] < 4 * 30000 / 32


def test_clustered_keys_are_spread(spark):
    # all but one key lie in a narrow range
    df = spark.range(20000).select(F.when(F.col("id") == 0, F.lit(2**60)).otherwise(F.col("id")).alias("k"))
    sizes = R.with_buckets(df, ["k"], buckets=32).groupBy("__b").count()
    assert sizes.agg(F.max("count")).first()[0] < 4 * 20000 / 32


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, g string")
    got = {r.id: r.pos for r in R.positions(df, ["id"], ["g"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_inputs(spark, n):
    df = spark.range(n)
    assert sorted(r.pos for r in R.positions(df, ["id"]).collect()) == list(range(n))


def test_string_and_composite_order(spark):
    words = [f"http://x/{i * 37 % 101:03d}/é{i}" for i in range(400)]
    df = spark.createDataFrame([(w, i % 7) for i, w in enumerate(words)], "w string, k int")
    got = [r.w for r in R.positions(df, ["w"], buckets=8).orderBy("pos").collect()]
    assert got == sorted(words)
    got = [(r.k, r.w) for r in R.positions(df, ["k", "w"], buckets=8).orderBy("pos").collect()]
    assert got == sorted((i % 7, w) for i, w in enumerate(words))


def test_running_values_match_pandas(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("aaab"), None if rnd.random() < 0.2 else rnd.randint(-50, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, g string, v long")
    got = R.running(df, {
        "s": ("sum", F.col("v")), "c": ("count", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v")),
        "p": ("previous", F.col("v")), "z": ("last", F.col("v"))}, ["i"], ["g"], buckets=16).toPandas().sort_values("i")
    pdf = pd.DataFrame(rows, columns=["i", "g", "v"]).astype({"v": "float"})
    by = pdf.groupby("g").v
    want = {"s": by.cumsum().groupby(pdf.g).ffill(), "m": by.cummax().groupby(pdf.g).ffill(), "l": by.cummin().groupby(pdf.g).ffill(),
            "p": by.shift(), "z": by.ffill(), "c": pdf.v.notna().astype(int).groupby(pdf.g).cumsum()}
    for name, w in want.items():
        a, b = got[name].astype(float).to_numpy(), w.astype(float).to_numpy()
        assert ((a == b) | (pd.isna(a) & pd.isna(b))).all(), name


def test_recurrences_match_a_loop(spark):
    rows = [(i, "hot" if i % 4 else "cold", (i * 31 % 97) / 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string, x double")
    plain = {r.i: r.ema for r in loss_ema(df, F.col("x"), ["i"], ["g"]).collect()}
    warm = {r.i: r.ema for r in warmup_ema(df, F.col("x"), ["i"], ["g"], 0.99).collect()}
    state, wstate, step = {}, {}, {}
    for i, g, x in rows:
        k = step.get(g, 0)
        mu = min(0.99, (1 + k) / (10 + k))
        state[g] = x if k == 0 else 0.9 * state[g] + 0.1 * x
        wstate[g] = x if k == 0 else mu * wstate[g] + (1 - mu) * x
        step[g] = k + 1
        assert plain[i] == pytest.approx(state[g], rel=1e-12)
        assert warm[i] == pytest.approx(wstate[g], rel=1e-12)


def test_recurrences_of_any_depth(spark, monkeypatch):
    """Blocks of four: five levels above the rows, none with more than four entries."""
    monkeypatch.setattr(R, "BLOCK", 4)
    rows = [(i, "hot" if i % 10 else "cold", (i * 31 % 97) / 7) for i in range(3000)]
    found = {r.i: r.ema for r in loss_ema(spark.createDataFrame(rows, "i long, g string, x double"), F.col("x"), ["i"], ["g"]).collect()}
    state = {}
    for i, g, x in rows:
        state[g] = 0.9 * state[g] + 0.1 * x if g in state else x
        assert found[i] == pytest.approx(state[g], rel=1e-9)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_move_no_whole_table_to_one_task(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = _plan(R.positions(orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], ["o_orderpriority"]))
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    plan = _plan(R.positions(orders.select("o_orderkey"), ["o_orderkey"]))
    # the only single-partition step scans one row per bucket
    head, tail = plan.split("Exchange SinglePartition", 1)
    assert "HashAggregate" in tail.split("\n")[1]
    assert "SinglePartition" not in tail and "NestedLoop" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
