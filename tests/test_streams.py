"""State across micro-batches and restarts."""

from pyspark.sql import functions as F

from kilnset.streaming import feeds as S
from kilnset.streaming import late as LT
from kilnset.streaming import stateful as ST
from kilnset.streaming import windows as W


def test_gap_holds_back_later_items(spark):
    # one stream holds most rows; index 3 arrives last, index 1 twice
    rows = spark.createDataFrame(
        [(0, 0, 0), (0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 0), (0, 5, 1), (1, 1, 0), (1, 0, 2), (0, 1, 1)], "stream long, idx long, p int")
    rows = rows.withColumn("payload", F.lit(1.0))
    out = S.Arrivals(rows, F.col("p"), "t").run(3, ST.reassemble).collect()
    got = {(r.stream, r.idx): r.released_in for r in out}
    assert len(out) == len(got)
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 2, (0, 4): 2, (0, 5): 2, (1, 0): 2, (1, 1): 2}


def test_mini_batches_complete_over_arrivals(spark):
    rows = [(7, 4, 40, 10, 0), (7, 4, 44, 10, 1), (7, 2, 20, 10, 2), (8, 3, 3, 3, 1), (9, 1, 1, 5, 0), (9, 3, 3, 5, 2)]
    feed = S.Arrivals(spark.createDataFrame(rows, "mini_batch long, samples long, bytes long, size long, p int"), F.col("p"), "t")
    got = {tuple(r) for r in feed.run(3, ST.complete_mini_batches).collect()}
    assert got == {(7, 3, 10, 104, 2), (8, 1, 3, 3, 1)}  # 9 still waits for a sample


def test_closed_epochs_stay_closed_until_they_expire(spark):
    rows = [(1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 0, 1), (2, 1, 2)]
    table = spark.createDataFrame(rows, "epoch long, rank long, p int")
    got = S.Arrivals(table, F.col("p"), "t").run(3, lambda s: ST.close_epochs(s, 2)).collect()
    assert sorted((r.epoch, r.closed_in) for r in got) == [(1, 0), (2, 2)]
    # forgotten at once, the repeats of the next arrival open epoch 1 again
    got = S.Arrivals(table, F.col("p"), "t").run(3, lambda s: ST.close_epochs(s, 2, keep_ms=1)).collect()
    assert sorted((r.epoch, r.closed_in) for r in got) == [(1, 0), (1, 1), (2, 2)]


def test_full_batches_only(spark):
    table = spark.range(50).select((F.col("id") % 2).alias("worker"), F.col("id").alias("sample_id"), (F.col("id") % 3).alias("p"))
    out = S.Arrivals(table, F.col("p"), "t").run(3, lambda s: ST.batch_arrivals(s, 4, drop_last=True)).collect()
    sizes = {}
    for r in out:
        sizes.setdefault((r.worker, r.batch_id), []).append(r.pos_in_batch)
    assert len(out) == 48 and all(sorted(v) == [0, 1, 2, 3] for v in sizes.values())


def test_reporter_sees_every_batch(spark):
    seen = []
    rows = spark.range(30).select((F.col("id") % 3).cast("int").alias("p"), F.col("id").cast("double").alias("value"))
    S.Arrivals(rows, F.col("p"), "t").run(3, lambda s: s, handle=lambda b, n: seen.append((n, *ST.summary(b).values())))
    assert seen == [(0, 10, 27.0), (1, 10, 28.0), (2, 10, 29.0)]


def test_batch_and_stream_windows_agree(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole = W.windowed_rates(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 hour")
    stream = S.event_time(S.read_samples(spark, "/root/testdata/sf0.001/events.parquet"), "ts", "10 minutes")
    closed = S.run_to_table(W.windowed_rates(stream, "ts", "event_type", "value", "1 hour"), "t")
    missing = whole.select("window_start", "event_type", "n").exceptAll(closed.select("window_start", "event_type", "n"))
    assert closed.select("window_start", "event_type", "n").exceptAll(whole.select("window_start", "event_type", "n")).isEmpty()
    assert missing.count() <= 5


def test_late_rows_are_kept_aside(spark):
    day = lambda d: None if d is None else f"2024-01-{d:02d} 12:00:00"
    # (id, day, arrival): 4 is two days behind 3, 5 within the delay, 7 has no time, 8 behind an arrival before the last
    rows = [(1, 1, 0), (2, 5, 0), (3, 9, 0), (4, 7, 1), (5, 8, 1), (6, 2, 1), (7, None, 1), (8, 6, 2), (9, 20, 2), (10, 3, 2)]
    table = spark.createDataFrame([(i, day(d), a) for i, d, a in rows], "id long, at string, a int")
    table = table.select("id", F.col("at").cast("timestamp_ntz").alias("ts"), "a")
    feed = S.Arrivals(table, F.col("a"), "t")
    split = LT.LateRows(spark, feed.base, "ts", "1 day")
    feed.run(3, lambda s: s, handle=split)
    got = split.rows().collect()
    assert len(got) == len(rows)
    assert {r.id for r in got if r.late} == {4, 6, 8, 10}
    # a micro-batch that runs again changes nothing
    split(feed.spark.read.schema(feed.schema).parquet(f"{feed.base}/feed/1"), 1)
    assert sorted((r.id, r.late) for r in split.rows().collect()) == sorted((r.id, r.late) for r in got)
