"""Streaming queries: each runs its stream over the table to the end."""

from pyspark.sql import functions as F

from kilnset.functions.hashing import pick, uniform
from kilnset.plans.registry import query, u
from kilnset.streaming import feeds as S
from kilnset.streaming import late as LT
from kilnset.streaming import stateful as ST
from kilnset.streaming import windows as W

SEED = 42
PART = f"cast(floor({u('part', SEED, 0, 'event_id')} * 3) as int)"


def _part():
    return pick(uniform("part", SEED, 0, "event_id"), 3).cast("int")


def _events(t):
    return S.read_samples(t.spark, t.path("events"))


@query("streamed_shards", "T1 S14", f"""
select doc_id, cast(floor({u('shard', SEED, 0, 'doc_id')} * 6) as bigint) as worker from documents""")
def streamed_shards(t):
    docs = S.read_samples(t.spark, t.path("documents")).select("doc_id")
    return S.run_to_table(S.shard(docs, "doc_id", 6, SEED), "shards")


#: A time after all events of any table.
END = "9000-01-01 00:00:00"


def _to_end(t, job, label):
    return S.run_to_end(lambda: _events(t), job, "ts", "10 minutes", label, END)


@query("tumbling_throughput", "T2", """
select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as high
from events group by 1, 2""")
def tumbling_throughput(t):
    rates = _to_end(t, lambda e: W.windowed_rates(e, "ts", "event_type", "value", "1 hour"), "tumbling")
    return rates.withColumn("mean", F.round("mean", 6))


@query("sliding_latency", "T3", """
with w as (select time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' as window_start, event_type, value
  from events, (values (0), (1), (2), (3)) v(k))
select window_start, event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as high from w
group by 1, 2""")
def sliding_latency(t):
    rates = _to_end(t, lambda e: W.windowed_rates(e, "ts", "event_type", "value", "1 hour", "15 minutes"), "sliding")
    return rates.withColumn("mean", F.round("mean", 6))


@query("busy_sessions", "T9", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as sid from g)
select user_id, min(ts) as busy_from, max(ts) + interval '6 hours' as idle_at, count(*) as n from s group by user_id, sid""")
def busy_sessions(t):
    return _to_end(t, lambda e: W.busy_sessions(e, "ts", "user_id", "6 hours"), "sessions")


@query("chained_streams", "T8 U2", """
select doc_id as id, 0 as ordinal from documents union all select page_id, 1 from pages union all select item_id, 2 from benchmark""")
def chained_streams(t):
    part = lambda name, key: S.read_samples(t.spark, t.path(name)).select(F.col(key).alias("id"))
    return S.run_to_table(S.chain(part("documents", "doc_id"), part("pages", "page_id"), part("benchmark", "item_id")), "chained")


@query("streamed_meters", "T4", f"""
with recursive s as (select user_id, event_id, value, row_number() over (partition by user_id order by {PART}, event_id) as k from events),
e as (select user_id, k, value as ema from s where k = 1
      union all select s.user_id, s.k, e.ema * 0.9::double + s.value * (1 - 0.9::double) from e join s on s.user_id = e.user_id and s.k = e.k + 1),
l as (select user_id, arg_max(ema, k) as ema from e group by 1)
select user_id as rank, count(*) as count, round(sum(value), 2) as sum, arg_max(value, event_id) as val, round(any_value(ema), 6) as ema
from events join l using (user_id) group by 1""")
def streamed_meters(t):
    rows = t.events.select("event_id", F.col("user_id").cast("long").alias("rank"), F.col("event_id").cast("long").alias("step"), "value")
    seen = S.Arrivals(rows, _part(), "meters").run(3, ST.meters)
    last = seen.groupBy("rank").agg(F.max_by(F.struct("count", "sum", "val", "ema"), "count").alias("m")).select("rank", "m.*")
    return last.select("rank", "count", F.round("sum", 2).alias("sum"), "val", F.round("ema", 6).alias("ema"))


@query("ordered_reassembly", "T5 O15", f"""
with r as (select user_id as stream, row_number() over (partition by user_id order by event_id) - 1 as idx, {PART} as part from events)
select stream, idx, max(part) over (partition by stream order by idx) as released_in from r""")
def ordered_reassembly(t):
    from kilnset.operators.ranking import positions

    rows = positions(t.events.select("event_id", F.col("user_id").cast("long").alias("stream"), F.col("value").alias("payload")),
                     ["event_id"], ["stream"], name="idx")
    return S.Arrivals(rows, _part(), "reassembly").run(3, ST.reassemble).select("stream", "idx", "released_in")


@query("completed_mini_batches", "T5", f"""
with micro as (select event_id // 64 as mini_batch, event_id % 64 // 16 as micro, {PART} as part, count(*) as samples,
  sum(length(event_type)) as bytes from events group by 1, 2, 3)
select mini_batch, count(*) as micro_batches, sum(samples)::bigint as samples, sum(bytes)::bigint as bytes, max(part) as completed_in
from micro group by 1""")
def completed_mini_batches(t):
    # micro-batches of up to 16 samples; those of one mini-batch come in several arrivals
    events = t.events.withColumns({"mini_batch": F.floor(F.col("event_id") / 64), "part": _part()})
    micro = events.groupBy("mini_batch", F.floor(F.col("event_id") % 64 / 16).alias("micro"), "part").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.length("event_type")).alias("bytes"))
    sizes = events.groupBy("mini_batch").agg(F.count(F.lit(1)).alias("size"))
    return S.Arrivals(micro.join(sizes, "mini_batch"), F.col("part"), "mini-batches").run(3, ST.complete_mini_batches)


@query("streamed_stragglers", "T6", """
with g as (select user_id % 8 as node, user_id as rank, count(*) as batch_no, sum(case when event_type = 'error' then 1 else 0 end)::bigint as left_tasks,
  max(value) > 489 as finished from events group by 1, 2),
e as (select node, max(batch_no) as fastest, min(batch_no) as slowest from g group by 1)
select node, rank, batch_no, left_tasks, fastest, slowest, case when slowest = fastest then 'even' when batch_no > slowest or finished then 'fast'
  when left_tasks >= 5 then 'slow' else 'nearly_done' end as state from g join e using (node)""")
def streamed_stragglers(t):
    def totals(stream):
        named = stream.withColumns({"node": F.col("user_id") % 8, "rank": F.col("user_id")})
        return ST.progress_totals(named, F.col("event_type") == "error", F.col("value") > 489)

    feed = S.Arrivals(t.events, _part(), "stragglers")
    feed.run(3, totals, "complete", lambda batch, n: ST.straggler_report(batch, 5).write.mode("overwrite").parquet(f"{feed.base}/report/{n}"))
    return t.spark.read.parquet(f"{feed.base}/report/2")


@query("closed_epochs", "T7", f"""
with f as (select event_id // 50 as epoch, user_id % 4 as rank, min({PART}) as first from events group by 1, 2)
select epoch, max(first) as closed_in from f group by 1 having count(*) = 4""")
def closed_epochs(t):
    rows = t.events.select("event_id", F.floor(F.col("event_id") / 50).alias("epoch"), (F.col("user_id") % 4).cast("long").alias("rank"))
    return S.Arrivals(rows, _part(), "epochs").run(3, lambda s: ST.close_epochs(s, 4))


def _worker_rows(t):
    return t.events.select("event_id", (F.col("user_id") % 5).cast("long").alias("worker"), F.col("event_id").cast("long").alias("sample_id"))


@query("arrival_batches", "B7", f"""
with r as (select event_id as sample_id, user_id % 5 as worker, row_number() over (partition by user_id % 5 order by {PART}, event_id) - 1 as pos from events)
select worker, sample_id, pos // 32 as batch_id, pos % 32 as pos_in_batch from r""")
def arrival_batches(t):
    return S.Arrivals(_worker_rows(t), _part(), "arrivals").run(3, lambda s: ST.batch_arrivals(s, 32))


@query("full_arrival_batches", "B7", f"""
with r as (select event_id as sample_id, user_id % 5 as worker, row_number() over (partition by user_id % 5 order by {PART}, event_id) - 1 as pos,
  count(*) over (partition by user_id % 5) as n from events)
select worker, sample_id, pos // 33 as batch_id, pos % 33 as pos_in_batch from r where pos // 33 < n // 33""")
def full_arrival_batches(t):
    return S.Arrivals(_worker_rows(t), _part(), "full-arrivals").run(3, lambda s: ST.batch_arrivals(s, 33, drop_last=True))


@query("reporter_callback", "X6", f"""
select {PART} as batch_no, count(*) as n, max(value) as high from events group by 1""")
def reporter_callback(t):
    seen = []
    feed = S.Arrivals(t.events.select("event_id", "value"), _part(), "reports")
    feed.run(3, lambda s: s, handle=lambda batch, n: seen.append((n, *ST.summary(batch).values())))
    return t.spark.createDataFrame(seen, "batch_no int, n bigint, high double")


#: Ten days of events an arrival; a fifth of the rows is held up until the next one.
LATE = f"""
with e as (select event_id, ts, least(2, datediff('day', (select min(ts) from events), ts) // 10
  + case when {u('delay', SEED, 0, 'event_id')} < 0.2 then 1 else 0 end) as arrival from events),
h as (select arrival, max(ts) as high from e group by 1),
m as (select a.arrival, max(b.high) - interval '1 day' as mark from h a left join h b on b.arrival < a.arrival group by 1),
j as (select event_id, arrival::bigint as arrival, coalesce(ts < mark, false) as late from e join m using (arrival))"""


def _split_by_lateness(t):
    first = t.events.agg(F.min("ts").cast("date")).first()[0]
    held_up = F.when(uniform("delay", SEED, 0, "event_id") < 0.2, 1).otherwise(0)
    arrival = F.least(F.lit(2), F.floor(F.datediff(F.col("ts").cast("date"), F.lit(first)) / 10) + held_up)
    feed = S.Arrivals(t.events.select("event_id", "ts"), arrival, "late")
    split = LT.LateRows(t.spark, feed.base, "ts", "1 day")
    feed.run(3, lambda s: s, handle=split)
    return split.rows()


@query("late_rows", "T10", f"""{LATE}
select event_id, arrival from j where late""")
def late_rows(t):
    return _split_by_lateness(t).where("late").select("event_id", "arrival")


@query("late_counts", "T10", f"""{LATE}
select arrival, count(*) as n, count(*) filter (where late) as n_late from j group by 1""")
def late_counts(t):
    return _split_by_lateness(t).groupBy("arrival").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("late"), 1)).alias("n_late"))
