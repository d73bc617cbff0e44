"""Metric, meter, window and search queries."""

from pyspark.sql import functions as F

from kilnset.functions import tensors as X
from kilnset.functions.hashing import uniform
from kilnset.operators import meters as M
from kilnset.operators import metrics as E
from kilnset.operators import telemetry as L
from kilnset.operators import trials as R
from kilnset.operators.batching import fixed_batches
from kilnset.operators.filters import iteration_window
from kilnset.operators.joins import mixup
from kilnset.operators.sampling import permutation
from kilnset.plans.registry import query, u
from kilnset.sources.catalog import SEARCH_OPS

SEED = 42
LOGITS = "[x::double for x in embedding]"
LSM = "[x - (list_max(z) + ln(list_sum([exp(y - list_max(z)) for y in z]))) for x in z]"
RANK = ("1 + len(list_filter(range(1, len(z) + 1), lambda i: z[i] > z[label + 1] or (z[i] = z[label + 1] and i < label + 1)))")
PRED = f"p as (select vec_id, label, {LOGITS} as z from embeddings)"
K = "cast(json_extract_string(props, '$.k') as bigint)"


def _preds(t):
    return t.embeddings.select("vec_id", "label", X.doubles(F.col("embedding")).alias("z"))


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


@query("average_meter", "G1", f"""
select event_type, round(arg_max(value, event_id), 6) as val, round(sum(value * {K}), 2) as sum, cast(sum({K}) as bigint) as count,
  round(sum(value * {K}) / sum({K}), 6) as avg from events group by 1""")
def average_meter(t):
    m = M.average_meter(t.events, F.col("value"), _k(), "event_id", ["event_type"])
    return m.select("event_type", F.round("val", 6).alias("val"), F.round("sum", 2).alias("sum"), "count", F.round("avg", 6).alias("avg"))


@query("dict_accumulator", "G2", f"""
with s as (select event_type, sum(value) as loss, sum({K})::double as k, count(*)::double as cnt from events group by 1)
select event_type, 'loss' as key, round(loss / cnt, 6) as value from s union all
select event_type, 'k', round(k / cnt, 6) from s union all select event_type, 'cnt', round(cnt, 6) from s""")
def dict_accumulator(t):
    dicts = t.events.select("event_type", F.create_map(
        F.lit("loss"), F.col("value"), F.lit("k"), _k().cast("double"), F.lit("cnt"), F.lit(1.0)).alias("d"))
    out = M.accumulate(dicts, "d", "cnt", ["event_type"])
    return out.select("event_type", "key", F.round("value", 6).alias("value"))


@query("topk_accuracy", "G3", f"""
with {PRED}, r as (select {RANK} as rank from p)
select count(*) as n, round(avg((rank <= 1)::int) * 100, 6) as top1, round(avg((rank <= 5)::int) * 100, 6) as top5 from r""")
def topk_accuracy(t):
    acc = E.topk_accuracy(_preds(t), "z", "label", [1, 5], percent=True)
    return acc.select("n", F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


@query("label_smooth_loss", "G4", f"""
with {PRED}, l as (select *, {LSM} as lp from p)
select vec_id, round(-list_sum([((case when i = label + 1 then 1.0 else 0.0 end) * (1 - 0.1::double) + 0.1::double / 64) * lp[i] for i in range(1, 65)]), 6) as loss from l""")
def label_smooth_loss(t):
    out = E.reduce_loss(_preds(t), E.label_smooth_loss(F.col("z"), F.col("label"), 64, 0.1), "none")
    return out.select("vec_id", F.round("loss", 6).alias("loss"))


@query("label_smooth_loss_mean", "G4", f"""
with {PRED}, l as (select *, {LSM} as lp from p),
m as (select label, -list_sum([((case when i = label + 1 then 1.0 else 0.0 end) * (1 - 0.1::double) + 0.1::double / 64) * lp[i] for i in range(1, 65)]) as loss from l)
select label, round(avg(loss), 6) as loss from m group by 1""")
def label_smooth_loss_mean(t):
    out = E.reduce_loss(_preds(t), E.label_smooth_loss(F.col("z"), F.col("label"), 64, 0.1), "mean", ["label"])
    return out.select("label", F.round("loss", 6).alias("loss"))


@query("soft_smooth_loss", "G5", f"""
with {PRED}, l as (select *, {LSM} as lp from p)
select vec_id, round(-list_sum([((case when i = label + 1 then 1.0 else 0.0 end) * (1 - (0.1::double / 64)) + (0.1::double / 64)) * lp[i] for i in range(1, 65)]), 6) as loss from l""")
def soft_smooth_loss(t):
    loss = E.soft_smooth_loss(F.col("z"), X.one_hot(F.col("label"), 64), 64, 0.1)
    return _preds(t).select("vec_id", F.round(loss, 6).alias("loss"))


def _ce(col):
    return f"-list_sum([((case when i = {col} + 1 then 1.0 else 0.0 end) * (1 - 0.1::double) + 0.1::double / 64) * lp[i] for i in range(1, 65)])"


@query("mixup_loss", "G6", f"""
with q as (select vec_id, label, embedding, row_number() over (order by {u('perm', SEED, 0, 'vec_id')}, vec_id) - 1 as pos from embeddings),
b as (select *, pos // 32 as batch_id, pos % 32 as place from q),
m as (select batch_id, row_number() over (partition by batch_id order by {u('mix', SEED, 0, 'vec_id')}, vec_id) - 1 as place,
        label as label2, embedding as other from b),
j as (select *, {u('lam0', SEED, 0, 'batch_id')} as d from b join m using (batch_id, place)),
g as (select vec_id, label, label2, greatest(d, 1 - d) as lam,
        [embedding[i]::double * greatest(d, 1 - d) + other[i]::double * (1 - greatest(d, 1 - d)) for i in range(1, 65)] as z from j),
l as (select *, {LSM} as lp from g)
select vec_id, round(lam * ({_ce('label')}) + (1 - lam) * ({_ce('label2')}), 6) as loss from l""")
def mixup_loss(t):
    rows = fixed_batches(permutation(t.embeddings, "vec_id", SEED, total="n"), 32)
    mixed = mixup(rows, "vec_id", "embedding", "label", SEED, 0).withColumn("z", F.col("mixed"))
    loss = E.mixup_loss(F.col("z"), F.col("label"), F.col("partner_target"), F.col("lam"), 64, 0.1)
    return mixed.select("vec_id", F.round(loss, 6).alias("loss"))


TTA = f"""
a as (select vec_id, label, vec_id // 50 as batch_id, [x::double for x in embedding[p * 16 + 1 : p * 16 + 16]] as z
      from embeddings, (values (0), (1), (2), (3)) v(p)),
l as (select vec_id, batch_id, -({LSM})[label + 1] as loss, case when {RANK} = 1 then 1 else 0 end as correct from a),
best as (select vec_id, min(loss) as loss, max(correct) as correct from l group by 1)"""


def _tta(t):
    views = t.embeddings.select(
        "vec_id", "label", F.floor(F.col("vec_id") / 50).alias("batch_id"), "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("policy")).withColumn(
        "z", X.doubles(F.slice("embedding", F.col("policy") * 16 + 1, F.lit(16))))
    loss = -F.element_at(X.log_softmax(F.col("z")), F.col("label") + 1)
    hit = (X.target_rank(F.col("z"), F.col("label")) == 1).cast("int")
    return views.select("vec_id", "batch_id", loss.alias("loss"), hit.alias("correct"))


@query("tta_metrics", "G7", f"""
with {TTA} select count(*) as cnt, round(-sum(loss) / count(*), 6) as minus_loss, round(sum(correct) / count(*), 6) as top1_valid from best""")
def tta_metrics(t):
    out = E.tta_metrics(_tta(t), "vec_id", "loss", "correct")
    return out.select("cnt", F.round("minus_loss", 6).alias("minus_loss"), F.round("top1_valid", 6).alias("top1_valid"))


@query("tta_metrics_batch_minimum", "G7", f"""
with {TTA}, lows as (select sum(low) as lows from (select min(loss) as low from l group by batch_id))
select count(*) as cnt, round(-any_value(lows) / count(*), 6) as minus_loss, round(sum(correct) / count(*), 6) as top1_valid from best, lows""")
def tta_metrics_batch_minimum(t):
    out = E.tta_metrics(_tta(t), "vec_id", "loss", "correct", "batch_id")
    return out.select("cnt", F.round("minus_loss", 6).alias("minus_loss"), F.round("top1_valid", 6).alias("top1_valid"))


@query("epoch_metrics", "G8", f"""
with a as (select vec_id // 50 as batch_id, epoch, label, [x::double for x in embedding[epoch * 16 + 1 : epoch * 16 + 16]] as z
      from embeddings, (values (0), (1), (2), (3)) v(epoch)),
b as (select epoch, batch_id, count(*) as size, avg(-({LSM})[label + 1]) as loss, avg(({RANK} <= 1)::int) as top1, avg(({RANK} <= 5)::int) as top5
      from a group by 1, 2)
select epoch, cast(sum(size) as bigint) as cnt, round(sum(loss * size) / sum(size), 6) as loss, round(sum(top1 * size) / sum(size), 6) as top1,
  round(sum(top5 * size) / sum(size), 6) as top5 from b group by 1""")
def epoch_metrics(t):
    z = X.doubles(F.slice("embedding", F.col("epoch") * 16 + 1, F.lit(16)))
    rows = t.embeddings.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "epoch", F.floor(F.col("vec_id") / 50).alias("batch_id"), "label", z.alias("z"))
    rank = X.target_rank(F.col("z"), F.col("label"))
    batches = rows.select("epoch", "batch_id", (-F.element_at(X.log_softmax(F.col("z")), F.col("label") + 1)).alias("loss"),
                          rank.alias("rank")).groupBy("epoch", "batch_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg("loss").alias("loss"), F.avg((F.col("rank") <= 1).cast("double")).alias("top1"),
        F.avg((F.col("rank") <= 5).cast("double")).alias("top5"))
    out = E.epoch_metrics(batches, ["loss", "top1", "top5"], "size", ["epoch"])
    return out.select("epoch", "cnt", *[F.round(c, 6).alias(c) for c in ("loss", "top1", "top5")])


@query("best_epoch", "G9", f"""
with e as (select user_id, cast(date_part('day', ts) as int) as epoch, max({K}) as top1, min(value) as loss from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by top1 desc, epoch) as rn from e)
select user_id, epoch, top1, loss from r where rn = 1""")
def best_epoch(t):
    epochs = t.events.groupBy("user_id", F.dayofmonth("ts").alias("epoch")).agg(F.max(_k()).alias("top1"), F.min("value").alias("loss"))
    return E.best_epoch(epochs, "epoch", "top1", ["user_id"])


@query("mode_means", "G10", """
select p_type as mode, count(*) as experiments, round(avg(p_retailprice), 6) as p_retailprice, round(avg(p_size), 6) as p_size from part group by 1""")
def mode_means(t):
    out = R.mode_means(t.part.withColumnRenamed("p_type", "mode"), "mode", ["p_retailprice", "p_size"])
    return out.select("mode", "experiments", F.round("p_retailprice", 6).alias("p_retailprice"), F.round("p_size", 6).alias("p_size"))


@query("gpu_hours", "G11", "select round(sum(value) / 3600, 6) as gpu_hours from events")
def gpu_hours(t):
    return R.gpu_hours(t.events, "value").select(F.round("gpu_hours", 6).alias("gpu_hours"))


@query("iteration_throughput", "G12 F9", """
with s as (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as step from events)
select user_id, count(*) as iterations, round(avg(256::double / value), 6) as mean_rate, round(count(*) * 256 / sum(value), 6) as overall_rate
from s where step >= 3 and step < 300 - 10 group by 1""")
def iteration_throughput(t):
    steps = iteration_window(t.events.select("user_id", "event_id", "value"), "user_id", ["event_id"], 3, 300, 10)
    out = L.throughput(steps, 256, "value", ["user_id"])
    return out.select("user_id", "iterations", F.round("mean_rate", 6).alias("mean_rate"), F.round("overall_rate", 6).alias("overall_rate"))


@query("stage_latency", "G13", """
select event_type as stage, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high,
  round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99
from events group by 1""")
def stage_latency(t):
    rows = t.events.select(F.col("event_type").alias("stage"), "value", "event_id")
    out = L.stage_latency(rows, "stage", "value", "event_id", [0.5, 0.9, 0.99])
    return out.select("stage", "n", F.round("mean", 6).alias("mean"), "low", "high", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("offload_choice", "G14", f"""
with m as (select user_id, event_type as pipeline, avg(value) as cpu, avg(500 / (value + 1)) as train_rate, avg(400 / (value + {K} + 1)) as rate
  from events group by 1, 2),
b as (select user_id, cpu as p, train_rate as g, rate as l from m where pipeline = 'view'),
c as (select m.user_id, pipeline, cpu as o, rate as r, p, g, l, l * (1 - cpu / p) + rate as value from m join b using (user_id) where pipeline <> 'view'),
r as (select *, row_number() over (partition by user_id order by value desc, pipeline) as rn from c),
x as (select *, (g - l) * (1 + o / p) as lower from r where rn = 1)
select user_id, pipeline, round(value, 6) as value, round(lower, 6) as lower,
  round(case when lower < r then r / g else r / (l + r) end, 6) as offload_ratio from x""")
def offload_choice(t):
    rows = t.events.select(
        "user_id", F.col("event_type").alias("pipeline"), F.col("value").alias("cpu"), (500 / (F.col("value") + 1)).alias("train_rate"),
        (400 / (F.col("value") + _k() + 1)).alias("rate"))
    out = L.choose_pipeline(rows, "user_id", "pipeline", "view")
    return out.select("user_id", "pipeline", *[F.round(c, 6).alias(c) for c in ("value", "lower", "offload_ratio")])


@query("straggler_report", "G15", """
with g as (select user_id % 8 as node, user_id as rank, count(*) as batch_no, sum(case when event_type = 'error' then 1 else 0 end)::bigint as left_tasks,
  max(event_id) = (select max(event_id) from events) as finished from events group by 1, 2),
e as (select node, max(batch_no) as fastest, min(batch_no) as slowest from g group by 1)
select node, rank, batch_no, left_tasks, fastest, slowest, case when slowest = fastest then 'even' when batch_no > slowest or finished then 'fast'
  when left_tasks >= 5 then 'slow' else 'nearly_done' end as state from g join e using (node)""")
def straggler_report(t):
    last = t.events.agg(F.max("event_id"))
    progress = t.events.groupBy((F.col("user_id") % 8).alias("node"), F.col("user_id").alias("rank")).agg(
        F.count(F.lit(1)).alias("batch_no"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("left_tasks"),
        F.max("event_id").alias("newest")).withColumn("finished", F.col("newest") == last.scalar())
    return L.stragglers(progress, "node", "rank", "batch_no", "left_tasks", "finished", 5)


@query("remaining_work", "G16", """
with s as (select l_suppkey, count(*) as planned, sum(case when l_shipdate < timestamp '2001-01-01' then 1 else 0 end)::bigint as sent,
  sum(case when l_shipdate < timestamp '2001-01-01' and l_linestatus = 'F' then 1 else 0 end)::bigint as done from lineitem group by 1)
select *, planned - sent as unsent, sent - done as queued, planned - done as left_tasks from s""")
def remaining_work(t):
    sent = F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    return L.remaining_work(t.lineitem, ["l_suppkey"], sent, sent & (F.col("l_linestatus") == "F"))


@query("class_cardinality", "G17", "select count(*) as samples, count(distinct l_partkey) as classes from lineitem")
def class_cardinality(t):
    return L.class_cardinality(t.lineitem, "l_partkey")


@query("class_counts", "G17", "select label, count(*) as n from embeddings group by 1")
def class_counts(t):
    return L.class_counts(t.embeddings, "label")


@query("running_average", "W1", f"""
select event_id, user_id, round(cast(sum(cast(value as decimal(18, 2)) * {K}) over w as double) / nullif(sum({K}) over w, 0), 6) as run_avg from events
window w as (partition by user_id order by event_id)""")
def running_average(t):
    # two-decimal values add up exactly as decimals, whatever the order
    rows = t.events.select("event_id", "user_id", F.col("value").cast("decimal(18,2)").alias("value"), _k().alias("k"))
    out = M.running_average(rows, F.col("value"), F.col("k"), ["event_id"], ["user_id"])
    return out.select("event_id", "user_id", F.round("run_avg", 6).alias("run_avg"))


@query("iteration_times", "W2", """
select event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by event_id) as iter_us from events""")
def iteration_times(t):
    rows = t.events.select("event_id", "user_id", "ts")
    out = M.iteration_times(rows, F.unix_micros(F.col("ts").cast("timestamp")), ["event_id"], ["user_id"])
    return out.select("event_id", "user_id", "iter_us")


@query("loss_ema", "W3", """
with recursive s as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events),
e as (select user_id, event_id, k, value as ema from s where k = 1
      union all select s.user_id, s.event_id, s.k, e.ema * 0.9::double + s.value * (1 - 0.9::double) from e join s on s.user_id = e.user_id and s.k = e.k + 1)
select user_id, event_id, round(ema, 6) as ema from e""")
def loss_ema(t):
    rows = t.events.select("user_id", "event_id", "value")
    return M.loss_ema(rows, F.col("value"), ["event_id"], ["user_id"]).select("user_id", "event_id", F.round("ema", 6).alias("ema"))


@query("warmup_ema", "W4", """
with recursive s as (select event_type, event_id, value, row_number() over (partition by event_type order by event_id) as k from events),
e as (select event_type, event_id, k, value as ema from s where k = 1
      union all select s.event_type, s.event_id, s.k, e.ema * least(0.99::double, s.k::double / (9 + s.k)) + s.value * (1 - least(0.99::double, s.k::double / (9 + s.k)))
      from e join s on s.event_type = e.event_type and s.k = e.k + 1)
select event_type, event_id, round(ema, 6) as ema from e""")
def warmup_ema(t):
    rows = t.events.select("event_type", "event_id", "value")
    return M.warmup_ema(rows, F.col("value"), ["event_id"], ["event_type"], 0.99).select("event_type", "event_id", F.round("ema", 6).alias("ema"))


@query("best_so_far", "W6", """
select user_id, event_id, max(value) over (partition by user_id order by event_id) as best from events""")
def best_so_far(t):
    return M.best_so_far(t.events.select("user_id", "event_id", "value"), F.col("value"), ["event_id"], ["user_id"]).drop("value")


@query("top_trials_per_fold", "W5", """
select p_brand as fold, p_partkey as trial_id, p_retailprice as reward, place from (
  select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part) where place <= 10""")
def top_trials_per_fold(t):
    rows = t.part.select(F.col("p_brand").alias("fold"), F.col("p_partkey").alias("trial_id"), F.col("p_retailprice").alias("reward"))
    return R.top_per_fold(rows, "fold", "reward", "trial_id")


@query("top_trials", "L4", """
select p_partkey as trial_id, p_retailprice as reward from part order by p_retailprice desc, p_partkey limit 20""")
def top_trials(t):
    rows = t.part.select(F.col("p_partkey").alias("trial_id"), F.col("p_retailprice").alias("reward"))
    return R.top_trials(rows, "reward", "trial_id", 20)


@query("vector_topk", "L3", """
select vec_id, array_to_string([i - 1 for i in list_transform(list_sort([{'x': -embedding[i]::double, 'i': i} for i in range(1, 65)]), lambda s: s.i)[1:5]], ',') as top
from embeddings""")
def vector_topk(t):
    return t.embeddings.select("vec_id", X.join_numbers(X.top_k(X.doubles(F.col("embedding")), 5)).alias("top"))


def _trials(t):
    def entries(kind, expr):
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(1)), lambda j: F.struct(
                F.concat_ws("_", F.lit(kind), i.cast("string"), j.cast("string")).alias("k"), expr(kind, i, j).alias("v")))))

    def draw(kind, i, j):
        return uniform(kind, SEED, 0, "p_partkey", i, j)

    op = entries("policy", lambda k, i, j: F.floor(draw(k, i, j) * len(SEARCH_OPS)).cast("double"))
    config = F.map_from_entries(F.concat(op, entries("prob", draw), entries("level", draw)))
    trials = t.part.select(F.col("p_brand").alias("fold"), F.col("p_partkey").alias("trial_id"), F.col("p_retailprice").alias("reward"), "p_partkey")
    return R.spread(trials).select("fold", "trial_id", "reward", config.alias("config"))


OPS_SQL = "[" + ", ".join(f"'{o}'" for o in SEARCH_OPS) + "]"
DECODED = f"""
dec as (select p_brand as fold, p_partkey as trial_id, p_retailprice as reward, i as policy_id, j as op_idx,
  {OPS_SQL}[1 + floor({u('policy', SEED, 0, 'p_partkey', 'i', 'j')} * {len(SEARCH_OPS)})::int] as op,
  {u('prob', SEED, 0, 'p_partkey', 'i', 'j')} as prob, {u('level', SEED, 0, 'p_partkey', 'i', 'j')} as level
  from part, (values (0), (1), (2), (3), (4)) a(i), (values (0), (1)) b(j))"""


@query("decoded_policies", "J11", f"""
with {DECODED} select fold, trial_id, policy_id, op_idx, op, round(prob, 9) as prob, round(level, 9) as level from dec""")
def decoded_policies(t):
    decoded = R.decode_policies(_trials(t), "config", 5, 2, SEARCH_OPS)
    return decoded.select("fold", "trial_id", "policy_id", F.posexplode("ops").alias("op_idx", "o")).select(
        "fold", "trial_id", "policy_id", "op_idx", "o.op", F.round("o.prob", 9).alias("prob"), F.round("o.level", 9).alias("level"))


@query("unique_policies", "U3", f"""
with {DECODED}, k as (select trial_id, policy_id, string_agg(op, '_' order by op_idx) as op_key from dec group by 1, 2),
r as (select *, row_number() over (partition by op_key order by trial_id, policy_id) as rn from k)
select op_key, trial_id, policy_id from r where rn = 1""")
def unique_policies(t):
    decoded = R.decode_policies(_trials(t), "config", 5, 2, SEARCH_OPS)
    return R.unique_policies(decoded, [], ["trial_id", "policy_id"]).select("op_key", "trial_id", "policy_id")


@query("search_final_policies", "W5 J11 U3 U1", f"""
with {DECODED}, best as (select p_partkey as trial_id from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part) where place <= 10),
k as (select fold, trial_id, policy_id, string_agg(op, '_' order by op_idx) as op_key from dec where trial_id in (select trial_id from best) group by 1, 2, 3),
r as (select *, row_number() over (partition by trial_id, op_key order by policy_id) as rn from k)
select fold, trial_id, policy_id, op_key from r where rn = 1""")
def search_final_policies(t):
    best = R.top_per_fold(_trials(t), "fold", "reward", "trial_id")
    decoded = R.decode_policies(best, "config", 5, 2, SEARCH_OPS)
    return R.unique_policies(decoded, ["trial_id"], ["policy_id"]).select("fold", "trial_id", "policy_id", "op_key")
