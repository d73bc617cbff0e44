"""Batching, collation and lane queries."""

import pandas as pd
from pyspark.sql import functions as F

from kilnset.operators import batching as B
from kilnset.operators.ranking import positions
from kilnset.operators.sampling import permutation
from kilnset.plans.registry import query, u

SEED = 42
DOC_PERM = f"row_number() over (order by {u('perm', SEED, 0, 'doc_id')}, doc_id) - 1"
DOCS = f"d as (select doc_id, lang, n_chars, {DOC_PERM} as pos, count(*) over () as n from documents)"
ORD_PERM = f"row_number() over (order by {u('perm', SEED, 0, 'o_orderkey')}, o_orderkey) - 1"


def _docs(t):
    return permutation(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", SEED, total="n")


def _orders(t):
    return permutation(t.orders.select("o_orderkey"), "o_orderkey", SEED, total="n")


@query("epoch_microbatches", "O2 O7 B2", f"""
with p as (select vec_id, label, list_sum([v::double for v in embedding]) as x,
             row_number() over (order by {u('perm', SEED, 0, 'vec_id')}, vec_id) - 1 as p0, count(*) over () as n
           from embeddings),
c as (select *, unnest(range(p0, cast(ceil(n / 4) as bigint) * 4, n)) as g from p),
r as (select *, g % 4 as rank, g // 4 as pos from c)
select rank, pos // 32 as mini_id, pos // 4 as micro_id, count(*) as samples, cast(sum(label) as bigint) as sum_label,
       round(avg(x), 6) as mean_sum
from r where pos // 4 < cast(ceil(n / 4) as bigint) // 4
group by 1, 2, 3""")
def epoch_microbatches(t):
    rows = t.embeddings.select("vec_id", "label", F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v).alias("x"))
    return B.epoch_batches(rows, "vec_id", SEED, 0, 4, 4, 32).groupBy("rank", "mini_id", "micro_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("label").alias("sum_label"), F.round(F.avg("x"), 6).alias("mean_sum"))


@query("fixed_batches", "B1", f"select o_orderkey, pos // 64 as batch_id, pos % 64 as pos_in_batch from (select o_orderkey, {ORD_PERM} as pos from orders)")
def fixed_batches(t):
    return B.fixed_batches(_orders(t), 64).select("o_orderkey", "batch_id", "pos_in_batch")


@query("fixed_batches_drop_last", "B1", f"""
select o_orderkey, pos // 64 as batch_id, pos % 64 as pos_in_batch
from (select o_orderkey, {ORD_PERM} as pos, count(*) over () as n from orders) where pos // 64 < n // 64""")
def fixed_batches_drop_last(t):
    return B.fixed_batches(_orders(t), 64, drop_last=True).select("o_orderkey", "batch_id", "pos_in_batch")


@query("microbatch_bytes", "B2 G18", f"""
with {DOCS} select pos // 32 as mini_id, pos // 4 as micro_id, count(*) as samples, cast(sum(n_chars) as bigint) as bytes
from d where pos // 4 < n // 4 group by 1, 2""")
def microbatch_bytes(t):
    return B.micro_sizes(B.micro_batches(_docs(t), 4, 32), F.col("n_chars"))


@query("replicated_batches", "B3 X7", f"""
with {DOCS} select doc_id, pos // 16 as batch_id, copy from d, (values (0), (1), (2)) c(copy)""")
def replicated_batches(t):
    return B.replicate(B.fixed_batches(_docs(t), 16).select("doc_id", "batch_id"), 3)


@query("collated_batches", "B4 B8", f"""
with {DOCS} select pos // 16 as batch_id, count(*) as size, string_agg(cast(doc_id as varchar), ',' order by pos) as ids,
  string_agg(lang, ',' order by pos) as langs, string_agg(cast(n_chars as varchar), ',' order by pos) as sizes
from d group by 1""")
def collated_batches(t):
    rows = B.fixed_batches(_docs(t), 16)
    stacked = B.collate(rows, ["batch_id"], "pos_in_batch", ["doc_id", "lang", "n_chars"])
    return stacked.select(
        "batch_id", F.col("size"), F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("ids"),
        F.array_join("lang", ",").alias("langs"), F.array_join(F.col("n_chars").cast("array<string>"), ",").alias("sizes"))


@query("collated_records", "B4", f"""
with {DOCS} select pos // 16 as batch_id, string_agg(lang, ',' order by pos) as langs, string_agg(source, ',' order by pos) as sources,
  string_agg(cast(n_chars as varchar), ',' order by pos) as sizes, string_agg(cast(doc_id as varchar), ',' order by pos) as ids,
  cast(sum(n_chars + doc_id) as bigint) as total
from (select d.*, documents.source from d join documents using (doc_id)) group by 1""")
def collated_records(t):
    rows = B.fixed_batches(_docs(t), 16).join(t.documents.select("doc_id", "source"), "doc_id")
    rows = rows.select("batch_id", "pos_in_batch", F.struct("lang", F.struct("source").alias("at")).alias("names"),
                       F.create_map(F.lit("chars"), "n_chars", F.lit("id"), "doc_id").alias("numbers"),
                       F.array(F.array("n_chars", "doc_id")).alias("nested"))
    out = B.collate(rows, ["batch_id"], "pos_in_batch", ["names", "numbers", "nested"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("batch_id", text("names.lang").alias("langs"), text("names.at.source").alias("sources"),
                      text("numbers.chars").alias("sizes"), text("numbers.id").alias("ids"),
                      F.aggregate(F.flatten(F.flatten("nested")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("collated_tensors", "B4", f"""
with p as (select vec_id, label, embedding, row_number() over (order by {u('perm', SEED, 0, 'vec_id')}, vec_id) - 1 as pos from embeddings),
b as (select pos // 32 as batch_id, pos, label, list_sum([x::double for x in embedding]) as s, len(embedding) as width from p)
select batch_id, count(*) as size, max(width) as width, string_agg(cast(label as varchar), ',' order by pos) as labels,
  round(sum(s), 6) as total from b group by 1""")
def collated_tensors(t):
    rows = B.fixed_batches(permutation(t.embeddings, "vec_id", SEED, total="n"), 32)
    stacked = B.collate(rows, ["batch_id"], "pos_in_batch", ["embedding", "label"])
    total = F.aggregate(F.flatten("embedding"), F.lit(0.0), lambda a, x: a + x)
    return stacked.select(
        "batch_id", "size", F.size(F.element_at("embedding", 1)).cast("bigint").alias("width"),
        F.array_join(F.col("label").cast("array<string>"), ",").alias("labels"), F.round(total, 6).alias("total"))


@query("user_collate", "X3", f"""
with {DOCS} select pos // 16 as batch_id, max(n_chars) as longest, cast(sum(n_chars) as bigint) as chars from d group by 1""")
def user_collate(t):
    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": [pdf.batch_id.iloc[0]], "longest": [pdf.n_chars.max()], "chars": [pdf.n_chars.sum()]})

    rows = B.fixed_batches(_docs(t), 16).select("batch_id", "n_chars")
    return B.collate_with(rows, ["batch_id"], stack, "batch_id long, longest long, chars long")


@query("converted_fields", "B5", """
select vec_id, cast(label as bigint) as label, round(list_sum([x::double for x in embedding]), 6) as total from embeddings""")
def converted_fields(t):
    rows = B.default_convert(t.embeddings, ["label", "embedding"])
    return rows.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("reassembled_minibatches", "B6 W8", f"""
with {DOCS}, m as (select pos // 32 as mini_id, pos // 4 as micro_id, count(*) as k, string_agg(cast(doc_id as varchar), ',' order by doc_id) as part
  from d where pos // 4 < n // 4 group by 1, 2),
o as (select *, coalesce(sum(k) over (partition by mini_id order by micro_id rows between unbounded preceding and 1 preceding), 0) as off from m)
select mini_id, string_agg(cast(off as varchar), ',' order by micro_id) as offsets, string_agg(part, ',' order by micro_id) as content
from o group by 1""")
def reassembled_minibatches(t):
    rows = B.micro_batches(_docs(t), 4, 32)
    whole = B.reassemble(rows, "mini_id", "micro_id", F.col("doc_id"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return whole.select("mini_id", join("offsets"), join("content"))


@query("loader_length", "B9", """
select count(*) as samples, count(*) // 256 as batches from lineitem""")
def loader_length(t):
    return B.batch_length(t.lineitem, 256, drop_last=True)


@query("loader_length_keep_last", "B9", """
select count(*) as samples, cast(ceil(count(*) / 256) as bigint) as batches from lineitem""")
def loader_length_keep_last(t):
    return B.batch_length(t.lineitem, 256, drop_last=False)


@query("sampler_hook", "X4 B8 J1", """
select doc_id, lang, pos // 16 as batch_id, pos % 16 as pos_in_batch from (
  select doc_id, lang, row_number() over (order by n_chars, doc_id) - 1 as pos from documents)""")
def sampler_hook(t):
    def shortest_first(samples):
        return positions(samples.select("doc_id", "n_chars"), ["n_chars", "doc_id"], total="n")

    return B.fetch_batches(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", shortest_first, 16).drop("n_chars")


LANES = f"""{DOCS}, m as (select pos // 32 as mini_id, pos // 4 as micro_id, cast(sum(n_chars) as bigint) as bytes
  from d where pos // 4 < n // 4 group by 1, 2),
l as (select *, row_number() over (partition by mini_id order by bytes, micro_id desc) - 1 as place,
        floor(count(*) over (partition by mini_id) * 0.75) as quota from m)"""


@query("size_balanced_lanes", "B10 L2", f"""
with {LANES} select mini_id, micro_id, bytes, place, case when place < quota then 'cpu' else 'gpu' end as lane from l""")
def size_balanced_lanes(t):
    micros = B.micro_sizes(B.micro_batches(_docs(t), 4, 32), F.col("n_chars")).drop("samples")
    return B.size_lanes(micros, 0.75).withColumn("place", F.col("place").cast("bigint"))


@query("lane_bytes", "B10", f"""
with {LANES} select case when place < quota then 'cpu' else 'gpu' end as lane, count(*) as micros, cast(sum(bytes) as bigint) as bytes from l group by 1""")
def lane_bytes(t):
    micros = B.micro_sizes(B.micro_batches(_docs(t), 4, 32), F.col("n_chars"))
    return B.size_lanes(micros, 0.75).groupBy("lane").agg(F.count(F.lit(1)).alias("micros"), F.sum("bytes").alias("bytes"))


OFFLOAD = f"""
with p as (select o_orderkey, {ORD_PERM} as pos, count(*) over () as n from orders),
b as (select o_orderkey, pos // 50 as batch_id, pos % 50 as pos_in_batch, least(50, n - (pos // 50) * 50) as size from p),
r as (select *, cast(floor(size * 0.3::double) as bigint) as remote from b)
select o_orderkey, batch_id, pos_in_batch, case when pos_in_batch < remote then 'remote' else 'local' end as lane,
  case when pos_in_batch >= remote then (pos_in_batch - remote) // cast(ceil((size - remote) / 4) as bigint) end as worker
from r"""


@query("worker_chunks", "B11 J9", OFFLOAD)
def worker_chunks(t):
    rows = B.fixed_batches(_orders(t), 50)
    return B.offload_lanes(rows, 50, 0.3, 4).drop("pos", "n")


@query("rejoined_lanes", "J9", f"select o_orderkey, batch_id, pos_in_batch, lane from ({OFFLOAD})")
def rejoined_lanes(t):
    rows = B.offload_lanes(B.fixed_batches(_orders(t), 50), 50, 0.3, 4).select("o_orderkey", "batch_id", "pos_in_batch", "lane")
    return B.rejoin_lanes(rows.where("lane = 'remote'"), rows.where("lane = 'local'"))
