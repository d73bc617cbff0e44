"""Samplers and splits over orders, documents and embeddings."""

from pyspark.sql import functions as F

from kilnset.functions.hashing import uniform
from kilnset.operators import sampling as S
from kilnset.operators import splits as P
from kilnset.plans.registry import query, u
from kilnset.session import checkpoint

SEED = 42
PERM = f"row_number() over (order by {u('perm', SEED, 0, 'o_orderkey')}, o_orderkey) - 1"


@query("sequential_order", "O1", """
select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders""")
def sequential_order(t):
    return S.sequential(t.orders.select("o_orderkey"), "o_orderkey")


@query("random_permutation", "O2", f"select o_orderkey, {PERM} as pos from orders")
def random_permutation(t):
    return S.permutation(t.orders.select("o_orderkey"), "o_orderkey", SEED)


@query("draws_with_replacement", "O3", f"""
with pos as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders),
n as (select count(*) as n from orders),
draws as (select i as draw, cast(floor({u('draw', SEED, 0, 'i')} * n) as bigint) as pos
          from n, lateral (select unnest(range(n)) as i))
select draw, o_orderkey from draws join pos using (pos)""")
def draws_with_replacement(t):
    return S.draws_with_replacement(t.orders.select("o_orderkey"), "o_orderkey", SEED)


@query("subset_by_index", "F1", """
with idx as (select doc_id, row_number() over (order by doc_id) - 1 as pos from labels where quality = 1)
select pos, doc_id, n_chars from documents join idx using (doc_id)""")
def subset_by_index(t):
    index = S.sequential(t.labels.where("quality = 1").select("doc_id"), "doc_id")
    return S.subset(t.documents.select("doc_id", "n_chars"), "doc_id", index)


@query("subset_random_order", "O4", f"""
select doc_id, n_chars, row_number() over (order by {u('perm', SEED, 0, 'doc_id')}, doc_id) - 1 as pos
from documents where doc_id in (select doc_id from labels where quality = 1)""")
def subset_random_order(t):
    index = S.permutation(t.labels.where("quality = 1").select("doc_id"), "doc_id", SEED)
    return S.subset(t.documents.select("doc_id", "n_chars"), "doc_id", index)


@query("weighted_draws", "O5 J12", f"""
with w as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as w from orders),
s as (select o_orderkey, w, sum(w) over (order by o_orderkey) - w as lo from w where w > 0),
total as (select sum(w)::double as total, count(*) as n from w),
draws as (select i as draw, cast(floor({u('weighted', SEED, 0, 'i')} * total) as bigint) as at
          from total, lateral (select unnest(range(n)) as i))
select draw, o_orderkey from draws asof join s on draws.at >= s.lo""")
def weighted_draws(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return S.weighted_with_replacement(
        orders, "o_orderkey", F.col("o_totalprice"), orders.count(), SEED)


@query("weighted_without_replacement", "O6", f"""
select draw, o_orderkey from (
  select o_orderkey, row_number() over (order by -ln(1 - {u('race', SEED, 0, 'o_orderkey')}) / o_totalprice, o_orderkey) - 1 as draw
  from orders where o_totalprice > 0) where draw < 1000""")
def weighted_without_replacement(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return S.weighted_without_replacement(orders, "o_orderkey", F.col("o_totalprice"), 1000, SEED).select(
        "draw", "o_orderkey")


@query("weighted_half_without_replacement", "O6", f"""
select draw, o_orderkey from (
  select o_orderkey, row_number() over (order by -ln(1 - {u('race', SEED, 0, 'o_orderkey')}) / o_totalprice, o_orderkey) - 1 as draw
  from orders where o_totalprice > 0) where draw < (select count(*) // 2 from orders)""")
def weighted_half_without_replacement(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return S.weighted_without_replacement(
        orders, "o_orderkey", F.col("o_totalprice"), orders.count() // 2, SEED, heap=0).select("draw", "o_orderkey")


def _distributed_sql(table, key, replicas, drop):
    size = (f"case when n % {replicas} = 0 then n else greatest(cast(ceil((n - {replicas}) / {replicas}) as bigint), 0) * {replicas} end"
            if drop else f"cast(ceil(n / {replicas}) as bigint) * {replicas}")
    return f"""
with p as (select {key}, row_number() over (order by {u('perm', SEED, 0, key)}, {key}) - 1 as p0,
                  count(*) over () as n from {table}),
s as (select *, {size} as size from p),
x as (select {key}, unnest(range(p0, size, n)) as pos from s)
select {key}, pos, pos % {replicas} as rank, pos // {replicas} as rank_pos from x"""


@query("distributed_shards", "O7", _distributed_sql("orders", "o_orderkey", 7, False))
def distributed_shards(t):
    return S.distributed(t.orders.select("o_orderkey"), "o_orderkey", 7, SEED)


@query("distributed_shards_drop_last", "O7", _distributed_sql("orders", "o_orderkey", 7, True))
def distributed_shards_drop_last(t):
    return S.distributed(t.orders.select("o_orderkey"), "o_orderkey", 7, SEED, drop_last=True)


@query("distributed_shards_wrapped", "O8", _distributed_sql("embeddings", "vec_id", 4096, False))
def distributed_shards_wrapped(t):
    return S.distributed(t.embeddings.select("vec_id"), "vec_id", 4096, SEED)


@query("epoch_reshuffle", "O9", f"""
select epoch, o_orderkey,
  row_number() over (partition by epoch order by {u('perm', SEED, 'epoch', 'o_orderkey')}, o_orderkey) - 1 as pos
from orders, (values (0), (1)) e(epoch)""")
def epoch_reshuffle(t):
    epochs = t.orders.select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    return S.permutation(epochs, "o_orderkey", SEED, F.col("epoch"), groups=["epoch"])


@query("random_split_lengths", "O10", f"""
select o_orderkey, case when pos < n - n // 5 then 0 else 1 end as split
from (select o_orderkey, {PERM} as pos, count(*) over () as n from orders)""")
def random_split_lengths(t):
    orders = t.orders.select("o_orderkey")
    n = orders.count()
    return P.random_split(orders, "o_orderkey", [n - n // 5, n // 5], SEED).select("o_orderkey", "split")


def _quota_sql(table, target, size):
    return f"""
counts as (select {target}, count(*) as n_class from {table} group by 1),
tot as (select count(*) as n from {table}),
shares as (select {target}, n_class, {size} as size, (n_class * ({size})) // n as base, (n_class * ({size})) % n as rest
           from counts, tot),
spare as (select any_value(size) - sum(base) as spare from shares),
quota as (select {target}, n_class, base + case when row_number() over (order by rest desc, {target}) <= spare then 1 else 0 end as quota
          from shares, spare)"""


@query("stratified_shuffle_split", "O11", f"""
with {_quota_sql('orders', 'o_orderpriority', 'cast(ceil(n * 15 / 100) as bigint)')},
r as (select o_orderkey, o_orderpriority, split_idx,
        row_number() over (partition by split_idx, o_orderpriority
                           order by {u('strat', SEED, 'split_idx', 'o_orderkey')}, o_orderkey) - 1 as pos
      from orders, (values (0), (1)) s(split_idx))
select split_idx, o_orderkey, o_orderpriority, pos < quota as is_valid from r join quota using (o_orderpriority)""")
def stratified_shuffle_split(t):
    return P.stratified_shuffle_split(
        t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority",
        F.ceil(F.col("n") * 15 / 100), SEED, draws=2)


@query("reduced_dataset", "O12", f"""
with {_quota_sql('orders', 'o_orderpriority', '1000')},
r as (select o_orderkey, o_orderpriority,
        row_number() over (partition by o_orderpriority
                           order by {u('strat', SEED, 0, 'o_orderkey')}, o_orderkey) - 1 as pos from orders)
select o_orderkey, o_orderpriority from r join quota using (o_orderpriority) where pos < quota""")
def reduced_dataset(t):
    return P.reduce_stratified(
        t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 1000, SEED)


@query("class_filter_after_split", "F3", f"""
with {_quota_sql('orders', 'o_orderpriority', 'cast(ceil(n * 15 / 100) as bigint)')},
r as (select o_orderkey, o_orderpriority,
        row_number() over (partition by o_orderpriority order by {u('strat', SEED, 0, 'o_orderkey')}, o_orderkey) - 1 as pos
      from orders)
select o_orderkey, pos < quota as is_valid from r join quota using (o_orderpriority)
where o_orderpriority = '1-URGENT'""")
def class_filter_after_split(t):
    split = P.stratified_shuffle_split(
        t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority",
        F.ceil(F.col("n") * 15 / 100), SEED)
    return split.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "is_valid")


@query("worker_shards", "O13", """
select o_orderkey, pos, pos // cast(ceil(n / 6) as bigint) as worker from (
  select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)""")
def worker_shards(t):
    return P.worker_shards(t.orders.select("o_orderkey"), "o_orderkey", 6)


@query("even_parts", "O14", """
select o_orderpriority, o_orderkey,
  ntile(7) over (partition by o_orderpriority order by o_orderkey) - 1 as part from orders""")
def even_parts(t):
    parts = P.even_parts(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 7, ["o_orderpriority"])
    return parts.drop("pos")


@query("restore_send_order", "O15", f"""
with a as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as send_idx,
             row_number() over (order by {u('perm', 7, 0, 'o_orderkey')}, o_orderkey) - 1 as arrival from orders)
select o_orderkey, send_idx, arrival, max(arrival) over (order by send_idx) as released_at from a""")
def restore_send_order(t):
    sent = S.sequential(t.orders.select("o_orderkey"), "o_orderkey").withColumnRenamed("pos", "send_idx")
    arrived = S.permutation(sent, "o_orderkey", 7).withColumnRenamed("pos", "arrival")
    return S.restore_order(checkpoint(arrived), "send_idx", "arrival")


SPLIT_SQL = f"select o_orderkey, case when {u('half', SEED, 0, 'o_orderkey')} < 0.8 then 0 else 1 end as split from orders"


def _halves(t):
    split = t.orders.select("o_orderkey", F.when(uniform("half", SEED, 0, "o_orderkey") < 0.8, 0).otherwise(1).alias("split"))
    return split.where("split = 0").drop("split"), split.where("split = 1").drop("split")


@query("split_disjointness", "J10", f"""
with a as (select o_orderkey from orders where {u('half', SEED, 0, 'o_orderkey')} < 0.8),
b as (select o_orderkey from orders where {u('other', SEED, 0, 'o_orderkey')} < 0.5)
select case when o_orderkey in (select o_orderkey from b) then 'shared' else 'left_only' end as kind, count(*) as n
from a group by 1""")
def split_disjointness(t):
    # two draws that know nothing of each other, as a leaky split would have it
    left = t.orders.select("o_orderkey").where(uniform("half", SEED, 0, "o_orderkey") < 0.8)
    right = t.orders.select("o_orderkey").where(uniform("other", SEED, 0, "o_orderkey") < 0.5)
    return P.overlap_report(left, right, "o_orderkey")


@query("index_complement", "U5", f"""
with s as ({SPLIT_SQL})
(select o_orderkey, 'complement' as kind from (select o_orderkey from orders except all select o_orderkey from s where split = 0))
union all
(select o_orderkey, 'intersection' as kind from (select o_orderkey from orders intersect select o_orderkey from s where split = 0))""")
def index_complement(t):
    train, _ = _halves(t)
    every = t.orders.select("o_orderkey")
    rest = every.exceptAll(train).withColumn("kind", F.lit("complement"))
    return rest.unionByName(every.intersect(train).withColumn("kind", F.lit("intersection")))


@query("class_quota", "O11", f"""
with {_quota_sql('orders', 'o_orderpriority', 'cast(ceil(n * 15 / 100) as bigint)')}
select o_orderpriority, n_class, quota from quota""")
def class_quota(t):
    return P.class_quota(t.orders.select("o_orderpriority"), "o_orderpriority", F.ceil(F.col("n") * 15 / 100))
