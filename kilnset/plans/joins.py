"""Lookup, pairing and concatenation queries."""

from pyspark.sql import functions as F

from kilnset.operators import filters as P
from kilnset.operators import joins as J
from kilnset.operators.batching import fixed_batches
from kilnset.operators.ranking import positions
from kilnset.operators.sampling import permutation
from kilnset.functions.hashing import pick, uniform
from kilnset.plans.registry import query, u

SEED = 42


@query("sample_targets", "J1", """
select doc_id, lang, n_chars, quality, toxic from documents join labels using (doc_id)""")
def sample_targets(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")


@query("synonym_counts", "J2 S7", """
with leaf as (select n_nationkey as idx, n_name || ', ' || lower(n_name) as names from nation
              where n_nationkey not in (select n_regionkey + 1000 from nation)),
syn as (select idx, unnest(string_split(names, ', ')) as class_name from leaf)
select class_name, idx, count(*) as customers from syn join customer on idx = c_nationkey group by 1, 2""")
def synonym_counts(t):
    leaf = t.nation.select(
        F.col("n_nationkey").alias("idx"), F.concat_ws(", ", "n_name", F.lower("n_name")).alias("names"))
    names = J.synonym_index(leaf, "idx", "names")
    # customers are counted per class before the fan-out to synonyms
    per_class = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return names.join(per_class, F.col("idx") == F.col("c_nationkey")).drop("c_nationkey")


FILES = "select 'wavs/' || role || '/' || conv_id || '_' || turn || '.wav' as path from conversations"
STEM = "split_part(list_extract(string_split(path, '/'), -1), '.', 1)"


def _stem(files):
    """The file name without folder and extension, as the lookup key."""
    return files.withColumn("id", F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1))


@query("transcript_join", "J3", f"""
select path, id, md5(text) as text_md5 from (select path, {STEM} as id from ({FILES}))
join (select conv_id || '_' || turn as id, text from conversations) using (id)""")
def transcript_join(t):
    path = F.concat(F.lit("wavs/"), "role", F.lit("/"), "conv_id", F.lit("_"), "turn", F.lit(".wav"))
    files = _stem(t.conversations.select(path.alias("path")))
    transcripts = t.conversations.select(F.concat("conv_id", F.lit("_"), "turn").alias("id"), "text")
    matched, _ = J.transcript_join(files, transcripts, "id")
    return matched.select("path", "id", F.md5("text").alias("text_md5"))


@query("transcript_orphans", "J3", f"""
select path, id from (select path, {STEM} as id from (select 'texts/' || lang || '/' || doc_id || '.txt' as path from documents))
where id not in (select doc_id::varchar from labels where doc_id is not null)""")
def transcript_orphans(t):
    # every document is a file, but only some have a row in the lookup
    path = F.concat(F.lit("texts/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))
    lookup = t.labels.select(F.col("doc_id").cast("string").alias("id"), "quality")
    return J.transcript_join(_stem(t.documents.select(path.alias("path"))), lookup, "id")[1]


SIZES = """sizes as (select 0 as ordinal, count(*) as n from documents union all select 1, count(*) from pages
  union all select 2, count(*) from benchmark),
cum as (select ordinal, n, sum(n) over (order by ordinal) - n as lo from sizes), tot as (select sum(n) as total from sizes)"""


@query("concat_addresses", "J4 W7", f"""
with {SIZES}, req as (select event_id, cast(floor({u('addr', SEED, 0, 'event_id')} * (2 * total)) as bigint) - total::bigint as idx from events, tot),
r as (select idx, case when idx < 0 then idx + total else idx end as spot, count(*) as times from req, tot group by 1, 2)
select cast(idx as bigint) as idx, times, ordinal, cast(spot - lo as bigint) as local_idx from r join cum on spot >= lo and spot < lo + n""")
def concat_addresses(t):
    sizes = None
    for i, d in enumerate((t.documents, t.pages, t.benchmark)):
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("ordinal"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    total = sizes.agg(F.sum("n"))
    req = t.events.select("event_id").withColumn("total", total.scalar()).select(
        (pick(uniform("addr", SEED, 0, "event_id"), 2 * F.col("total")) - F.col("total")).alias("idx"))
    return J.resolve_addresses(req, sizes)


@query("concatenated_datasets", "U1", """
with a as (select 0 as ordinal, doc_id as id from documents union all select 1, page_id from pages union all select 2, item_id from benchmark)
select ordinal, id, row_number() over (partition by ordinal order by id) - 1 as local_idx,
  row_number() over (order by ordinal, id) - 1 as global_idx from a""")
def concatenated_datasets(t):
    parts = [t.documents.select(F.col("doc_id").alias("id")), t.pages.select(F.col("page_id").alias("id")),
             t.benchmark.select(F.col("item_id").alias("id"))]
    return J.concat_index(parts, "id")


@query("mixup_pairs", "J5", f"""
with p as (select vec_id, label, embedding, row_number() over (order by {u('perm', SEED, 0, 'vec_id')}, vec_id) - 1 as pos from embeddings),
b as (select *, pos // 32 as batch_id, pos % 32 as place from p),
m as (select batch_id, row_number() over (partition by batch_id order by {u('mix', SEED, 0, 'vec_id')}, vec_id) - 1 as place,
        vec_id as partner, label as partner_target, embedding as other from b),
l as (select *, {u('lam0', SEED, 0, 'batch_id')} as d from b join m using (batch_id, place)),
g as (select *, greatest(d, 1 - d) as lam from l)
select vec_id, batch_id, partner, label, partner_target, round(lam, 9) as lam,
  round(list_sum([(embedding[i]::double * lam + other[i]::double * (1 - lam)) * i for i in range(1, 65)]), 6) as checksum from g""")
def mixup_pairs(t):
    rows = fixed_batches(permutation(t.embeddings, "vec_id", SEED, total="n"), 32)
    mixed = J.mixup(rows, "vec_id", "embedding", "label", SEED, 0)
    check = F.aggregate(F.transform("mixed", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return mixed.select("vec_id", "batch_id", "partner", "label", "partner_target",
                        F.round("lam", 9).alias("lam"), F.round(check, 6).alias("checksum"))


@query("sample_pairing", "J6", f"""
with p as (select vec_id as partner, embedding as other, row_number() over (order by vec_id) - 1 as spot from embeddings),
a as (select vec_id, embedding, cast(floor({u('pair', SEED, 0, 'vec_id')} * (select count(*) from embeddings)) as bigint) as spot from embeddings)
select vec_id, partner, round(list_sum([(embedding[i]::double * 0.7::double + other[i]::double * (1 - 0.7::double)) * i for i in range(1, 65)]), 6) as checksum
from a join p using (spot)""")
def sample_pairing(t):
    paired = J.sample_pairing(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 0.3, SEED)
    check = F.aggregate(F.transform("paired", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return paired.select("vec_id", "partner", F.round(check, 6).alias("checksum"))


@query("noise_pairing", "J7", f"""
with p as (select vec_id as noise_id, embedding as noise, row_number() over (order by vec_id) - 1 as spot from embeddings where label = 0),
a as (select vec_id, embedding, cast(floor({u('noise', SEED, 0, 'vec_id')} * (select count(*) from p)) as bigint) as spot from embeddings),
j as (select *, list_max(embedding)::double / list_max(noise)::double as prop from a join p using (spot))
select vec_id, noise_id, round(prop, 9) as prop,
  round(list_sum([(embedding[i]::double + noise[i]::double * prop * 0.5) * i for i in range(1, 65)]), 5) as checksum from j""")
def noise_pairing(t):
    vecs = t.embeddings.select("vec_id", "embedding")
    noises = t.embeddings.where("label = 0").select("vec_id", "embedding")
    noisy = J.add_noise(vecs, noises, "vec_id", "embedding", "vec_id", "embedding", 0.5, SEED)
    check = F.aggregate(F.transform("noisy", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return noisy.select("vec_id", "noise_id", F.round("prop", 9).alias("prop"), F.round(check, 5).alias("checksum"))


@query("class_relabel", "F2", """
select vec_id, label, case label when 7 then 0 when 3 then 1 when 9 then 2 when 0 then 3 end as new_label
from embeddings where label in (7, 3, 9, 0)""")
def class_relabel(t):
    return P.relabel(t.embeddings.select("vec_id", "label"), "label", [7, 3, 9, 0])


@query("transform_hooks", "F4 X1", """
select doc_id, md5(lower(text)) as text, case lang when 'en' then 0 when 'fr' then 1 else 2 end as lang from documents""")
def transform_hooks(t):
    return P.map_samples(
        t.documents.select("doc_id", "text", "lang"), "text", "lang", lambda c: F.md5(F.lower(c)),
        lambda c: F.when(c == "en", 0).when(c == "fr", 1).otherwise(2))


@query("short_transcripts", "F5", "select conv_id, turn, length(text) as n from conversations where length(text) < 120")
def short_transcripts(t):
    return t.conversations.where(F.length("text") < 120).select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))


@query("extension_filter", "F6", r"""
select page_id, url from pages where regexp_matches(lower(url), '\.(html|htm)$')""")
def extension_filter(t):
    return t.pages.where(P.has_extension(F.col("url"), ".HTML".lower(), "htm")).select("page_id", "url")


@query("record_integrity", "F7", """
with man as (select doc_id, md5(case when toxic = 1 then text || 'x' else text end) as digest from documents join labels using (doc_id))
select doc_id, md5(text) as actual, case when digest is null then 'missing' when digest = md5(text) then 'ok' else 'mismatch' end as status
from documents left join man using (doc_id)""")
def record_integrity(t):
    docs = t.documents.select("doc_id", "text")
    manifest = docs.join(t.labels, "doc_id").select(
        "doc_id", F.md5(F.when(F.col("toxic") == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("digest"))
    return P.integrity(docs, "doc_id", F.col("text"), manifest, "digest")


@query("stage_projection", "F8", "select doc_id, length(trim(text)) as decoded from documents")
def stage_projection(t):
    stages = [("decoded", F.length(F.trim("text")).cast("bigint")), ("augmented", F.md5(F.upper("text")))]
    return P.stage_output(t.documents, stages, ["decoded"], ["doc_id"])


@query("iteration_window", "F9", """
select user_id, event_id, step from (
  select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as step from events)
where step >= 3 and step < 60 - 10""")
def iteration_window(t):
    return P.iteration_window(t.events.select("user_id", "event_id"), "user_id", ["event_id"], 3, 60, 10)


@query("nan_report", "F10", """
select event_type, count(*) as n, cast(sum(case when event_type = 'error' and value > 400 then 1 else 0 end) as bigint) as n_nan
from events group by 1""")
def nan_report(t):
    loss = F.when((F.col("event_type") == "error") & (F.col("value") > 400), F.lit(float("nan"))).otherwise(F.col("value"))
    return P.nan_report(t.events.select("event_type", loss.alias("loss")), ["event_type"], "loss")


@query("distinct_classes", "U4 L1", "select distinct lang as class_name from documents")
def distinct_classes(t):
    return t.documents.select(F.col("lang").alias("class_name")).distinct()


@query("sorted_file_names", "L1", """
select url, page_id, row_number() over (order by url, page_id) - 1 as place from pages""")
def sorted_file_names(t):
    return positions(t.pages.select("url", "page_id"), ["url", "page_id"], name="place")
