"""Source and sink queries."""

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from kilnset.functions import tensors as X
from kilnset.functions import text as TX
from kilnset.operators.batching import fixed_batches
from kilnset.operators.sampling import distributed, sequential
from kilnset.plans.registry import query, u
from kilnset.session import fresh_path
from kilnset.sources import logs as LG
from kilnset.sources import samples as S
from kilnset.sources import sinks as K
from kilnset.sources.catalog import policy_lines, read_policies

SEED = 42


@query("labelled_folder", "S1 L1", """
with f as (select 'data/' || lang || '/' || doc_id || '.txt' as path, n_chars as bytes, lang as class_name from documents)
select path, bytes, class_name, dense_rank() over (order by class_name) - 1 as target from f""")
def labelled_folder(t):
    path = F.concat(F.lit("data/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))
    files = t.documents.select(path.alias("path"), F.col("n_chars").alias("bytes"))
    return S.label_by_folder(files, S.parent_folder(F.col("path")))


@query("audio_folder", "S2 F6", """
with f as (select role || '/' || conv_id || '_' || turn || case turn % 3 when 0 then '.wav' when 1 then '.MP3' else '.txt' end as path, role as class_name from conversations),
k as (select * from f where regexp_matches(lower(path), '\\.(mp3|wav)$'))
select path, class_name, dense_rank() over (order by class_name) - 1 as target from k""")
def audio_folder(t):
    ext = F.when(F.col("turn") % 3 == 0, ".wav").when(F.col("turn") % 3 == 1, ".MP3").otherwise(".txt")
    files = t.conversations.select(F.concat("role", F.lit("/"), "conv_id", F.lit("_"), "turn", ext).alias("path"))
    return S.label_by_folder(S.only_extensions(files, "path", "mp3", "wav"), S.parent_folder(F.col("path")))


@query("manifest_scan", "S3 C2", r"""
with l as (select page_id, '  ' || replace(regexp_replace(url, '^https?://', ''), '.', '_') || ' ' || page_id || '  ' as value from pages),
p as (select page_id, regexp_extract(trim(value), '^(\S+)', 1) as path from l where trim(value) <> '')
select page_id, path, split_part(path, '/', 1) as class_name from p""")
def manifest_scan(t):
    line = F.concat(F.lit("  "), F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("."), F.lit("_")), F.lit(" "),
                    F.col("page_id").cast("string"), F.lit("  "))
    return S.parse_manifest(t.pages.select("page_id", line.alias("value")))


@query("transcript_scan", "S4", """
select conv_id || '_' || turn as id, md5(replace(replace(text, '|', ' '), chr(10), ' ')) as text_md5 from conversations""")
def transcript_scan(t):
    clean = F.replace(F.replace("text", F.lit("|"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    lines = t.conversations.select(
        F.concat("conv_id", F.lit("_"), "turn", F.lit("|"), "role", F.lit("|"), clean, F.lit("|")).alias("value"))
    return S.parse_transcripts(lines).select("id", F.md5("text").alias("text_md5"))


@query("compression_sniffing", "S5", """
select doc_id, case when lang = 'en' then 'gzip' else 'plain' end as codec from documents""")
def compression_sniffing(t):
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("lang") == "en", F.concat(F.unhex(F.lit("1F8B")), body)).otherwise(body)
    return t.documents.select("doc_id", S.codec(content).alias("codec"))


@query("decompressed_texts", "S5", """
select doc_id, case when lang = 'en' then 'gzip' else 'plain' end as codec, md5(text) as text_md5 from documents""")
def decompressed_texts(t):
    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return S.in_pieces(batches, lambda x: gzip.compress(x.as_py().encode(), mtime=0))

    content = F.when(F.col("lang") == "en", pack("text")).otherwise(F.encode("text", "UTF-8"))
    packed = t.documents.select("doc_id", content.alias("content")).withColumn("codec", S.codec(F.col("content")))
    return S.decompress(packed).select("doc_id", "codec", F.md5("content").alias("text_md5"))


@query("policy_archive", "S15 C4", """
select i as op_idx, case when i = 0 then 'Rotate' else 'Invert' end as op, count(*) as n, round(sum(p_size / 50.0::double), 6) as level,
  round(sum(case when i = 0 then 0.25::double else 0.5::double end), 6) as prob from part, (values (0), (1)) v(i) group by 1, 2""")
def policy_archive(t):
    steps = t.part.select("p_brand", F.col("p_partkey").alias("policy_id"), (F.col("p_size") / 50.0).alias("level"),
                          F.explode(F.array(F.lit(0), F.lit(1))).alias("op_idx"))
    steps = steps.withColumn("op", F.when(F.col("op_idx") == 0, "Rotate").otherwise("Invert")).withColumn(
        "prob", F.when(F.col("op_idx") == 0, 0.25).otherwise(0.5))
    path = fresh_path(t.spark, "policies")
    policy_lines(steps, ["p_brand"]).select("value").write.text(path)
    return read_policies(t.spark, path).groupBy("op_idx", "op").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("level"), 6).alias("level"), F.round(F.sum("prob"), 6).alias("prob"))


@query("concatenated_splits", "S6", """
select doc_id as id, 'train' as source_split from documents union all select item_id, 'extra' from benchmark""")
def concatenated_splits(t):
    return S.concat_splits({"train": t.documents.select(F.col("doc_id").alias("id")),
                            "extra": t.benchmark.select(F.col("item_id").alias("id"))})


@query("leaf_class_metadata", "S7", """
with nodes as (select r_name as names, (select count(*) from nation where n_regionkey = r_regionkey) as children, r_regionkey + 100 as idx from region
  union all select n_name || ', ' || lower(n_name), 0, n_nationkey from nation),
leaf as (select idx, unnest(string_split(names, ', ')) as class_name from nodes where children = 0)
select idx, class_name, count(s_suppkey) as suppliers from leaf left join supplier on s_nationkey = idx group by 1, 2""")
def leaf_class_metadata(t):
    kids = t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("children"))
    regions = t.region.join(kids, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        (F.col("r_regionkey") + 100).alias("idx"), F.col("r_name").alias("names"), F.coalesce("children", F.lit(0)).alias("children"))
    leaves = t.nation.select(F.col("n_nationkey").alias("idx"), F.concat_ws(", ", "n_name", F.lower("n_name")).alias("names"),
                             F.lit(0).cast("bigint").alias("children"))
    names = S.leaf_classes(regions.unionByName(leaves), "children", "names")
    counts = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("c"))
    return names.join(counts, F.col("s_nationkey") == F.col("idx"), "left").select(
        "idx", "class_name", F.coalesce("c", F.lit(0)).alias("suppliers"))


@query("positional_ground_truth", "S8", """
with f as (select url, page_id, row_number() over (order by url, page_id) - 1 as line from pages),
g as (select row_number() over (order by page_id) - 1 as line, length(html) % 10 as label from pages)
select url, page_id, label from f join g using (line)""")
def positional_ground_truth(t):
    lines = sequential(t.pages.select("page_id", (F.length("html") % 10).cast("bigint").alias("label")), "page_id")
    truth = lines.select(F.col("pos").alias("line_no"), "label")
    return S.positional_labels(t.pages.select("url", "page_id"), ["url", "page_id"], truth, "line_no")


@query("synthetic_tensors", "S9", f"""
select vec_id, label, round(list_sum([{u('synthetic', SEED, 0, 'vec_id', 'i')} for i in range(0, 12)]), 9) as fresh,
  round(list_sum([{u('synthetic', SEED, 0, "'fixed'", 'i')} for i in range(0, 12)]), 9) as fixed from embeddings""")
def synthetic_tensors(t):
    rows = t.embeddings.select("vec_id", "label")
    fresh = S.synthetic(rows, "vec_id", 12, SEED).withColumn("fresh", F.round(X.total(F.col("tensor")), 9))
    both = S.synthetic(fresh.drop("tensor"), "vec_id", 12, SEED, fresh=False)
    return both.withColumn("fixed", F.round(X.total(F.col("tensor")), 9)).drop("tensor")


@query("read_only_scan", "S10 G18", """
select lang, count(*) as n, cast(sum(strlen(text)) as bigint) as bytes from documents group by 1""")
def read_only_scan(t):
    return S.read_only_scan(t.documents, ["lang"], F.octet_length("text"))


@query("pinned_subset", "S11", """
select doc_id, md5(text) as text_md5 from documents where doc_id in (select doc_id from labels where quality = 1)""")
def pinned_subset(t):
    kept = S.pin_subset(t.documents.select("doc_id", "text"), "doc_id", t.labels.where("quality = 1"))
    return kept.select("doc_id", F.md5("text").alias("text_md5"))


@query("prepared_samples", "S12", """
select vec_id, label, round(list_sum([(embedding[i]::double * 2 - 1) * i for i in range(1, 65)]), 6) as checksum from embeddings""")
def prepared_samples(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 2 - 1)
    ready = S.materialise(t.embeddings.select("vec_id", "label", scaled.alias("tensor")))
    return ready.select("vec_id", "label", F.round(X.weighted_checksum(F.col("tensor")), 6).alias("checksum"))


@query("aligned_columns", "S13", """
select coalesce(d.doc_id, l.doc_id) as doc_id, n_chars, quality,
  case when d.doc_id is null then 'left_missing' when l.doc_id is null then 'right_missing' else 'ok' end as status
from documents d full join labels l on d.doc_id = l.doc_id""")
def aligned_columns(t):
    return S.aligned_columns(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), "doc_id", check=False)


@query("result_partitions", "S16", """
select event_type, cast(date_part('day', ts) as int) as day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def result_partitions(t):
    path = fresh_path(t.spark, "results")
    summary = t.events.groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    K.write_results(summary, path, ["event_type", "day"])
    K.write_results(summary.where("event_type = 'click'"), path, ["event_type", "day"])
    return t.spark.read.parquet(path)


@query("utilisation_rows", "S17", """
select cast(user_id as int) as gpu_id, count(*) as n, round(avg(value), 6) as gpu_utilization from events group by 1""")
def utilisation_rows(t):
    line = F.concat_ws(",", F.col("ts").cast("string"), "user_id", "value", F.lit("0.5"), F.lit("12.0"), F.lit(""))
    rows = LG.parse_utilisation(t.events.select(line.alias("value")))
    return rows.groupBy("gpu_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gpu_utilization"), 6).alias("gpu_utilization"))


@query("trace_stages", "S18", """
with s as (select cast(user_id % 6 as int) as gpu, event_id as index, value as get_img, value / 2 as load, value / 4 as aug from events)
select gpu, index, 'GET_img' as stage, get_img as seconds from s union all select gpu, index, 'LOAD', load from s
union all select gpu, index, 'AUG', aug from s""")
def trace_stages(t):
    line = F.concat(
        F.lit("GPU: "), (F.col("user_id") % 6).cast("string"), F.lit(" Dataset GET_img\t"), F.col("value").cast("string"),
        F.lit("\t\tLOAD\t"), (F.col("value") / 2).cast("string"), F.lit("\t\tAUG\t"), (F.col("value") / 4).cast("string"),
        F.lit("\t\tINDEX\t"), F.col("event_id").cast("string"))
    return LG.parse_trace(t.events.select(line.alias("value")))


@query("epoch_shards", "S19", f"""
with p as (select o_orderkey, row_number() over (order by {u('perm', SEED, 0, 'o_orderkey')}, o_orderkey) - 1 as p0, count(*) over () as n from orders),
x as (select o_orderkey, unnest(range(p0, cast(ceil(n / 4) as bigint) * 4, n)) as pos from p)
select 0 as epoch, cast(pos % 4 as int) as rank, (pos // 4) // 64 as batch_id, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from x group by 1, 2, 3""")
def epoch_shards(t):
    path = fresh_path(t.spark, "epoch")
    ranked = distributed(t.orders.select("o_orderkey"), "o_orderkey", 4, SEED)
    local = ranked.drop("pos").withColumnRenamed("rank_pos", "pos")
    K.write_epoch(fixed_batches(local, 64).withColumn("epoch", F.lit(0)).select("epoch", "rank", "batch_id", "pos_in_batch", "o_orderkey"), path)
    return t.spark.read.parquet(path).groupBy("epoch", "rank", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("path_pieces", "C2", r"""
select page_id, split_part(url, '/', 1) as first, list_extract(string_split(url, '/'), -1) as last,
  split_part(list_extract(string_split(url, '/'), -1), '.', 1) as stem,
  regexp_extract(list_extract(string_split(url, '/'), -1), '\.([^.]+)$', 1) as ext from pages""")
def path_pieces(t):
    url = F.col("url")
    return t.pages.select("page_id", TX.first_segment(url).alias("first"), TX.last_segment(url).alias("last"),
                          TX.stem(url).alias("stem"), TX.extension(url).alias("ext"))


@query("char_vectors", "C1", r"""
with b as (select conv_id, turn, '<' || substr(lower(text), 1, 198) || '>' as s from conversations)
select conv_id, turn, array_to_string([case when strpos('-#<>abcdefghijklmnopqrstuvwxyz .,?', substr(s, i, 1)) = 0 then 1
  else strpos('-#<>abcdefghijklmnopqrstuvwxyz .,?', substr(s, i, 1)) - 1 end for i in range(1, length(s) + 1)]
  || [0 for i in range(0, 200 - length(s))], ',') as codes from b""")
def char_vectors(t):
    return t.conversations.select("conv_id", "turn", X.join_numbers(TX.vectorize_chars(F.col("text"), 200)).alias("codes"))


@query("op_base_names", "C3", """
select p_partkey, split_part(p_brand || ':' || p_size, ':', 1) as op from part""")
def op_base_names(t):
    return t.part.select("p_partkey", TX.op_base_name(F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string"))).alias("op"))


@query("metadata_rows", "C4", r"""
select page_id, length(url) || chr(9) || page_id || chr(9) || strlen(html) || chr(9) || 'HTML' || chr(9) || replace(url || chr(9) || 'x', chr(9), '\t') as line from pages""")
def metadata_rows(t):
    return t.pages.select("page_id", TX.metadata_row(
        F.length("url"), F.col("page_id"), F.octet_length("html"), F.lit("HTML"), F.concat("url", F.lit("\tx"))).alias("line"))


@query("metadata_json", "C4", """
select doc_id, '{"path":"' || lang || '/' || doc_id || '","type":"TXT","file_size":' || n_chars || '}' as json from documents""")
def metadata_json(t):
    return t.documents.select("doc_id", TX.metadata_json(
        path=F.concat("lang", F.lit("/"), "doc_id"), type=F.lit("TXT"), file_size=F.col("n_chars")).alias("json"))
