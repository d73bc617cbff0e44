"""Registered queries of the subpackage: each dealt operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnset.llm.scratch import Scratch, text_column

WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@register
def op8_packing(spark, sf_dir):
    from kilnset.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@register
def op9_source_mix(spark, sf_dir):
    from kilnset.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents")
    text = text_column(docs)
    sized = Scratch(spark, "op9").write(docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text).alias("mark")))
    out = mix_sources(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@register
def op10_feistel_shards(spark, sf_dir):
    from kilnset.llm.sharding import shard_rows

    docs = table(spark, sf_dir, "documents")
    text = text_column(docs)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, 16, count=docs.count()).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register
def op5_quality_rules(spark, sf_dir):
    from kilnset.llm.quality_rules import fit_quality, quality_rules

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@register
def op7_near_vectors(spark, sf_dir):
    from kilnset.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@register
def op1_substring_dedup(spark, sf_dir):
    from kilnset.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


@register
def op4_jaccard_join(spark, sf_dir):
    from kilnset.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@register
def op6_line_dedup(spark, sf_dir):
    from kilnset.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_similar", "kept_sha256")


@register
def op3_weak_label_quality(spark, sf_dir):
    from kilnset.llm.weak_labels import classify

    return classify(table(spark, sf_dir, "documents"))


@register
def op2_quote_links(spark, sf_dir):
    from kilnset.llm.quote_links import link_quotes

    return link_quotes(table(spark, sf_dir, "conversations"))


SQL["op2_quote_links"] = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS mid, conv_id, coalesce(conv_id::varchar, 'none') AS talk, turn, role, coalesce(text, '') AS text
  FROM conversations
), lines AS (
  SELECT mid, talk, turn, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM base WHERE regexp_matches(text, '(?m)^[ \t]*>')
), deep AS (
  SELECT mid, talk, turn, place, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS depth,
         regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') AS body FROM lines
), changes AS (
  SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY mid ORDER BY place) = depth THEN 0 ELSE 1 END AS change FROM deep
), runs AS (
  SELECT *, sum(change) OVER (PARTITION BY mid ORDER BY place) AS run FROM changes
), parts AS (
  SELECT mid, talk, turn, run, depth, string_agg(body, chr(10) ORDER BY place) AS body
  FROM runs GROUP BY mid, talk, turn, run, depth
), said AS (
  SELECT mid, string_agg(body, chr(10) ORDER BY run) AS own FROM parts WHERE depth = 0 GROUP BY mid
), clean AS (
  SELECT b.*, CASE WHEN regexp_matches(text, '(?m)^[ \t]*>') THEN coalesce(own, '') ELSE text END AS own
  FROM base b LEFT JOIN said USING (mid)
), told AS (
  SELECT talk, turn, list_filter([trim(regexp_replace(lower(x), '[ \t\n\x0B\f\r]+', ' ', 'g')) for x in string_split(own, chr(10))],
                                 lambda x: x <> '') AS own_lines FROM clean
), counts AS (
  SELECT DISTINCT talk, len(list_filter([trim(regexp_replace(lower(x), '[ \t\n\x0B\f\r]+', ' ', 'g')) for x in string_split(body, chr(10))],
                                        lambda x: x <> '')) AS n FROM parts WHERE depth > 0
), starts AS (
  SELECT talk, turn, own_lines, n, unnest(range(1, len(own_lines) - n + 2)) AS first
  FROM told JOIN counts USING (talk) WHERE n > 1 AND n <= len(own_lines)
), units AS (
  SELECT talk, turn, own AS unit FROM clean
  UNION ALL SELECT talk, turn, unnest(string_split(own, chr(10))) FROM clean
  UNION ALL SELECT talk, turn, body FROM parts WHERE depth = 0
  UNION ALL SELECT talk, turn, array_to_string(own_lines[first:first + n - 1], ' ') FROM starts
), source AS (
  SELECT talk, trim(regexp_replace(lower(unit), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS unit, min(turn) AS said_at
  FROM units WHERE turn IS NOT NULL GROUP BY 1, 2
), linked AS (
  SELECT p.mid, p.depth, CASE WHEN s.said_at < p.turn THEN s.said_at END AS said_at
  FROM parts p LEFT JOIN source s ON s.talk = p.talk AND s.unit <> ''
    AND s.unit = trim(regexp_replace(lower(p.body), '[ \t\n\x0B\f\r]+', ' ', 'g'))
  WHERE p.depth > 0
), per AS (
  SELECT mid, count(*) AS n_quotes, count(said_at) AS n_linked,
         arg_max(said_at, -1000000000000 * depth + said_at) FILTER (WHERE said_at IS NOT NULL) AS reply_to
  FROM linked GROUP BY mid
), rows_ AS (
  SELECT c.talk, c.conv_id, c.turn, c.role, c.own AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
         reply_to FROM clean c LEFT JOIN per USING (mid)
), nodes AS (
  SELECT talk, turn, max(reply_to) AS up FROM rows_ WHERE reply_to IS NOT NULL GROUP BY 1, 2
), climb AS (
  SELECT talk, turn, up, [turn] AS path FROM nodes
  UNION ALL
  SELECT c.talk, c.turn, n.up, list_prepend(c.up, c.path) FROM climb c
  LEFT JOIN nodes n ON n.talk = c.talk AND n.turn = c.up WHERE c.up IS NOT NULL
), paths AS (
  SELECT talk, turn, path FROM climb WHERE up IS NULL
), threads AS (
  SELECT r.*, coalesce(p.path, [r.turn]) AS path FROM rows_ r LEFT JOIN paths p USING (talk, turn)
)
SELECT conv_id, row_number() OVER (PARTITION BY talk ORDER BY [coalesce(x, -9223372036854775808) for x in path], role NULLS FIRST, md5(text), reply_to NULLS FIRST, n_quotes) - 1 AS position,
       turn, role, reply_to, len(path) - 1 AS depth, n_quotes, n_linked, text
FROM threads
"""


@register
def op11_secret_scan(spark, sf_dir):
    from kilnset.llm.secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


@register
def op13_collocations(spark, sf_dir):
    from kilnset.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@register
def op12_prefix_trie(spark, sf_dir):
    from kilnset.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL["op12_prefix_trie"] = r"""
WITH ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  -- crc32 of the decimal id: eight shifts a character, from all ones
  SELECT conv_id, n, conv_id - conv_id % 100 AS family, xor(4294967295::bigint, list_reduce(
           list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda s, b: list_reduce(list_prepend(xor(s, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, z:
             CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::bigint) ELSE v >> 1 END))) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM ranked GROUP BY conv_id)
), whole AS (
  SELECT c.conv_id, r.pos, r.role, r.text FROM convs c JOIN ranked r ON r.conv_id = c.family WHERE r.pos < c.h
  UNION ALL
  SELECT c.conv_id, r.pos - c.h + least(c.h, coalesce(a.n, 0)), r.role, r.text
  FROM ranked r JOIN convs c USING (conv_id) LEFT JOIN convs a ON a.conv_id = c.family WHERE r.pos >= c.h
), paths AS (
  SELECT c.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids,
         coalesce(list(length(text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN whole w USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, ids, sizes, unnest(range(0, len(ids) + 1)) AS depth FROM paths
), nodes AS (
  SELECT ids[1:depth] AS node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS saved,
         coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (len(ids) = depth), '') AS ends
  FROM prefixes GROUP BY ids[1:depth]
), kids AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)
), behind AS (
  SELECT node[1:up] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth::bigint AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       b.n_leaves::bigint AS n_leaves, b.saved_tokens::bigint AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN behind b USING (node) LEFT JOIN full_nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""
