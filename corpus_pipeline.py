"""Corpus pipeline over the documents table.

``run`` applies the stages in order; each result is written to the shared folder
as Parquet and reread as the next stage's documents. All stages but the last
return the columns of ``documents``: quality rules refuse documents, line dedup
and the others keep the text of what is left up to date (``n_chars`` follows the
text), near copies lose all but the smallest id of their group, and mixing gives
each document as many rows as the mix takes copies of it.

Nulls: documents without a text count as empty and fail the quality rules; a null
source is a source; documents with a null id are never near copies. Columns of
``documents`` that no stage knows are carried along. An empty table goes through
as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnset.llm.jaccard_join import jaccard_components
from kilnset.llm.line_dedup import dedup_lines
from kilnset.llm.mixing import mix_sources
from kilnset.llm.packing import pack
from kilnset.llm.quality_rules import fit_quality, quality_rules
from kilnset.llm.queries import WORD, table
from kilnset.llm.scratch import Scratch, text_column


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trained verdict."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules(docs.withColumn("__id", F.col("doc_id")), model, key="__id", carry=tuple(docs.columns))
    return judged.where("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has, equal or alike."""
    found = dedup_lines(docs).where("n_removed > 0").select("row", F.col("kept_text").alias("__kept")).distinct()
    rows = docs.withColumn("row__", F.xxhash64(F.col("doc_id").cast("long"), text_column(docs)))
    rows = rows.join(found.withColumnRenamed("row", "row__"), "row__", "left")
    text = F.coalesce("__kept", "text")
    fresh = {"text": text, "n_chars": F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept"))}
    return rows.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies."""
    groups = jaccard_components(docs)
    lost = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def row_mark(docs: DataFrame):
    """A number that tells rows apart by all their columns. Hashes pass over
    nulls, so these count beside the values; nested columns are hashed as JSON."""
    cells = []
    for field in docs.schema:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cells.append(F.to_json(F.struct(cell), {"ignoreNullFields": "false"}))
        else:
            cells.append(cell)
        cells.append(cell.isNull())
    return F.xxhash64(*cells)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies. Rows alike in all
    columns are one document, with the copies of all of them."""
    text = text_column(docs)
    rows = docs.withColumn("__mark", row_mark(docs))
    sized = rows.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                        F.col("__mark").alias("mark"))
    taken = mix_sources(Scratch(spark, "mix-sizes").write(sized)).groupBy("mark").agg(
        F.sum("copies").alias("__copies")).where("__copies > 0").withColumnRenamed("mark", "__mark")
    found = rows.dropDuplicates(["__mark"]).join(taken, "__mark")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return found.withColumn("__copy", copies).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("source mix", mix),
    ("packing", pack_windows),
]

#: The trained verdict and the random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
