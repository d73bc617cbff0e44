"""Sample sources: labelled folders, manifests, transcripts, synthetic data."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnset.functions import text as X
from kilnset.functions.hashing import uniform
from kilnset.operators.filters import has_extension
from kilnset.operators.joins import class_index
from kilnset.operators.ranking import positions
from kilnset.operators.small import join_small
from kilnset.session import checkpoint, fresh_path

GZIP_MAGIC = "1F8B"


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root/<class>/..`` with path, bytes and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", F.col("length").alias("bytes"), "content")


def label_by_folder(files: DataFrame, folder: Column) -> DataFrame:
    """Add ``class_name`` and its dense index among the sorted class names."""
    named = files.withColumn("class_name", folder)
    # the content of files stays where it was read
    return join_small(named, checkpoint(class_index(named, "class_name")), "class_name")


def parent_folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def only_extensions(files: DataFrame, path: str, *extensions: str, allow_empty: bool = False) -> DataFrame:
    """Files with one of the extensions; none at all is an error."""
    kept = files.where(has_extension(F.col(path), *extensions))
    if not allow_empty and kept.isEmpty():
        raise FileNotFoundError(f"no file with extension {', '.join(extensions)}")
    return kept


def parse_manifest(lines: DataFrame, value: str = "value") -> DataFrame:
    """Manifest lines: trimmed, blanks dropped, first token is the path and
    its first segment the class."""
    path = F.regexp_extract(F.trim(F.col(value)), r"^(\S+)", 1)
    rows = lines.where(F.trim(F.col(value)) != "").withColumn("path", path).drop(value)
    return rows.withColumn("class_name", X.first_segment(F.col("path")))


def parse_transcripts(lines: DataFrame, value: str = "value") -> DataFrame:
    """``id|..|text`` lines."""
    parts = F.split(F.trim(F.col(value)), r"\|")
    return lines.select(parts[0].alias("id"), parts[2].alias("text"))


def codec(content: Column) -> Column:
    """gzip or plain by the first two bytes."""
    return F.when(F.hex(F.substring(content, 1, 2)) == GZIP_MAGIC, F.lit("gzip")).otherwise(F.lit("plain"))


#: Bytes that leave a function on contents at once: a batch may hold 10,000 of them.
PIECE_BYTES = 1 << 20


def in_pieces(batches: Iterator[pa.Array], body: Callable[[pa.Scalar], bytes | None]) -> Iterator[pa.Array]:
    """``body`` of every value, handed on as soon as ``PIECE_BYTES`` are there."""
    for batch in batches:
        out, size = [], 0
        for value in batch:
            out.append(body(value))
            size += len(out[-1] or b"")
            if size >= PIECE_BYTES:
                yield pa.array(out, pa.binary())
                out, size = [], 0
        if out:
            yield pa.array(out, pa.binary())


def decompress(df: DataFrame, content: str = "content") -> DataFrame:
    """Content after gunzip where the magic bytes say gzip; only those rows
    carry their bytes to Python."""

    @F.arrow_udf("binary")
    def gunzip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_pieces(batches, lambda b: gzip.decompress(b.as_buffer()) if b.is_valid else None)

    packed = F.when(codec(F.col(content)) == "gzip", F.col(content))
    return df.withColumn(content, F.coalesce(gunzip(packed), F.col(content)))


def concat_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of named splits with ``source_split``."""
    whole = None
    for name, part in parts.items():
        tagged = part.withColumn("source_split", F.lit(name))
        whole = tagged if whole is None else whole.unionByName(tagged)
    return whole


def leaf_classes(nodes: DataFrame, children: str, names: str, sep: str = ", ") -> DataFrame:
    """Classes without children, one row per name."""
    return nodes.where(F.col(children) == 0).withColumn("class_name", F.explode(F.split(names, sep))).drop(children, names)


def positional_labels(files: DataFrame, path: list[str], labels: DataFrame, line_no: str) -> DataFrame:
    """The n-th label belongs to the n-th file in sorted order."""
    placed = positions(files, path, name="__line")
    return placed.join(labels, F.col("__line") == F.col(line_no)).drop("__line", line_no)


def synthetic(targets: DataFrame, key: str, size: int, seed: int, fresh: bool = True) -> DataFrame:
    """Random tensors with real targets: one fixed tensor, or one per sample."""
    value = lambda i: uniform("synthetic", seed, 0, F.col(key) if fresh else F.lit("fixed"), i)
    return targets.withColumn("tensor", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value))


def read_only_scan(df: DataFrame, groups: list[str], size: Column) -> DataFrame:
    """Rows and bytes per class of a scan that keeps nothing else."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def scan_to_nothing(df: DataFrame) -> None:
    """Read everything, write nothing (for timing)."""
    df.write.format("noop").mode("overwrite").save()


def pin_subset(df: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Subset kept in executor memory, spilling to disk."""
    from pyspark import StorageLevel

    return df.join(index.select(key), key, "left_semi").persist(StorageLevel.MEMORY_AND_DISK)


def materialise(df: DataFrame, label: str = "prepared") -> DataFrame:
    """Run a transform once into the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aligned_columns(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Columns of both sides by sample id. With ``check`` a sample missing on
    one side raises; otherwise ``status`` reports it."""
    a = left.withColumn("__l", F.lit(True))
    b = right.withColumn("__r", F.lit(True))
    whole = a.join(b, key, "full")
    status = F.when(F.col("__l").isNull(), "left_missing").when(F.col("__r").isNull(), "right_missing").otherwise("ok")
    if check:
        bad = F.raise_error(F.lit("columns are not aligned"))
        whole = whole.withColumn("status", F.when(status != "ok", bad).otherwise(status))
    else:
        whole = whole.withColumn("status", status)
    return whole.drop("__l", "__r")
