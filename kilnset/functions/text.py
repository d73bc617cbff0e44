"""Text, path and metadata functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnset.functions.binding import bind

# Symbols of the character vocabulary, in index order.
VOCABULARY = "-#<>abcdefghijklmnopqrstuvwxyz .,?"
UNKNOWN = 1


def vectorize_chars(text: Column, max_len: int) -> Column:
    """Lower-cased, cut to ``max_len - 2``, wrapped in < >, as vocabulary
    indices, zero padded to ``max_len``."""
    def encode(body):
        chars = F.transform(
            F.sequence(F.lit(1), F.length(body)),
            lambda i: bind(
                lambda at: F.when(at == 0, F.lit(UNKNOWN)).otherwise(at - 1),
                F.instr(F.lit(VOCABULARY), body.substr(i, F.lit(1)))))
        return F.concat(chars, F.array_repeat(F.lit(0), F.lit(max_len) - F.length(body)))

    return bind(encode, F.concat(F.lit("<"), F.substring(F.lower(text), 1, max_len - 2), F.lit(">")))


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(last_segment(path), ".", 1)


def extension(path: Column) -> Column:
    """Last dotted suffix of the file name, without the dot."""
    return F.regexp_extract(last_segment(path), r"\.([^.]+)$", 1)


def op_base_name(name: Column) -> Column:
    return F.substring_index(name, ":", 1)


def metadata_row(width: Column, height: Column, size: Column, kind: Column, path: Column) -> Column:
    """Tab-separated metadata line; tabs inside the path are escaped."""
    return F.concat_ws(
        "\t", width.cast("string"), height.cast("string"), size.cast("string"), kind,
        F.replace(path, F.lit("\t"), F.lit("\\t")))


def metadata_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
