"""Records of the source tables: one row an id, labels in one spelling, shingles of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textform


def label(c: Column) -> Column:
    """A profession or subject in one spelling: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")


def split_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def one_per_id(rows: DataFrame, id_col: str, columns: dict[str, Column], order: Column | None = None) -> DataFrame:
    """(id, columns): one row for each id that is not null, the last by `order`; the values break ties."""
    picked = rows.select(F.col(id_col).alias("id"), F.struct((F.lit(0) if order is None else order).alias("_at"), *(c.alias(n) for n, c in columns.items())).alias("r"))
    picked = picked.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("r").alias("r"))
    return picked.select("id", *(F.col(f"r.{n}").alias(n) for n in columns))


def with_shingles(rows: DataFrame, text_col: str, size: int) -> DataFrame:
    """rows without the text, with `shingles` (ascending distinct hashes of runs of `size` words) and
    `set_key`, equal for equal sets of shingles.  Texts without any run are left out: they are like no text."""
    kept = [c for c in rows.columns if c != text_col]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("shingles", T.ArrayType(T.LongType(), False), False)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = textform.shingle_batch(batch.column(text_col).to_pylist(), size)
            offsets = pa.array([0, *sizes.cumsum()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(offsets, pa.array(values))], [*kept, "shingles"])

    made = rows.where(F.col(text_col).isNotNull()).select(*kept, text_col).mapInArrow(cut, schema).where(F.size("shingles") > 0)
    return made.withColumn("set_key", F.struct(F.xxhash64("shingles"), F.hash("shingles")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets given as arrays of distinct values."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)
