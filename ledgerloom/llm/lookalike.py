"""Texts that look the same in one form, and the records whose texts differ but look the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textform
from .records import one_per_id
from .scratch import stored


def with_form(rows: DataFrame, text_col: str = "hard_text", form_col: str = "form") -> DataFrame:
    """rows with the text's form as a further column (null for a null text, empty for an empty or blank one).

    A column that has form_col's name already is replaced.  Row count and other columns stay as they are."""
    kept = [c for c in rows.columns if c != form_col]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(form_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([textform.form(t) for t in batch.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, form_col])

    return rows.select(*kept).mapInArrow(run, schema)


def _keyed(rows: DataFrame, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    """(id, form, own): digests of the form and of the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            forms = [xxhash.xxh3_128_digest(textform.form(t)) for t in texts]
            own = [xxhash.xxh3_128_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forms, pa.binary()), pa.array(own, pa.binary())], ["id", "form", "own"])

    one = one_per_id(rows, id_col, {"text": F.col(text_col)}, F.col(order_col) if order_col else None).where("text is not null")
    return stored(one.select("id", "text").mapInArrow(run, "id string, form binary, own binary"), "forms")


def same_looking_classes(rows: DataFrame, id_col: str = "id", text_col: str = "hard_text", order_col: str | None = "loaded_at") -> DataFrame:
    """(class_id, id, texts): the records of each form that several different texts have; class_id is the smallest of their ids, texts how many
    texts there are.  Records are taken as in same_looking_pairs()."""
    keyed = _keyed(rows, id_col, text_col, order_col)
    forms = keyed.groupBy("form", "own").agg(F.min("id").alias("id")).groupBy("form").agg(F.min("id").alias("class_id"), F.count("*").alias("texts")).where("texts > 1")
    return keyed.select("form", "id").join(forms, "form").select("class_id", "id", "texts")


def same_looking_pairs(rows: DataFrame, id_col: str = "id", text_col: str = "hard_text", order_col: str | None = "loaded_at") -> DataFrame:
    """(id_a, id_b), id_a < id_b: records whose texts differ although they have one form.

    These are all pairs, which a group of n such records has n * (n - 1) / 2 of; same_looking_classes() has a row for each record.
    Texts are compared once each: copies of one text are no pair of each other and are brought back as ids only
    when another text of their form exists.  Null texts and null ids are left out; an empty and a blank text look
    the same.  Records of one id are one record, the latest.  An empty table gives no rows."""

    keyed = _keyed(rows, id_col, text_col, order_col)
    texts = keyed.select("form", "own").distinct()
    several = texts.join(texts.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form"), "form")
    pairs = several.alias("a").join(several.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.own") < F.col("b.own")))
    pairs = pairs.select(F.col("a.own").alias("own_a"), F.col("b.own").alias("own_b"))
    a = keyed.select(F.col("own").alias("own_a"), F.col("id").alias("x"))
    b = keyed.select(F.col("own").alias("own_b"), F.col("id").alias("y"))
    both = pairs.join(a, "own_a").join(b, "own_b")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
