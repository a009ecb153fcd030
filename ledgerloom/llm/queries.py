"""Queries of the training-data operators; pN_found holds the rows that problem N asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bottomk, fmindex, lookalike, packing, raking, simhash, subjects, vptree

ABOUT = "share >= 0.2 - 1e-9"  # a fifth of the sentences, parts of which may not add up exactly


def _reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_reader(spark, sf_dir)("train_vectors"), least=0.85)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.similar_pairs(p1_neighbours(spark, sf_dir))


def p1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists without any loss: factor 1 rules out only what cannot hold a neighbour."""
    return vptree.nearest(_reader(spark, sf_dir)("train_vectors"), least=0.85, factor=1.0).select("id", "other")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _reader(spark, sf_dir)
    return simhash.cross_split_overlaps(read("source_rows"), words=3, threshold=0.75).select("eval_id", "train_id")


def p2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs without any loss: nothing may be missed, so all sets meet by their shingles."""
    read = _reader(spark, sf_dir)
    return simhash.cross_split_overlaps(read("source_rows"), words=3, threshold=0.75, miss=0).select("eval_id", "train_id")


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.overlap_report(_reader(spark, sf_dir)("source_rows"), words=3, threshold=0.75)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicate_groups(_reader(spark, sf_dir)("source_rows"), words=3, threshold=0.55)


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = _reader(spark, sf_dir)
    return raking.balanced_sample(read("source_rows"), read("sample_requests"), read("sample_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[1].where("not met").select("request_id", "profession", "gender")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[0]


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[1]


def p4_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the report is counted, not fitted."""
    return _sampled(spark, sf_dir)[1].drop("taken", "gap")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking_pairs(_reader(spark, sf_dir)("source_rows"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking_classes(_reader(spark, sf_dir)("source_rows"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.with_form(_reader(spark, sf_dir)("source_rows").select("id", "loaded_at", "hard_text")).drop("hard_text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cut_items(p6_containers(spark, sf_dir))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _reader(spark, sf_dir)
    return packing.pack(read("documents"), read("context_windows"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _reader(spark, sf_dir)
    return fmindex.leaked_spans(read("documents"), read("eval_items")).select("doc_id", "item_id").distinct()


def p7_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _reader(spark, sf_dir)
    return fmindex.removal_spans(fmindex.leaked_spans(read("documents"), read("eval_items")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _reader(spark, sf_dir)
    return subjects.subject_shares(read("documents"), read("doc_labels"), read("subject_areas"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).where(ABOUT).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_reader(spark, sf_dir)("documents"), p8_shares(spark, sf_dir).where(ABOUT))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
