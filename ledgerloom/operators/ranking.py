"""Dense ranks of conditions within each language model, and the winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import metric_name


def _rank(metric: str, direction: str, within: list[str]):
    order = F.col(metric).asc_nulls_last() if direction == "minimize" else F.col(metric).desc_nulls_last()
    return F.when(F.col(metric).isNotNull(), F.dense_rank().over(Window.partitionBy(*within).orderBy(order)))


def rank_results(results: DataFrame, quality: str = "macro_f1", quality_direction: str = "maximize", fairness: str = "mean_equalized_odds_difference", fairness_direction: str = "minimize", *, check: bool = True) -> DataFrame:
    """results with ranks by quality and by fairness, each among the conditions of one language model and evaluation split.

    Equal values share a rank, undefined values have none, and every condition of rank 1 is a winner.  With check, a
    language model without any defined quality is an error; one without fairness has no winner."""
    quality, fairness = metric_name(quality), metric_name(fairness)
    for d in (quality_direction, fairness_direction):
        if d not in ("maximize", "minimize"):
            raise ValueError(f"unknown direction: {d}")
    kinds = dict(results.dtypes)
    within = [c for c in ("language_model", "evaluation_split") if c in results.columns]
    for m in (quality, fairness):
        if kinds.get(m) not in ("double", "float", "int", "bigint"):
            raise ValueError(f"no numeric column: {m}")
    if check:
        for r in results.groupBy(*within).agg(F.count(quality).alias("n")).where("n = 0").limit(1).collect():
            raise ValueError(f"{quality} is undefined for every condition of {r[0]}")
    ranked = results.withColumn("quality_rank", _rank(quality, quality_direction, within)).withColumn("fairness_rank", _rank(fairness, fairness_direction, within))
    return ranked.withColumns({f"is_{k}_best": F.coalesce(F.col(f"{k}_rank") == 1, F.lit(False)) for k in ("quality", "fairness")})


def in_order(ranked: DataFrame, metric: str = "macro_f1", direction: str = "maximize") -> DataFrame:
    m = F.col(metric_name(metric))
    return ranked.orderBy("language_model", m.asc_nulls_last() if direction == "minimize" else m.desc_nulls_last(), "condition")


def winners(ranked: DataFrame, criterion: str = "quality") -> DataFrame:
    return ranked.where(F.col(f"is_{criterion}_best"))


def of_winners(rows: DataFrame, ranked: DataFrame, criterion: str = "quality") -> DataFrame:
    """The rows (as of predictions) that belong to winning conditions."""
    keys = [c for c in ("condition", "evaluation_split") if c in rows.columns and c in ranked.columns]
    return rows.join(winners(ranked, criterion).select(*keys).distinct(), keys, "left_semi")
