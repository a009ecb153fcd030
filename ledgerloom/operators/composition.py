"""How splits are composed of professions and genders."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import rate
from ..schema import GENDERS, PROFESSIONS


def composition_counts(rows: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test"), professions=PROFESSIONS) -> DataFrame:
    """Rows of every cell of every split, zeros kept, with their shares and the gaps between shares."""
    spark = rows.sparkSession
    spine = spark.createDataFrame(list(product(splits, professions, GENDERS)), "split string, profession string, gender string")
    n = rows.groupBy("split", "profession", "gender").agg(F.count("*").alias("count"))
    full = F.broadcast(spine).join(n, ["split", "profession", "gender"], "left").fillna(0, "count")
    over = lambda *keys: F.sum("count").over(Window.partitionBy(*keys))
    shared = full.withColumns({
        "gender_share_within_profession": rate(F.col("count"), over("split", "profession")),
        "profession_share_within_gender": rate(F.col("count"), over("split", "gender")),
        "cell_share_of_split": rate(F.col("count"), over("split")),
    })

    def gap(share: str, *keys: str):
        w = Window.partitionBy(*keys)
        return F.max(share).over(w) - F.min(share).over(w)

    return shared.withColumns({
        "gender_share_gap_within_profession": gap("gender_share_within_profession", "split", "profession"),
        "profession_share_gap_within_gender": gap("profession_share_within_gender", "split", "gender"),
    })
