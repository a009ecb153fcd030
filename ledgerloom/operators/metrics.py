"""Metrics of predictions, all from one table of confusion cells.

cells() reads the predictions once; every later table is a function of it and has no more rows than conditions,
groups and labels allow.  Undefined rates are null."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import both, ordered_mean, rate, value_range, value_ratio
from ..schema import CONDITION, COUNTS, FAIRNESS, RATES


def last_predictions(predictions: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One prediction for each condition and query: that of the last run, then the last made, then the largest by what is kept.

    columns: what is kept beside keys and order (all without it); only that is read and shuffled."""
    rest = [c for c in predictions.columns if c not in keys and (columns is None or c in order or c in columns)]
    ordered = [*order, *(c for c in rest if c not in order)]
    return predictions.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def validate(predictions: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> None:
    """Fails without rows or columns, on nulls, and on labels that aren't configured."""
    if not labels or len(set(labels)) < len(labels):
        raise ValueError("labels are empty or repeated")
    need = [*condition, "true_label", "predicted_label", "audit_group"]
    if missing := [c for c in need if c not in predictions.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in need]
    strange = [F.sum((~F.col(c).isin(*labels)).cast("long")).alias(f"_{c}") for c in ("true_label", "predicted_label")]
    found = predictions.agg(F.count("*").alias("_rows"), *nulls, *strange).first()
    if not found["_rows"]:
        raise ValueError("there are no predictions")
    if bad := [c for c in need if found[c]]:
        raise ValueError(f"null values in {', '.join(bad)}")
    if bad := [c for c in ("true_label", "predicted_label") if found[f"_{c}"]]:
        raise ValueError(f"labels that are not configured in {', '.join(bad)}")


def require_constant(rows: DataFrame, column_sets: list[str], key: str = "condition") -> None:
    """Fails if a condition has two values of a column that describes it."""
    sizes = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in column_sets]
    for r in rows.groupBy(key).agg(*sizes).where(reduce(lambda a, b: a | b, (F.col(c) > 1 for c in column_sets))).limit(1).collect():
        raise ValueError(f"condition {r[0]} has several values of a column that describes it")


def cells(predictions: DataFrame, condition: list[str] = CONDITION) -> DataFrame:
    return predictions.groupBy(*condition, "audit_group", "true_label", "predicted_label").agg(F.count("*").alias("n"))


def label_spine(cells: DataFrame, labels: list[str]) -> DataFrame:
    return cells.sparkSession.createDataFrame(list(enumerate(labels)), "label_index int, target_label string")


def confusion_matrix(cells: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> DataFrame:
    """Rows of every true and predicted label of every condition, zeros kept."""
    grid = cells.sparkSession.createDataFrame(list(product(labels, labels)), "true_label string, predicted_label string")
    n = cells.groupBy(*condition, "true_label", "predicted_label").agg(F.sum("n").alias("count"))
    spine = cells.select(*condition).distinct().join(F.broadcast(grid))
    return spine.join(n, [*condition, "true_label", "predicted_label"], "left").fillna(0, "count")


def confusion_pivot(matrix: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> DataFrame:
    """One row a true label, one column a predicted label."""
    return matrix.groupBy(*condition, "true_label").pivot("predicted_label", labels).agg(F.sum("count")).fillna(0, labels)


def one_vs_rest(cells: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """Counts and rates of each label against the rest, for each group of keys."""
    t, p = F.col("true_label") == F.col("target_label"), F.col("predicted_label") == F.col("target_label")
    add = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    small = cells.groupBy(*keys, "true_label", "predicted_label").agg(F.sum("n").alias("n"))
    counted = small.join(F.broadcast(label_spine(cells, labels))).groupBy(*keys, "label_index", "target_label").agg(
        add(t).alias("positive_support"), add(~t).alias("negative_support"), add(p).alias("predicted_positive"),
        add(t & p).alias("tp"), add(~t & p).alias("fp"), add(t & ~p).alias("fn"), add(~t & ~p).alias("tn"),
    )
    return counted.select(
        "*", rate("predicted_positive", F.col("positive_support") + F.col("negative_support")).alias("selection_rate"),
        rate("tp", F.col("tp") + F.col("fp")).alias("precision"), rate("tp", F.col("tp") + F.col("fn")).alias("recall"),
        rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        rate("tn", F.col("tn") + F.col("fp")).alias("specificity"), rate("fp", F.col("tn") + F.col("fp")).alias("false_positive_rate"),
        rate("fn", F.col("tp") + F.col("fn")).alias("false_negative_rate"), rate("tn", F.col("tn") + F.col("fn")).alias("negative_predictive_value"),
    )


def target_label_metrics(cells: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> DataFrame:
    return one_vs_rest(cells, labels, condition).select(*condition, "target_label", *COUNTS, *RATES)


def _group_metrics(cells: DataFrame, labels: list[str], condition: list[str]) -> DataFrame:
    keys = [*condition, "audit_group"]
    right = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0))
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("audit_group_n"), right.alias("_right"))
    sizes = sizes.select(*keys, "audit_group_n", rate("_right", "audit_group_n").alias("audit_group_accuracy"))
    return one_vs_rest(cells, labels, keys).join(sizes, keys)


def audit_group_metrics(cells: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> DataFrame:
    """one_vs_rest within every observed audit group, with the group's size and accuracy."""
    return _group_metrics(cells, labels, condition).select(*condition, "audit_group", "audit_group_n", "audit_group_accuracy", "target_label", *COUNTS, *RATES)


def _fairness(cells: DataFrame, labels: list[str], condition: list[str]) -> DataFrame:
    groups = one_vs_rest(cells, labels, [*condition, "audit_group"])
    spread = groups.groupBy(*condition, "label_index", "target_label").agg(
        value_range("selection_rate").alias("demographic_parity_difference"), value_ratio("selection_rate").alias("demographic_parity_ratio"),
        value_range("recall").alias("equal_opportunity_difference"), value_range("false_positive_rate").alias("false_positive_rate_difference"),
        value_range("precision").alias("predictive_parity_difference"), F.count("*").alias("n_audit_groups_compared"),
        *(F.count(c).alias(f"n_{c}_defined_audit_groups") for c in ("selection_rate", "recall", "false_positive_rate", "precision")),
    )
    return spread.withColumn("equalized_odds_difference", both(F.col("equal_opportunity_difference"), F.col("false_positive_rate_difference")))


def fairness_metrics(cells: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> DataFrame:
    """How far the audit groups are apart in each label's rates."""
    coverage = ["n_audit_groups_compared", *(f"n_{c}_defined_audit_groups" for c in ("selection_rate", "recall", "false_positive_rate", "precision"))]
    return _fairness(cells, labels, condition).select(*condition, "target_label", *FAIRNESS, *coverage)


def _weighted(value: str, order: str = "label_index") -> Column:
    """Mean of a rate weighed by support, over labels with support where it is defined, in label order."""
    used = F.col(value).isNotNull() & (F.col("positive_support") > 0)
    listed = F.array_sort(F.collect_list(F.when(used, F.struct(order, (F.col(value) * F.col("positive_support")).alias("x")))))
    return F.aggregate(listed, F.lit(0.0), lambda s, x: s + x["x"]) / F.nullif(F.sum(F.when(used, F.col("positive_support"))).cast("double"), F.lit(0.0))


def _summary(name: str) -> tuple[str, str]:
    """Names of a fairness value's aggregates: what follows mean_, min_ and max_, and its coverage count."""
    short = name if name.endswith("ratio") else name.removesuffix("_difference")
    return name, f"n_{short}_defined_target_labels"


def results(cells: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> DataFrame:
    """One row a condition: sizes, quality, agreement, accuracy by group, and the fairness values over its labels."""
    per_label = one_vs_rest(cells, labels, condition)
    n = F.sum("positive_support")
    # agreement from the labels' marginals, in whole numbers up to the last division
    s, c = n.cast("double"), F.sum("tp").cast("double")
    pt = F.sum(F.col("positive_support") * F.col("predicted_positive")).cast("double")
    pp = F.sum(F.col("predicted_positive") * F.col("predicted_positive")).cast("double")
    tt = F.sum(F.col("positive_support") * F.col("positive_support")).cast("double")
    quality = per_label.groupBy(*condition).agg(
        n.alias("sample_count"), F.count("*").alias("n_target_labels"), (c / s).alias("accuracy"),
        ordered_mean("precision", "label_index").alias("macro_precision"), ordered_mean("recall", "label_index").alias("macro_recall"),
        ordered_mean("f1", "label_index").alias("macro_f1"), _weighted("precision").alias("weighted_precision"), _weighted("f1").alias("weighted_f1"),
        *(F.count(x).alias(f"n_{x}_defined_target_labels") for x in ("precision", "recall", "f1")),
        F.coalesce((c * s - pt) / F.nullif(F.sqrt((s * s - pp) * (s * s - tt)), F.lit(0.0)), F.lit(0.0)).alias("matthews_correlation_coefficient"),
        ((c * s - pt) / F.nullif(s * s - pt, F.lit(0.0))).alias("cohen_kappa"),
    )
    right = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0))
    groups = cells.groupBy(*condition, "audit_group").agg(rate(right, F.sum("n")).alias("accuracy_"))
    groups = groups.groupBy(*condition).agg(F.count("*").alias("n_audit_groups"), F.min("accuracy_").alias("worst_audit_group_accuracy"), value_range("accuracy_").alias("audit_group_accuracy_difference"))
    spread = _fairness(cells, labels, condition).groupBy(*condition).agg(*(
        x for name in FAIRNESS for x in (
            ordered_mean(name, "label_index").alias(f"mean_{name}"), F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}"), F.count(name).alias(_summary(name)[1]),
        )
    ))
    return quality.join(groups, condition).join(spread, condition)


def metric_tables(predictions: DataFrame, labels: list[str], condition: list[str] = CONDITION) -> dict[str, DataFrame]:
    """All five tables of all conditions at once."""
    table = cells(predictions, condition)
    return {
        "results": results(table, labels, condition), "target_label_metrics": target_label_metrics(table, labels, condition),
        "confusion_matrix": confusion_matrix(table, labels, condition), "audit_group_metrics": audit_group_metrics(table, labels, condition),
        "fairness_metrics": fairness_metrics(table, labels, condition),
    }
