"""Matched contrasts: how metrics change when one factor changes and all others stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONDITION, CONTEXT, FACTORS, NOT_APPLICABLE

DETAIL = ["contrast_type", "factor", "from_factor_value", "to_factor_value", *CONTEXT, "language_model", "fixed_context", "metric", "direction", "from_metric_value", "to_metric_value", "delta", "improvement", "outcome", "from_condition_count", "to_condition_count"]
SUMMARY = ["contrast_type", "aggregation_scope", "scope_language_model", "factor", "from_factor_value", "to_factor_value", "metric", "direction", "n_total_pairs", "n_defined_pairs", "mean_from_metric_value", "mean_to_metric_value", "mean_delta", "std_delta", "n_improved", "n_tied", "n_worsened", "improvement_rate"]
_NO_METRICS = {"example_count", "sample_count", "quality_rank", "fairness_rank"}


def pinned(results: DataFrame) -> DataFrame:
    """results computed once.  They have one row a condition, so they are as many as the configured grid; every contrast
    reads them again."""
    return results.sparkSession.createDataFrame(results.toArrow())


def metric_columns(results: DataFrame) -> list[str]:
    """The numeric columns that are metrics: no sizes, ranks or coverage counts."""
    return [c for c, kind in results.dtypes if kind in ("double", "float", "int", "bigint") and c not in _NO_METRICS and not c.startswith("n_")]


def levels(config: dict[str, list]) -> dict[str, list]:
    """Configured values of each factor, in order; of example_count those above 0."""
    return {f: [v for v in config[f] if f != "example_count" or v > 0] for f in FACTORS}


def _long(results: DataFrame, metrics: list[str]) -> DataFrame:
    return results.select(*CONTEXT, *FACTORS, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([*CONTEXT, *FACTORS], metrics, "metric", "value")


def _finish(pairs: DataFrame, kind: str, n_to: int) -> DataFrame:
    """pairs: factor, levels, CONTEXT, language_model, fixed_context, metric and the two values."""
    minimize = F.col("metric").endswith("_difference")
    delta = F.col("to_metric_value") - F.col("from_metric_value")
    improvement = F.when(minimize, -delta).otherwise(delta)
    outcome = F.when(improvement.isNull(), "undefined").when(improvement > 0, "improved").when(improvement < 0, "worsened").otherwise("tied")
    return pairs.select(
        F.lit(kind).alias("contrast_type"), "factor", F.col("from_factor_value").cast("string"), F.col("to_factor_value").cast("string"), *CONTEXT,
        F.when(F.col("factor") == "language_model", NOT_APPLICABLE).otherwise(F.col("language_model")).alias("language_model"), "fixed_context",
        "metric", F.when(minimize, "minimize").otherwise("maximize").alias("direction"),
        "from_metric_value", "to_metric_value", delta.alias("delta"), improvement.alias("improvement"), outcome.alias("outcome"),
        F.lit(1).alias("from_condition_count"), F.lit(n_to).alias("to_condition_count"),
    ).select(*DETAIL)


def _fixed(held: list[str]) -> Column:
    """What a contrast holds, as JSON that is equal for equal values."""
    return F.to_json(F.struct(*sorted(held)), {"ignoreNullFields": "false"})


def _one(df: DataFrame, message: str) -> None:
    if df.limit(1).count():
        raise ValueError(message)


def _require_metrics(results: DataFrame) -> list[str]:
    """The metric columns; fails without any, and without a column that the contrasts read."""
    if missing := [c for c in (*CONTEXT, *FACTORS) if c not in results.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if not (metrics := metric_columns(results)):
        raise ValueError("there is no metric to contrast")
    return metrics


def strict_contrasts(results: DataFrame, config: dict[str, list], *, check: bool = True) -> DataFrame:
    """For each factor with at least two levels, every pair of levels (in configured order) of otherwise equal conditions.

    Every condition stands once for each factor, with its level and all that is held; one join pairs them."""
    metrics = _require_metrics(results)
    roles = []
    sizes = {f: len(values) for f, values in levels(config).items() if len(values) > 1}
    for factor in sizes:
        at = F.lit(None).cast("int")
        for i, value in enumerate(levels(config)[factor]):
            at = F.when(F.col(factor) == value, i).otherwise(at)
        roles.append(F.struct(F.lit(factor).alias("factor"), at.alias("at"), F.col(factor).cast("string").alias("level"), _fixed([c for c in (*CONTEXT, *FACTORS) if c != factor]).alias("fixed_context")))
    if not roles:
        return _finish(results.select(*CONTEXT, "language_model", *(F.lit("").alias(c) for c in ("factor", "from_factor_value", "to_factor_value", "fixed_context", "metric")), *(F.lit(0.0).alias(c) for c in ("from_metric_value", "to_metric_value"))).where(F.lit(False)), "single_factor", 1)
    there = results.withColumn("role", F.explode(F.array(*roles))).where("role.at is not null")
    if check:
        wanted = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("factor")]
        per = there.groupBy("role.factor", "role.fixed_context").agg(F.count("*").alias("n"), F.count_distinct("role.at").alias("levels"))
        wrong = per.where((F.col("n") > F.col("levels")) | (F.col("levels") != wanted)).first()
        if wrong is not None:
            raise ValueError(f"{wrong['factor']}: " + ("two rows for one condition" if wrong["n"] > wrong["levels"] else "a condition has no partner"))
    rows = there.select(*CONTEXT, "language_model", "role.*", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([*CONTEXT, "language_model", "factor", "at", "level", "fixed_context"], metrics, "metric", "value")
    keys = ["factor", "fixed_context", "metric"]
    a = rows.select(*CONTEXT, "language_model", *keys, F.col("level").alias("from_factor_value"), F.col("value").alias("from_metric_value"), F.col("at").alias("_a"))
    b = rows.select(*keys, F.col("level").alias("to_factor_value"), F.col("value").alias("to_metric_value"), F.col("at").alias("_b"))
    return _finish(a.join(b, keys).where("_a < _b"), "single_factor", 1)


def zero_shot_contrasts(results: DataFrame, config: dict[str, list], *, check: bool = True) -> DataFrame | None:
    """Zero-shot conditions against the mean of the retrieval conditions at each count; None without zero-shot rows.

    A mean over an undefined value is undefined."""
    metrics = _require_metrics(results)
    counts = levels(config)["example_count"]
    zero = results.where("example_count = 0")
    if not counts or not zero.limit(1).count():
        return None
    held = [*CONTEXT, "language_model", "prompt_name"]
    grid = len(config["retrieval_method"]) * len(config["embedding_model"]) * len(config["example_order"])
    few = results.where(F.col("example_count").isin(*counts))
    if check:
        _one(zero.groupBy(*held).count().where("count > 1"), "two zero-shot rows for one language model and prompt")
        per = few.groupBy(*held, "example_count").count()
        _one(per.where(F.col("count") != grid), f"a language model and prompt must have {grid} retrieval conditions at each count")
        spine = zero.select(*held).unionByName(few.select(*held)).distinct()
        _one(spine.join(zero, held, "left_anti"), "retrieval conditions without zero-shot")
        _one(spine.join(per.groupBy(*held).agg(F.count("*").alias("n")).where(F.col("n") == len(counts)), held, "left_anti"), "zero-shot without retrieval conditions at each count")
    mean = _mean_in_order(F.col("value"), [c for c in FACTORS if c not in held and c != "example_count"])
    a = _long(zero, metrics).select(*held, "metric", F.lit(0).alias("from_factor_value"), F.col("value").alias("from_metric_value"))
    b = _long(few, metrics).groupBy(*held, "metric", "example_count").agg(mean.alias("to_metric_value")).withColumnRenamed("example_count", "to_factor_value")
    return _finish(a.join(b, [*held, "metric"]).withColumns({"factor": F.lit("example_count"), "fixed_context": _fixed(held)}), "zero_shot_to_few_shot", grid)


def _mean_in_order(value: Column, order: list[str]) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(*order, value.alias("x"))))
    return F.when(F.count(value) == F.count("*"), F.aggregate(listed, F.lit(0.0), lambda s, x: s + x["x"]) / F.count("*"))


def contrast_details(results: DataFrame, config: dict[str, list], *, check: bool = True) -> DataFrame:
    results = pinned(results)
    zero = zero_shot_contrasts(results, config, check=check)
    strict = strict_contrasts(results, config, check=check)
    return strict if zero is None else strict.unionByName(zero)


def contrast_summary(details: DataFrame) -> DataFrame:
    """Overall and, but for the factor language_model, by language model."""
    keys = ["contrast_type", "factor", "from_factor_value", "to_factor_value", "metric", "direction"]
    defined = F.col("delta").isNotNull()
    order = ["language_model", *CONTEXT, "fixed_context"]

    def mean(c: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(defined, F.struct(*order, F.col(c).alias("x")))))
        return F.aggregate(listed, F.lit(0.0), lambda s, x: s + x["x"]) / F.nullif(F.count("delta").cast("double"), F.lit(0.0))

    tally = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    values = [
        F.count("*").alias("n_total_pairs"), F.count("delta").alias("n_defined_pairs"), mean("from_metric_value").alias("mean_from_metric_value"), mean("to_metric_value").alias("mean_to_metric_value"),
        mean("delta").alias("mean_delta"), F.stddev_samp("delta").alias("std_delta"), tally("improved").alias("n_improved"), tally("tied").alias("n_tied"), tally("worsened").alias("n_worsened"),
        (tally("improved") / F.nullif(F.count("delta").cast("double"), F.lit(0.0))).alias("improvement_rate"),
    ]
    model = F.col("language_model")
    scopes = F.array(F.struct(F.lit("overall").alias("scope"), F.lit(NOT_APPLICABLE).alias("model")), F.struct(F.lit("language_model").alias("scope"), model.alias("model")))
    each = details.withColumn("_s", F.explode(F.when(F.col("factor") == "language_model", F.slice(scopes, 1, 1)).otherwise(scopes)))
    keys = [*keys, F.col("_s.scope").alias("aggregation_scope"), F.col("_s.model").alias("scope_language_model")]
    return each.groupBy(*keys).agg(*values).select(*SUMMARY)
