"""Reports and the data behind plots; drawing them is left to whoever has a plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FAIRNESS, RATES

PLOTTED = {"quality": ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_f1", "matthews_correlation_coefficient", "cohen_kappa", "worst_audit_group_accuracy", "audit_group_accuracy_difference"], "fairness": [f"{a}_{x}" for x in FAIRNESS for a in ("mean", "min", "max")], "label": RATES}
NOT_PLOTTED = {"example_count", "sample_count", "quality_rank", "fairness_rank"}


def selected_prompts(ranked: DataFrame, templates: dict[str, str], criterion: str, metric: str, values: dict[str, str]) -> str:
    """The winners' prompts by language model, placeholders filled in; says so where a model has no winner."""
    won = ranked.where(f"is_{criterion}_best").select("language_model", "condition", "prompt_name", "retrieval_method", "example_count", "example_order", metric)
    models = [r[0] for r in ranked.select("language_model").distinct().orderBy("language_model").collect()]
    rows = won.orderBy("language_model", "condition").collect()  # as many as conditions at most
    parts = []
    for model in models:
        own = [r for r in rows if r["language_model"] == model]
        if not own:
            parts.append(f"{model}\nno winner: {metric} is undefined for every condition")
        for r in own:
            head = f"{model}\ncondition: {r['condition']}\n{metric}: {r[metric]!r}\nprompt: {r['prompt_name']}\nretrieval: {r['retrieval_method']}, {r['example_count']} examples, {r['example_order']}"
            parts.append(f"{head}\n\n{templates[r['prompt_name']].format(**values)}")
    return "\n\n---\n\n".join(parts) + "\n"


def axis_limits(df: DataFrame, columns: list[str]) -> tuple[float, float]:
    """From the least value or 0 to the largest or 0, with a margin of a twentieth; (0, 1) if all are undefined."""
    r = df.agg(F.least(F.lit(0.0), *(F.min(c) for c in columns)).alias("a"), F.greatest(F.lit(0.0), *(F.max(c) for c in columns)).alias("b"), *(F.count(c).alias(f"n{i}") for i, c in enumerate(columns))).first()
    if not any(r[f"n{i}"] for i in range(len(columns))):
        return 0.0, 1.0
    a, b = float(r["a"]), float(r["b"])
    m = (b - a) * 0.05 or 0.05
    return (a - m if a < 0 else 0.0), (b + m if b > 0 else m)


def condition_label():
    return F.concat_ws(" | ", "language_model", "prompt_name", "retrieval_method", F.col("example_count").cast("string"), "example_order")


def metric_panels(results: DataFrame, kind: str = "quality") -> DataFrame:
    """(label, metric, value, undefined): one row for each mark of a panel plot."""
    columns = [c for c in PLOTTED[kind] if c in results.columns]
    wide = results.select(condition_label().alias("label"), *(F.expr(f"try_cast({c} AS double)").alias(c) for c in columns))
    return wide.unpivot("label", columns, "metric", "value").withColumn("undefined", F.col("value").isNull())


def ranked_panels(ranked: DataFrame, criterion: str) -> DataFrame:
    keep = ["condition", f"{criterion}_rank", f"is_{criterion}_best"]
    return metric_panels(ranked).join(ranked.select(condition_label().alias("label"), *keep), "label").orderBy(F.col(f"{criterion}_rank").asc_nulls_last(), "condition", "metric")


def require_coverage(df: DataFrame) -> None:
    """Fails if a numeric column is neither plotted nor excepted."""
    known = {c for columns in PLOTTED.values() for c in columns} | NOT_PLOTTED
    if left := [c for c, kind in df.dtypes if kind in ("double", "int", "bigint") and c not in known and not c.startswith("n_")]:
        raise ValueError(f"columns that no plot shows: {', '.join(left)}")


def preview(df: DataFrame, rows: int = 500) -> DataFrame:
    return df.limit(rows)


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a front end shows of a run: winners, rankings, their metrics and predictions, cut to a preview."""
    from .ranking import of_winners, winners

    ranked = tables["results"]
    out = {f"{k}_winners": winners(ranked, k) for k in ("quality", "fairness")} | {"ranking": ranked.orderBy("language_model", F.col("quality_rank").asc_nulls_last(), "condition")}
    for name in ("target_label_metrics", "confusion_matrix", "audit_group_metrics", "fairness_metrics"):
        out[name] = of_winners(tables[name], ranked)
    for k in ("quality", "fairness"):
        out[f"{k}_winner_predictions"] = of_winners(tables["predictions"], ranked, k)
    return {k: preview(v) for k, v in out.items()} | {k: tables[k] for k in ("source_counts", "run_counts") if k in tables}


def require_consistent(ranked: DataFrame) -> None:
    """Fails unless every model has a quality winner, winners share one value, and no rank 1 is left out."""
    r = ranked.groupBy("language_model").agg(F.sum(F.col("is_quality_best").cast("int")).alias("n"), F.sum(((F.col("fairness_rank") == 1) != F.col("is_fairness_best")).cast("int")).alias("odd"))
    for x in r.where("n = 0 or odd > 0").limit(1).collect():
        raise ValueError(f"ranks and winners of {x[0]} don't fit")


