"""Queries of the core operators over the test tables; oracle.py has the SQL they must equal.

Values that come from sums of fractions are rounded to 10 decimals, as engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text, values
from .operators import composition, contrasts, metrics, prompts, ranking, reports, retrieval, sampling
from .oracle import oracle_sql  # noqa: F401
from .schema import CONDITION, NOT_APPLICABLE, PROFESSIONS
from .session import table

LABELS = list(PROFESSIONS)
SEED = 42


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(F.abs(c) < 5e-11, 0.0).otherwise(F.round(c, 10)) for c, kind in df.dtypes if kind == "double"})


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Source rows without their texts."""
    return sampling.of_professions(sampling.source_rows(table(spark, d, "source_rows"), columns=("split", "profession", "gender")))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """The last prediction of each condition and query, without outputs that are no label."""
    used = [*CONDITION, "true_label", "predicted_label", "audit_group"]
    one = metrics.last_predictions(table(spark, d, "predictions"), ["condition", "evaluation_split", "query_id"], ["run_no", "predicted_at"], used)
    good = one.where("predicted_label is not null and true_label is not null and audit_group is not null")
    return good.withColumns({"target": F.lit("profession"), "audit_column": F.lit("gender"), "prediction_method": F.lit("generated_output")})


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cells(_predictions(spark, d))


def composition_counts(spark, d):
    return composition.composition_counts(_rows(spark, d))


def max_balanced(spark, d):
    return sampling.max_balanced(_rows(spark, d), "validation")


def balanced_sample(spark, d):
    return sampling.balanced_sample(_rows(spark, d), "test", 5).select("id", "profession", "gender", "place")


def train_order(spark, d):
    return sampling.with_train_order(_rows(spark, d)).select("id", "split", "train_order")


def train_cap(spark, d):
    rows = _rows(spark, d)
    return sampling.train_cap(rows, 100).select("id", "profession", "gender", "ordinal")


def condition_grid(spark, d):
    c = table(spark, d, "conditions")
    names = ("language_model", "retrieval_method", "embedding_model", "example_count", "example_order")
    rows = c.select(*names, "prompt_name", "master_prompt").distinct().collect()  # a fixed table of conditions
    levels = {k: sorted({r[k] for r in rows} - {NOT_APPLICABLE}) for k in names}
    templates = dict(sorted({(r["prompt_name"], r["master_prompt"]) for r in rows}))
    return prompts.condition_grid(spark, levels["language_model"], levels["retrieval_method"], levels["embedding_model"], levels["example_count"], levels["example_order"], templates)


def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_cells(spark, d), LABELS)


def confusion_pivot(spark, d):
    return metrics.confusion_pivot(metrics.confusion_matrix(_cells(spark, d), LABELS), LABELS)


def target_label_metrics(spark, d):
    return metrics.target_label_metrics(_cells(spark, d), LABELS)


def audit_group_metrics(spark, d):
    return metrics.audit_group_metrics(_cells(spark, d), LABELS)


def fairness_metrics(spark, d):
    return metrics.fairness_metrics(_cells(spark, d), LABELS)


def _results(spark, d):
    return metrics.results(_cells(spark, d).persist(), LABELS)  # read thrice; as many rows as conditions, groups and labels allow


def condition_results(spark, d):
    return _rounded(_results(spark, d))


def metric_panels(spark, d):
    return reports.metric_panels(_rounded(_results(spark, d)))


def axis_limits(spark, d):
    found = _results(spark, d)
    wide = ["macro_f1", "cohen_kappa", "matthews_correlation_coefficient"]
    rows = [(c, *map(float, reports.axis_limits(found, columns))) for c, columns in (("accuracy", ["accuracy"]), ("agreement", wide))]
    return _rounded(spark.createDataFrame(rows, "panel string, low double, high double"))  # a row a panel


def best_labels(spark, d):
    """The label that each true label is taken for most often, by the scoring rule: of equal scores the first configured."""
    n = _cells(spark, d).groupBy("condition", "evaluation_split", "true_label", "predicted_label").agg(F.sum("n").cast("double").alias("n"))
    scores = n.groupBy("condition", "evaluation_split", "true_label").agg(F.map_from_entries(F.collect_list(F.struct("predicted_label", "n"))).alias("scores"))  # an entry a label
    return scores.select("condition", "evaluation_split", "true_label", prompts.best_label(F.col("scores"), LABELS).alias("best_label"))


def length_order(spark, d):
    """Places of the training rows in the order in which vectors are made, counted within a profession."""
    measured = table(spark, d, "source_rows").withColumn("length", F.length("hard_text"))
    rows = sampling.of_professions(sampling.source_rows(measured, columns=("split", "profession", "gender", "length"))).where("split = 'train' and length is not null")
    order = Window.partitionBy("profession").orderBy(F.desc("length"), "ordinal", "id")
    return rows.select("id", "length", F.row_number().over(order).alias("place"))


def _ranked(spark, d):
    return ranking.rank_results(_rounded(_results(spark, d)), check=False)


def ranked_results(spark, d):
    return _ranked(spark, d).select("condition", "language_model", "evaluation_split", "macro_f1", "mean_equalized_odds_difference", "quality_rank", "is_quality_best", "fairness_rank", "is_fairness_best")


def winners(spark, d):
    return ranking.winners(_ranked(spark, d)).select("language_model", "evaluation_split", "condition", "macro_f1")


def winner_predictions(spark, d):
    return ranking.of_winners(_predictions(spark, d), _ranked(spark, d)).select("condition", "evaluation_split", "query_id", "true_label", "predicted_label")


def _config(spark, d) -> dict[str, list]:
    """Configured levels, from the fixed table of conditions."""
    names = ("language_model", "prompt_name", "retrieval_method", "embedding_model", "example_count", "example_order")
    rows = table(spark, d, "conditions").select(*names).distinct().collect()
    return {k: sorted({r[k] for r in rows} - {NOT_APPLICABLE, 0}) for k in names}


def _details(spark, d):
    return contrasts.contrast_details(_results(spark, d), _config(spark, d), check=False)


def contrast_details(spark, d):
    return _rounded(_stable(_details(spark, d).where("contrast_type = 'single_factor'"))).drop("fixed_context")


def _stable(details: DataFrame) -> DataFrame:
    """Outcomes of rounded improvements, so that they do not hang on the last bit."""
    i = F.round("improvement", 10)
    return details.withColumn("outcome", F.when(i.isNull(), "undefined").when(i > 0, "improved").when(i < 0, "worsened").otherwise("tied"))


def zero_shot_contrasts(spark, d):
    return _rounded(_stable(_details(spark, d).where("contrast_type = 'zero_shot_to_few_shot'"))).drop("fixed_context")


def contrast_summary(spark, d):
    return _rounded(contrasts.contrast_summary(_stable(_details(spark, d))))


def _pool(spark, d):
    v = retrieval.usable_vectors(table(spark, d, "train_vectors"), 64)
    measured = table(spark, d, "source_rows").withColumn("text_length", F.length("hard_text").cast("long"))
    lengths = sampling.source_rows(measured, columns=("split", "text_length")).select("id", "text_length")
    return v.join(lengths, "id", "left").withColumn("text_length", F.coalesce("text_length", F.lit(0)))


def _queries(pool: DataFrame) -> DataFrame:
    """The stated query set: every vector whose train_order 50 divides."""
    return pool.where("train_order % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def semantic_topk(spark, d):
    pool = _pool(spark, d).where("profession is not null and gender is not null")
    return retrieval.semantic_topk(pool, _queries(pool), 8).withColumn("score", F.round("score", 6))


def balanced_topk(spark, d):
    pool = _pool(spark, d).where("profession is not null and gender is not null")
    return retrieval.balanced_topk(pool, _queries(pool), 4).withColumn("score", F.round("score", 6))


def vector_problems(spark, d):
    return retrieval.vector_problems(table(spark, d, "train_vectors"), sampling.source_rows(table(spark, d, "source_rows"), columns=("split", "profession", "gender", "train_order")), 64)


def _selected(spark, d):
    keys = ["retrieval_method", "embedding_model", "query_id"]
    s = table(spark, d, "retrieval_selections").distinct()
    return s.where("pos <= 4").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "retrieval_score"))).alias("examples"))


def ordered_examples(spark, d):
    s = _selected(spark, d).where("size(examples) = 4")
    out = [s.select("retrieval_method", "query_id", F.lit(o).alias("example_order"), F.posexplode(retrieval.order_examples(F.col("examples"), o, SEED, 4)).alias("place", "x")) for o in ("most_similar_first", "most_similar_last", "shuffle")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("retrieval_method", "query_id", "example_order", "place", F.col("x.id").alias("id"))


def hydrated_examples(spark, d):
    rows = sampling.source_rows(table(spark, d, "source_rows"), columns=("split", "hard_text")).select("id", "hard_text")
    return retrieval.hydrate(table(spark, d, "retrieval_selections"), rows)


def build_prompt(spark, d):
    """The prompts of every condition with examples, for every query with selections, most similar example first."""
    rows = sampling.source_rows(table(spark, d, "source_rows"))
    shown = table(spark, d, "retrieval_selections").where("profession is not null and gender is not null").select("retrieval_method", "query_id", "pos", "id", "profession", "gender").distinct()
    shown = shown.join(rows.select("id", "hard_text").where("hard_text is not null"), "id")
    shown = shown.groupBy("retrieval_method", "query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "hard_text", "profession", "gender"))).alias("examples"))
    queries = rows.where("hard_text is not null and gender is not null").select(F.col("id").alias("query_id"), "hard_text", "gender")
    grid = table(spark, d, "conditions").where("example_count > 0").select("condition", "retrieval_method", "example_count", "master_prompt")
    joined = shown.join(queries, "query_id").join(F.broadcast(grid), "retrieval_method")
    system = prompts.fill(F.col("master_prompt"), "profession", "gender", LABELS)
    messages = prompts.chat(system, F.slice("examples", F.lit(1), F.col("example_count")), prompts.render_input(F.col("hard_text"), "gender", F.col("gender")), "profession", "gender")
    return joined.select("condition", "query_id", F.size(messages).alias("messages"), F.sha2(prompts.chat_text(messages), 256).alias("prompt_sha256"))


def label_normalise(spark, d):
    p = table(spark, d, "predictions").withColumn("label", text.output_label(F.col("model_output")))
    p = p.withColumn("valid", F.coalesce(F.col("label").isin(LABELS), F.lit(False)))
    return p.groupBy("condition", "label", "valid").agg(F.count("*").alias("outputs"))


def clean_text(spark, d):
    return table(spark, d, "source_rows").select("id", "loaded_at", text.clean_text(F.col("hard_text")).alias("clean"))


def fingerprints(spark, d):
    rows = table(spark, d, "source_rows")
    return rows.select("id", values.row_digest("id", "split", "hard_text", "profession", "gender", "train_order").alias("digest"))


def benchmark_aggregate(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("embedding_model"), (F.col("user_id") % 9).alias("batch_size"))
    # whole hundredths add up exactly in any order
    return e.agg(F.count("*").alias("row_count"), (F.sum(F.round(F.col("value") * 100).cast("long")) / 100).alias("seconds")).withColumn("rows_per_second", F.round(values.rate("row_count", "seconds"), 10))


def group_quality_extra_volume(spark, d):
    """The same metrics over lineitem: return flag as label, line status as group, prediction by line number."""
    li = table(spark, d, "lineitem").select(F.lit("lineitem").alias("condition"), F.col("l_returnflag").alias("true_label"), F.col("l_linestatus").alias("audit_group"), F.when(F.col("l_linenumber") % 4 == 0, "N").otherwise(F.col("l_returnflag")).alias("predicted_label"))
    return metrics.audit_group_metrics(metrics.cells(li, ["condition"]), ["A", "N", "R"], ["condition"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (composition_counts, max_balanced, balanced_sample, train_order, train_cap, condition_grid, confusion_matrix, confusion_pivot, target_label_metrics, audit_group_metrics, fairness_metrics, condition_results, metric_panels, axis_limits, best_labels, length_order, ranked_results, winners, winner_predictions, contrast_details, zero_shot_contrasts, contrast_summary, semantic_topk, balanced_topk, vector_problems, ordered_examples, hydrated_examples, build_prompt, label_normalise, clean_text, fingerprints, benchmark_aggregate, group_quality_extra_volume)
    return {f.__name__: f for f in named}


