"""A whole experiment: prepare vectors, retrieve, predict, measure, rank, contrast and write."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import task_settings, validate
from ..functions.values import canonical_json
from ..operators import composition, contrasts, metrics, prompts, ranking, reports, retrieval, sampling
from ..schema import GENDERS
from ..sources import tables as io

Make = Callable[[], object]


def _split_rows(config: dict, rows: DataFrame) -> DataFrame:
    task = task_settings(config)
    kept = sampling.with_train_order(sampling.source_rows(rows)).where(F.col("profession").isin(*task.professions) & F.col("gender").isin("male", "female") & F.col("hard_text").isNotNull())
    sampling.require_splits(kept, ("train", config["defaults"]["evaluation_split"]))
    return kept


def select_run_data(config: dict, rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(training pool, evaluation rows, evaluation rows of each cell)."""
    task, d = task_settings(config), config["dataset"]
    kept = _split_rows(config, rows)
    train = sampling.train_cap(kept, None if d["train_size"] == "all" else d["train_size"])
    split, n = config["defaults"]["evaluation_split"], d["evaluation_per_profession_gender"]
    if n == "max_balanced":
        n = sampling.max_balanced(kept, split, task.professions).first()["rows_per_cell"]
        if not n:
            raise ValueError("a cell of the evaluation split has no rows")
    sample = sampling.balanced_sample(kept, split, n)
    sampling.require_cells(sample, n, task.professions)
    return train, sample, n


def grid(spark: SparkSession, config: dict) -> DataFrame:
    r = config["retrieval"]
    models = [m if isinstance(m, str) else m["id"] for m in config["inference"]["language_models"]]
    return prompts.condition_grid(spark, models, r["methods"], [m["id"] for m in r["embedding_models"]], r["example_counts"], r["example_orders"], config["prompt_templates"])


def _vector_path(folder: str, model: dict) -> str:
    return f"{folder}/vectors/{model['id'].lower().replace('/', '_')}"


def prepare_vectors(config: dict, rows: DataFrame, folder: str, make: Callable[[dict], Make]) -> dict[str, int]:
    """Rows of the vector table of each encoder, made where it is missing or out of date."""
    train = _split_rows(validate(config), rows).where("split = 'train'")
    return {m["id"]: io.prepare_vectors(train, _vector_path(folder, m), m, make(m))["rows"] for m in config["retrieval"]["embedding_models"]}


def retrievals(config: dict, rows: DataFrame, folder: str, make: Callable[[dict], Make]) -> DataFrame | None:
    """Selections of every method and encoder at the largest count, smaller counts being their first rows; None if no
    condition has examples."""
    k = max(config["retrieval"]["example_counts"])
    if not k:
        return None
    train, sample, _ = select_run_data(config, rows)
    all_train = _split_rows(config, rows).where("split = 'train'")
    pairs = [(p, g) for p in task_settings(config).professions for g in GENDERS]
    out = None
    for m in config["retrieval"]["embedding_models"]:
        _warn_cut(all_train, m)
        v = io.open_vectors(all_train, _vector_path(folder, m), m)
        retrieval.require_usable(v, all_train, m["dimension"])
        pool = v.join(train.select("id", F.length("hard_text").cast("long").alias("text_length")), "id")
        retrieval.require_pool(pool, k)
        queries = io.query_vectors(sample, f"{folder}/queries", m, make(m))
        for method in config["retrieval"]["methods"]:
            found = retrieval.semantic_topk(pool, queries, k) if method == "semantic" else retrieval.balanced_topk(pool, queries, k, pairs)
            found = found.select(F.lit(method).alias("retrieval_method"), F.lit(m["id"]).alias("embedding_model"), "query_id", "pos", "id", "profession", "gender", F.col("score").alias("retrieval_score"))
            out = found if out is None else out.unionByName(found)
    return retrieval.hydrate(out, train)  # the pool was joined to the same rows, so that each has its text


def _warn_cut(rows: DataFrame, model: dict) -> None:
    if most := model.get("max_sequence_length"):
        if n := prompts.too_long(rows, most).count():
            warnings.warn(f"{model['id']} takes {most} tokens; {n} training texts are longer by white space alone and will be cut", stacklevel=3)


def predictions(config: dict, rows: DataFrame, folder: str, encoder: Callable[[dict], Make], predictor: Callable[[str], Make]) -> DataFrame:
    """Predictions of every condition for every evaluation row, written by language model, so that a broken run goes on where it was."""
    task, d = task_settings(validate(config)), config["defaults"]
    spark = rows.sparkSession
    _, sample, _ = select_run_data(config, rows)
    found = None
    order, k = config["retrieval"]["example_orders"], max(config["retrieval"]["example_counts"])
    out = None
    for model in [m if isinstance(m, str) else m["id"] for m in config["inference"]["language_models"]]:

        def make(model=model) -> DataFrame:
            nonlocal found
            if k and found is None:
                found = retrievals(config, rows, folder, encoder).groupBy("retrieval_method", "embedding_model", "query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "hard_text", "profession", "gender", "retrieval_score"))).alias("all_examples"))
            cells = F.broadcast(grid(spark, config).where(F.col("language_model") == model))
            queries = sample.select(F.col("id").alias("query_id"), "hard_text", "profession", "gender")
            asked = queries.join(cells)  # conditions are few and stated; every query runs under each
            asked = asked.join(found, ["retrieval_method", "embedding_model", "query_id"], "left") if found is not None else asked.withColumn("all_examples", F.expr("cast(null as array<struct<pos:int,id:string,hard_text:string,profession:string,gender:string,retrieval_score:double>>)"))
            cut = F.coalesce(F.slice("all_examples", F.lit(1), F.greatest("example_count", F.lit(1))), F.expr("slice(all_examples, 1, 0)"))
            cut = F.when(F.col("example_count") > 0, F.when(F.size("all_examples") >= F.col("example_count"), cut).otherwise(F.raise_error(F.concat(F.lit("no examples for "), "query_id"))))
            asked = asked.withColumn("cut", cut)
            shown = F.when(F.lit(False), F.col("cut"))
            for o in order:
                if o == "shuffle":
                    for n in sorted({c for c in config["retrieval"]["example_counts"] if c}):
                        shown = shown.when((F.col("example_order") == o) & (F.col("example_count") == n), retrieval.order_examples(F.col("cut"), o, d["seed"], n))
                else:
                    shown = shown.when(F.col("example_order") == o, retrieval.order_examples(F.col("cut"), o))
            empty = F.expr("cast(array() as array<struct<pos:int,id:string,hard_text:string,profession:string,gender:string,retrieval_score:double>>)")
            asked = asked.withColumn("shown", F.coalesce(shown, empty))
            system = prompts.fill(F.col("master_prompt"), task.target, task.audit_column, list(task.labels))
            chat = prompts.chat(system, F.col("shown"), prompts.render_input(F.col("hard_text"), task.audit_column, F.col(task.audit_column)), task.target, task.audit_column)
            examples = F.transform("shown", lambda x: F.struct(x["id"].alias("id"), x["profession"].alias("profession"), x["gender"].alias("gender"), x["retrieval_score"].alias("retrieval_score")))
            method = config["inference"].get("prediction_method", "generated_output")
            ready = asked.select("condition", F.lit(task.target).alias("target"), F.lit(task.audit_column).alias("audit_column"), "retrieval_method", "embedding_model", "example_count", "example_order", "prompt_name", "master_prompt", "language_model", F.lit(method).alias("prediction_method"), F.lit("spark").alias("device"), F.lit(d["seed"]).alias("example_order_seed"), F.lit(config["dataset"]["shuffle_seed"]).alias("dataset_shuffle_seed"), F.lit(d["evaluation_split"]).alias("evaluation_split"), "query_id", "hard_text", "profession", "gender", F.col(task.target).alias("true_label"), F.col(task.audit_column).alias("audit_group"), chat.alias("prompt"), F.size("shown").alias("examples_used"), examples.alias("examples"))
            return prompts.predict(ready, predictor(model), list(task.labels))

        part = io.checkpointed(spark, io.checkpoint_path(folder, config, model), make)
        out = part if out is None else out.unionByName(part)
    return out.select(*(c.split()[0] for c in io.PREDICTION_CSV.split(", ")))


def calculate(config: dict, predicted: DataFrame) -> dict[str, DataFrame]:
    """All metric tables, ranked results and contrasts of predictions; no model is touched."""
    task, d = task_settings(config), config["defaults"]
    metrics.validate(predicted, list(task.labels))
    metrics.require_constant(predicted, [c for c in metrics.CONDITION if c != "condition"])
    out = metrics.metric_tables(predicted, list(task.labels))
    out["results"] = ranking.rank_results(out["results"], d["quality_metric"], d["quality_direction"], d["fairness_metric"], d["fairness_direction"])
    r = config["retrieval"]
    levels = {"language_model": [m if isinstance(m, str) else m["id"] for m in config["inference"]["language_models"]], "prompt_name": list(config["prompt_templates"]), "retrieval_method": r["methods"], "embedding_model": [m["id"] for m in r["embedding_models"]], "example_count": r["example_counts"], "example_order": r["example_orders"]}
    out["factor_contrast_details"] = contrasts.contrast_details(out["results"], levels)
    out["factor_contrast_summary"] = contrasts.contrast_summary(out["factor_contrast_details"])
    out["predictions"] = predicted
    return out


def run_experiment(config: dict, rows: DataFrame, folder: str, encoder: Callable[[dict], Make], predictor: Callable[[str], Make]) -> tuple[str, dict[str, DataFrame]]:
    """Runs all of it, writes every table and both reports to a new folder, and drops the checkpoints of the run."""
    spark, task, d = rows.sparkSession, task_settings(validate(config)), config["defaults"]
    path = io.run_folder(f"{folder}/{d['output_dir']}", d["evaluation_split"])
    # typed predictions stay with the run, as the checkpoints go at its end
    predictions(config, rows, folder, encoder, predictor).write.parquet(f"{path}/predictions.parquet")
    out = calculate(config, spark.read.parquet(f"{path}/predictions.parquet"))
    kept = _split_rows(config, rows)
    out["source_counts"] = composition.composition_counts(kept, ("train", d["evaluation_split"]), task.professions)
    train, sample, _ = select_run_data(config, rows)
    out["run_counts"] = composition.composition_counts(train.unionByName(sample.drop("place")), ("train", d["evaluation_split"]), task.professions)
    for name, df in out.items():
        io.write_csv(df, f"{path}/{name}", single=name != "predictions")
    values = {"target": task.target, "audit_column": task.audit_column, "labels": ", ".join(task.labels)}
    for kind in ("quality", "fairness"):
        metric = ranking.metric_name(d[f"{kind}_metric"])
        io.write_text(spark, f"{path}/best_{kind}_prompts.txt", reports.selected_prompts(out["results"], config["prompt_templates"], kind, metric, values))
    io.write_text(spark, f"{path}/config_used.yaml", canonical_json(config))  # JSON is YAML as well
    io.discard_incomplete(spark, folder, config)
    return path, out


def load_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables and reports of a finished run; metric columns have the reports' names."""
    names = ("results", "target_label_metrics", "confusion_matrix", "audit_group_metrics", "fairness_metrics", "factor_contrast_details", "factor_contrast_summary", "predictions", "source_counts", "run_counts")
    return {n: spark.read.options(**io.CSV, inferSchema=n != "predictions").csv(f"{path}/{n}") for n in names if io.exists(spark, f"{path}/{n}")}


def recalculate(config: dict, path: str, spark: SparkSession) -> dict[str, DataFrame]:
    """Metrics anew from a finished run's predictions, as after a change of the ranking metric."""
    return calculate(validate(config), io.read_predictions(spark, f"{path}/predictions", (config["defaults"]["evaluation_split"],)))
