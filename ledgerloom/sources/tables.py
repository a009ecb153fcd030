"""Sources and sinks: source rows as JSON lines, prediction files, vector tables with a manifest, run folders.

Everything goes through Spark's readers and writers, so that a path may lie on any file system the cluster shares;
only small documents (manifests, reports, configurations) are written by the driver."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical_json, fingerprint, is_usable_vector, row_digest
from ..operators.prompts import Encoder, encode
from ..schema import GENDERS, PROFESSIONS, REPORT_NAMES, SOURCE_ROW, VECTOR_ROW

PREDICTION_CSV = "condition string, target string, audit_column string, retrieval_method string, embedding_model string, example_count int, example_order string, prompt_name string, master_prompt string, language_model string, prediction_method string, device string, example_order_seed int, dataset_shuffle_seed int, evaluation_split string, query_id string, hard_text string, profession string, gender string, true_label string, audit_group string, predicted_label string, prompt string, model_output string, label_scores string, examples_used int, examples string"
CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


# documents on the driver's side


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small document whole or not at all: beside its place first, then renamed over it in one step."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(path + f".{os.getpid()}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(target), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small document, None if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


# source rows


def read_source_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of id, split, hard_text, profession and gender; other fields are not read."""
    return spark.read.schema(SOURCE_ROW).json(path)


def write_source_rows(rows: DataFrame, path: str) -> None:
    rows.select(*(c.split()[0] for c in SOURCE_ROW.split(", "))).write.mode("overwrite").json(path)


def decode_names(rows: DataFrame) -> DataFrame:
    """Whole-number codes of profession and gender as names; an unknown code is null."""
    name = lambda c, names: F.get(F.array(*map(F.lit, names)), F.col(c))
    return rows.withColumn("profession", name("profession", PROFESSIONS)).withColumn("gender", name("gender", GENDERS))


def seeded_order(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """Ids split:seed:index, index counting rows of each split in an order drawn by the seed."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("split").orderBy(F.xxhash64(F.lit(seed), key), key)) - 1
    return rows.withColumn("id", F.concat_ws(":", "split", F.lit(str(seed)), place.cast("string")))


# prediction files


def read_predictions(spark: SparkSession, path: str, splits: tuple[str, ...]) -> DataFrame:
    """A CSV of predictions; fails unless it holds exactly the splits."""
    rows = spark.read.schema(PREDICTION_CSV).options(**CSV).csv(path)
    found = {r[0] for r in rows.select("evaluation_split").distinct().collect()}
    if found != set(splits):
        raise ValueError(f"the file holds the splits {sorted(map(str, found))}; {sorted(splits)} are configured")
    return rows


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """CSV with nested columns as JSON and the reports' metric names; single for tables that people read."""
    flat = df.select(*((F.to_json(c) if kind.startswith(("array", "map", "struct")) else F.col(c)).alias(REPORT_NAMES.get(c, c)) for c, kind in df.dtypes))
    (flat.coalesce(1) if single else flat).write.mode("overwrite").options(**CSV).csv(path)


# vector tables


def rows_digest(rows: DataFrame) -> str:
    """A digest of all rows that doesn't hang on their order: digests of buckets, then one over these."""
    d = row_digest("id", "hard_text", "profession", "gender", "train_order")
    part = rows.select(d.alias("d")).groupBy(F.substring("d", 1, 3).alias("b")).agg(F.sum(F.conv(F.substring("d", 4, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return fingerprint([[r[0], str(r[1]), r[2]] for r in part.orderBy("b").collect()])  # at most 4096 buckets


def vector_manifest(rows: DataFrame, settings: dict) -> dict:
    return {"version": 1, "rows": rows.count(), "digest": rows_digest(rows), "order": "text length descending, then train_order", "encoder": settings}


def prepare_vectors(rows: DataFrame, path: str, settings: dict, make: Callable[[], Encoder]) -> dict:
    """Writes the vectors of training rows unless a table with the same manifest stands there; the manifest comes last, so
    that a broken run is never taken for a table."""
    spark = rows.sparkSession
    want = vector_manifest(rows, settings)
    if read_text(spark, path + ".manifest.json") == canonical_json(want):
        return want
    delete(spark, path + ".manifest.json")
    try:
        made = encode(rows.select("id", "profession", "gender", "train_order", "hard_text"), make, settings["dimension"])
        made.select(*(c.split()[0] for c in VECTOR_ROW.split(", "))).write.mode("overwrite").parquet(path)
    except Exception:
        delete(spark, path)
        raise
    write_text(spark, path + ".manifest.json", canonical_json(want))
    return want


def open_vectors(rows: DataFrame, path: str, settings: dict) -> DataFrame:
    """The vector table; fails if it or its manifest is missing or was made of other rows or with other settings."""
    spark = rows.sparkSession
    if read_text(spark, path + ".manifest.json") != canonical_json(vector_manifest(rows, settings)):
        raise ValueError(f"{path} is missing or doesn't fit; prepare it first")
    table = spark.read.parquet(path)
    if [f.simpleString().replace("struct<", "") for f in table.schema.fields] != [c.replace(" ", ":") for c in VECTOR_ROW.split(", ")]:
        raise ValueError(f"{path} has other columns")
    return table


def query_vectors(queries: DataFrame, folder: str, settings: dict, make: Callable[[], Encoder], text_col: str = "hard_text") -> DataFrame:
    """Vectors of queries, kept under a fingerprint of settings and texts; what is missing, not whole or unusable is made anew."""
    spark = queries.sparkSession
    prompted = queries.select("id", F.concat(F.lit(settings.get("query_prompt", "")), F.col(text_col)).alias("text"))
    digest = prompted.agg(F.count("*"), F.sum(F.xxhash64("id", "text").cast("decimal(38,0)"))).first()
    path = f"{folder}/{fingerprint([settings, digest[0], str(digest[1])])}"
    if exists(spark, f"{path}/_SUCCESS"):
        kept = spark.read.parquet(path)
        if dict(kept.dtypes) == {"query_id": "string", "vector": "array<float>"}:
            met = kept.where(is_usable_vector(F.col("vector"), settings["dimension"])).groupBy("query_id").count().join(queries.select(F.col("id").alias("query_id")), "query_id")
            if (kept.count(), met.where("count = 1").count()) == (digest[0], digest[0]):
                return kept
    encode(prompted, make, settings["dimension"], "text").select(F.col("id").alias("query_id"), "vector").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# runs


def slug(name: str) -> str:
    return name.replace("/", "--")


def run_folder(output: str, split: str, now: float | None = None) -> str:
    t = time.time() if now is None else now
    return f"{output}/{split}-run-{time.strftime('%Y%m%d-%H%M%S', time.gmtime(t))}-{int(t % 1 * 1e6):06d}"


def checkpoint_path(output: str, config: dict, model: str) -> str:
    """Where a model's predictions are kept until a run is whole; another configuration has another place."""
    return f"{output}/incomplete/{fingerprint(config)[:16]}/{slug(model)}"


def checkpointed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was written whole, otherwise that of make, written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard_incomplete(spark: SparkSession, output: str, config: dict) -> bool:
    return delete(spark, f"{output}/incomplete/{fingerprint(config)[:16]}")


def completed_runs(output: str) -> list[str]:
    """Folders of whole runs on a local file system, the newest first."""
    if not os.path.isdir(output):
        return []
    need = ("config_used.yaml", "best_quality_prompts.txt", "best_fairness_prompts.txt")
    found = [d for d in os.listdir(output) if "-run-" in d and all(os.path.isfile(f"{output}/{d}/{n}") for n in need)]
    return [f"{output}/{d}" for d in sorted(found, key=lambda d: d.split("-run-", 1)[1], reverse=True)]
