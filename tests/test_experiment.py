import copy

import pytest
from pyspark.sql import functions as F

from ledgerloom import config as cfg
from ledgerloom.operators import prompts, reports
from ledgerloom.plans import experiment
from ledgerloom.sources import tables as io

CONFIG = {
    "defaults": {"target": "profession", "evaluation_split": "validation", "seed": 42, "output_dir": "out", "quality_metric": "balanced_accuracy", "quality_direction": "maximize", "fairness_metric": "mean_equalized_odds_difference", "fairness_direction": "minimize"},
    "dataset": {"file": "rows", "hub_id": "some/set", "revision": "r", "professions": ["nurse", "dj"], "shuffle_seed": 1, "train_size": "all", "evaluation_per_profession_gender": "max_balanced"},
    "retrieval": {"methods": ["semantic", "balanced_semantic"], "example_counts": [0, 2, 4], "example_orders": ["most_similar_last", "shuffle"], "embedding_models": [{"id": "enc/a", "revision": "r", "dimension": 16, "max_sequence_length": 64, "batch_size": 4, "dtype": "float32", "query_prompt": "Find: "}]},
    "prompt_templates": {"plain": "Name the {target}: {labels}.", "fair": "Ignore {audit_column}. {labels}"},
    "inference": {"language_models": ["lm/one", "lm/two"], "prediction_method": "generated_output", "batch_size": 2},
}


def make_rows(spark):
    out = [(f"{s}:1:{i}", s, f"text of {p} number {i} and {g} in {s}", p, g) for s, n in (("train", 40), ("dev", 13)) for i, (p, g) in enumerate([(p, g) for p in ("nurse", "dj") for g in ("male", "female")] * n)]
    return spark.createDataFrame(out, "id string, split string, hard_text string, profession string, gender string")


def test_experiment(spark, tmp_path):
    folder, rows = f"file://{tmp_path}", make_rows(spark)
    encoder, predictor = lambda m: lambda: prompts.StubEncoder(16), lambda m: lambda: prompts.StubPredictor()
    with pytest.raises(ValueError, match="prepare"):
        experiment.retrievals(CONFIG, rows, folder, encoder)
    assert experiment.prepare_vectors(CONFIG, rows, folder, encoder) == {"enc/a": 160}
    path, out = experiment.run_experiment(CONFIG, rows, folder, encoder, predictor)
    n = 2 * 2 * (1 + 2 * 2 * 2)
    assert out["results"].count() == n and out["predictions"].count() == n * 52
    used = {(r["example_count"], r["examples_used"]) for r in out["predictions"].select("example_count", "examples_used").distinct().collect()}
    assert used == {(0, 0), (2, 2), (4, 4)}
    p = out["predictions"].where("example_count = 2").first()
    assert [m["role"] for m in p["prompt"]] == ["system", "user", "assistant", "user", "assistant", "user"] and "{" not in p["prompt"][0]["content"]
    found = io.completed_runs(str(tmp_path / "out"))
    assert found == [path.removeprefix("file://")]
    again = experiment.recalculate(CONFIG, path, spark)["results"].select("condition", "accuracy", "quality_rank").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in out["results"].select("condition", "accuracy", "quality_rank").collect()} and len(again) == n
    loaded = experiment.load_run(spark, path)
    assert set(loaded) == set(out) and "accuracy / micro_precision / micro_recall / micro_f1 / weighted_recall" in loaded["results"].columns
    reports.require_consistent(out["results"])
    reports.require_coverage(out["results"])
    assert reports.metric_panels(out["results"]).count() > n
    low, high = reports.axis_limits(out["results"], ["accuracy"])
    assert low == 0 and 0 < high <= 1.05
    assert "no winner" not in io.read_text(spark, f"{path}/best_quality_prompts.txt")
    assert reports.views(out)["quality_winner_predictions"].count() >= 52
    assert not io.discard_incomplete(spark, folder, CONFIG)


def test_faulty_vectors_fail_the_run(spark, tmp_path):
    from ledgerloom.operators import retrieval

    rows = spark.createDataFrame([(f"train:1:{i}", "train", "nurse", "male", i) for i in range(3)], "id string, split string, profession string, gender string, train_order int")
    good = rows.drop("split").withColumn("vector", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    retrieval.require_usable(good, rows, 2)
    for bad in (good.limit(2), good.unionByName(good.limit(1)), good.withColumn("gender", F.lit("female")), good.withColumn("vector", F.expr("array(float(0), float(0))")), good.withColumn("vector", F.expr("array(float('nan'), float(0))"))):
        with pytest.raises(ValueError, match="don't fit"):
            retrieval.require_usable(bad, rows, 2)
    for k in (0, 4, True):
        with pytest.raises(ValueError):
            retrieval.require_pool(good, k)


def test_values_with_placeholders_stay(spark):
    df = spark.createDataFrame([("{target} of {labels}",)], "t string")
    assert df.select(prompts.fill(F.col("t"), "{labels}", "g", ["a{target}", "b"])).first()[0] == "{labels} of a{target}, b"


def test_text_is_replaced_in_one_step(spark, tmp_path):
    for text in ("one", "two"):
        io.write_text(spark, f"file://{tmp_path}/x.json", text)
        assert io.read_text(spark, f"file://{tmp_path}/x.json") == text
    assert not [f for f in tmp_path.iterdir() if "tmp" in f.name and not f.name.startswith(".")]


def test_broken_query_cache_is_made_anew(spark, tmp_path):
    rows, settings = spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, hard_text string"), {"dimension": 4}
    make = lambda: prompts.StubEncoder(4)
    first = sorted(map(tuple, io.query_vectors(rows, f"file://{tmp_path}/q", settings, make).collect()))
    path = next(p for p in (tmp_path / "q").iterdir())
    spark.createDataFrame([("a", [0.0, 0.0, 0.0, 0.0])], "query_id string, vector array<float>").write.mode("overwrite").parquet(f"file://{path}")
    assert sorted(map(tuple, io.query_vectors(rows, f"file://{tmp_path}/q", settings, make).collect())) == first


def test_strict_outputs(spark):
    grid = spark.createDataFrame([([("user", "x")],)], "prompt array<struct<role:string,content:string>>")

    class Wrong:
        def predict(self, chats, labels):
            return [("the physician", "the physician", None) for _ in chats]

    with pytest.raises(Exception, match="no label"):
        prompts.predict(grid, Wrong, ["physician"]).collect()
    assert prompts.predict(grid, Wrong, ["physician"], strict=False).first()["predicted_label"] is None


@pytest.mark.parametrize("path, value", [
    (("defaults", "target"), "age"), (("defaults", "seed"), -1), (("defaults", "seed"), True), (("defaults", "fairness_metric"), "accuracy"), (("defaults", "more"), 1), (("dataset", "professions"), ["nurse"]), (("dataset", "professions"), ["nurse", "pilot"]),
    (("dataset", "train_size"), 0), (("retrieval", "methods"), []), (("retrieval", "methods"), ["semantic", "semantic"]), (("retrieval", "example_counts"), [-1]), (("retrieval", "embedding_models"), [{}]), (("prompt_templates", "plain"), "{x}"), (("inference", "language_models"), []),
])
def test_bad_configurations(path, value):
    c = copy.deepcopy(CONFIG)
    cfg.validate(c)
    c[path[0]][path[1]] = value
    with pytest.raises(cfg.ConfigError):
        cfg.validate(c)


def test_prompt_files(tmp_path):
    (tmp_path / "p.txt").write_text(" {labels} \n")
    got = cfg.load_config_text("prompt_templates: {a: {file: p.txt}}", str(tmp_path))
    assert got["prompt_templates"] == {"a": "{labels}"}
    for bad in ("{a: {file: ../p.txt}}", "{a: {file: /etc/hosts}}", "{a: {file: none.txt}}", "{a: {file: p.txt}, b: text}"):
        with pytest.raises(cfg.ConfigError):
            cfg.load_config_text(f"prompt_templates: {bad}", str(tmp_path))


def test_rows_and_csv(spark, tmp_path):
    rows = make_rows(spark)
    io.write_source_rows(rows, f"file://{tmp_path}/rows")
    assert sorted(io.read_source_rows(spark, f"file://{tmp_path}/rows").collect()) == sorted(rows.collect())
    coded = spark.createDataFrame([(0, 1), (99, 0)], "profession int, gender int")
    assert sorted(map(tuple, io.decode_names(coded).collect()), key=str) == [("accountant", "female"), (None, "male")]
    assert io.seeded_order(rows, 7, "hard_text").select("id").distinct().count() == rows.count()
    a, b = io.rows_digest(rows.withColumn("train_order", F.lit(1))), io.rows_digest(rows.repartition(7).withColumn("train_order", F.lit(1)))
    assert a == b and a != io.rows_digest(rows.withColumn("train_order", F.lit(2)))
    odd = spark.createDataFrame([('a "q", b\nline', ["x"], None)], "t string, l array<string>, n string")
    io.write_csv(odd, f"file://{tmp_path}/odd", single=True)
    assert spark.read.options(**io.CSV).csv(f"file://{tmp_path}/odd").first()["t"] == 'a "q", b\nline'
    assert io.slug("a/b") == "a--b"
