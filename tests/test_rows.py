import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text, values
from ledgerloom.operators import composition, prompts, retrieval, sampling

ROWS = "id string, split string, hard_text string, profession string, gender string, loaded_at int"


def rows(spark):
    return spark.createDataFrame([
        ("train:1:0", "train ", "a", "Nurse", "male", 1), ("train:1:0", "train", "new", "nurse", "male", 2), ("train:1:1", "TRAIN", "bb", "software engineer", "female", 1),
        ("train:1:10", "train", "c", "nurse", "female", 1), ("dev:1:0", "Dev", "d", "nurse", "male", 1), ("dev:1:1", "dev", "", "software-engineer", "male", 1), (None, "dev", "x", "nurse", "male", 1), ("dev:1:2", "dev", None, None, None, 1),
    ], ROWS)


def test_source_rows_and_order(spark):
    r = sampling.with_train_order(sampling.source_rows(rows(spark)))
    got = {x["id"]: x for x in r.collect()}
    assert len(got) == 6 and got["train:1:0"]["hard_text"] == "new" and got["train:1:1"]["profession"] == "software_engineer"
    assert [got[f"train:1:{i}"]["train_order"] for i in (0, 1, 10)] == [0, 1, 2] and got["dev:1:0"]["train_order"] is None
    assert got["dev:1:0"]["split"] == "validation"
    kept = sampling.of_professions(r)
    assert kept.count() == 5
    assert [x["id"] for x in sampling.train_cap(kept, 2).orderBy("ordinal").collect()] == ["train:1:0", "train:1:1"]
    with pytest.raises(ValueError, match="there are 3"):
        sampling.train_cap(kept, 4)
    with pytest.raises(ValueError, match="test"):
        sampling.require_splits(kept, ("train", "test"))
    assert sampling.pool_filter(sampling.train_cap(kept, 2), ("nurse", "dj")) == "profession in ('nurse', 'dj') and train_order <= 1"
    b = sampling.max_balanced(kept, "validation", ("nurse", "software_engineer")).first()
    assert (b["rows_per_cell"], b["empty_cells"]) == (0, 2)
    with pytest.raises(ValueError, match="fewer than 1"):
        sampling.require_cells(sampling.balanced_sample(kept, "validation", 1), 1, ("nurse",))


def test_composition(spark):
    c = composition.composition_counts(sampling.of_professions(sampling.source_rows(rows(spark))), ("train", "validation", "test"), ("nurse", "dj"))
    got = {(r["split"], r["profession"], r["gender"]): r for r in c.collect()}
    assert len(got) == 12
    assert got["train", "nurse", "male"]["gender_share_within_profession"] == 0.5 and got["train", "nurse", "male"]["gender_share_gap_within_profession"] == 0
    assert got["train", "dj", "male"]["gender_share_within_profession"] is None and got["test", "nurse", "male"]["cell_share_of_split"] is None


@pytest.mark.parametrize("raw, clean", [("a  b", "a b"), ("x​y", "xy"), ("hi ,", "hi,"), ("<p>A&amp;B</p><script>x</script>", "A&B"), ("ﬁn　１", "fin 1"), ("café", "café"), ("a\x0cb", "a b"), ("<!-- x -->", ""), ("", ""), (None, None), ("a < b & c", "a < b & c"), ("“q”", '"q"')])
def test_clean_text(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(text.clean_text(F.col("t"))).first()[0] == clean


def test_labels_and_values(spark):
    df = spark.createDataFrame([(" Physician\n", 1.0, 0.0)], "t string, a double, b double")
    assert df.select(text.output_label(F.col("t"))).first()[0] == "physician"
    assert df.select(text.display_name(F.lit("hard_text"))).first()[0] == "Hard Text"
    assert df.select(values.rate("a", "b")).first()[0] is None
    assert values.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    m = spark.createDataFrame([({"b": -1.0, "a": -1.0, "c": -2.0},)], "m map<string,double>")
    assert m.select(prompts.best_label(F.col("m"), ["b", "a", "c"])).first()[0] == "b"
    assert m.select(values.sorted_map_json(F.col("m"))).first()[0] == '{"a":-1.0,"b":-1.0,"c":-2.0}'


def test_greedy():
    full = [("A", "m"), ("A", "f"), ("B", "m"), ("B", "f")]
    rank = [("A", "m"), ("A", "m"), ("A", "f"), ("B", "m"), ("B", "f")]
    assert retrieval.greedy_balanced([p for p, _ in rank], [g for _, g in rank], 4, full) == [0, 4, 2, 3]
    with pytest.raises(ValueError, match="balance"):
        retrieval.greedy_balanced(["A", "B", "B"], ["m", "m", "f"], 4, [("A", "m"), ("B", "m"), ("B", "f")])


def vectors(spark):
    v = [("q", "A", "m", 0, [1.0, 0.0], 1), ("a", "A", "m", 3, [1.0, 0.1], 5), ("b", "A", "f", 1, [2.0, 0.2], 9), ("c", "B", "m", 2, [1.0, 0.1], 9), ("d", "B", "f", 4, [0.0, 1.0], 1)]
    return spark.createDataFrame(v, "id string, profession string, gender string, train_order int, vector array<float>, text_length long")


def test_topk_and_ties(spark):
    pool = vectors(spark)
    queries = pool.where("id = 'q'").select(F.col("id").alias("query_id"), "vector")
    got = [r["id"] for r in retrieval.semantic_topk(pool, queries, 3).orderBy("pos").collect()]
    assert got == ["b", "c", "a"]  # equal scores: longer text, then smaller train_order
    got = [r["id"] for r in retrieval.balanced_topk(pool, queries, 4).orderBy("pos").collect()]
    assert got == ["b", "c", "a", "d"]
    assert retrieval.semantic_topk(pool, queries.limit(0), 3).count() == 0


def test_vector_problems(spark):
    nan = float("nan")
    v = spark.createDataFrame([("train:1:0", "nurse", "male", 0, [1.0, 2.0]), ("train:1:0", "nurse", "male", 0, [1.0, 2.0]), ("x", "nurse", "male", 0, None), ("y", "n", "m", 1, [nan, 1.0]), ("z", "n", "m", 1, [0.0, 0.0]), ("w", "n", "m", 1, [1.0])], "id string, profession string, gender string, train_order int, vector array<float>")
    r = retrieval.vector_problems(v, sampling.with_train_order(sampling.source_rows(rows(spark))), 2).first()
    assert (r["vector_rows"], r["null_vectors"], r["wrong_length"], r["not_finite"], r["zero_vectors"], r["repeated_ids"], r["without_row"], r["rows_without_vector"]) == (6, 1, 1, 1, 1, 1, 4, 2)
    assert retrieval.usable_vectors(v, 2).count() == 1


def test_example_order(spark):
    df = spark.createDataFrame([([(1, "a", 0.5), (2, "b", None), (3, "c", 0.5), (4, "d", 0.9)],)], "x array<struct<pos:int,id:string,retrieval_score:double>>")
    ids = lambda o: [r["id"] for r in df.select(retrieval.order_examples(F.col("x"), o, 42, 4)).first()[0]]
    assert ids("most_similar_first") == ["d", "a", "c", "b"] and ids("most_similar_last") == ["a", "c", "d", "b"]
    assert sorted(ids("shuffle")) == list("abcd") and ids("shuffle") == ["abcd"[i] for i in retrieval.permutation(42, 4)]


def test_grid(spark):
    g = prompts.condition_grid(spark, ["x", "y"], ["s", "b"], ["e"], [0, 2, 4], ["f"], {"p": "{labels}", "q": "t"}).collect()
    assert len(g) == 2 * 2 * (1 + 2 * 2) and len({r["condition"] for r in g}) == len(g)
    for bad in ("{x}", "{labels"):
        with pytest.raises(ValueError):
            prompts.check_template(bad)
