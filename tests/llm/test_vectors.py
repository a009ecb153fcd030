import numpy as np
import pytest

from ledgerloom.llm import vptree

SCHEMA = "id string, vector array<float>, shard string, other string"


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.4], n)[:, None]
    return (x * rng.uniform(0.2, 3, (n, 1))).astype(np.float32)


def brute(x, k, least):
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


@pytest.mark.parametrize("factor, recall", [(1.0, 1.0), (0.1, 0.95)])
def test_recall(spark, factor, recall):
    x = clustered(1500, 16)
    df = spark.createDataFrame([(f"{i:05}", v.tolist(), "", "") for i, v in enumerate(x)], SCHEMA)
    got = {(int(r["id"]), int(r["other"])) for r in vptree.nearest(df, dim=16, k=5, least=0.85, factor=factor, shard_rows=200, leaf_rows=32, visitors=300).collect()}
    want = brute(x, 5, 0.85)
    assert len(want) > 3000 and len(got & want) >= recall * len(want)
    assert not factor == 1 or got == want


def test_odd_rows_copies_and_ties(spark):
    nan, one = float("nan"), [1.0, 0.0]
    rows = [("a", one), ("a", one), ("b", [2.0, 0.0]), ("c", one), ("d", [0.0, 1.0]), ("e", None), ("f", [1.0]), ("g", [nan, 1.0]), ("h", [0.0, 0.0]), ("i", [float("inf"), 1.0]), (None, one), ("j", [1.0, 0.1]), ("k", [3e38, 3e37])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)
    got = [(r["id"], r["other"]) for r in vptree.nearest(df, dim=2, k=2, least=0.5).collect()]
    by = {i: [b for a, b in got if a == i] for i in "abcdjk"}
    assert set(by["a"]) <= {"b", "c"} and len(by["a"]) == 2 and set(by["c"]) == {"a", "b"} and by["d"] == []
    assert "k" in by["j"] and len(by["j"]) == 2
    pairs = {tuple(r) for r in vptree.similar_pairs(vptree.nearest(df, dim=2, k=2, least=0.5)).collect()}
    assert ("a", "b") in pairs and all(a < b for a, b in pairs)
    assert vptree.nearest(df.limit(0), dim=2).count() == 0


def test_very_many_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i:05}", [1.0, 2.0, 3.0, 4.0]) for i in range(1000)] + [(f"x{i:05}", rng.normal(size=4).tolist()) for i in range(500)]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)
    got = vptree.nearest(df, dim=4, k=3, least=0.9, factor=1.0, shard_rows=100, leaf_rows=16).where("id like 'c%'").collect()
    assert len(got) == 3000 and {r["other"] for r in got} == {"c00000", "c00001", "c00002", "c00003"}


def test_no_row_under_the_bound_over_many_shards(spark):
    x = clustered(1200, 16, 7)
    df = spark.createDataFrame([(f"{i:05}", v.tolist(), "", "") for i, v in enumerate(x)], SCHEMA)
    got = vptree.nearest(df, dim=16, k=5, least=0.9, factor=1.0, shard_rows=60, leaf_rows=16, visitors=40).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert got and all(r["similarity"] >= 0.9 and abs(r["similarity"] - u[int(r["id"])] @ u[int(r["other"])]) < 1e-9 for r in got)
    assert {(int(r["id"]), int(r["other"])) for r in got} == brute(x, 5, 0.9)


def test_one_hot_vectors(spark):
    """Equally far from each other: no vantage point halves them."""
    df = spark.createDataFrame([(f"{i:02}", np.eye(64)[i].tolist(), "", "") for i in range(64)], SCHEMA)
    got = vptree.nearest(df, k=3, factor=1.0, shard_rows=8, leaf_rows=4)
    assert got.count() == 64 * 3 and vptree.nearest(df, k=3, least=0.5, shard_rows=8, leaf_rows=4).count() == 0


def test_dense_shard_is_split(spark):
    """Two thirds of the vectors lie close together; their shard is split again by vectors of its own."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(300, 8)), np.ones(8) + 0.01 * rng.normal(size=(600, 8))))
    df = spark.createDataFrame([(f"{i:05}", v.tolist(), "", "") for i, v in enumerate(x)], SCHEMA)
    rows = df.selectExpr("id", "vector")
    router = vptree._fitted(rows, 900, 8, 64, 64, 0)
    at = vptree._homes(router, rows.toArrow().to_batches()[0], 8)
    assert np.bincount(at).max() <= 2 * 64 + 16
    got = {(int(r["id"]), int(r["other"])) for r in vptree.nearest(df, dim=8, k=4, least=0.5, factor=1.0, shard_rows=64, sample_rows=64, leaf_rows=16).collect()}
    assert got == brute(x.astype(np.float32), 4, 0.5)
