import random

import numpy as np
import pytest

from ledgerloom.llm import bottomk, components, simhash, textform

SCHEMA = "id string, split string, hard_text string, profession string, source string, loaded_at int, key string, rep string"


def corpus(seed=0, n=120):
    """Texts of which many are edited copies of others, over few words, so that some runs are very frequent."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        else:
            t = "one common way to begin every text here".split() + rng.choices(words, k=rng.randrange(8, 40))
        texts.append(" ".join(t))
    return [(f"{i:03}", rng.choice(["train", " Train", "dev", "TEST"]), t, rng.choice(["a", "A ", "b c", "b-c"]), rng.choice(["s", None]), 0, "x", "y") for i, t in enumerate(texts)]


ODD = [("n1", "train", None, "a", "s", 0, "", ""), ("n2", "dev", "", "a", "s", 0, "", ""), ("n3", "dev", "too short", "a", "s", 0, "", ""), (None, "dev", "one common way to begin every", "a", "s", 0, "", ""), ("n4", None, "one common way to begin every text", None, "s", 0, "", "")]


def sets(rows):
    return {r[0]: set(textform.shingle_batch([r[2]], 3)[0].tolist()) for r in rows if r[0] and r[2]}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    s = sets(rows)
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prof = {r[0]: r[3].strip().lower().replace(" ", "_").replace("-", "_") for r in rows}
    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if prof[a] == prof[b] and jaccard(s[a], s[b]) >= 0.55:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    groups = {}
    for i in ids:
        groups.setdefault(root(i), []).append(i)
    want = sorted((g, i) for g, m in groups.items() if len(m) > 1 for i in m)
    df = spark.createDataFrame(rows + ODD + rows[:5], SCHEMA)
    got = sorted(tuple(r) for r in bottomk.near_duplicate_groups(df, words=3, threshold=0.55).collect())
    assert got == want


@pytest.mark.parametrize("seed", [0, 1])
def test_overlaps_equal_brute_force(spark, seed):
    rows = corpus(seed)
    s = sets(rows)
    train = {r[0] for r in rows if r[1].strip().lower() == "train"}
    want = {(a, b) for a in s if a not in train for b in s if b in train and jaccard(s[a], s[b]) >= 0.75}
    df = spark.createDataFrame(rows + ODD + rows[:5], SCHEMA)
    got = simhash.cross_split_overlaps(df, words=3, threshold=0.75).select("eval_id", "train_id").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want
    report = simhash.overlap_report(df, words=3, threshold=0.75).collect()
    assert sum(r["overlapping"] for r in report) == len({a for a, _ in want})
    assert any(r["source"] is None for r in report)


def test_overlaps_of_short_texts(spark):
    """Texts of a few runs against themselves with a word more: likeness of just 0.75 and above."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        t = [f"w{rng.randrange(10**6)}" for _ in range(5 + i % 12)]
        rows += [(f"a{i}", "train", " ".join(t), "a", "s", 0, "", ""), (f"b{i}", "dev", " ".join([*t, "more"]), "a", "s", 0, "", "")]
    got = simhash.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA), words=3, threshold=0.75).select("eval_id", "train_id").collect()
    assert {tuple(r) for r in got} == {(f"b{i}", f"a{i}") for i in range(300)}


def test_large_sets_share_a_block():
    rng = np.random.default_rng(3)
    n, both = 250_000, 214_286
    for _ in range(3):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, 2 * n - both))
        rng.shuffle(x)
        a, b = np.sort(x[:n]), np.sort(x[n - both :])
        (ca, ka), (cb, kb) = (simhash.fingerprints(v, np.array([len(v)]), simhash.tables(0.75, 1e-5)) for v in (a, b))
        assert (ka == kb).any() and (int(ca[0] ^ cb[0]) & (1 << 64) - 1).bit_count() <= simhash.radius(0.75, 1e-5)


@pytest.mark.parametrize("n, both", [(7, 6), (14, 12), (70, 60), (700, 600)])
def test_agreement_is_the_likeness(n, both):
    """Over many pairs of sets of one likeness, blocks and bits agree as often as the number of tables and the radius suppose."""
    rng = np.random.default_rng(n)
    tried, t = 1500, simhash.tables(0.75, 1e-5)
    whole = rng.integers(-(2**63), 2**63 - 1, (tried, 2 * n - both))
    (ca, ka), (cb, kb) = (simhash.fingerprints(np.sort(x, axis=1).ravel(), np.full(tried, x.shape[1]), t) for x in (whole[:, :n], whole[:, n - both :]))
    like = both / (2 * n - both)
    assert abs((ka == kb).mean() - like**simhash.SAMPLES) < 0.02 and (ka == kb).any(1).mean() > 0.998
    differ = np.array([int(x).bit_count() for x in (ca ^ cb).view(np.uint64)])
    assert abs(differ.mean() / simhash.CODE - (1 - like) / 2) < 0.02


def test_hot_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rows = corpus(4, 150)
    s = sets(rows)
    train = {r[0] for r in rows if r[1].strip().lower() == "train"}
    want = {(a, b) for a in s if a not in train for b in s if b in train and jaccard(s[a], s[b]) >= 0.75}
    got = simhash.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA), words=3, threshold=0.75).select("eval_id", "train_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_and_hot(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bottomk.near_duplicate_groups(df).count() == 0 and simhash.cross_split_overlaps(df).count() == 0
    text = "the very same text stands here again and again and again"
    rows = [(f"{i:04}", "train" if i % 3 else "dev", text, "a", "s", 0, "", "") for i in range(600)]
    hot = spark.createDataFrame(rows + [("z", "dev", text * 3000, "a", "s", 0, "", "")], SCHEMA)
    got = bottomk.near_duplicate_groups(hot).collect()
    assert len(got) == 600 and {r["group_id"] for r in got} == {"0000"}
    assert simhash.cross_split_overlaps(hot).count() == 200 * 400


def test_components(spark):
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(200) if i != 99] + [("x", "x"), ("0000", "0001")]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(got) == 201 and all(got[f"{i:04}"] == ("0000" if i < 100 else "0100") for i in range(201))


def test_sketch_estimate(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    a = sorted(rng.sample(range(-(10**9), 10**9), 2000))
    b = sorted(a[:1400] + rng.sample(range(2 * 10**9, 3 * 10**9), 600))
    df = spark.createDataFrame([(a, a, b)], "a array<long>, c array<long>, b array<long>")
    same, part = df.select(bottomk.union_estimate(F.col("a"), F.col("c"), 64), bottomk.union_estimate(F.col("a"), F.col("b"), 64)).first()
    assert same == 1 and 0 <= part <= 1


@pytest.mark.parametrize("hot, miss", [(0, 1e-5), (20_000, 0)])
def test_pairs_of_one_block_are_kept(spark, monkeypatch, hot, miss):
    """Pairs of a likeness of just 0.75 that share one block only, which is hot, are found; so they are without any block."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(6)] for _ in range(20_000)]
    (ca, ka), (cb, kb) = (simhash.fingerprints(*textform.shingle_batch([" ".join(t[:n]) for t in texts], 3), simhash.tables(0.75, 1e-5)) for n in (5, 6))
    single = np.flatnonzero((ka == kb).sum(axis=1) == 1)
    assert len(single)
    rows = [r for i in single for r in ((f"a{i}", "train", " ".join(texts[i][:5]), "a", "s", 0, "", ""), (f"b{i}", "dev", " ".join(texts[i]), "a", "s", 0, "", ""))]
    got = simhash.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA), words=3, threshold=0.75, miss=miss).select("eval_id", "train_id").collect()
    assert sorted(tuple(r) for r in got) == sorted((f"b{i}", f"a{i}") for i in single)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_overlaps_by_shingles_equal_brute_force(spark, monkeypatch, seed):
    """Without blocks, in parts of three sets."""
    monkeypatch.setattr(simhash, "PART", 3)
    rows = corpus(seed, 150)
    s = sets(rows)
    train = {r[0] for r in rows if r[1].strip().lower() == "train"}
    for threshold in (0.3, 0.75, 1.0):
        want = sorted((a, b) for a in s if a not in train for b in s if b in train and jaccard(s[a], s[b]) >= threshold)
        got = simhash.cross_split_overlaps(spark.createDataFrame(rows + ODD, SCHEMA), words=3, threshold=threshold, miss=0).select("eval_id", "train_id").collect()
        assert sorted(tuple(r) for r in got) == want
