import random

import numpy as np
import pytest

from ledgerloom.llm import fmindex, subjects, textform


@pytest.mark.parametrize("n, letters", [(1, 1), (2, 1), (60, 2), (500, 5), (3000, 40)])
def test_index_finds_every_place(n, letters):
    rng = np.random.default_rng(n)
    text = rng.integers(0, letters, n)
    assert fmindex.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
    index = fmindex.FMIndex(text, letters)
    for length in (1, 2, 5):
        if length > n:
            continue
        phrases = np.array([text[i : i + length] for i in rng.integers(0, n - length + 1, 15)] + [rng.integers(0, letters, length)])
        for p, a, b in zip(phrases, *index.search(phrases)):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n - length + 1) if text[i : i + length].tolist() == p.tolist()]


def test_spans_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(words, k=rng.choice([4, 20, 40]))) for _ in range(12)]
    docs = []
    for _ in range(80):
        t = rng.choices(words, k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            p = rng.choice(passages).split()
            a = rng.randrange(len(p) // 2 + 1)
            at = rng.randrange(len(t) + 1)
            t[at:at] = p[a : a + rng.randrange(5, 25)]
        docs.append(" ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    docs += [None, "", passages[-1], "pad " * 100_000 + passages[1] + " <b>" + passages[2] + "</b>"]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)] + [(None, passages[0], "x", "y")], "doc_id long, text string, item_id string, k string")
    i = spark.createDataFrame([(f"i{n}", p, "z") for n, p in enumerate(passages)] + [("i0", passages[0], "z"), ("n", None, "z"), (None, passages[1], "z"), ("e", "", "z")], "item_id string, passage string, text string")
    want = set()
    for n, t in enumerate(docs):
        w = textform.words(t)
        grams = {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
        for m, p in enumerate(passages):
            q = p.split()
            if any(tuple(q[j : j + 10]) in grams for j in range(len(q) - 9)):
                want.add((n, f"i{m}"))
    found = fmindex.leaked_spans(d, i, shard_words=700).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 10
    by_block = fmindex.leaked_spans(d, i, block_words=40)
    assert sorted(by_block.collect()) == sorted(found)
    for r in found:
        run = textform.words(docs[r["doc_id"]])[r["first_word"] : r["end_word"]]
        assert len(run) >= 10
    merged = fmindex.removal_spans(by_block).collect()
    assert {r["doc_id"] for r in merged} == {a for a, _ in want}
    assert fmindex.leaked_spans(d.limit(0), i).count() == 0 and fmindex.leaked_spans(d, i.limit(0)).count() == 0


TOPICS = {"law": ["court", "appeal", "statute", "verdict"], "sport": ["goal", "sprint", "referee", "league"], "music": ["chord", "opera", "violin", "tempo"]}


def make_docs(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        names = rng.choice([["law"], ["sport"], ["music"], ["law", "music"], []])
        sentences = [f"In {rng.randrange(1900, 2000)} they spoke about {rng.choice(TOPICS[t])} with Mr{rng.randrange(10**6)}." for t in names for _ in range(rng.randrange(3, 7))]
        sentences += [f"The page of N{rng.randrange(10**6)} was changed on day {rng.randrange(99)}." for _ in range(rng.randrange(1, 4))]
        rng.shuffle(sentences)
        docs.append((i, " ".join(sentences), "x", "y"))
        truth[i] = {t: sum(any(w in s for w in TOPICS[t]) for s in sentences) / len(sentences) for t in names}
    return docs, truth


def test_held_out_subjects(spark):
    docs, truth = make_docs(600, 1)
    labels = [(i, t, "r") for i in range(0, 600, 4) for t in truth[i]]
    labels += [(labels[k][0], " " + labels[k][1].upper(), "r") for k in range(10)] + [(1, None, "r"), (99999, "law", "r"), (2, "nonsense", "r"), (None, "law", "r")]
    d = spark.createDataFrame(docs + [(7000, None, "x", "y"), (7001, "", "x", "y"), (None, "court", "x", "y"), (7002, "court appeal. " * 30_000, "x", "y")], "doc_id long, text string, subject string, terms string")
    l = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    a = spark.createDataFrame([(t, t) for t in TOPICS], "subject string, description string")
    shares = subjects.subject_shares(d, l, a)
    found = {(r["doc_id"], r["subject"]) for r in shares.where("share >= 0.2").collect()}
    want = {(i, t) for i, x in truth.items() for t, s in x.items() if s >= 0.2}
    assert len(found & want) >= 0.97 * len(want) and len(found - want - {(7002, "law")}) <= 0.03 * len(want)
    counted = {r["subject"]: r["documents"] for r in subjects.composition(d, shares.where("share >= 0.2")).collect()}
    assert counted[None] > 50 and counted["law"] > 150
    for x, y, z in ((d.limit(0), l, a), (d, l.limit(0), a), (d, l, a.limit(0))):
        assert subjects.subject_shares(x, y, z).count() == 0


def test_subject_of_a_third(spark):
    """One subject holds a third of the documents, each of its words over a fifth; with the query's parameters."""
    rng = random.Random(5)
    names = ["law", "sport", "music", "food", "film"]
    words = TOPICS | {"food": ["oven", "recipe", "flour", "butter"], "film": ["camera", "scene", "actor", "studio"]}
    docs, truth = [], {}
    for i in range(900):
        about = ["law"] if i % 3 == 0 else rng.choice([[n] for n in names[1:]] + [[]])
        sentences = [f"In {rng.randrange(1900, 2000)} they spoke about {rng.choice(words[t])} with Mr{rng.randrange(10**6)}." for t in about for _ in range(rng.randrange(4, 8))]
        sentences += [f"The page of N{rng.randrange(10**6)} was changed on day {rng.randrange(99)}." for _ in range(rng.randrange(1, 4))]
        docs.append((i, " ".join(sentences)))
        truth |= {(i, t): True for t in about}
    assert all(sum(w in t for _, t in docs) > 0.2 * len(docs) for w in words["law"])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([(i, t) for i, t in truth if i % 4 < 1], "doc_id long, subject string")
    a = spark.createDataFrame([(t,) for t in names], "subject string")
    found = {(r["doc_id"], r["subject"]) for r in subjects.subject_shares(d, l, a).where("share >= 0.2").collect()}
    for name in names:
        want = {x for x in truth if x[1] == name}
        got = {x for x in found if x[1] == name}
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_rare_subject_without_a_leaf(spark):
    """One document in a hundred is about a subject that no leaf is mostly about; hand labels name some of them."""
    docs, truth = make_docs(1000, 3)
    rng = random.Random(9)
    moves = ["gambit", "bishop", "rook", "castling"]
    for i in range(0, 1000, 100):
        chess = " ".join(f"In {rng.randrange(1900, 2000)} they spoke about {x} with Mr{rng.randrange(10**6)}." for x in moves)
        docs[i], truth[i] = (i, f"{docs[i][1]} {chess} {chess}", "x", "y"), truth[i] | {"chess": 1.0}
    d = spark.createDataFrame(docs, "doc_id long, text string, a string, b string")
    l = spark.createDataFrame([(i, t) for i in range(0, 1000, 4) for t in truth[i]], "doc_id long, subject string")
    a = spark.createDataFrame([(t,) for t in [*TOPICS, "chess"]], "subject string")
    found = {r["doc_id"] for r in subjects.subject_shares(d, l, a).where("share >= 0.2 and subject = 'chess'").collect()}
    assert found == set(range(0, 1000, 100))


def test_leaves_are_of_all_documents(spark):
    """Split in Spark, the vectors give the leaves that they give in memory."""
    rng = np.random.default_rng(2)
    x = (rng.random((900, 12)) * (rng.random((900, 12)) < 0.3)).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    points = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x], "at array<int>, w array<float>").repartition(5)
    tree, leaves, centres = subjects.grow(subjects._totaller(points), 12, 9, 8)
    assert len(leaves) == 9 and np.allclose(centres, subjects.bisecting_kmeans(x, 9, 8), atol=1e-5)
    leaf = tree.leaf_of(*np.nonzero(x), x[np.nonzero(x)], len(x))
    assert set(leaf[(x != 0).any(1)]) == set(leaves)
    for i, c in zip(leaves, centres):
        s = x[leaf == i].sum(0)
        assert np.allclose(s / np.linalg.norm(s), c, atol=1e-5)


def test_bisecting():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, 4)) for c in np.eye(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = subjects.bisecting_kmeans(x.astype(np.float32), 4, 5)
    assert sorted((centres @ np.eye(4)).argmax(1).tolist()) == [0, 1, 2, 3]
    assert len(subjects.bisecting_kmeans(np.zeros((5, 4), np.float32), 4, 1)) == 0
