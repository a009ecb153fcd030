import random

import numpy as np

from ledgerloom.llm import packing, raking

ROWS = "id string, batch_id long, profession string, gender string, loaded_at int, weight double, available long"
REQUESTS = "request_id long, batch_id long, sample_size int"
TARGETS = "request_id long, profession string, gender string, target_share double, min_rows int"


def test_rake_meets_margins():
    have = np.array([50.0, 20, 30, 40])
    a, b = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    w = raking.rake(have, np.array([30.0, 10, 15, 45]), [a, b])
    assert np.allclose(np.bincount(a, have * w), [40, 60]) and np.allclose(np.bincount(b, have * w), [45, 55])


def test_rake_keeps_margins_when_a_cell_is_empty():
    """A cell without rows: the others of its profession and gender make up for it, as far as they have rows."""
    a, b = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    have = np.array([100.0, 0, 100, 100])
    got = have * raking.rake(have, np.array([30.0, 10, 15, 45]), [a, b])
    assert np.allclose(got, [40, 0, 5, 55], atol=1e-6)
    tight = np.array([100.0, 4, 100, 60])
    got = tight * raking.rake(tight, np.array([30.0, 10, 15, 45]), [a, b])
    assert (got <= tight + 1e-9).all() and np.allclose(np.bincount(a, got), [40, 60], atol=1e-6)


def test_quotas_are_the_rounded_targets():
    request = np.array([0, 0, 0, 1, 1])
    got = raking.quotas(np.array([10.4, 5.3, 4.3, 2.5, 2.5]), request, np.array([20, 5]), np.array([50, 50, 50, 2, 9]))
    assert got.tolist() == [10, 5, 5, 2, 3] or got.tolist() == [11, 5, 4, 2, 3]
    assert got[:3].sum() == 20 and got[3:].sum() == 5


def test_repair_fills_minimums():
    got = raking.repair(np.array([10, 0, 5]), np.array([0, 3, 5]), np.array([20, 2, 9]), np.array([8.0, 2, 5]))
    assert got.tolist() == [8, 2, 5]


def test_sample(spark):
    rng = random.Random(1)
    rows = [(f"{i:04}", i % 2, rng.choice(["nurse", "Nurse ", "dj", None]), rng.choice(["male", "female", None]), 0, 0.0, 0) for i in range(400)]
    requests = [(1, 0, 40), (2, 1, 30), (3, 9, 10), (4, 0, 0), (None, 0, 5)]
    targets = [(1, "nurse", "male", 0.5, 0), (1, "nurse", "female", 0.25, 5), (1, "dj", "male", 0.25, 0), (1, "dj", "male", 0.25, 0), (2, "nurse", "male", 1.0, 500), (3, "dj", "male", 1.0, 1), (4, "dj", "male", 1.0, 0), (2, None, "male", 0.0, 1), (8, "dj", "male", 1.0, 1)]
    frames = spark.createDataFrame(rows + rows[:9], ROWS), spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(targets, TARGETS)
    sample, report = raking.balanced_sample(*frames)
    picked = [(r["request_id"], r["id"]) for r in sample.collect()]
    assert len(picked) == len(set(picked)) and sum(r == 1 for r, _ in picked) == 40
    out = {(r["request_id"], r["profession"], r["gender"]): r for r in report.collect()}
    assert not out[2, "nurse", "male"]["met"] and out[2, "nurse", "male"]["taken"] == out[2, "nurse", "male"]["available"]
    assert not out[3, "dj", "male"]["met"] and out[4, "dj", "male"]["met"] and not out[2, None, "male"]["met"]
    assert out[1, "nurse", "female"]["taken"] >= 5 and out[1, "nurse", "male"]["taken"] == 20 and out[1, "dj", "male"]["taken"] == 10
    assert {(r, i) for r, i in picked} == {(r["request_id"], r["id"]) for r in raking.balanced_sample(*frames)[0].collect()}
    assert raking.balanced_sample(frames[0].limit(0), *frames[1:])[0].count() == 0
    assert raking.balanced_sample(frames[0], frames[1], frames[2].limit(0))[1].count() == 0


def test_minimum_of_a_cell_without_share(spark):
    """A cell with share 0, and a request of size 0, get the rows of their minimums; the report counts those in the sample."""
    rows = [(f"{i:03}", 0, "nurse" if i % 2 else "dj", "male", 0, 0.0, 0) for i in range(60)]
    frames = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1, 0, 10), (2, 0, 0)], REQUESTS), spark.createDataFrame([(1, "nurse", "male", 1.0, 0), (1, "dj", "male", 0.0, 3), (2, "dj", "male", 1.0, 4)], TARGETS)
    sample, report = raking.balanced_sample(*frames)
    held = [(r["request_id"], r["profession"]) for r in sample.collect()]
    assert {x: held.count(x) for x in held} == {(1, "nurse"): 7, (1, "dj"): 3, (2, "dj"): 4}
    assert {(r["request_id"], r["profession"]): (r["taken"], r["gap"]) for r in report.collect()} == {(1, "nurse"): (7, 3), (1, "dj"): (3, 0), (2, "dj"): (4, 0)}


def plain_best_fit(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(left) if r >= s]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= s
        else:
            left.append(capacity - s)
    return sorted(left)


def test_best_fit_equals_plain_search():
    rng = random.Random(2)
    for capacity in (1, 7, 64, 100):
        sizes = [rng.randrange(0, capacity + 1) for _ in range(300)]
        where = packing.best_fit_decreasing(np.array(sizes), capacity)
        left = capacity - np.bincount(where, sizes).astype(int)
        assert sorted(left.tolist()) == plain_best_fit(sizes, capacity)


def test_pack(spark):
    texts = [None, "", "é" * 60, "x" * 100, "x" * 101, "y" * 250, "z" * 1_000_000, *("w" * (i % 90 + 1) for i in range(500))]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "a", "c", 1)], "doc_id long, text string, container string, size int")
    windows = spark.createDataFrame([("s", 120, 20), ("l", 1000, 0), ("bad", 10, 10), (None, 5, 0)], "window_name string, max_tokens int, reserved_tokens int")
    packed = packing.pack(docs, windows, shard_items=100)
    got = packed.toPandas()
    for name, capacity in (("s", 100), ("l", 1000)):
        part = got[got.window_name == name]
        assert part.groupby("container")["size"].sum().max() <= capacity
        sizes = part.groupby("item_id")["size"].sum().to_dict()
        assert sizes == {i: len(t.encode()) for i, t in enumerate(texts) if t is not None}
        assert part.container.nunique() <= 1.05 * -(-sum(sizes.values()) // capacity) + 1
    assert set(got.window_name) == {"s", "l"}
    cut = {tuple(r) for r in packing.cut_items(packed).collect()}
    assert cut == {(2, "s"), (4, "s"), (5, "s"), (6, "s"), (6, "l")}
    assert packing.pack(docs.limit(0), windows).count() == 0 and packing.pack(docs, windows.limit(0)).count() == 0
