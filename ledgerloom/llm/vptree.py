"""The k most similar vectors of every vector, by vantage-point trees.

Vectors are taken at unit length, where distance and cosine follow from each other: d^2 = 2 - 2 cos.  The top of
the tree is built on a bounded sample and sends every vector to one shard.  Each shard has a vantage-point tree of its
own.  A vector first searches its own shard; the distance of its k-th best so far is its radius, and it then visits the
other shards that the triangle inequality doesn't rule out within `factor` times that radius.  With factor 1 no
similar vector can be missed; smaller factors visit fewer shards and branches.  Whenever two vectors meet, either may
take the other into its list, so that a pair is lost only if both sides were pruned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import hash_sample, stored


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def split_point(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(vantage point, median distance): of a few candidates the one whose distances spread most."""
    seen = x if len(x) <= 1024 else x[rng.choice(len(x), 1024, False)]
    tried = x[rng.choice(len(x), min(len(x), 8), False)]
    d = _distance(tried @ seen.T)
    best = int(d.std(1).argmax())
    return tried[best], float(np.median(d[best] if len(seen) == len(x) else _distance(x @ tried[best])))


class Router:
    """The top of the tree: inner nodes hold a vantage point and a distance, leaves are shards (the number of a node names its shard)."""

    def __init__(self, dim: int) -> None:
        self.point, self.median = np.zeros((1, dim), np.float32), np.zeros(1)
        self.child = np.full((1, 2), -1)
        self.held = np.ones(1, bool)  # whether a shard holds vectors

    def grow(self, leaf: int, sample: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        """Splits a leaf `depth` times by a sample of its vectors, as far as that has 16 for a split and tells them apart."""
        if depth <= 0 or len(sample) < 16:
            return
        point, median = split_point(sample, rng)
        d = _distance(sample @ point)
        if not (d > median).any():  # half or more are equally far and nothing is farther
            if not (d < median).any():
                return
            median = float(d[d < median].max())
        at = len(self.child)
        self.point, self.median = np.concatenate((self.point, np.zeros((2, self.point.shape[1]), np.float32))), np.append(self.median, [0, 0])
        self.child, self.held = np.concatenate((self.child, np.full((2, 2), -1))), np.append(self.held, [True, True])
        self.point[leaf], self.median[leaf], self.child[leaf] = point, median, (at, at + 1)
        self.grow(at, sample[d <= median], depth - 1, rng)
        self.grow(at + 1, sample[d > median], depth - 1, rng)

    def shards(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, shard) for each shard that holds points within `reach` of a vector, as far as the triangle inequality tells."""
        who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            leaf = self.child[node, 0] < 0
            done.append((who[leaf], node[leaf]))
            who, node = who[~leaf], node[~leaf]
            d = _distance(np.einsum("ij,ij->i", x[who], self.point[node]))
            near, far = d - reach[who] <= self.median[node], d + reach[who] > self.median[node]
            who, node = np.concatenate((who[near], who[far])), np.concatenate((self.child[node[near], 0], self.child[node[far], 1]))
        who, node = (np.concatenate(p) for p in zip(*done)) if done else (who, node)
        return who[self.held[node]], node[self.held[node]]


class Best:
    """The k best partners so far of each of n vectors."""

    def __init__(self, n: int, k: int, least: float) -> None:
        self.k = k
        self.similarity = np.full((n, k), -np.inf, np.float32)
        self.partner = np.full((n, k), -1, np.int64)
        self.floor = np.full(n, least, np.float32)
        self.least = least

    def offer(self, who: np.ndarray, partners: np.ndarray, s: np.ndarray) -> None:
        """s: similarity of each of `who` (rows) to each of `partners` (columns)."""
        s = np.where(s >= self.floor[who, None], s, -np.inf)
        rows = np.flatnonzero((s > -np.inf).any(1))
        if not len(rows):
            return
        at = who[rows]
        all_s = np.concatenate((self.similarity[at], s[rows]), axis=1)
        all_p = np.concatenate((self.partner[at], np.broadcast_to(partners, (len(rows), len(partners)))), axis=1)
        top = np.argpartition(-all_s, self.k - 1, axis=1)[:, : self.k]
        self.similarity[at] = np.take_along_axis(all_s, top, 1)
        self.partner[at] = np.where(self.similarity[at] > -np.inf, np.take_along_axis(all_p, top, 1), -1)
        self.floor[at] = np.maximum(self.similarity[at].min(1), self.least)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        who, column = np.nonzero(self.partner >= 0)
        return who, self.partner[who, column]


class Tree:
    """The vantage-point tree of one shard; its leaves are compared whole."""

    def __init__(self, x: np.ndarray, leaf_rows: int, seed: int = 0) -> None:
        self.x = x
        self.root = self._build(np.arange(len(x)), leaf_rows, np.random.default_rng(seed))

    def _build(self, rows: np.ndarray, leaf_rows: int, rng: np.random.Generator):
        if len(rows) <= leaf_rows:
            return rows
        point, median = split_point(self.x[rows], rng)
        near = _distance(self.x[rows] @ point) <= median
        if near.all():  # all equally far: no point tells them apart
            half = len(rows) // 2
            return point, -1.0, self._build(rows[:half], leaf_rows, rng), self._build(rows[half:], leaf_rows, rng)
        return point, median, self._build(rows[near], leaf_rows, rng), self._build(rows[~near], leaf_rows, rng)

    def search(self, q: np.ndarray, factor: float, best: Best, residents: Best, same: bool) -> None:
        """Fills best (of the queries) and residents (of the tree's vectors).  same: the queries are the tree's vectors."""

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                for at in range(0, len(who), 4096):
                    part = who[at : at + 4096]
                    s = q[part] @ self.x[node].T
                    if same:
                        s[part[:, None] == node[None, :]] = -np.inf
                    best.offer(part, node, s)
                    residents.offer(node, part, s.T)
                return
            point, median, near, far = node
            if median < 0:
                visit(near, who)
                visit(far, who)
                return
            d = _distance(q[who] @ point)
            inside = d <= median
            visit(near, who[inside])
            visit(far, who[~inside])
            reach = factor * _distance(best.floor[who])
            visit(near, who[~inside & (d - reach <= median)])
            visit(far, who[inside & (d + reach > median)])

        visit(self.root, np.arange(len(q)))


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors at unit length, in double precision; scaled first, as squares of extreme components could overflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], sizes.cumsum())), pa.int32())


def _cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for at in range(0, len(a), 50_000):
        out[at : at + 50_000] = np.einsum("ij,ij->i", x[a[at : at + 50_000]], y[b[at : at + 50_000]])
    return np.minimum(out, 1)


def _lists(n: int, who: np.ndarray, s: np.ndarray, ids: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """Of n vectors the ids and similarities of their partners: who has which similarity to the ids of which list."""
    sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(who, kind="stable")
    offsets = _offsets(np.bincount(who, sizes, n).astype(np.int64))
    return pa.ListArray.from_arrays(offsets, ids.take(pa.array(order)).flatten()), pa.ListArray.from_arrays(offsets, pa.array(np.repeat(s[order], sizes[order])))


def _best_of(batch: pa.RecordBatch, keep: int, least: float) -> pa.RecordBatch:
    """Of each row the `keep` most similar of its partners, each once; the smaller id first where they are equally similar."""
    others, s = batch.column("others"), batch.column("similarities").flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), others.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    flat = others.flatten().dictionary_encode()
    place = np.empty(len(flat.dictionary), np.int64)
    place[pa.compute.array_sort_indices(flat.dictionary).to_numpy()] = np.arange(len(place))
    name = place[flat.indices.to_numpy()]
    order = np.lexsort((name, -s, row))
    order = order[s[order] >= least]
    _, first = np.unique(row[order] * np.int64(len(place) + 1) + name[order], return_index=True)
    order = order[np.sort(first)]
    r = row[order]
    begin = np.searchsorted(r, np.arange(batch.num_rows))
    order = order[np.arange(len(r)) - begin[r] < keep]
    offsets = _offsets(np.bincount(row[order], minlength=batch.num_rows))
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, others.flatten().take(pa.array(order))), pa.ListArray.from_arrays(offsets, pa.array(s[order]))], ["id", "others", "similarities"])


LISTS = "id string, others array<string>, similarities array<double>"


def usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN sorts above infinity
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", *, dim: int = 64, k: int = 10, least: float = -1.0, factor: float = 0.1, shard_rows: int = 8192, sample_rows: int = 16384, leaf_rows: int = 256, visitors: int = 40_000, seed: int = 0) -> DataFrame:
    """(id, other, similarity, rank): for every usable vector the k other ids most similar to it, of cosine at least `least`.

    Usable: `dim` finite values, not all zero.  Null ids and all other rows are left out.  Rows of one id are one
    vector, the smallest in the order of arrays.  Equal vectors are searched once; all their ids come back, each
    with the ids of its copies.  Of equally similar ids the smaller come first.  An empty table gives no rows; other
    columns are ignored.

    factor: see the module; 1 is exact.  The top of the tree is fitted on at most sample_rows vectors, those with the smallest hashes;
    every vector is indexed and searched.  Shards of more than 2 * shard_rows vectors are split again, by a sample of their own of
    at most as many in all, until none is left that vantage points tell apart.  visitors bounds how many vectors visit a shard in one task; only a
    shard with more is searched in several."""
    one = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    one = one.where(F.col("id").isNotNull() & usable(F.col("vector"), dim)).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = stored(one.withColumn("copy_key", F.struct(F.xxhash64("vector"), F.hash("vector"))), "vectors")
    several = stored(rows.groupBy("copy_key").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1"), "several")
    copies = stored(rows.select("id", "copy_key").join(several, "copy_key").select("id", "rep"), "copies")
    # the first k + 1 ids of a group are all that any list can take of it
    few = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(f"n <= {k + 1}")
    few = few.groupBy("rep").agg(F.collect_list("id").alias("ids"))
    reps = rows.join(copies, "id", "left").where("rep is null or rep = id").select("id", "vector").join(few.withColumnRenamed("rep", "id"), "id", "left")
    n = rows.count() - copies.count() + several.count()

    router = _fitted(reps, n, dim, shard_rows, sample_rows, seed)
    slots, low = k + 2, least - 1e-6  # what single precision may put in the wrong order or under the bound is settled in double

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_homes(router, batch, dim))], ["id", "vector", "ids", "shard"])

    def names(table: pa.Table) -> pa.ListArray:
        ids, more = table.column("id").combine_chunks(), table.column("ids").combine_chunks()
        single = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1), pa.int32()), ids)
        return pa.compute.coalesce(more, single)

    def inside(table: pa.Table) -> pa.Table:
        exact = _unit(table.column("vector"), dim)
        x = exact.astype(np.float32)
        m = len(x)
        best, residents = Best(m, slots, low), Best(m, slots, low)
        Tree(x, leaf_rows).search(x, factor, best, residents, True)
        a, b = (np.concatenate(p) for p in zip(best.pairs(), residents.pairs()))
        both = np.unique(a * np.int64(m) + b)
        a, b = both // m, both % m
        copied = np.flatnonzero(table.column("ids").combine_chunks().is_valid().to_numpy(zero_copy_only=False))
        s = np.concatenate((_cosines(exact, exact, a, b), np.ones(len(copied))))
        others, similarities = _lists(m, np.concatenate((a, copied)), s, names(table).take(pa.array(np.concatenate((b, copied)))))
        floor = np.maximum(best.floor, residents.floor)
        who, shard = router.shards(x, factor * _distance(floor))
        away = shard != table.column("shard").to_numpy()[who]
        who, shard = who[away], shard[away]
        visits = pa.ListArray.from_arrays(_offsets(np.bincount(who, minlength=m)), pa.array(shard[np.argsort(who, kind="stable")]))
        return pa.table([table.column("id"), table.column("vector"), table.column("ids"), table.column("shard"), pa.array(floor, pa.float32()), visits, others, similarities], ["id", "vector", "ids", "shard", "floor", "visits", "others", "similarities"])

    def across(residents_: pa.Table, visitors_: pa.Table) -> pa.Table:
        if not residents_.num_rows or not visitors_.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()))], ["id", "others", "similarities"])
        ex, eq = _unit(residents_.column("vector"), dim), _unit(visitors_.column("vector"), dim)
        x, q = ex.astype(np.float32), eq.astype(np.float32)
        best, residents = Best(len(q), slots, low), Best(len(x), slots, low)
        best.floor[:] = visitors_.column("floor").to_numpy()
        residents.floor[:] = residents_.column("floor").to_numpy()
        Tree(x, leaf_rows).search(q, factor, best, residents, False)
        out = []
        for mine, theirs, (a, b), u, v in ((visitors_, residents_, best.pairs(), eq, ex), (residents_, visitors_, residents.pairs(), ex, eq)):
            others, similarities = _lists(len(u), a, _cosines(u, v, a, b), names(theirs).take(pa.array(b)))
            some = pa.array(np.bincount(a, minlength=len(u)) > 0)
            out.append(pa.table([mine.column("id").combine_chunks(), others, similarities], ["id", "others", "similarities"]).filter(some))
        return pa.concat_tables(out)

    housed = reps.select("id", "vector", "ids").mapInArrow(home, "id string, vector array<float>, ids array<string>, shard long")
    state = "id string, vector array<float>, ids array<string>, shard long, floor float, visits array<long>, others array<string>, similarities array<double>"
    first = stored(housed.groupBy("shard").applyInArrow(inside, state), "shards")
    goes = first.select(*(F.col(c).alias(c) for c in ("id", "vector", "ids", "floor")), F.explode("visits").alias("shard"))
    visited = {r[0]: r[1] for r in goes.groupBy("shard").count().collect()}  # a row a shard
    met = first.select("id", "others", "similarities")
    if visited:
        many = vectors.sparkSession.createDataFrame([(shard, -(-n // visitors)) for shard, n in visited.items()], "shard long, parts long")
        goes = goes.join(many, "shard").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        stay = first.select("id", "vector", "ids", "floor", "shard").join(many, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = met.unionByName(stay.drop("parts").groupBy("shard", "part").cogroup(goes.drop("parts").groupBy("shard", "part")).applyInArrow(across, LISTS))
    # a row of its own shard, one of each it visits and one of each task that visits its shard
    gathered = met.groupBy("id").agg(F.flatten(F.collect_list("others")).alias("others"), F.flatten(F.collect_list("similarities")).alias("similarities"))
    lists = gathered.mapInArrow(lambda batches: (_best_of(batch, k + 1, least) for batch in batches), LISTS)
    twins = copies.where("id <> rep").join(lists.withColumnRenamed("id", "rep"), "rep").select("id", "others", "similarities")
    each = lists.unionByName(twins).select("id", F.arrays_zip(F.col("others").alias("other"), F.col("similarities").alias("similarity")).alias("p"))
    each = each.select("id", F.posexplode(F.slice(F.filter("p", lambda x: x["other"] != F.col("id")), 1, k)).alias("rank", "p"))
    return each.select("id", F.col("p.other").alias("other"), F.col("p.similarity").alias("similarity"), (F.col("rank") + 1).alias("rank"))


def _homes(router: Router, batch: pa.RecordBatch, dim: int) -> np.ndarray:
    x = _unit(batch.column("vector"), dim).astype(np.float32)
    who, shard = router.shards(x, np.zeros(len(x)))
    at = np.zeros(len(x), np.int64)
    at[who] = shard
    return at


def _fitted(reps: DataFrame, n: int, dim: int, shard_rows: int, sample_rows: int, seed: int) -> Router:
    """The top of the tree over n vectors, grown until no shard is too large; it knows which shards hold any."""
    rng = np.random.default_rng(seed)
    router = Router(dim)
    sizes = {0: n}
    stuck: set[int] = set()
    while True:
        large = {shard: size for shard, size in sizes.items() if size > (2 if len(sizes) > 1 else 1) * shard_rows and shard not in stuck}
        if not large:
            break
        total = sum(large.values())

        def routed(batches: Iterator[pa.RecordBatch], router=router) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(_homes(router, batch, dim))], ["id", "vector", "shard"])

        schema = "id string, vector array<float>, shard long"
        here = reps.select("id", "vector").mapInArrow(routed, schema).where(F.col("shard").isin(list(large)))
        sample = hash_sample(here, "id", total, sample_rows).select("shard", "vector").toArrow()
        shards, x = sample.column("shard").to_numpy(), _unit(sample.column("vector"), dim).astype(np.float32)
        for shard, size in large.items():
            part = x[shards == shard]
            router.grow(shard, part, min(math.ceil(math.log2(size / shard_rows)), int(math.log2(max(1, len(part) / 8)))), rng)
            if router.child[shard, 0] < 0 and len(part) >= min(16, size):
                stuck.add(shard)
        if all(router.child[shard, 0] < 0 for shard in large):
            break
        sizes = {r[0]: r[1] for r in reps.select("id", "vector").mapInArrow(routed, schema).groupBy("shard").count().collect()}  # a row a shard
    router.held[:] = False
    router.held[list(sizes)] = True
    return router


def similar_pairs(lists: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: distinct pairs of which one is in the other's list."""
    return lists.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
