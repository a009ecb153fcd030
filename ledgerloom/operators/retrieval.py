"""Exact retrieval by cosine similarity: plain and balanced over the labels, and the order of examples.

Scores come from blocks of vectors multiplied in the executors; only the best of each task are shuffled.  Equal
scores (to 12 decimals) go to the longer text, then to the smaller train_order."""

from __future__ import annotations

import random
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_usable_vector

FOUND = "query_id string, id string, profession string, gender string, train_order int, text_length long, score double"


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """One row an id with a vector of dim finite values that are not all zero; of several the smallest."""
    good = vectors.where(F.col("id").isNotNull() & is_usable_vector(F.col("vector"), dim))
    rest = [c for c in vectors.columns if c != "id"]
    return good.groupBy("id").agg(F.min(F.struct("vector", *(c for c in rest if c != "vector"))).alias("r")).select("id", *(f"r.{c}" for c in rest))


def vector_problems(vectors: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """One row of counts: what keeps a vector table from matching its source rows exactly."""
    v = F.col("vector")
    shaped = v.isNotNull() & (F.size(v) == dim)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    shape = vectors.agg(F.count("*").alias("vector_rows"), one(v.isNull()).alias("null_vectors"), one(v.isNotNull() & (F.size(v) != dim)).alias("wrong_length"), one(shaped & ~finite).alias("not_finite"), one(shaped & finite & ~F.exists(v, lambda x: x != 0)).alias("zero_vectors"))
    ids = vectors.groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct("profession", "gender", "train_order")).alias("a"))
    train = rows.where("split = 'train'").select(F.col("id").alias("row_id"), F.struct("profession", "gender", "train_order").alias("b"))
    both = ids.join(train, F.col("id") == F.col("row_id"), "full_outer")
    differs = F.col("id").isNotNull() & F.col("row_id").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))
    match = both.agg(one(F.col("n") > 1).alias("repeated_ids"), one(F.col("row_id").isNull()).alias("without_row"), one(F.col("id").isNull()).alias("rows_without_vector"), one(differs).alias("labels_differ"))
    return shape.join(match)  # one row each


def _best(q: np.ndarray, score: np.ndarray, length: np.ndarray, order: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query and group."""
    by = np.lexsort((order, -length, -score, group, q))
    qs, gs = q[by], group[by]
    first = np.concatenate(([True], (qs[1:] != qs[:-1]) | (gs[1:] != gs[:-1]))) if len(by) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < k]


def _score(pool: pa.Table, queries: pa.Table, k: int, per_pair: bool) -> pa.Table:
    """The k best rows of a block of the pool for each query of a block, or of each profession and gender of it."""
    names, matrix = queries.column("query_id").combine_chunks(), _matrix(queries)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    number = {x: i for i, x in enumerate(names.to_pylist())}
    rows = pool.select(["id", "profession", "gender", "train_order", "text_length"]).to_pandas()
    by = rows.sort_values(["train_order", "id"], kind="stable").index.to_numpy()  # settles what score and length leave equal
    rows, x = rows.iloc[by].reset_index(drop=True), _matrix(pool)[by]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pair = pd.factorize(rows["profession"].astype(str) + "|" + rows["gender"].astype(str))[0] if per_pair else np.zeros(len(rows), int)
    length = rows["text_length"].to_numpy()
    own = np.array([number.get(i, -1) for i in rows["id"]])
    q, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(rows), 2048):
        s = np.round(matrix @ x[at : at + 2048].T, 12)
        here = np.flatnonzero(own[at : at + 2048] >= 0)
        s[own[at + here], here] = -np.inf
        found = []
        for g in np.unique(pair[at : at + 2048]):
            columns = np.flatnonzero(pair[at : at + 2048] == g)
            part = s[:, columns]
            least = np.partition(part, -k, axis=1)[:, -k, None] if len(columns) > k else -np.inf
            a, c = np.nonzero((part >= least) & (part > -np.inf))
            found.append((a, columns[c]))
        a, c = (np.concatenate(f) for f in zip(*found))
        q, j, score = np.concatenate((q, a)), np.concatenate((j, c + at)), np.concatenate((score, s[a, c]))
        best = _best(q, score, length[j], j, pair[j], k)
        q, j, score = q[best], j[best], score[best]
    picked = pa.Table.from_pandas(rows.iloc[j], preserve_index=False).add_column(0, "query_id", names.take(pa.array(q)))
    return picked.append_column("score", pa.array(score)).cast(pa.schema([("query_id", pa.string()), ("id", pa.string()), ("profession", pa.string()), ("gender", pa.string()), ("train_order", pa.int32()), ("text_length", pa.int64()), ("score", pa.float64())]))


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def candidates(pool: DataFrame, queries: DataFrame, k: int, *, per_pair: bool, query_rows: int = 4096, pool_rows: int = 32768) -> DataFrame:
    """The k nearest pool rows of each query, or of each profession and gender of each query, as each pair of blocks has them.

    pool: id, profession, gender, train_order, text_length, vector; queries: query_id, vector.  A query never finds its own
    id.  Both sides are cut by hash into blocks of about query_rows and pool_rows vectors; each block of one side meets each of the
    other in an executor, and only their best go on.  A row of one side is sent as often as the other side has blocks."""
    cores = pool.sparkSession.sparkContext.defaultParallelism
    n = pool.count()
    parts = max(1, -(-n // pool_rows), min(cores, -(-n // 1024)))  # small pools are spread over the cores
    blocks = max(1, -(-queries.count() // query_rows))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    p = pool.select("id", "profession", "gender", F.coalesce("train_order", F.lit(2147483647)).alias("train_order"), "text_length", "vector", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_p"), each(blocks).alias("_q"))
    q = queries.select(F.col("query_id").alias("query_id"), F.col("vector").alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_q"), each(parts).alias("_p"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "id": pa.array([], pa.string()), "profession": pa.array([], pa.string()), "gender": pa.array([], pa.string()), "train_order": pa.array([], pa.int32()), "text_length": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _score(a, b, k, per_pair)

    return p.groupBy("_p", "_q").cogroup(q.groupBy("_p", "_q")).applyInArrow(meet, FOUND)


def _nearest(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("text_length"), "train_order", "id")


def semantic_topk(pool: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, id, profession, gender, score): the k nearest; those of a smaller k are the first of them."""
    ranked = candidates(pool, queries, k, per_pair=False).withColumn("pos", F.row_number().over(_nearest("query_id")))
    return ranked.where(F.col("pos") <= k).select("query_id", "pos", "id", "profession", "gender", "score")


def greedy_balanced(profession: list, gender: list, k: int, pairs: list[tuple]) -> list[int]:
    """Places picked from rows in order of nearness: always the first whose profession, gender and pair each have been picked
    as rarely as any that `pairs` holds."""
    counts: list[dict] = [dict.fromkeys((p for p, _ in pairs), 0), dict.fromkeys((g for _, g in pairs), 0), dict.fromkeys(pairs, 0)]
    picked: list[int] = []
    used: set[int] = set()
    while len(picked) < k:
        least = [min(c.values()) for c in counts]
        for i, keys in enumerate(zip(profession, gender, zip(profession, gender))):
            if i not in used and all(c.get(x) == m for c, x, m in zip(counts, keys, least)):
                break
        else:
            raise ValueError(f"no row keeps the balance after {len(picked)} of {k}")
        used.add(i)
        picked.append(i)
        for c, x in zip(counts, (profession[i], gender[i], (profession[i], gender[i]))):
            c[x] += 1
    return picked


def balanced_topk(pool: DataFrame, queries: DataFrame, k: int, pairs: list[tuple] | None = None) -> DataFrame:
    """Like semantic_topk, but professions, genders and their pairs are kept in balance.

    pairs: the configured professions and genders, without which those of the pool count; a pair that has no row keeps the balance from being met.

    Of each pair at most its k nearest rows can be picked, so the rest of the pool is dropped without loss.  Fails
    where no row keeps the balance."""
    pairs = pairs or [tuple(r) for r in pool.select("profession", "gender").distinct().orderBy("profession", "gender").collect()]  # as many as there are labels
    near = candidates(pool, queries, k, per_pair=True).withColumn("n", F.row_number().over(_nearest("query_id", "profession", "gender"))).where(F.col("n") <= k)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "text_length", "train_order", "id"], ascending=[False, False, True, True], kind="stable").reset_index(drop=True)
        got = greedy_balanced(group["profession"].tolist(), group["gender"].tolist(), k, pairs)
        return group.iloc[got].assign(pos=range(1, len(got) + 1))[["query_id", "pos", "id", "profession", "gender", "score"]]

    return near.groupBy("query_id").applyInPandas(pick, "query_id string, pos int, id string, profession string, gender string, score double")


def require_usable(vectors: DataFrame, rows: DataFrame, dim: int) -> None:
    """Fails unless the vectors are those of the training rows: one each, usable, with the rows' labels."""
    found = vector_problems(vectors, rows, dim).first().asDict()
    if bad := {name: n for name, n in found.items() if n and name != "vector_rows"}:
        raise ValueError("the vectors don't fit the training rows: " + ", ".join(f"{name} {n}" for name, n in bad.items()))


def require_pool(pool: DataFrame, k: int) -> None:
    """Fails if k is no count or a query could not get k rows of the pool."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"the number of examples must be a whole number above 0, not {k!r}")
    if (n := pool.limit(k).count()) < k:
        raise ValueError(f"{k} examples are asked for; the pool has {n} rows")


def permutation(seed: int, k: int) -> list[int]:
    places = list(range(k))
    random.Random(seed).shuffle(places)
    return places


def order_examples(examples: Column, order: str, seed: int = 0, k: int = 0) -> Column:
    """Orders an array of structs with pos and retrieval_score, already cut to k: by score (undefined last, equal ones as
    they come), or by the permutation that seed and k give for every query alike."""
    if order == "shuffle":
        return F.filter(F.transform(F.array(*map(F.lit, permutation(seed, k))), lambda i: F.get(examples, i)), lambda x: x.isNotNull()) if k else examples
    sign = {"most_similar_first": -1, "most_similar_last": 1}[order]
    keyed = F.transform(examples, lambda x: F.struct(x["retrieval_score"].isNull().alias("a"), (x["retrieval_score"] * sign).alias("b"), x["pos"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def hydrate(selections: DataFrame, rows: DataFrame) -> DataFrame:
    """Selections with the texts of their rows, joined only after the selection."""
    wanted = rows.select("id", "hard_text").join(selections.select("id").distinct(), "id", "left_semi")  # texts that nobody picked stay where they are
    return selections.join(wanted, "id")


def require_hydrated(selections: DataFrame, rows: DataFrame) -> None:
    for r in selections.join(rows.select("id"), "id", "left_anti").limit(1).collect():
        raise ValueError(f"no source row for {r['id']}")
