"""Samples of a batch that match target shares of category cells, by raking.

For each request the rows of its batch are counted by cell and the cells' weights are raked by iterative
proportional fitting over the margins of profession and of gender; the shares of the cells themselves are only where the
fitting starts.  No cell can give more rows than it has, so what one lacks others of its margins make up for.  The weighed counts, rounded to
the size of the sample, are the cells' quotas; cells under their minimum are filled, in exchange for rows of the cells that are
furthest over their share.  Every row gets a weighted exponential key -ln(u)/w, u being a hash of seed, request and id, and each cell
gives the rows with its smallest keys.  Only counts by cell reach a single task, never a batch's rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import label, one_per_id
from .scratch import stored

SALTS = 32


def rake(available: np.ndarray, target: np.ndarray, margins: list[np.ndarray], rounds: int = 500, close: float = 1e-9) -> np.ndarray:
    """Weights w by cell so that available * w meets the sums of target in every margin, as far as cells have rows (w is at most 1).

    margins: for each margin the group of each cell.  The fitting starts from target.  A group without rows is left as it is."""
    n = np.minimum(target, available).astype(float)
    for _ in range(rounds):
        off = 0.0
        for groups in margins:
            want, have = np.bincount(groups, target), np.bincount(groups, n)
            open_ = n < available  # the others can give no more, but may have to give less
            up = want > have
            free = np.bincount(groups, np.where(open_ | ~up[groups], n, 0))
            factor = np.divide(want - (have - free), free, out=np.ones_like(want), where=free > 0)
            before = n
            n = np.where(open_ | ~up[groups], np.minimum(n * np.maximum(factor, 0)[groups], available), n)
            off = max(off, np.abs(n - before).max(initial=0))
        if off < close:
            break
    return np.divide(n, available, out=np.zeros_like(n), where=available > 0)


def quotas(wanted: np.ndarray, request: np.ndarray, size: np.ndarray, available: np.ndarray) -> np.ndarray:
    """Whole rows by cell, as near to wanted as adding up to the size of the request's sample allows (or to all that is wanted, if less).

    request: the request of each cell; size: of each request."""
    made = np.minimum(np.floor(wanted + 0.5), available).astype(np.int64)
    total = np.minimum(size, np.floor(np.bincount(request, wanted, len(size)) + 0.5)).astype(np.int64)
    short = total - np.bincount(request, made, len(size)).astype(np.int64)
    for r in np.flatnonzero(short):
        at = np.flatnonzero(request == r)
        step = 1 if short[r] > 0 else -1
        can = at[(made[at] < available[at]) if step > 0 else (made[at] > 0)]
        made[can[np.argsort(-step * (wanted[can] - made[can]), kind="stable")][: abs(short[r])]] += step
    return made


def repair(drawn: np.ndarray, least: np.ndarray, available: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rows to take of each cell of a request: every cell gets its minimum, as far as it has rows, and as many rows as that adds are
    taken off the cells that are furthest over their target and stay at their minimum or above."""
    floor = np.minimum(least, available)
    made = np.maximum(drawn, floor)
    extra = int(made.sum() - drawn.sum())
    while extra > 0:
        over = np.where(made > floor, made - target, -np.inf)
        at = int(over.argmax()) if len(over) else -1
        if at < 0 or over[at] == -np.inf:
            break  # the minimums alone are more than the sample
        made[at] -= 1
        extra -= 1
    return made


def _cells(rows: DataFrame, requests: DataFrame, targets: DataFrame, order: Column | None) -> tuple[DataFrame, DataFrame]:
    """(records with their batch and cell, requested cells with the rows available for each)."""
    records = one_per_id(rows, "id", {"batch_id": F.col("batch_id"), "profession": label(F.col("profession")), "gender": F.col("gender")}, order)
    asked = requests.where("request_id is not null").groupBy("request_id").agg(F.max(F.struct("batch_id", "sample_size")).alias("r")).select("request_id", "r.*")
    cells = targets.select("request_id", label(F.col("profession")).alias("profession"), "gender", "target_share", "min_rows").distinct()
    cells = cells.groupBy("request_id", "profession", "gender").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("min_rows"))
    cells = cells.join(asked, "request_id")
    have = records.groupBy("batch_id", "profession", "gender").agg(F.count("*").alias("available"))
    cells = cells.join(have, ["batch_id", "profession", "gender"], "left")
    wanted = F.round(F.coalesce("sample_size", F.lit(0)) * F.col("target_share")).cast("long")
    return records, cells.select("request_id", "batch_id", "profession", "gender", F.coalesce("sample_size", F.lit(0)).alias("sample_size"), "target_share", F.col("min_rows").cast("long").alias("min_rows"), wanted.alias("target_rows"), F.coalesce("available", F.lit(0)).alias("available"))


def _plan(cells: pd.DataFrame) -> pd.DataFrame:
    """The cells of many requests with their weight and the rows to take."""
    cells = cells.sort_values(["request_id", "profession", "gender"], kind="stable", ignore_index=True)
    first, request = np.unique(cells["request_id"].to_numpy(), return_index=True, return_inverse=True)[1:]
    size = cells["sample_size"].to_numpy(np.int64)[first]
    codes = [pd.factorize(cells[c], use_na_sentinel=False)[0] for c in ("profession", "gender")]
    groups = [np.unique(request * (code.max(initial=0) + 1) + code, return_inverse=True)[1] for code in codes]
    target = (cells["target_share"] * cells["sample_size"]).to_numpy(float)
    available, least = cells["available"].to_numpy(np.int64), cells["min_rows"].to_numpy(np.int64)
    weight = rake(available.astype(float), target, groups)
    drawn = quotas(available * weight, request, size, available)
    taken = drawn.copy()
    for r in np.unique(request[np.minimum(least, available) > drawn]):
        at = np.flatnonzero(request == r)
        taken[at] = repair(drawn[at], least[at], available[at], target[at])
    return cells.assign(weight=weight, taken=taken)


CELL = "request_id long, batch_id long, profession string, gender string, sample_size int, target_share double, min_rows long, target_rows long, available long"
KEYS = ["request_id", "profession", "gender"]


def balanced_sample(rows: DataFrame, requests: DataFrame, targets: DataFrame, order_col: str | None = "loaded_at", *, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    sample: (request_id, id, profession, gender), no id twice for one request.
    report: (request_id, profession, gender, target_rows, min_rows, available, taken, gap, met) for each requested cell; the
    cell needs max(min_rows, target_rows), gap is what the sample lacks of it and met says whether the batch has that many.

    Records of one id are one record, the latest; those with null batch, profession or gender fill no cell.  A request
    without a row in `requests`, or a row there without targets, gives nothing; equal target rows count once, and
    different ones of one cell add up.  A target with a null label or share, or of a batch without rows, has no rows
    or none to find.  The sample may be larger than asked only if the minimums are.  Other columns are ignored."""
    records, cells = _cells(rows, requests, targets, F.col(order_col) if order_col else None)
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = stored(cells.groupBy(F.pmod(F.xxhash64("request_id"), F.lit(buckets))).applyInPandas(_plan, CELL + ", weight double, taken long"), "quotas")
    u = (F.xxhash64(F.lit(seed), "request_id", "id") / F.lit(2.0**64) + 0.5) * (1 - 2.0**-52) + 2.0**-53
    key = F.when(F.col("weight") > 0, -F.log(u) / F.col("weight")).otherwise(F.lit(float("inf")))
    keyed = records.join(planned.where("taken > 0"), ["batch_id", "profession", "gender"]).select(*KEYS, "id", "taken", key.alias("key"), u.alias("u"), F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt"))
    # first within salted parts of a cell, so that no task sorts a whole cell
    order = ["key", F.desc("u"), "id"]
    kept = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*KEYS, "salt").orderBy(*order))).where("n <= taken")
    sample = kept.withColumn("n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).where("n <= taken").select("request_id", "id", "profession", "gender")
    needed = F.greatest("min_rows", "target_rows")
    # a cell never has fewer rows than it is to give, so this is what the sample holds
    report = planned.select(*KEYS, "target_rows", "min_rows", "available", "taken", F.greatest(needed - F.col("taken"), F.lit(0)).alias("gap"), (F.col("available") >= needed).alias("met"))
    return sample, report
