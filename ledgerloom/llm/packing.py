"""Filling containers of fixed capacity with whole items: best-fit decreasing.

Items are spread over shards by a hash, each shard is packed by best-fit decreasing, and the containers that stay
visibly short of full are opened again and packed together.  The tightest open container is found in a segment
tree over remaining capacities in logarithmic time per item.  Only ids and sizes are moved, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


class Remaining:
    """How many open containers have each remaining capacity; finds the least one that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, remaining: int, container: int) -> None:
        self.open.setdefault(remaining, []).append(container)
        i = remaining + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(remaining capacity, container) of the tightest one with at least `size` left, taken out; None if there is none."""
        i, count = size + self.leaves, self.count
        while not count[i]:
            while i & 1:  # up, as long as this is a right child
                i >>= 1
            if not i:
                return None
            i += 1  # the next subtree to the right
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        found = i - self.leaves
        container = self.open[found].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return found, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; items are taken largest first, equal ones in the order given."""
    where = np.zeros(len(sizes), np.int64)
    tree, used = Remaining(capacity), 0
    order = np.argsort(-sizes, kind="stable")
    for at, size in zip(order.tolist(), sizes[order].tolist()):
        found = tree.take(size)
        if found is None:
            found = capacity, used
            used += 1
        where[at] = found[1]
        tree.add(found[0] - size, found[1])
    return where


PIECES = "item_id long, window_name string, piece int, size long, capacity long, shard long"


def _pack(pieces: DataFrame, stage: str) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item_id", "piece"], kind="stable")
        where = best_fit_decreasing(group["size"].to_numpy(np.int64), int(group["capacity"].iloc[0]))
        shard = group["shard"].iloc[0]
        filled = np.bincount(where, group["size"])[where]
        return group.assign(container=[f"{stage}-{shard}-{w}" for w in where.tolist()], filled=filled.astype(np.int64))

    return pieces.groupBy("window_name", "shard").applyInPandas(run, PIECES + ", container string, filled long")


def pack(items: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shard_items: int = 50_000, short: float = 0.97) -> DataFrame:
    """(item_id, window_name, piece, size, container): where each item goes, for each window's capacity.

    The size of an item is the number of UTF-8 bytes of its text; a window's capacity is max_tokens - reserved_tokens.
    An item larger than the capacity is cut into full pieces and a rest, each in a container; every other item is one piece, 0.
    A null text or null id is no item; an empty text has size 0 and fits anywhere.  Items are taken to have
    distinct ids.  Windows without a name or a positive capacity are left out; of equal names the largest capacity
    holds.  Containers are named within their window.  Other columns are ignored.

    shard_items bounds what one task packs; containers filled to less than `short` are packed again."""
    sized = items.select(F.col(id_col).cast("long").alias("item_id"), F.octet_length(text_col).cast("long").alias("size")).where("item_id is not null and size is not null")
    spaces = windows.select("window_name", (F.col("max_tokens") - F.col("reserved_tokens")).cast("long").alias("capacity")).where("window_name is not null and capacity > 0")
    spaces = spaces.groupBy("window_name").agg(F.max("capacity").alias("capacity"))
    sized = stored(sized, "sizes")
    shards = max(1, -(-sized.count() // shard_items))
    each = sized.join(spaces)  # windows are a fixed table of a few rows; every item goes into each
    full = F.floor(F.col("size") / F.col("capacity")).cast("int")
    rest = F.col("size") - full * F.col("capacity")
    cut = each.withColumn("full", full).withColumn("rest", rest)
    whole = cut.where("full > 0").select("item_id", "window_name", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.col("capacity").alias("size"))
    whole = whole.select("*", F.concat_ws("-", F.lit("full"), "item_id", "piece").alias("container"))
    rests = cut.where("rest > 0 or full = 0").select("item_id", "window_name", F.col("full").alias("piece"), F.col("rest").alias("size"), "capacity", F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard"))
    first = stored(_pack(rests, "a"), "packed")
    loose = F.col("filled") < F.lit(short) * F.col("capacity")
    again = first.where(loose).drop("container", "filled")
    few = max(1, -(-again.count() // (4 * shard_items)))
    second = _pack(again.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(few))), "b")
    columns = ["item_id", "window_name", "piece", "size", "container"]
    return whole.select(columns).unionByName(first.where(~loose).select(columns)).unionByName(second.select(columns))


def cut_items(packed: DataFrame) -> DataFrame:
    """(doc_id, window_name) of the items that pack() had to cut."""
    return packed.where("piece = 1").select(F.col("item_id").alias("doc_id"), "window_name")
