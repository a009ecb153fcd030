"""Near-duplicate groups by bottom-k sketches of word shingles.

Every distinct set of shingles keeps its k smallest values under one order: by the number of sets that hold
the value, then by its hash.  Inverted lists of the retained values give candidate pairs; the sketch of the
union of a pair (by hash alone) estimates their likeness and removes most; the exact Jaccard similarity
decides.  Exact copies are one set, so they never pair with each other.

k follows from the size of the set: two sets of likeness t or more share a value among the first
n - ceil(t*n) + 1 of each under any common order, so every pair becomes a candidate.  The estimate drops those four standard
deviations below t, which by the binomial tail loses a pair at just t with a probability of up to 3e-5 at 0.55 and 1.5e-4 at 0.8.  Rare values come first, so a value of
a template, which a large part of all sets may hold, is retained only by sets made of little else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .records import label, likeness, one_per_id, with_shingles
from .scratch import stored

SCHEMA = "group_id string, id string"


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: numbers of sets that share a retained value and may be `threshold` alike.

    Values are hashed together with the key, so that only whole numbers are shuffled."""
    held = sets.select("number", "key", F.size("shingles").alias("n"), F.explode("shingles").alias("v")).select("number", "n", F.xxhash64("key", "v").alias("v"))
    shared = held.join(held.groupBy("v").agg(F.count("*").alias("holders")).where("holders > 1"), "v")
    ordered = shared.groupBy("number", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "v"))).alias("vs"))
    k = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    ordered = ordered.withColumn("own", F.col("n") - F.size("vs"))  # values no other set holds come first
    kept = ordered.select("number", "n", "own", F.posexplode(F.slice("vs", F.lit(1), F.greatest(k - F.col("own"), F.lit(0)).cast("int"))).alias("i", "x"))
    posted = stored(kept.select("number", "n", (F.col("n") - F.col("own") - F.col("i")).alias("rest"), F.col("x.v").alias("v")), "postings")
    a, b = posted.alias("a"), posted.alias("b")
    # at the first value two sets share, no more than what follows it can be shared as well
    enough = F.least("a.rest", "b.rest") * (1 + threshold) >= (F.col("a.n") + F.col("b.n")) * threshold - 1e-6
    sizes = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-6
    joined = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.number") < F.col("b.number")) & enough & sizes)
    return joined.select(F.col("a.number").alias("a"), F.col("b.number").alias("b")).distinct()


def union_estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the k smallest values of both sets' union that both sets hold."""
    sa, sb = F.slice(a, 1, k), F.slice(b, 1, k)
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, sa), sb)) / F.size(union)


def linked(sets: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, likeness) of the numbers of the pairs of distinct sets of one key that are at least `threshold` alike.

    Candidates meet with their sketches; only what these leave is joined to the whole sets."""
    short = sets.select("number", "key", F.slice("shingles", 1, k).alias("sketch"))  # ascending hashes, so these are the smallest
    one = short.select(F.col("number").alias("a"), F.col("key").alias("ka"), F.col("sketch").alias("sa"))
    two = short.select(F.col("number").alias("b"), F.col("key").alias("kb"), F.col("sketch").alias("sb"))
    least = threshold - 4 * (threshold * (1 - threshold) / k) ** 0.5  # four standard deviations of the estimate
    both = candidates(sets, threshold).join(one, "a").join(two, "b")
    near = stored(both.where((F.col("ka") == F.col("kb")) & (union_estimate(F.col("sa"), F.col("sb"), k) >= least)).select("a", "b"), "near")
    whole = sets.select("number", "shingles")
    met = near.join(whole.select(F.col("number").alias("a"), F.col("shingles").alias("xa")), "a").join(whole.select(F.col("number").alias("b"), F.col("shingles").alias("xb")), "b")
    return met.select("a", "b", likeness(F.col("xa"), F.col("xb")).alias("likeness")).where(F.col("likeness") >= threshold)


def near_duplicate_groups(rows: DataFrame, id_col: str = "id", text_col: str = "hard_text", key_col: str = "profession", order_col: str | None = "loaded_at", *, words: int = 5, threshold: float = 0.8, k: int = 32) -> DataFrame:
    """(group_id, id): groups of two or more records of one key that are alike, directly or through others.

    One row for each member; group_id is the smallest id of the group.  Records of one id are one record, the
    latest.  A record with null id, null key, null or empty text, or fewer than `words` words is in no group.
    Columns besides the four named are ignored, whatever their names.  An empty table gives no rows."""
    at = F.col(order_col) if order_col else None
    one = one_per_id(rows, id_col, {"key": label(F.col(key_col)), "text": F.col(text_col)}, at).where("key is not null")
    docs = stored(with_shingles(one, "text", words), "shingles")
    copies = stored(docs.groupBy("key", "set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "copies")
    sets = docs.join(copies.select("rep"), docs["id"] == copies["rep"], "left_semi").select("key", F.col("id").alias("rep"), "shingles")
    sets = stored(sets.withColumn("number", F.monotonically_increasing_id()), "sets")  # written, so the numbers stay
    roots = components(linked(sets, threshold, k)).join(sets.select(F.col("number").alias("id"), "rep"), "id")
    named = roots.select("rep", "root").join(roots.groupBy("root").agg(F.min("rep").alias("smallest")), "root").select("rep", "smallest")
    # a set is in a group if it is linked or has copies
    grouped = copies.join(named, "rep", "left").where("smallest is not null or copies > 1")
    grouped = grouped.select("key", "set_key", F.coalesce("smallest", "rep").alias("group_id"))
    return docs.select("key", "set_key", "id").join(grouped, ["key", "set_key"]).select("group_id", "id")
