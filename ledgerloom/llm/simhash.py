"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Every set of word shingles gets a similarity hash for the Jaccard likeness, b-bit minwise hashing: under each of a number of
orders the set names its smallest shingle, which two sets have in common with a probability of just their likeness t,
whatever their sizes.  Two kinds of bits come from these samples:
- the code, one bit of each of CODE samples, of which two sets differ in (1 - t) / 2 of the bits in the mean;
- blocks of 64 bits, each the joint hash of SAMPLES further samples, so that a block is equal with probability t^SAMPLES.
Evaluation and training sets that share a whole block are candidates; those whose codes differ in more than the Hamming
radius are dropped; the exact likeness of the texts decides.  The number of blocks and the radius follow from the threshold and the
probability `miss` with which a pair of just that likeness may be lost; likelier pairs are lost far less.

(In the classic code every shingle votes on every bit.  At a likeness of 0.75 such bits differ with probability 0.17,
so a segment of 16 bits stays whole in 5 of 100 pairs and 184 tables would be needed to lose but one pair in 10,000.)

A block that very many sets share, as of a template, is not joined.  The sets that have one meet by their shingles instead, which loses none: ordered
by how many of these sets hold them, rare ones first, two sets of likeness t or more share a shingle among the first n - ceil(t*n) + 1 of each.
With `miss` = 0 all sets meet so, without blocks, codes or any loss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .records import likeness, one_per_id, split_name, with_shingles
from .scratch import drop, stored
from .textform import mix, shingle_batch

CODE = 64
SAMPLES = 2
HOT = 20_000  # pairs of a block from which on its sets meet by their shingles
PART = 2_000  # sets of a side that meet those of the other in one piece, where very many share a shingle


def tables(threshold: float, miss: float) -> int:
    """How many blocks lose a pair of likeness `threshold` with probability `miss` at most; 0 if none may be lost, as no number does for that."""
    if miss <= 0:
        return 0
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(threshold, 1 - 1e-9) ** SAMPLES)))


def radius(threshold: float, miss: float) -> int:
    """The least Hamming distance that the codes of a pair of that likeness exceed with probability `miss` at most."""
    p, rest = (1 - threshold) / 2, 1.0
    for r in range(CODE):
        rest -= math.comb(CODE, r) * p**r * (1 - p) ** (CODE - r)
        if rest <= miss:
            return r
    return CODE


def fingerprints(values: np.ndarray, sizes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, blocks by set) of sets of signed hashes given one after another, each of size 1 or more."""
    n = len(sizes)
    starts = (sizes.cumsum() - sizes).astype(np.int64)
    v = values.view(np.uint64)
    codes = np.zeros(n, np.uint64)
    joint = np.zeros((n, blocks), np.uint64)
    if n:
        for i in range(CODE + SAMPLES * blocks if blocks else 0):
            # another order of the hashes for each i; the low bits of a product hang on few bits of the hash, so they are mixed in
            salt = mix(np.array([i + 1], np.uint64))[0]
            x = (v ^ salt) * (salt | np.uint64(1))
            least = mix(np.minimum.reduceat(x ^ (x >> np.uint64(31)), starts))
            if i < CODE:
                codes |= (least & np.uint64(1)) << np.uint64(i)
            else:
                b = (i - CODE) % blocks
                joint[:, b] = mix(joint[:, b] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(b))
    return codes.view(np.int64), joint.view(np.int64)


def _printed(rows: DataFrame, words: int, blocks: int) -> DataFrame:
    """rows (id, side, text) with the set's key, code and blocks; texts without any run of words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                values, sizes = shingle_batch(batch.column("text").to_pylist(), words)
                some = sizes > 0
                batch, sizes = batch.filter(pa.array(some)), sizes[some]
                codes, joint = fingerprints(values, sizes, blocks)
                starts = sizes.cumsum() - sizes
                v = values.view(np.uint64)
                keys = [np.add.reduceat(mix(v ^ np.uint64(s)), starts).view(np.int64) if len(sizes) else np.empty(0, np.int64) for s in (1, 2)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * blocks), pa.array(joint.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "side", "text")), pa.array(keys[0]), pa.array(keys[1]), pa.array(codes), lists], ["id", "side", "text", "k1", "k2", "code", "blocks"])

    return rows.select("id", "side", "text").where("text is not null").mapInArrow(run, "id string, side boolean, text string, k1 long, k2 long, code long, blocks array<long>")


def _candidates(sets: DataFrame, near: int) -> tuple[DataFrame, DataFrame]:
    """(e, t): numbers of evaluation and training sets that share a block and whose codes differ in at most `near` bits, but for blocks of
    more than HOT pairs; and the numbers of the sets that have such a block."""
    keyed = sets.select("side", "number", "code", F.explode("blocks").alias("key"))
    count = keyed.groupBy("key").agg(F.sum(F.when(F.col("side"), 0).otherwise(1)).alias("ne"), F.sum(F.when(F.col("side"), 1).otherwise(0)).alias("nt"))
    hot = stored(count.where(F.col("ne") * F.col("nt") > HOT).select("key"), "hot")  # a block of so many pairs has sqrt(HOT) sets at least, so these are few
    usual = keyed.join(hot, "key", "left_anti")
    e = usual.where("not side").select("key", F.col("number").alias("e"), F.col("code").alias("ce"))
    t = usual.where("side").select("key", F.col("number").alias("t"), F.col("code").alias("ct"))
    met = e.join(t, "key").where(F.bit_count(F.col("ce").bitwiseXOR(F.col("ct"))) <= near).select("e", "t")
    return met, keyed.join(hot, "key", "left_semi").select("number").distinct()


def _sharing(sets: DataFrame, threshold: float) -> DataFrame:
    """(e, t): of sets (side, number, shingles) all pairs that may be `threshold` alike by the shingles they share; see the module.

    Shingles that no set of the other side holds come first of all, so that they are only counted."""
    held = sets.select("side", "number", F.size("shingles").alias("n"), F.explode("shingles").alias("v"))
    holders = held.groupBy("v").agg(F.count("*").alias("holders"), F.bool_or("side").alias("t"), F.bool_or(~F.col("side")).alias("e")).where("t and e").select("v", "holders")
    # shared: how many shingles of the set others hold; i: which of these it is
    each = Window.partitionBy("number")
    ordered = held.join(holders, "v").withColumn("shared", F.count("*").over(each)).withColumn("i", F.row_number().over(each.orderBy("holders", "v")))
    first = F.col("shared") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    posted = stored(ordered.where(F.col("i") <= first).select("side", "number", "n", (F.col("shared") - F.col("i") + 1).alias("rest"), "v"), "postings")
    # every part of the one side meets every part of the other
    parts = posted.groupBy("v").agg(*(F.ceil(F.count_if(F.col("side") == side) / PART).cast("int").alias(c) for c, side in (("pe", False), ("pt", True)))).where("pe > 0 and pt > 0")

    def parted(of: bool, name: str, own: str, other: str) -> DataFrame:
        rows = posted.where(F.col("side") == of).join(parts, "v")
        part = F.pmod(F.xxhash64("number"), F.col(own)).cast("int").alias(own)
        return rows.select("v", part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), F.col("number").alias(name), F.col("n").alias(f"n{name}"), F.col("rest").alias(f"rest_{name}"))

    # at the first shingle two sets share, no more than what follows it can be shared as well
    enough = F.least("rest_e", "rest_t") * (1 + threshold) >= (F.col("ne") + F.col("nt")) * threshold - 1e-6
    sizes = F.least("ne", "nt") >= threshold * F.greatest("ne", "nt") - 1e-6
    return parted(False, "e", "pe", "pt").join(parted(True, "t", "pt", "pe"), ["v", "pe", "pt"]).where(enough & sizes).select("e", "t")


def cross_split_overlaps(rows: DataFrame, id_col: str = "id", text_col: str = "hard_text", split_col: str = "split", order_col: str | None = "loaded_at", *, train: str = "train", words: int = 5, threshold: float = 0.8, miss: float = 1e-5) -> DataFrame:
    """(eval_id, train_id, likeness): records outside and inside the training split that are at least `threshold` alike.

    Records of one id are one record, the latest.  A record with null id, null split, null or empty text or
    fewer than `words` words overlaps with none.  Splits are compared trimmed and in lower case; every
    split but `train` is an evaluation split.  Columns besides those named are ignored.  Copies are compared once
    and come back as their ids; an empty table gives no rows.  miss: see the module; it holds for the blocks and for the radius, and 0 gives every pair."""
    at = F.col(order_col) if order_col else None
    one = one_per_id(rows, id_col, {"side": split_name(F.col(split_col)) == train, "text": F.col(text_col)}, at).where("side is not null")
    docs = stored(_printed(one, words, tables(threshold, miss)).withColumn("number", F.monotonically_increasing_id()), "prints")
    # one set of each side stands for its copies; they are brought back by its number
    ids = docs.select("side", "k1", "k2", "number", "id")
    reps = ids.groupBy("side", "k1", "k2").agg(F.min("number").alias("rep"))
    copies = stored(ids.join(reps, ["side", "k1", "k2"]).where("number <> rep").select("number", "rep", "id"), "copies")
    sets = docs.join(copies.select("number"), "number", "left_anti")
    if miss > 0:
        met, shared = _candidates(sets.select("side", "number", "code", "blocks"), radius(threshold, miss))
        met = stored(met.distinct(), "met")
        ends = met.select(F.col("e").alias("number")).unionByName(met.select(F.col("t").alias("number")))
        wanted = shared.withColumn("open", F.lit(True)).unionByName(ends.withColumn("open", F.lit(False))).groupBy("number").agg(F.max("open").alias("open"))
        sets = docs.join(wanted, "number")
    else:
        met, sets = None, sets.withColumn("open", F.lit(True))
    sets = stored(with_shingles(sets.select("side", "number", "id", "open", "text"), "text", words).drop("set_key"), "shingles")
    drop(docs)
    pairs = _sharing(sets.where("open"), threshold)
    pairs = stored((pairs if met is None else met.unionByName(pairs)).distinct(), "pairs")
    a, b = (sets.where(F.col("side") == side).select(F.col("number").alias(number), F.col("id").alias(name), F.col("shingles").alias(held)) for side, number, name, held in ((False, "e", "eval_id", "sa"), (True, "t", "train_id", "sb")))
    held = pairs.join(a, "e").join(b, "t").select("e", "t", "eval_id", "train_id", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    held = stored(held.where(F.col("likeness") >= threshold), "alike")
    twins = copies.select("rep", F.col("id").alias("copy"))
    for number, name in (("e", "eval_id"), ("t", "train_id")):
        again = held.join(twins, held[number] == twins["rep"]).withColumn(name, F.col("copy")).select(held.columns)
        held = held.unionByName(again)
    return held.select("eval_id", "train_id", "likeness")


def overlap_report(rows: DataFrame, id_col: str = "id", text_col: str = "hard_text", split_col: str = "split", source_col: str = "source", order_col: str | None = "loaded_at", **options) -> DataFrame:
    """(split, source, records, overlapping, train_records): for each evaluation split and source, its records, those
    that overlap with training records, and how many distinct training records they overlap with.  A null source is
    a source of its own."""
    train = options.get("train", "train")
    found = stored(cross_split_overlaps(rows, id_col, text_col, split_col, order_col, **options).select("eval_id", "train_id"), "overlaps")
    at = F.col(order_col) if order_col else None
    records = one_per_id(rows, id_col, {"split": split_name(F.col(split_col)), "source": F.col(source_col)}, at).where(F.col("split") != train)
    hit = records.join(found, records["id"] == found["eval_id"], "left")
    once = hit.groupBy("split", "source", "id").agg(F.max(F.col("train_id").isNotNull().cast("int")).alias("hit"))
    counted = once.groupBy("split", "source").agg(F.count("*").alias("records"), F.sum("hit").alias("overlapping"))
    reached = hit.where("train_id is not null").select("split", "source", "train_id").distinct().groupBy("split", "source").agg(F.count("*").alias("train_records"))
    joined = counted.alias("c").join(reached.alias("r"), (F.col("c.split") == F.col("r.split")) & F.col("c.source").eqNullSafe(F.col("r.source")), "left")
    return joined.select("c.split", "c.source", "c.records", "c.overlapping", F.coalesce("r.train_records", F.lit(0)).alias("train_records"))
