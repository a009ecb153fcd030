"""Passages of held-out items in a corpus, found with an FM-index over each shard of it.

A shard is a run of documents of one task, cut at about `shard_words` words, as numbers with a separator behind each
document.  Its index holds the Burrows-Wheeler transform as a wavelet matrix and every 16th suffix position.  All
phrases of `phrase` words of all items are searched backwards at once; each occurrence is walked to the next
sampled position.  Occurrences of one item that overlap or touch are merged to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textform

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `text` (numbers from 0) in order; a suffix comes before those it starts.

    Prefix doubling that sorts only the suffixes that are not told apart yet."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    step = int(text.max()) + 2
    key = (text.astype(np.int64) + 1) * step
    key[:-1] += text[1:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))  # first of a group of equal keys, at its place in the order
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    length = 2
    while True:
        single = head & np.concatenate((head[1:], [True]))
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        at = order[open_]
        next_ = np.where(at + length < n, rank[np.minimum(at + length, n - 1)], -1)
        group = rank[at]
        by = np.lexsort((next_, group))
        order[open_] = at = at[by]
        group, next_ = group[by], next_[by]
        first = np.concatenate(([True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])))
        head[open_] = first
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        length *= 2


class Wavelet:
    """A sequence of numbers in [0, size); counts how often a number stands before a place, and reads places."""

    def __init__(self, values: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ranks, self.zeros = [], []
        v = values
        for b in range(self.bits - 1, -1, -1):
            bit = (v >> b) & 1
            ones = np.zeros(len(v) + 1, np.int32)
            np.cumsum(bit, out=ones[1:], dtype=np.int32)
            self.ranks.append(ones)
            self.zeros.append(len(v) - int(ones[-1]))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def rank(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        low, high = np.zeros_like(place), place
        for k in range(self.bits):
            ones, zeros = self.ranks[k], self.zeros[k]
            one = ((value >> (self.bits - 1 - k)) & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low = np.where(one, zeros + l1, low - l1)
            high = np.where(one, zeros + h1, high - h1)
        return high - low

    def read(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the values at the places, how often each stands before its place)."""
        value, low, at = np.zeros_like(place), np.zeros_like(place), place
        for k in range(self.bits):
            ones, zeros = self.ranks[k], self.zeros[k]
            bit = ones[at + 1] - ones[at]
            one = bit.astype(bool)
            value = value * 2 + bit
            at = np.where(one, zeros + ones[at], at - ones[at])
            low = np.where(one, zeros + ones[low], low - ones[low])
        return value, at - low


class FMIndex:
    def __init__(self, text: np.ndarray, size: int) -> None:
        """text: numbers in [0, size).  Inside they are one more, and a single 0 ends the text."""
        text = np.append(text + 1, 0)
        self.n = len(text)
        order = suffix_array(text)
        self.first = np.concatenate(([0], np.bincount(text, minlength=size + 1).cumsum()))
        self.before = Wavelet(text[order - 1], size + 1)  # before the whole text stands its end
        self.sampled = np.zeros(self.n, bool)
        self.sampled[order % SAMPLE == 0] = True
        self.place = np.concatenate(([0], self.sampled.cumsum()))
        self.position = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) row of each phrase (a row of numbers of equal count)."""
        phrases = phrases + 1
        last = phrases[:, -1]
        low, high = self.first[last].copy(), self.first[last + 1].copy()
        live = np.flatnonzero(low < high)
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[live, k]
            l = self.first[c] + self.before.rank(c, low[live])
            h = self.first[c] + self.before.rank(c, high[live])
            low[live], high[live] = l, h
            live = live[l < h]
        high[high < low] = low[high < low]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        found = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            hit = self.sampled[at]
            found[live[hit]] = self.position[self.place[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            value, count = self.before.read(at)
            at = self.first[value] + count
            steps += 1
        return found


def phrases_of(words: np.ndarray, sizes: np.ndarray, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of `phrase` words that lies in one item, the item)."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    m = max(0, len(words) - phrase + 1)
    start = np.flatnonzero(item[:m] == item[phrase - 1 : phrase - 1 + m])
    return start, item[start]


def find_in_shard(words: np.ndarray, sizes: np.ndarray, item_words: np.ndarray, start: np.ndarray, item: np.ndarray, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first word, end) of the merged spans; documents and items by number, words within the document."""
    vocabulary, text = np.unique(words, return_inverse=True)
    ends = sizes.cumsum()
    begins = ends - sizes
    # place of each word with one separator (0) behind each document
    doc = np.repeat(np.arange(len(sizes)), sizes)
    full = np.zeros(len(words) + len(sizes), np.int64)
    full[np.arange(len(words)) + doc] = text + 1
    number = np.searchsorted(vocabulary, item_words)
    known = number < len(vocabulary)
    known[known] = vocabulary[number[known]] == item_words[known]
    number = np.where(known, number + 1, 0)
    missing = np.concatenate(([0], (~known).cumsum()))
    possible = np.flatnonzero(missing[start + phrase] == missing[start])
    empty = np.empty(0, np.int64)
    if not len(possible) or not len(words):
        return empty, empty, empty, empty
    index = FMIndex(full, len(vocabulary) + 1)
    low, high = index.search(number[start[possible][:, None] + np.arange(phrase)])
    counts = high - low
    which = np.repeat(np.arange(len(possible)), counts)
    offsets = np.arange(len(which)) - np.repeat(counts.cumsum() - counts, counts)
    position = index.locate(low[which] + offsets)
    d = np.searchsorted(begins + np.arange(len(sizes)), position, side="right") - 1
    i = item[possible][which]
    order = np.lexsort((position, i, d))
    d, i, p = d[order], i[order], position[order]
    if not len(d):
        return empty, empty, empty, empty
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (p[1:] > p[:-1] + phrase)))
    heads = np.flatnonzero(new)
    lasts = np.append(heads[1:], len(d)) - 1
    origin = begins[d[heads]] + d[heads]
    return d[heads], i[heads], p[heads] - origin, p[lasts] + phrase - origin


def _blocks(items: DataFrame, item_col: str, passage_col: str, phrase: int, most_words: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Items with their words, in blocks of at most most_words words (or of one item)."""
    ids, parts, total = [], [], 0
    for row in items.select(item_col, passage_col).where(F.col(item_col).isNotNull() & F.col(passage_col).isNotNull()).distinct().toLocalIterator():
        words = np.fromiter(textform.word_hashes(row[1]), np.uint64)
        if len(words) < phrase:
            continue
        if ids and total + len(words) > most_words:
            yield ids, np.concatenate(parts), np.array([len(p) for p in parts])
            ids, parts, total = [], [], 0
        ids.append(row[0])
        parts.append(words)
        total += len(words)
    if ids:
        yield ids, np.concatenate(parts), np.array([len(p) for p in parts])


SPANS = "doc_id long, item_id string, first_word int, end_word int"


def leaked_spans(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", *, phrase: int = 10, shard_words: int = 400_000, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, first_word, end_word): the runs of words of each document that stand in an item's passage.

    Words count from 0 in the document; end_word is exclusive.  Each run is at least `phrase` words long, and runs of one item that
    overlap or touch are one.  A null or empty text or passage, and one of fewer than `phrase` words, holds nothing and is
    held nowhere.  Rows of equal doc_id are documents of their own; an item given twice counts once.  Other columns
    are ignored.  Texts of any length are searched whole.

    Items are sent to the executors in blocks of at most block_words words (8 bytes each); beyond one block the
    corpus is indexed once for each."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], SPANS)
    for ids, words, sizes in _blocks(items, item_col, passage_col, phrase, block_words):
        block = spark.sparkContext.broadcast((ids, words, sizes))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, item_words, item_sizes = block.value
            start, item = phrases_of(item_words, item_sizes, phrase)
            names = np.array(ids, object)

            def search(keys: list, parts: list) -> pa.RecordBatch:
                words, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
                d, i, first, end = find_in_shard(words, sizes, item_words, start, item, phrase)
                return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[d]), pa.array(names[i], pa.string()), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "item_id", "first_word", "end_word"])

            keys: list = []
            parts: list = []
            size = 0
            for batch in batches:
                for key, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                    keys.append(key)
                    parts.append(np.fromiter(textform.word_hashes(text), np.uint64))
                    size += len(parts[-1]) + 1
                    if size >= shard_words:
                        yield search(keys, parts)
                        keys, parts, size = [], [], 0
            if keys:
                yield search(keys, parts)

        usable = docs.select(F.col(doc_col).cast("long").alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
        found = found.unionByName(usable.mapInArrow(run, SPANS))
    return found


def removal_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, items): the words to remove from each document, over all items; spans that overlap
    or touch are one, items counts those that reach into it."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", (F.col("first_word") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("part", F.sum("new").over(by))
    return parted.groupBy("doc_id", "part").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.countDistinct("item_id").alias("items")).drop("part")
