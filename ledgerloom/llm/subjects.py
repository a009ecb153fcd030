"""Subject areas of documents: bisecting k-means over vectors of their sentences, leaves labelled by discriminative terms, leaf mixtures.

The subjects of a document are asked by its sentences, so a vector stands for a sentence: a whole document about two
subjects would only give leaves of both.  Terms are the words that hand labels depend on; a sentence is the set of terms it
holds, a normalised vector in which a term weighs by its rarity and by how much labels depend on it.  Equal sets are one
weighted row from there on.  Bisecting k-means splits all rows, a level of the tree at a time, until no
leaf holds another group of some size; their number follows the corpus.  The mixture of a leaf says for each subject in what part of its labelled
sentences the document is labelled with it, together with what its discriminative terms say, which decides where labels are few.
A subject has a leaf if it stands out there from what the labels of any document give; a leaf of several subjects is shared among
them.  A sentence is about the subjects of its leaf if it holds one of the leaf's discriminative terms, else about none.  The share of a subject in a document is the mean over its sentences.

Counts of terms, the leaves and their mixtures are over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textform
from .records import label
from .scratch import drop, stored

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# what hides the end of a sentence or a word's form; without the planes above 0, as the search is 20 times as fast without them
_ODD = re.compile(f"[<&＜＆．！？{re.escape(''.join(c for c in textform.BLANKS if ord(c) < 0x10000))}]")
WEAK = 0.3
SPEAKS = 0.3  # least weight of a discriminative term in its leaf's centre
END = 0  # ends a sentence in a document's row of terms
MANY = 4_000_000  # entries that a task gathers before it passes them on


def _terms_of(text: str) -> list[int]:
    """64-bit hashes of the words, END behind each sentence that holds any."""
    out: list[int] = []
    if _ODD.search(text):
        text = textform.plain(text)
    for sentence in _SENTENCE.split(text):
        n = len(out)
        out.extend(textform.word_hashes(sentence))
        if len(out) > n:
            out.append(END)
    return out


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], sizes.cumsum())), pa.int32())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists one after another, the list of each)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[new], np.add.reduceat(counts[order], new) if len(new) else np.empty(0, counts.dtype)


TOKENS = "doc_id long, terms array<int>, numbers array<int>, bucket int, keys binary, counts binary"


def _tokenised(docs: DataFrame, sets: DataFrame, doc_col: str, text_col: str, subjects: int, buckets: int) -> DataFrame:
    """Rows of documents (doc_id, terms, numbers of their labels), and rows (bucket, keys, counts) that sum up a part of them.

    A key is a term and a subject: in how many documents with that label the term is, behind the subjects in how many labelled
    documents and in how many at all.  So the texts are read and cut once."""
    width = subjects + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def batch_of(n: int, **given: pa.Array) -> pa.RecordBatch:
            kinds = {"doc_id": pa.int64(), "terms": pa.list_(pa.int32()), "numbers": pa.list_(pa.int32()), "bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()], list(kinds))

        def sums() -> pa.RecordBatch:
            keys, counts = _summed(*(np.concatenate(p) for p in zip(*held)))
            held.clear()
            bucket = keys // width % buckets
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(1, buckets))
            parts = [(np.split(x[order], cut)) for x in (keys, counts)]
            return batch_of(buckets, bucket=pa.array(np.arange(buckets), pa.int32()), keys=pa.array([x.tobytes() for x in parts[0]], pa.binary()), counts=pa.array([x.astype(np.int32).tobytes() for x in parts[1]], pa.binary()))

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                parts = [np.array(_terms_of(t), np.uint64) for t in batch.column("t").to_pylist()]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                flat = np.concatenate(parts)
                terms = np.where(flat == END, 0, (flat >> np.uint64(33)) | np.uint64(1)).astype(np.int64)
                numbers = batch.column("numbers")
                yield batch_of(batch.num_rows, doc_id=batch.column("doc_id"), terms=pa.ListArray.from_arrays(_offsets(sizes), pa.array(terms.astype(np.int32))), numbers=numbers)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                words = terms != END
                once = np.unique(doc[words] << 32 | terms[words])
                d, t = once >> 32, once & 0xFFFFFFFF
                given, owner = _flat(numbers)
                many = np.bincount(owner, minlength=len(sizes))
                first = many.cumsum() - many
                pick = np.repeat(first[d], many[d]) + np.arange(many[d].sum()) - np.repeat(many[d].cumsum() - many[d], many[d])
                keys = np.concatenate((t * width + subjects + 1, np.repeat(t, many[d]) * width + given[pick]))
                held.append(_summed(keys, np.ones(len(keys), np.int64)))
                if sum(len(k) for k, _ in held) > MANY:
                    yield sums()
        if held:
            yield sums()

    usable = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("doc_id is not null and t is not null")
    return usable.join(sets, "doc_id", "left").select("doc_id", "t", "numbers").mapInArrow(run, TOKENS)


def _frequencies(sums: DataFrame, subjects: int, least: float, buckets: int) -> list:
    """Rows (term, subject, documents) of the terms in at least `least` documents; behind the subjects labelled and all ones."""
    width = subjects + 2

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                held.append((np.frombuffer(k, np.int64), np.frombuffer(c, np.int32).astype(np.int64)))
        if not held:
            return
        keys, counts = _summed(*(np.concatenate(p) for p in zip(*held)))
        every = keys % width == subjects + 1
        often = keys[every & (counts >= least)] // width
        keep = np.isin(keys // width, often)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[keep] // width, keys[keep] % width, counts[keep])], ["term", "subject", "n"])

    return sums.where("bucket is not null").select("bucket", "keys", "counts").repartition(buckets, "bucket").mapInArrow(merge, "term long, subject long, n long").collect()


class Vocabulary:
    """Terms (ascending) with their weights."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray) -> None:
        self.terms, self.weight = terms, weight

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, -1 for other words and ends of sentences."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def sentences(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document of each sentence, key of each sentence, sentence and place of each entry).

        A sentence holds a place once, and none that weighs under WEAK of its strongest, which would hardly turn its vector.  Equal sets have equal keys, and those without a term have key 0."""
        terms, doc = _flat(lists)
        ends = terms == END
        owner = doc[ends]
        sentence = ends.cumsum() - ends
        place = self.places(terms)
        inside = place >= 0
        width = max(1, len(self.terms))
        both = np.unique(sentence[inside] * width + place[inside])
        s, t = both // width, both % width
        key = np.zeros(len(owner), np.uint64)
        if len(s):
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            most = np.repeat(np.maximum.reduceat(self.weight[t], first), np.diff(np.append(first, len(s))))
            strong = self.weight[t] >= WEAK * most
            s, t = s[strong], t[strong]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            key[s[first]] = np.add.reduceat(textform.mix(t.astype(np.uint64) + np.uint64(1)), first) | np.uint64(1)
        return owner, key.view(np.int64), s, t

    def vectors(self, s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        """Weights of the entries (row, place) so that each of n rows has unit length."""
        w = self.weight[t]
        return w / np.sqrt(np.maximum(np.bincount(s, w * w, n), 1e-24))[s]


class Tree:
    """Splits of unit vectors in two: a row goes left if its product with a node's direction is at least the node's offset."""

    def __init__(self, width: int) -> None:
        self.direction, self.offset = np.zeros((0, width), np.float32), np.zeros(0)
        self.split, self.child = np.array([-1]), np.array([[-1, -1]])  # of each node its row of direction (-1: a leaf), left and right

    def cut(self, nodes: list[int]) -> None:
        """Turns leaves into inner nodes whose directions are yet to be set."""
        m, at = len(nodes), len(self.split)
        self.split[nodes] = np.arange(len(self.offset), len(self.offset) + m)
        self.child[nodes] = at + np.arange(2 * m).reshape(m, 2)
        self.direction = np.concatenate((self.direction, np.zeros((m, self.direction.shape[1]), np.float32)))
        self.offset = np.append(self.offset, np.zeros(m))
        self.split, self.child = np.append(self.split, np.full(2 * m, -1)), np.concatenate((self.child, np.full((2 * m, 2), -1)))

    def leaf_of(self, d: np.ndarray, t: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n rows, given as entries (row, place, weight) in order of rows; -1 for rows without any."""
        node = np.where(np.bincount(d, minlength=n) > 0, 0, -1)
        while True:
            at = np.where(node >= 0, self.split[node], -1)
            inner = at[d] >= 0
            if not inner.any():
                return node
            d, t, w = d[inner], t[inner], w[inner]
            score = np.bincount(d, w * self.direction[at[d], t], n)
            node = np.where(at >= 0, self.child[node, (score < self.offset[at]).astype(int)], node)

    def sums(self, d: np.ndarray, t: np.ndarray, w: np.ndarray, count: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of each given leaf the number of its rows (each counts `count` times), the sum of them and the sum of their squares, in one row."""
        width = self.direction.shape[1]
        number = np.full(len(self.split) + 1, -1)
        number[nodes] = np.arange(len(nodes))
        at = number[self.leaf_of(d, t, w, len(count))]
        inner = at[d] >= 0
        d, t, w = d[inner], t[inner], w[inner]
        key, size = at[d] * width + t, len(nodes) * width
        parts = [np.bincount(key, count[d] * x, size).reshape(len(nodes), width) for x in (w, w * w)]
        return np.concatenate([np.bincount(at[at >= 0], count[at >= 0], len(nodes))[:, None], *parts], 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def grow(total: Callable[[Tree, np.ndarray], np.ndarray], width: int, leaves: float, least: float, rounds: int = 2, together: int = 1 << 30) -> tuple[Tree, np.ndarray, np.ndarray]:
    """(tree, its leaves, their centres), by splitting the leaves with the most spread in two until there are enough.

    total: Tree.sums over all rows.  Leaves of a quarter of the largest spread or more are split together, without a bound on their number all
    that may be, at most `together` of them, which bounds the sums.  A split starts from halves of the terms that vary alike, as a single term would only part its own rows from the rest.  Leaves of under 2 * least rows stay whole, and those whose spread (the sum
    of 1 - cosine to the centre over their rows) is under `least`: they hold no other group of that size."""
    tree = Tree(width)
    sums = {0: total(tree, np.array([0]))[0]}
    whole: set[int] = set()

    def spread(node: int) -> float:
        return float(sums[node][0] - np.linalg.norm(sums[node][1 : 1 + width]))

    while True:
        open_ = sorted((i for i in sums if i not in whole and sums[i][0] >= max(2, 2 * least) and spread(i) >= max(least, 1e-6 * sums[i][0])), key=lambda i: (-spread(i), i))
        chosen = [i for i in open_ if leaves == np.inf or spread(i) >= 0.25 * spread(open_[0])][: int(min(max(0, leaves - len(sums)), together))]
        if not chosen:
            break
        tree.cut(chosen)
        for i in chosen:
            mean, square = sums[i][1 : 1 + width] / sums[i][0], sums[i][1 + width :] / sums[i][0]
            order = np.argsort(-(square - mean * mean), kind="stable")
            way = np.zeros(width)
            way[order] = np.where((np.arange(width) + 1) // 2 % 2, -1, 1)  # + - - + + - - ...
            tree.direction[tree.split[i]], tree.offset[tree.split[i]] = way, way @ mean
        halves = tree.child[chosen].ravel()
        for at in range(rounds):
            got = total(tree, halves)
            if at + 1 < rounds:
                for i, a, b in zip(chosen, got[::2], got[1::2]):
                    if a[0] and b[0]:
                        tree.direction[tree.split[i]] = _unit(a[1 : 1 + width]) - _unit(b[1 : 1 + width])
                        tree.offset[tree.split[i]] = 0
        for i, a, b in zip(chosen, got[::2], got[1::2]):
            for half, x in zip(tree.child[i], (a, b)):
                if x[0]:
                    sums[int(half)] = x
            if not (a[0] and b[0]):
                whole.update(map(int, tree.child[i]))
            del sums[i]
    found = np.array(sorted(i for i in sums if sums[i][0] > 0), int)
    centres = np.stack([sums[i][1 : 1 + width] for i in found]) if len(found) else np.empty((0, width))
    return tree, found, _unit(centres).astype(np.float32)


def bisecting_kmeans(x: np.ndarray, leaves: float, least: float, rounds: int = 2) -> np.ndarray:
    """Centres of unit length of the rows of x, unit vectors (rows of zeros take no part)."""
    d, t = np.nonzero(x)
    return grow(lambda tree, nodes: tree.sums(d, t, x[d, t], np.ones(len(x)), nodes), x.shape[1], leaves, least, rounds)[2]


def _gathered(points: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """Sum over all batches of the matrices that f gives; tasks send the rows that aren't zero, merged before they reach the driver."""
    context = points.sparkSession.sparkContext

    def packed(held: np.ndarray, out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([out[i].tobytes() for i in held], pa.binary())], ["row", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((rows, columns))
        for batch in batches:
            out += f(batch)
        yield packed(np.flatnonzero(out.any(1)), out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("row").to_pylist(), batch.column("x").to_pylist()):
                out[i] = out.get(i, 0) + np.frombuffer(x)
        yield packed(np.array(sorted(out), int), out)

    schema = "row long, x binary"
    made = points.coalesce(4 * context.defaultParallelism).mapInArrow(run, schema).repartition(max(1, min(rows, context.defaultParallelism)), "row").mapInArrow(merge, schema)
    out = np.zeros((rows, columns))
    for i, x in made.collect():  # a row each at most
        out[i] = np.frombuffer(x)
    return out


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, weight) of the entries of a batch's vectors, and how often each row counts."""
    t, d = _flat(batch.column("at"))
    return d, t, batch.column("w").flatten().to_numpy(), batch.column("n").to_numpy()


def _totaller(points: DataFrame) -> Callable[[Tree, np.ndarray], np.ndarray]:
    """Tree.sums over all rows of a table of vectors (at, w, n: how often the row counts, once without that column)."""
    points = points.select("at", "w", (F.col("n") if "n" in points.columns else F.lit(1)).cast("double").alias("n"))

    def total(tree: Tree, nodes: np.ndarray) -> np.ndarray:
        sent = points.sparkSession.sparkContext.broadcast((tree, nodes))
        out = _gathered(points, lambda batch: sent.value[0].sums(*_entries(batch), sent.value[1]), len(nodes), 1 + 2 * tree.direction.shape[1])
        sent.destroy()
        return out

    return total


def dependence(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Relative entropy of the labels of a term's documents to those of all documents, less what chance gives (two standard deviations above its mean); at least 0.

    counts: (terms x subjects) labelled documents.  The words of any document come out near 0."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(p > 0, p * np.log(p / prior), 0).sum(1)
    free = max(1, counts.shape[1] - 1)
    return np.maximum(entropy - (free + 2 * np.sqrt(2 * free)) / np.maximum(2 * total[:, 0], 1), 0)


def mixtures(labelled: np.ndarray, centres: np.ndarray, by_term: np.ndarray, prior: np.ndarray, doubt: float, least: float) -> np.ndarray:
    """(leaves x subjects): how far a sentence of the leaf is about each subject; adds up to 1 or, for none, 0.

    labelled: (leaves x subjects + 1) labelled sentences with each label, at last all.  by_term: the same of the labelled
    documents that hold a term, which are shrunk towards all documents.  What the terms say counts like `doubt` labelled sentences.  A subject has part in a leaf if surely at least `least`
    of the labels name it and it stands out from its share of all documents nearly as much as the subject that does most."""
    k = len(prior)
    weight = centres**2  # adds up to 1 in a leaf
    by_term = (by_term[:, :k] + 0.75 * doubt * prior) / (by_term[:, k:] + 0.75 * doubt)
    said = (labelled[:, :k] + doubt * weight @ by_term) / (labelled[:, k:] + doubt)
    sure = said - np.sqrt(said * (1 - said) / (labelled[:, k:] + doubt))  # one standard error less
    part = np.where(sure >= least, np.maximum(said - prior, 0), 0)
    part = np.where(part >= 0.7 * part.max(1, keepdims=True, initial=0), part, 0)
    return part / np.where(part.sum(1, keepdims=True) > 0, part.sum(1, keepdims=True), 1)


SIGNED = "key long, at array<int>, n double, labelled array<double>"


def _signed(rows: DataFrame, vocabulary: Vocabulary, k: int) -> DataFrame:
    """(key, at, w, n, labelled): each set of terms that a sentence holds, its vector, in how many documents a sentence holds just it, and how many of these documents
    have each label, at last with any (none without).  A document counts each set once."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def rows_of(key: np.ndarray, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        has = counts[:, k + 1] > 0
        labelled = pa.ListArray.from_arrays(_offsets(np.where(has, k + 1, 0)), pa.array(counts[has, 1:].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.ListArray.from_arrays(_offsets(sizes), pa.array(places.astype(np.int32))), pa.array(counts[:, 0]), labelled], ["key", "at", "n", "labelled"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        held: list[tuple] = []

        def merged() -> tuple:
            key, sizes, places, counts = (np.concatenate(p) for p in zip(*held))
            held.clear()
            u, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            out = np.stack([np.bincount(inverse, c, len(u)) for c in counts.T], 1)
            starts = sizes.cumsum() - sizes
            n = sizes[first]
            pick = np.repeat(starts[first] - (n.cumsum() - n), n) + np.arange(n.sum())
            return u, n, places[pick], out

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                owner, key, s, t = vocabulary.sentences(batch.column("terms"))
                given, doc = _flat(batch.column("numbers"))
                has = np.zeros((batch.num_rows, k + 1))
                has[doc, given] = 1
                u, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                once = np.unique(owner * np.int64(len(u)) + inverse)  # a document counts a set once, however often it repeats it
                at_ = once % len(u)
                number = np.full(len(key), -1)
                number[first] = np.arange(len(u))
                entry = number[s] >= 0
                counts = np.stack([np.bincount(at_, x, len(u)) for x in (np.ones(len(at_)), *has[once // len(u)].T)], 1)
                some = u != 0
                held.append((u[some], np.bincount(number[s[entry]], minlength=len(u))[some], t[entry][np.argsort(number[s[entry]], kind="stable")], counts[some]))
                if len(held) % 16 == 0:
                    held.append(merged())
                    if len(held[0][0]) * (k + 4) > MANY:
                        yield rows_of(*held.pop())
        if held:
            yield rows_of(*merged())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            t, d = _flat(batch.column("at"))
            w = vocabulary.vectors(d, t, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.ListArray.from_arrays(batch.column("at").offsets, pa.array(w.astype(np.float32))), batch.column("n"), batch.column("labelled")], ["at", "w", "n", "labelled"])

    made = rows.mapInArrow(count, SIGNED)
    add = F.expr("aggregate(filter(l, x -> size(x) > 0), cast(array() as array<double>), (a, x) -> case when size(a) = 0 then x else zip_with(a, x, (p, q) -> p + q) end)")
    one = made.groupBy("key").agg(F.first("at").alias("at"), F.sum("n").alias("n"), F.collect_list("labelled").alias("l")).select("at", "n", add.alias("labelled"))  # a row of each task at most
    return one.mapInArrow(weigh, "at array<int>, w array<float>, n double, labelled array<double>")


def subject_shares(docs: DataFrame, labels: DataFrame, areas: DataFrame, doc_col: str = "doc_id", text_col: str = "text", *, least_share: float = 0.0003, leaf_share: float = 0.0003, doubt: float = 10.0, least: float = 0.5) -> DataFrame:
    """(doc_id, subject, sentences, share): for each document the subjects that any of its sentences is about.

    sentences is how many are (a sentence of a leaf of several subjects counts in part for each), share what part of all its sentences.  A
    document with a null id, a null text or no word has no row, nor has one about none of the areas.  Documents of one id count as
    one that holds all their sentences.  Labels are compared trimmed, in lower case, with underscores; those of unknown documents or
    subjects are left out, equal ones of a document count once.  Without labels no leaf has a subject, and there are no rows.

    Terms: words in at least least_share of the documents (and 3 of them) that labels depend on, which bounds their number by the mean
    length of a document / least_share; the rest are names and grammar.  Leaves are split until none holds another group of leaf_share of the
    sentences, which bounds their number by 2 / leaf_share.  doubt and least: see mixtures()."""
    spark = docs.sparkSession
    subjects = sorted(r[0] for r in areas.select(label(F.col("subject"))).where("subject is not null").distinct().collect()) if "subject" in areas.columns else []
    k = len(subjects)
    empty = spark.createDataFrame([], "doc_id long, subject string, sentences double, share double")
    if not k:
        return empty
    named = spark.createDataFrame([(s, i) for i, s in enumerate(subjects)], "subject string, number int")
    given = labels.select(F.col(doc_col).cast("long").alias("doc_id"), label(F.col("subject")).alias("subject")).where("doc_id is not null").join(F.broadcast(named), "subject")  # one row a subject
    # at most one entry a subject, and one behind them that stands for any
    sets = stored(given.groupBy("doc_id").agg(F.array_union(F.collect_set("number"), F.array(F.lit(k))).alias("numbers")), "labels")
    prior = np.zeros(k + 1)
    for i, c in sets.select(F.explode("numbers").alias("i")).groupBy("i").count().collect():
        prior[i] = c
    buckets = max(1, spark.sparkContext.defaultParallelism)
    rows = stored(_tokenised(docs, sets, doc_col, text_col, k, buckets), "terms")
    n = rows.where("doc_id is not null").count()
    if not n or not prior[k]:
        return empty
    found = _frequencies(rows, k, max(3, least_share * n), buckets)
    terms = np.unique(np.array([r[0] for r in found], np.int64))
    counts = np.zeros((len(terms), k + 2))
    for t, i, c in found:
        counts[np.searchsorted(terms, t), i] = c
    weight = dependence(counts[:, :k], (prior[:k] + 1) / (prior[:k] + 1).sum())
    terms, counts, weight = terms[weight > 0], counts[weight > 0], weight[weight > 0]
    if not len(terms):
        return empty
    vocabulary = Vocabulary(terms, weight * np.log(1 + n / counts[:, k + 1]))

    rows = rows.where("doc_id is not null").select("doc_id", "terms", "numbers")
    points = stored(_signed(rows, vocabulary, k), "sentences")
    total = points.agg(F.sum("n")).first()[0] or 0
    if not total:
        return empty
    tree, places, centres = grow(_totaller(points), len(terms), np.inf, max(2, leaf_share * total), together=max(1, MANY // len(terms)))
    m = len(places)
    number_of = np.full(len(tree.split) + 1, -1)  # the last is for sentences without a term
    number_of[places] = np.arange(m)
    grown = spark.sparkContext.broadcast((tree, number_of))

    def by_leaf(batch: pa.RecordBatch) -> np.ndarray:
        tree, number_of = grown.value
        leaf = number_of[tree.leaf_of(*_entries(batch)[:3], batch.num_rows)]
        x, d = _flat(batch.column("labelled"))
        has = np.unique(d)
        x = x.reshape(-1, k + 1)
        return np.stack([np.bincount(leaf[has], x[:, i], m) for i in range(k + 1)], 1)

    held = _gathered(points.select("at", "w", "n", "labelled"), by_leaf, m, k + 1)
    mixture = mixtures(held, centres.astype(float), counts[:, : k + 1], prior[:k] / prior[k], doubt, least)
    # a leaf's discriminative terms: at most 1 / SPEAKS**2 each, as its centre has unit length
    leaf, term = np.nonzero(centres >= SPEAKS)
    shares = _shares(rows, vocabulary, tree, number_of, mixture, leaf * len(terms) + term, subjects)
    drop(points)
    return shares


def _shares(rows: DataFrame, vocabulary: Vocabulary, tree: Tree, number_of: np.ndarray, mixture: np.ndarray, speaking: np.ndarray, subjects: list[str]) -> DataFrame:
    leaf, subject = np.nonzero(mixture)
    many = np.bincount(leaf, minlength=len(mixture))
    sent = rows.sparkSession.sparkContext.broadcast((vocabulary, tree, number_of, subject, mixture[leaf, subject], many, speaking))
    k = len(subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tree, number_of, subject, part, many, speaking = sent.value
        start = many.cumsum() - many
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                owner, key, s, t = vocabulary.sentences(batch.column("terms"))
                u, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                number = np.full(len(key), -1)
                number[first] = np.arange(len(u))
                once = number[s] >= 0  # each set of terms is led to its leaf once
                d, t = number[s[once]], t[once]
                leaf = number_of[tree.leaf_of(d, t, vocabulary.vectors(d, t, len(u)), len(u))]
                spoken = np.isin(leaf[d] * np.int64(len(vocabulary.terms)) + t, speaking)
                leaf = np.where(np.bincount(d, spoken, len(u)) > 0, leaf, -1)[inverse]
                doc, leaf = owner[leaf >= 0], leaf[leaf >= 0]
                n = many[leaf]
                pick = np.repeat(start[leaf] - (n.cumsum() - n), n) + np.arange(n.sum())
                both, at_ = np.unique(np.repeat(doc, n) * np.int64(k) + subject[pick], return_inverse=True)
                parts = np.bincount(at_, part[pick], len(both))
                offsets = _offsets(np.bincount(both // k, minlength=batch.num_rows))
                columns = [batch.column("doc_id"), pa.array(np.bincount(owner, minlength=batch.num_rows)), pa.ListArray.from_arrays(offsets, pa.array((both % k).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(parts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "total", "numbers", "parts"])

    made = rows.select("doc_id", "terms").mapInArrow(run, "doc_id long, total long, numbers array<int>, parts array<double>")
    per = made.groupBy("doc_id").agg(F.sum("total").alias("total"), F.flatten(F.collect_list(F.arrays_zip("numbers", "parts"))).alias("s"))  # a row of each delivery of the document
    each = per.select("doc_id", "total", F.explode("s").alias("s")).groupBy("doc_id", "total", F.col("s.numbers").alias("number")).agg(F.sum("s.parts").alias("sentences"))
    name = F.element_at(F.array(*(F.lit(s) for s in subjects)), F.col("number") + 1)
    return each.select("doc_id", name.alias("subject"), "sentences", (F.col("sentences") / F.col("total")).alias("share"))


def composition(docs: DataFrame, assigned: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(subject, documents, share_of_documents): how many documents are about each subject; the null subject holds
    those about none."""
    ids = docs.select(F.col(doc_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    counted = ids.join(assigned.select("doc_id", "subject").distinct(), "doc_id", "left").groupBy("subject").agg(F.count("*").alias("documents"))
    total = ids.agg(F.count("*").alias("all"))  # one row
    return counted.join(F.broadcast(total)).select("subject", "documents", (F.col("documents") / F.col("all")).alias("share_of_documents"))
