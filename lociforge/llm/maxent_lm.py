"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class given the tokens before it, times that of the token in its class.

* Classes: the end of a text, the commonest words one by one, and the rest by cluster and frequency band. Clusters come
  from texts that share common words: centers by k-means over all training texts, each of which joins the nearest. A word gets the cluster that its first and last letters speak for, counted over all whole training texts, so
  every word has one, seen or not.
* Class given history: a softmax over hashed features, the word before, the skip words two and three back, the two
  words before together, the classes of the two before, and those of the three before. Weights are trained over all
  training texts in rounds: each task takes gradient steps on its own texts from shared weights, and the results are
  averaged over the tasks by rows.
* Token in class: its smoothed share of the class, from counts over all training texts. Words seen once or never are in
  a cluster's rare class; all its unseen words are one event, with the Good-Turing mass of the words seen once.

Counts stay distributed. Words above a count that at most ``FREQUENT`` words reach are broadcast; the others are looked
up with a join. As history every word is itself, broadcast or not, seen or not: features hash a frequent word's place and
another word's bytes. Tokens are scored in numpy, a block of texts at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, texts, written
from .language_id import held_out

#: Words that are broadcast, at most.
FREQUENT = 200_000
SINGLE, CLUSTERS, BANDS = 7, 6, 4
CLASSES = 1 + SINGLE + CLUSTERS * BANDS
#: Rank from which a frequent word is in the third band; words that aren't frequent are in the fourth.
BAND_RANKS = (600, 12_000)
ROW_BITS = 15
BLOCK_ROWS = 512
ROUNDS = 2
RATE = 0.25
#: A row's step goes no further than this over its tokens: the loss curves by at most 1/4 a token for each of a token's six rows.
FURTHEST = 1 / 1.5
#: Results that are averaged at a time.
FAN_IN = 32
#: A bound on the texts that the clusters' centers are fitted on: there is none, all are read.
SAMPLE_DOCUMENTS = None
#: Commonest words that texts are compared by.
COMMON = 200
#: Rounds of k-means over all training texts, at most; and units of a sum, which is of integers and so the same in any order.
CENTER_ROUNDS = 12
UNIT = 1 << 20
SMOOTHING = 0.1
#: Bytes in a block of texts, and tokens in a gradient step.
BLOCK, STEP = 4 << 20, 4096
#: Words whose letters are looked up at a time.
LETTER_STEP = 1 << 16
END = b""

_ODD = np.random.Generator(np.random.Philox(key=13)).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: str) -> list[bytes]:
    """Words, with A-Z in lower case, that white space of ASCII separates; the end of the text isn't among them."""
    return text.encode().lower().split()


@dataclass
class Letters:
    """Log-likelihoods per cluster of words' first and last three bytes, which are behind a mark in the keys."""

    keys: np.ndarray  # ascending
    table: np.ndarray  # [key, cluster]

    def get(self, key: bytes) -> np.ndarray | None:
        """The row of a marked key, or none."""
        k = np.uint32(int.from_bytes(key, "big"))
        at = int(np.searchsorted(self.keys, k))
        return self.table[at] if at < len(self.keys) and self.keys[at] == k else None

    def sums(self, mark: bytes, lengths: np.ndarray, firsts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows for the up to three bytes of ``data`` from ``firsts`` on, zeros where there is none, and where there is one."""
        if not len(self.keys):
            return np.zeros((len(lengths), CLUSTERS), np.float32), np.zeros(len(lengths), bool)
        k = np.full(len(lengths), mark[0], np.uint32)
        for i in range(3):
            k = np.where(i < lengths, k * np.uint32(256) + data[np.minimum(firsts + i, len(data) - 1)], k) if len(data) else k
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        known = self.keys[at] == k
        return np.where(known[:, None], self.table[at], np.float32(0)), known


@dataclass
class Vocabulary:
    """Ids of frequent words are their places; another word's, after those, carries its hash and its cluster."""

    words: list[bytes]  # the end first, then by falling count
    counts: np.ndarray
    clusters: Letters
    table: pa.Array | None = None

    def prepare(self) -> Vocabulary:
        if self.table is None:
            self.table = pa.array(self.words, pa.string())
            rank = np.arange(len(self.words))
            band = (rank >= BAND_RANKS[0]).astype(int) + (rank >= BAND_RANKS[1])
            own = self.clusters_of(self.table)
            rare = np.arange(CLUSTERS)
            self.classes = np.concatenate([np.where(rank <= SINGLE, rank, 1 + SINGLE + own * BANDS + band), 1 + SINGLE + rare * BANDS + BANDS - 1])
            self.log_counts = np.concatenate([np.log10(self.counts + SMOOTHING), np.zeros(CLUSTERS)])
        return self

    def clusters_of(self, words: pa.Array) -> np.ndarray:
        """The cluster that each word's letters speak for, the last one where they are new."""
        out = np.empty(len(words), np.int64)
        for at in range(0, len(words), LETTER_STEP):
            part = pa.concat_arrays([words.slice(at, LETTER_STEP).cast(pa.binary())])  # of its own bytes, from their begin
            _, offsets, body = part.buffers()
            ends = np.frombuffer(offsets, np.int32)[: len(part) + 1].astype(np.int64)
            data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
            lengths = np.minimum(np.diff(ends), 3)
            a, in_a = self.clusters.sums(b"<", lengths, ends[:-1], data)
            b, in_b = self.clusters.sums(b">", lengths, ends[1:] - lengths, data)
            out[at : at + LETTER_STEP] = np.where(in_a | in_b, (a + b).argmax(axis=1), CLUSTERS - 1)
        return out

    def cluster(self, word: bytes) -> int:
        return int(self.clusters_of(pa.array([word], pa.binary()))[0])

    def rare_ids(self, words: pa.Array) -> np.ndarray:
        marks = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.int64, len(words))
        return len(self.words) + marks * CLUSTERS + self.clusters_of(words)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where ``classes`` and ``log_counts`` have the words: behind the frequent ones, a cluster's others have one place."""
        n = len(self.words)
        return np.where(ids < n, ids, n + (ids - n) % CLUSTERS)

    def __getstate__(self):
        return {"words": self.words, "counts": self.counts, "clusters": self.clusters}

    def __setstate__(self, state):
        self.__dict__.update(state, table=None)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts end to end, as ``tokens`` has them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full, min_count=0).as_py():
        return flat, sizes
    sums = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    return flat.filter(full), sums[ends] - sums[ends - sizes]


def encode(vocabulary: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Ids of the texts' tokens with an end before and after each text, the size of each text with its last end, the words that aren't frequent, and how many of those each text has."""
    words, sizes = split_words(column)
    found = pc.index_in(words, value_set=vocabulary.table)
    rare_here = pc.is_null(found).to_numpy(zero_copy_only=False)
    ids = found.fill_null(0).to_numpy().astype(np.int64)
    rare = words.filter(pa.array(rare_here))
    kinds = rare.dictionary_encode()
    own = vocabulary.rare_ids(kinds.dictionary)
    ids[rare_here] = own[kinds.indices.to_numpy()] if len(own) else 0
    out = np.zeros(len(ids) + len(sizes) + 1, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = ids
    sums = np.concatenate([[0], np.cumsum(rare_here)])
    ends = np.cumsum(sizes)
    return out, sizes + 1, rare, sums[ends] - sums[ends - sizes]


def features(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """[token, feature]: rows of the weights for each token but the first, from what is before it in its text."""
    n = len(ids) - 1
    one = ids[:-1]
    start = one == 0
    two = np.where(start, 0, np.concatenate([[0], ids])[:n])
    three = np.where(start | (two == 0), 0, np.concatenate([[0, 0], ids])[:n])
    c1, c2, c3 = (vocabulary.classes[vocabulary.places(x)].astype(np.uint64) for x in (one, two, three))
    a, b, c = (x.astype(np.uint64) for x in (one, two, three))
    with np.errstate(over="ignore"):
        keys = (a * _ODD[0] + _ODD[7], b * _ODD[1] + _ODD[6], c * _ODD[2] + _ODD[5], (a * _ODD[3] ^ b * _ODD[4]) * _ODD[5], (c1 * np.uint64(64) + c2) * _ODD[6] + _ODD[1], ((c1 * np.uint64(64) + c2) * np.uint64(64) + c3) * _ODD[7] + _ODD[2])
    return np.column_stack([((k ^ (k >> np.uint64(31))) * _ODD[3] >> np.uint64(64 - ROW_BITS)).astype(np.uint16) for k in keys])


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        logits += weights.take(rows[:, k], axis=0)
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def group_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: most runs are short, and are added up run by run at once; long ones by themselves."""
    sizes = np.diff(np.append(starts, len(rows)))
    out = rows.take(starts, axis=0)
    live, k = np.flatnonzero(sizes > 1), 1
    while len(live) and k < 6:
        out[live] += rows.take(starts[live] + k, axis=0)
        k += 1
        live = live[sizes[live] > k]
    for g in live.tolist():
        out[g] += rows[starts[g] + k : starts[g] + sizes[g]].sum(axis=0)
    return out


def steps(vocabulary: Vocabulary, weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, touched: np.ndarray, ids: np.ndarray) -> None:
    """Gradient steps over the tokens, in place; the step size of a row falls with its past gradients, and stays below what overshoots."""
    rows, classes = features(vocabulary, ids), vocabulary.classes[vocabulary.places(ids[1:])]
    for at in range(0, len(rows), STEP):
        own, target = rows[at : at + STEP], classes[at : at + STEP]
        n = len(own)
        pull = log_softmax(weights, bias, own)
        np.exp(pull, out=pull)
        pull[np.arange(n), target] -= 1
        flat = own.T.ravel()
        order = np.argsort(flat, kind="stable")  # radix, of 16-bit rows
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        kinds = flat[starts]
        slope = group_sums(pull.take(order % n, axis=0), starts)
        times = np.diff(np.append(starts, len(flat)))
        seen[kinds] += np.einsum("ij,ij->i", slope, slope) / slope.shape[1]
        touched[kinds] += times
        weights[kinds] -= np.minimum(RATE / np.sqrt(seen[kinds]), FURTHEST / times)[:, None] * slope


def _blocks(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of texts of bounded size, at least one text each, and the place of their first."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        yield at, column.slice(at, last - at)
        at = last


def count_tokens(train: DataFrame) -> DataFrame:
    """``word, n`` over all texts; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts_here in _blocks(batch.column(1)):
                words, sizes = split_words(texts_here)
                counts = words.value_counts()
                found = pa.concat_arrays([counts.field("values").cast(pa.binary()), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([found, pa.concat_arrays([counts.field("counts"), pa.array([len(sizes)], pa.int64())])], ["word", "n"])

    return train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def profiles(common: pa.Array, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """[text, common word]: square roots of counts, scaled to length one."""
    found = pc.index_in(words, value_set=common)
    here = pc.is_valid(found).to_numpy(zero_copy_only=False)
    width = max(1, len(common))
    place = np.repeat(np.arange(len(sizes)), sizes)[here] * width + found.drop_null().to_numpy()
    x = np.sqrt(np.bincount(place, minlength=len(sizes) * width).reshape(len(sizes), width))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def text_profiles(train: DataFrame, common: pa.Array) -> DataFrame:
    """``sizes, places, values`` of a block of whole texts in a row: how many common words each text has, which, and their ``profiles`` in whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(common))
        for batch in batches:
            for _, texts_here in _blocks(batch.column(1)):
                x = profiles(common, *split_words(texts_here))
                at = np.flatnonzero(x)
                parts = np.bincount(at // width, minlength=len(x)).astype("<u4"), (at % width).astype("<u2"), np.rint(x.ravel()[at] * UNIT).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["sizes", "places", "values"])

    return train.mapInArrow(run, "sizes binary, places binary, values binary")


def unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block of texts in rows of ``text_profiles``: texts, places and values, and these as a matrix of floats."""
    for row in batch.to_pylist():
        sizes, places, values = (np.frombuffer(row[c], kind) for c, kind in (("sizes", "<u4"), ("places", "<u2"), ("values", "<u4")))
        own = np.repeat(np.arange(len(sizes)), sizes)
        x = np.zeros((len(sizes), width), np.float32)
        x[own, places] = values
        yield own, places, values, x


def _added(table: DataFrame, width: int, height: int, sums: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of ``sums``, whole numbers, of all blocks of texts: a matrix of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(height * width, np.int64)
        for batch in batches:
            for block in unpacked(batch, width):
                total += np.rint(sums(*block)).astype(np.int64).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(height * width)
    with small_batches(table.sparkSession):
        for r in table.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
    return out.reshape(height, width)


def fit_centers(train: DataFrame, common: pa.Array, rounds: int = CENTER_ROUNDS) -> np.ndarray:
    """Centers of clusters of all texts by common words.

    They start from clusters of the common words, by the words that they share texts with; then k-means over the texts.
    """
    table = written(text_profiles(train, common), "lm-profiles")
    width = max(1, len(common))

    def pairs(own: np.ndarray, places: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = np.rint(x * 2**-8).astype(np.float64)  # so products and their sums are whole
        return x.T @ x

    together = _added(table, width, width, pairs)
    centers = induce_centers(together / np.maximum(np.linalg.norm(together, axis=1, keepdims=True), 1e-9))
    for _ in range(rounds):
        before = centers.copy()

        def joined(own: np.ndarray, places: np.ndarray, values: np.ndarray, x: np.ndarray, c: np.ndarray = before.astype(np.float32)) -> np.ndarray:
            near = (x @ c.T).argmax(axis=1)
            return np.bincount(near[own] * width + places, weights=values, minlength=CLUSTERS * width)

        sums = _added(table, width, CLUSTERS, joined)
        lengths = np.linalg.norm(sums, axis=1)
        centers[lengths > 0] = sums[lengths > 0] / lengths[lengths > 0, None]
        if (centers == before).all():
            break
    discard(table)
    return centers


def induce_centers(x: np.ndarray, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centers of clusters of the rows."""
    rng = np.random.Generator(np.random.Philox(key=seed))
    centers = x[rng.permutation(len(x))[:1]] if len(x) else np.zeros((1, x.shape[1]))
    while len(centers) < CLUSTERS:  # the row that is farthest from all centers
        far = (x @ centers.T).max(axis=1) if len(x) else np.zeros(1)
        centers = np.vstack([centers, x[int(far.argmin())] if len(x) else centers[:1]])
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        for k in range(CLUSTERS):
            if (near == k).any():
                m = x[near == k].sum(axis=0)
                centers[k] = m / max(np.linalg.norm(m), 1e-9)
    return centers


def count_letters(train: DataFrame, common: pa.Array, centers: np.ndarray) -> DataFrame:
    """``key, n0, n1, ...``: in how many tokens of each cluster's texts a word begins or ends so, over all whole texts.

    There are at most two keys for each three bytes, however many texts there are.
    """
    names = [f"n{k}" for k in range(CLUSTERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts_here in _blocks(batch.column(1)):
                words, sizes = split_words(texts_here)
                near = (profiles(common, words, sizes) @ centers.T).argmax(axis=1)
                kinds = words.dictionary_encode()
                count = len(kinds.dictionary)
                n = np.bincount(kinds.indices.to_numpy() * np.int64(CLUSTERS) + np.repeat(near, sizes), minlength=count * CLUSTERS).reshape(count, CLUSTERS)
                whole = kinds.dictionary.cast(pa.binary())
                parts = [pc.binary_join_element_wise(pa.scalar(mark), part, pa.scalar(b"")) for mark, part in ((b"<", pc.binary_slice(whole, 0, 3)), (b">", pc.binary_slice(whole, -3)))]
                keys = pa.concat_arrays(parts).dictionary_encode()
                at = keys.indices.to_numpy()
                sums = [np.bincount(at, weights=np.tile(n[:, k], 2), minlength=len(keys.dictionary)).astype(np.int64) for k in range(CLUSTERS)]
                yield pa.RecordBatch.from_arrays([keys.dictionary, *map(pa.array, sums)], ["key", *names])

    counted = train.mapInArrow(run, "key binary, " + ", ".join(f"{c} long" for c in names))
    return counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in names))


def fit_letters(counted: pa.Table) -> Letters:
    """From the rows of ``count_letters``."""
    keys = np.array([int.from_bytes(key, "big") for key in counted.column("key").to_pylist()], np.uint32)
    n = np.column_stack([counted.column(f"n{k}").to_numpy() for k in range(CLUSTERS)]).astype(np.float64).reshape(len(keys), CLUSTERS)
    sums = 1 + n.sum(axis=0) / 2  # a token has two keys
    order = np.argsort(keys)
    return Letters(keys[order], (np.log(n + 0.05) - np.log(sums)).astype(np.float32)[order])


@dataclass
class MaxentModel:
    vocabulary: Vocabulary
    counts: DataFrame  # word, n of every word in the training texts
    total: int
    distinct: int
    unseen: float  # what a cluster's unseen words count as together
    mass: np.ndarray  # [class]: smoothed count of the class, unseen words included
    bias: np.ndarray
    weights: np.ndarray  # [row, class]


def fit(train: DataFrame) -> MaxentModel:
    """From ``doc_id, text`` rows. All of them are counted, clustered and trained on.

    A null text has to be an empty one (``texts``); repeated rows count again; a table without rows gives a model in which
    every word is unseen.
    """
    spark = train.sparkSession
    counts = written(count_tokens(train), "lm-counts")
    common = pa.array([bytes(r["word"]) for r in counts.where(F.octet_length("word") > 0).orderBy(F.col("n").desc(), "word").limit(COMMON).collect()], pa.string())
    clusters = fit_letters(count_letters(train, common, fit_centers(train, common)).toArrow())
    level = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.col("level").desc()).collect()  # some hundred rows
    total, distinct = sum(r["n"] for r in levels), sum(r["words"] for r in levels)
    once = sum(r["n"] for r in levels if r["level"] < 8)
    least, room = 10**6, FREQUENT
    for r in levels:
        room -= r["words"]
        if room < 0 or r["level"] < 8:  # once: the rare class
            break
        least = r["level"]
    found = counts.where((level >= least) | (F.octet_length("word") == 0)).collect()  # at most FREQUENT and one
    found = sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda p: (p[0] != END, -p[1], p[0]))
    if not found or found[0][0] != END:
        found.insert(0, (END, 0))
    vocabulary = Vocabulary([w for w, _ in found], np.array([n for _, n in found], np.float64), clusters)
    held = spark.sparkContext.broadcast(vocabulary)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value.prepare()
        sums = np.zeros(CLASSES)
        for batch in batches:
            found = pc.index_in(batch.column(0).cast(pa.string()), value_set=own.table)
            ids = found.fill_null(0).to_numpy().astype(np.int64)
            rare = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
            ids[rare] = len(own.words) + own.clusters_of(batch.column(0).take(pa.array(rare)))
            sums += np.bincount(own.classes[ids], weights=batch.column(1).to_numpy() + SMOOTHING, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums)], ["class", "mass"])

    unseen = max(SMOOTHING, once / CLUSTERS)
    mass = np.full(CLASSES, SMOOTHING)
    mass[1 + SINGLE + BANDS - 1 :: BANDS] = unseen
    for k, m in counts.select("word", "n").mapInArrow(masses, "class long, mass double").groupBy("class").agg(F.sum("mass")).collect():
        mass[k] += m
    bias = np.log(mass / mass.sum()).astype(np.float32)

    weights = np.zeros((1 << ROW_BITS, CLASSES), np.float32)
    for k in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)) == k)
        weights = _mixed(part, held, spark.sparkContext.broadcast((weights, bias)), weights)
    return MaxentModel(vocabulary, counts, total, distinct, unseen, mass, bias, weights)


def _mixed(part: DataFrame, vocabulary, start, before: np.ndarray) -> np.ndarray:
    """One round: every task trains on its own texts; rows of the results are averaged by how often each was touched."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value.prepare()
        weights, bias = start.value
        weights = weights.copy()
        seen, touched = np.ones(len(weights), np.float32), np.zeros(len(weights))
        for batch in batches:
            for _, texts_here in _blocks(batch.column(1)):
                steps(own, weights, bias, seen, touched, encode(own, texts_here)[0])
        task = TaskContext.get().partitionId()
        for at in range(0, len(weights), BLOCK_ROWS):
            share = touched[at : at + BLOCK_ROWS].astype(np.float32)
            if share.any():
                body = (weights[at : at + BLOCK_ROWS] * share[:, None]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([at // BLOCK_ROWS], pa.int64()), pa.array([share.tobytes()]), pa.array([body.tobytes()])], ["task", "block", "share", "body"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in table.column(c)) for c in ("share", "body")]
        return pa.table({"task": [key[0].as_py()], "block": [key[1].as_py()], **{c: [t.astype("<f4").tobytes()] for c, t in zip(("share", "body"), total, strict=True)}}, schema=table.schema)

    schema = "task long, block long, share binary, body binary"
    sums = part.mapInArrow(train, schema)
    tasks = sums.rdd.getNumPartitions()
    while True:  # at most FAN_IN results meet in one group
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task", "block").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    weights = before.copy()
    for r in sums.collect():  # the model, of fixed size
        share, body = np.frombuffer(r["share"], "<f4"), np.frombuffer(r["body"], "<f4").reshape(-1, CLASSES)
        rows = np.flatnonzero(share > 0)
        weights[r["block"] * BLOCK_ROWS + rows] = body[rows] / share[rows, None]
    return weights


def score(docs: DataFrame, model: MaxentModel) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each whole text; a null text is an empty one.

    Rows are independent: repeated rows are scored again, a null doc_id stays null, an empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.vocabulary, model.weights, model.bias, np.log10(model.mass)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, bias, log_mass = held.value
        own.prepare()
        counted = np.concatenate([own.counts > 0, np.zeros(CLUSTERS, bool)]).astype(np.int64)  # the end may be unseen
        for batch in batches:
            for first, texts_here in _blocks(batch.column(1)):
                ids, sizes, rare, rares = encode(own, texts_here)
                goal, rows = own.places(ids[1:]), features(own, ids)
                value = np.empty(len(goal))
                for at in range(0, len(goal), STEP):
                    part = log_softmax(weights, bias, rows[at : at + STEP])
                    value[at : at + STEP] = part[np.arange(len(part)), own.classes[goal[at : at + STEP]]]
                value = value / np.log(10) - log_mass[own.classes[goal]]
                starts = np.cumsum(sizes) - sizes
                known = counted[goal]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rares)]).astype(np.int32)), rare.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sizes)), pa.array(sizes), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(own.log_counts[goal], starts)), pa.array(np.add.reduceat(value, starts)), lists],
                    ["doc_id", "n_tokens", "known", "log_counts", "inner", "words"],
                )

    scored = texts(docs).mapInArrow(run, "doc_id long, n_tokens long, known long, log_counts double, inner double, words array<binary>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode("words").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))  # a text's own repeats
    looked = rare.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("rare_log"),
        F.sum(F.col("times") * F.when(F.col("n").isNull(), F.lit(float(np.log10(model.unseen / SMOOTHING)))).otherwise(0.0)).alias("rare_more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    logs = F.col("log_counts") + F.coalesce("rare_log", F.lit(0.0))
    every = float(np.log10(model.total + SMOOTHING * (model.distinct + 1)))
    return scored.join(looked, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(every)).alias("base_score"), (logs + F.coalesce("rare_more", F.lit(0.0)) + F.col("inner")).alias("score"),
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """``score`` and ``held_out`` of all documents, learned from those that aren't held out.

    Without training texts every token is unseen. Rows are independent; repeated rows are scored again and, in training
    texts, counted again. An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    rows = texts(docs)
    return score(rows, fit(rows.where(~held_out(10, 0)))).withColumn("held_out", held_out(10, 0))
