"""MinHash near-deduplication with tensored banding.

A text is its set of word shingles. Two collections of ``TABLES`` short minhash bands are computed, and each band of
the first with each of the second makes a table key: ``TABLES ** 2`` tables from ``2 * TABLES * ROWS`` minhashes, where
plain banding would take ``2 * ROWS`` for each table. Two sets of similarity 0.8 miss each other with a probability of
less than 0.0008.

Equal sets count once. Bands that no other set has make no keys. In a table's bucket every set is held against the
bucket's center, its smallest id (a star, not all pairs). What the star leaves apart is searched through differences: with
``d(x)`` the symmetric difference of x and the center, two sets x, y of sizes n, m are linked if and only if
``|d(x)| + |d(y)| - 2 |d(x) & d(y)| <= c (n + m)`` with ``c = (1 - s) / (1 + s)``. A set that isn't linked with the center
has a large difference, so a link with it needs a large common part of the differences, and prefixes of the two
differences (in an order from rare to common, as counted over the center's whole family) share an element (``SHOWN`` of
them), after which enough of both is left. Only such pairs are compared; members of a family that vary independently share none but the common elements, which come last. A family
finds all links between its members, so two sets with the same largest family meet there and in no other. Every link is
confirmed on the full sets of both texts, as integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WordCache, discard, free_name, row_number, texts, use_worker, written
from .components import components

WORDS = 5
PERCENT = 80
TABLES = 12
ROWS = 3
#: Common elements that prefixes show, where that many are needed.
SHOWN = 1

_RNG = np.random.Generator(np.random.Philox(key=11))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FUNCTIONS = (_RNG.integers(1, 2**63, 2 * TABLES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_HASH = WordCache(xxhash.xxh64_intdigest, 40 << 20)


def _own_worker() -> None:
    use_worker("near", _HASH.reset)



def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of ``words`` words; of all words if they are fewer; none without words.

    Words are what white space of ASCII separates, with A-Z in lower case.
    """
    own = text.encode().lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, own), np.uint64, n)
    size = min(words, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            out = (out ^ (out >> np.uint64(32))) * _PLACE[k] + h[k : n - size + 1 + k]
        out = (out ^ (out >> np.uint64(29))) * _PLACE[-1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def bands(signed: np.ndarray) -> np.ndarray:
    """Hashes of the ``2 * TABLES`` bands of a set; the first half is the first collection."""
    least = np.full(len(_FUNCTIONS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(signed), 4096):
            np.minimum(least, (signed[None, at : at + 4096] * _FUNCTIONS).min(axis=1), out=least)
        rows = least.reshape(2 * TABLES, ROWS)
        out = np.arange(2 * TABLES, dtype=np.uint64)
        for k in range(ROWS):
            out = (out ^ (out >> np.uint64(31))) * _PLACE[40 + k] + rows[:, k]
        return (out ^ (out >> np.uint64(30))) * _PLACE[50]


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, set_high, set_low, bands``: size, 128-bit hash and bands of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        for batch in batches:
            n, high, low, found = [], [], [], []
            for x in batch.column(1):
                s = shingles(x.as_py(), words)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                high.append((d >> 64) - (1 << 63))
                low.append((d & (1 << 64) - 1) - (1 << 63))
                found.append(bands(s).astype(np.int64) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists], ["doc_id", "n_shingles", "set_high", "set_low", "bands"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_high long, set_low long, bands array<long>")


def _keys(sets: DataFrame) -> DataFrame:
    """``id, n, key``: of each set, the tensored pairs of those bands that some other set has."""
    one = sets.select("id", "n", F.posexplode("bands").alias("place", "band"))
    shared = one.groupBy("band").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("band")
    first = F.sort_array(F.collect_list(F.when(F.col("place") < TABLES, F.col("band"))))
    second = F.sort_array(F.collect_list(F.when(F.col("place") >= TABLES, F.col("band"))))
    kept = one.join(shared, "band").groupBy("id", "n").agg(first.alias("first"), second.alias("second"))  # at most 2 * TABLES rows a set
    kept = kept.where((F.size("first") > 0) & (F.size("second") > 0))
    return kept.select("id", "n", "second", F.explode("first").alias("a")).select("id", "n", "a", F.explode("second").alias("b")).select("id", "n", F.xxhash64("a", "b").alias("key"))


def confirm(pairs: DataFrame, bodies: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets have ``100 * intersection >= percent * union``; bodies are ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        last, left = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, left = a, shingles(x.as_py(), words)
                right = shingles(y.as_py(), words)
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                both = int((left[at] == right).sum()) if len(left) else 0
                keep.append(100 * both >= percent * (len(left) + len(right) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both_texts(pairs, bodies).mapInArrow(run, "a long, b long")


def _both_texts(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    joined = pairs.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b")


def compare_stars(pairs: DataFrame, bodies: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``a, b, a_n, n, linked, d``: pairs of a center and another set, with their sizes and symmetric difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        last, left = None, None
        for batch in batches:
            sizes, linked, out = [], [], []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, left = a, shingles(x.as_py(), words)
                right = shingles(y.as_py(), words)
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                hit = left[at] == right
                gone = np.ones(len(left), bool)
                gone[at[hit]] = False
                both = int(hit.sum())
                sizes.append((len(left), len(right)))
                linked.append(100 * both >= percent * (len(left) + len(right) - both))
                out.append(np.concatenate([right[~hit], left[gone]]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1)), pa.array(linked, pa.bool_()), _lists(out)], ["a", "b", "a_n", "n", "linked", "d"])

    return _both_texts(pairs, bodies).mapInArrow(run, "a long, b long, a_n long, n long, linked boolean, d array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


#: Bounds of classes of a difference's size, as shares of the largest one that a linked set may have; above 1, sets aren't linked.
CLASSES = (0, 0.25, 0.5, 0.75, 1, 1.25, 1.5, 2, 3, math.inf)
UNLINKED = 4


def prefix_lengths(size: int, n: int, center: int, linked: bool, percent: int, shown: int = SHOWN) -> tuple[int, list[tuple[int, int, int]]]:
    """The class of a set's difference, and, per class that it could find a link in, how long its prefix must be and how many common elements are in it.

    Of ``least`` common elements of two differences the first ``k`` are among the first ``size - least + k`` of each. Of
    two linked sets nothing is asked. Another set has from 0.8 to 1 / 0.8 times this one's size n, and of a class that
    starts at share f a difference of at least f c (its size + the center's).
    """
    c = (100 - percent) / (100 + percent)
    low, high = n * percent / 100, n * 100 / percent
    share = size / (c * (n + center))
    own = next(k for k in range(len(CLASSES) - 1) if share < CLASSES[k + 1])
    own = min(own, UNLINKED - 1) if linked else max(own, UNLINKED)
    out = []
    for k, (f, g) in enumerate(zip(CLASSES, CLASSES[1:], strict=False)):
        if (linked and k < UNLINKED) or size - g * c * (high + center) > c * (n + high) or f * c * (low + center) - size > c * (n + high):
            continue  # the sizes of the differences alone rule a link out
        least = (size + f * c * center - c * n + (f - 1) * c * (low if f > 1 else high)) / 2
        least = max(1, math.ceil(least - 1e-9))
        if least <= size:
            out.append((k, size - least + min(shown, least), min(shown, least)))
    return own, out


def prefixes(family: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b, n, part, main, size, apart, own, other, shown, place, e``: a row per element of each prefix with its place in the difference, from ``compare_stars`` rows with their components.

    The order of elements is by how many of the family's differences hold them, counted over all members, then by value.
    Elements that no two members of different components share, one of them apart from the center, come first of all:
    they have places, but no rows, as no link between components shows in them.
    """
    elements = family.select("a", "b", "part", "apart", F.explode("d").alias("e"))
    counted = elements.groupBy("a", "e").agg(F.count(F.lit(1)).alias("held"), F.min("part").alias("least"), F.max("part").alias("most"), F.max("apart").alias("apart"))
    shared = counted.where("least <> most and apart").select("a", "e", "held")
    of_member = elements.select("a", "b", "e").join(shared, ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("held", "e")))["e"].alias("es"))  # at most a difference each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        for batch in batches:
            at, classes, out = [], [], []
            rows = zip(*(batch.column(k).to_pylist() for k in (2, 5, 7, 8)), batch.column(9), strict=True)
            for i, (n, size, center, linked, es) in enumerate(rows):
                es = es.values.to_numpy()
                first = size - len(es)
                own, found = prefix_lengths(size, n, center, linked, percent)
                for other, length, shown in found:
                    if length > first:
                        at.append(i)
                        classes.append((own, other, shown, first))
                        out.append(es[: length - first])
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(7)), *(pa.array([c[k] for c in classes], pa.int32()) for k in range(4)), _lists(out)], ["a", "b", "n", "part", "main", "size", "apart", "own", "other", "shown", "first", "es"])

    rows = family.select("a", "b", "n", "part", "main", F.size("d").cast("long").alias("size"), "apart", "a_n", "linked").join(of_member, ["a", "b"])
    made = rows.mapInArrow(run, "a long, b long, n long, part long, main long, size long, apart boolean, own int, other int, shown int, first int, es array<long>")
    return made.select("a", "b", "n", "part", "main", "size", "apart", "own", "other", "shown", "first", F.posexplode("es").alias("next", "e")).select(
        "a", "b", "n", "part", "main", "size", "apart", "own", "other", "shown", (F.col("first") + F.col("next")).alias("place"), "e"
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; component_id is the smallest doc_id reachable over links.

    Null, empty and blank texts have an empty set, no links and a component of their own. Rows that share a doc_id are
    one node; a row without one is linked with equal sets only. Texts with equal sets are linked. An empty table gives an empty result; columns other than doc_id and
    text are not read.
    """
    sketches = written(sketch(docs, words), "near-sketches")
    some = sketches.where("n_shingles > 0")
    classes = written(some.groupBy("set_high", "set_low").agg(F.min("doc_id").alias("id")), "near-classes")
    own = some.join(classes.select(F.col("id").alias("doc_id"), "set_high", "set_low"), ["doc_id", "set_high", "set_low"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands").dropDuplicates(["id"])
    keys = _keys(own)
    least = keys.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    keys = written(keys.join(least.select("key", "center"), "key"), "near-keys")

    candidates = keys.select("id").distinct()
    if (few := candidates.count()) <= BROADCAST_IDS:
        candidates = F.broadcast(candidates)
    bodies = texts(docs).withColumnRenamed("doc_id", "id").join(candidates, "id") if few else texts(docs).withColumnRenamed("doc_id", "id").limit(0)
    bodies = written(bodies.dropDuplicates(["id"]), "near-bodies")

    star = keys.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    star = written(compare_stars(star, bodies, words, percent), "near-star")
    links = written(star.where("linked").select("a", "b"), "near-links")

    # what the stars leave in other components than their center's
    labels = written(components(links), "near-labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    told = star.join(of("b"), "b", "left").join(of("a"), "a", "left").select("a", "b", "a_n", "n", "linked", "d", F.coalesce("b_part", "b").alias("part"), F.coalesce("a_part", "a").alias("center_part"))
    members = star.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    largest = star.select("a", "b").join(members, "a").groupBy("b").agg(F.max(F.struct("members", (-F.col("a")).alias("minus"))).alias("most")).select("b", (-F.col("most")["minus"]).alias("main"))
    told = written(told.withColumn("apart", F.col("part") != F.col("center_part")).join(largest, "b"), "near-told")
    family = told.join(told.where("apart").select("a").distinct(), "a", "left_semi")
    marks = written(prefixes(family, percent), "near-prefixes")
    name = lambda c, own, other: ["a", "e", F.col("own").alias(own), F.col("other").alias(other), F.col("b").alias(c), F.col("n").alias(f"{c}_n"), F.col("part").alias(f"{c}_part"), F.col("main").alias(f"{c}_main"), F.col("shown").alias(f"{c}_shown"), F.col("size").alias(f"{c}_size"), F.col("place").alias(f"{c}_place")]
    x, y = marks.where("apart").select(*name("x", "x_class", "y_class")), marks.where(F.col("other") >= UNLINKED).select(*name("y", "y_class", "x_class"))
    fits = (F.col("x_n") * 100 >= F.col("y_n") * percent) & (F.col("y_n") * 100 >= F.col("x_n") * percent)
    # at the last of the common elements that prefixes show, what is left of both differences has to reach their overlap
    left = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place")) - 1 + SHOWN
    reaches = (100 + percent) * (2 * left - F.col("x_size") - F.col("y_size")) + (100 - percent) * (F.col("x_n") + F.col("y_n")) >= 0
    met = x.join(y, ["a", "e", "x_class", "y_class"]).where((F.col("x_part") != F.col("y_part")) & fits & reaches & ((F.col("x_main") != F.col("y_main")) | (F.col("a") == F.col("x_main"))))
    # a pair may come from either side, x and y exchanged; each way shows its common elements
    found = met.groupBy("a", "x", "y").agg(F.count(F.lit(1)).alias("common"), F.min(F.least("x_shown", "y_shown")).alias("shown")).where("common >= shown")
    cross = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    cross = written(cross.join(star.select("a", "b"), ["a", "b"], "left_anti"), "near-cross")
    more = confirm(cross, bodies, words, percent)

    # a pair's two components are as good as its two sets
    part = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    bridges = written(more.join(part, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "near-bridges")
    if not bridges.isEmpty():
        joined = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        alone = joined.join(labels, joined["component"] == labels["node"], "left_anti").select(F.col("component").alias("node"), F.col("wider").alias("component"))
        labels = labels.join(joined, "component", "left").select("node", F.coalesce("wider", "component").alias("component")).unionByName(alone)

    named = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("set_high", "set_low", F.coalesce("component", "id").alias("component_id"))
    discard(keys, bodies, star, links, told, marks, cross)
    out = sketches.join(named, ["set_high", "set_low"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns as they are.

    The row with the smallest doc_id stays. Where doc_ids repeat or are missing, rows are told apart by their place in the
    table instead, and the first row of each group stays; ``docs`` has to be a table that is read in the same parts each
    time. Null, empty and blank texts are no duplicates of anything. An empty table stays empty.
    """
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null")
    name = free_name(docs, "_row")
    numbered = docs.withColumn(name, F.col("doc_id").cast("long") if ids.isEmpty() else row_number())
    found = near_duplicates(numbered.select(F.col(name).alias("doc_id"), "text"), words, percent)
    keep = written(found.where("kept").select(F.col("doc_id").alias(name)), "near-kept")
    if keep.count() <= BROADCAST_IDS:
        keep = F.broadcast(keep)
    return numbered.join(keep, name, "left_semi").select(*docs.columns)
