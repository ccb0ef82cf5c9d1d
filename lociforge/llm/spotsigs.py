"""SpotSigs fingerprints: sets of word chains that start at common words.

A spot is a common word (an anchor); its signature is the anchor with the next two content words. A content word whose
hash is divisible by four stands in for an anchor where the eight words before it hold none, so texts without common
words have spots too; what is a spot depends on nearby words only. A fingerprint is the sorted set of 32-bit signature
hashes in Base64. Sets are compared by Jaccard similarity, pruned where their sizes alone rule a threshold out; the
search for similar pairs compares only neighbouring partitions of set length.
"""

from __future__ import annotations

import base64
import json
import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, WordCache, row_number, texts, use_worker, written

CHAIN = 2
#: Words without an anchor after which a content word may stand in for one.
DRY = 8
#: Rows in a range of doc_ids, at most, about.
RANGE_ROWS = 65_536
#: The commonest function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "am auf das dem den der des die ein eine es für im ist mit nicht sich und von zu "
    "au aux ce dans de des du en est et la le les par pas pour que qui sur un une "
    "al con del el las lo los no para por se su y".split()
)
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿„“”’…"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word(token: str) -> int:
    """Hash of a token's word with its last bit set for anchors; 0 for tokens that are all marks."""
    word = token.strip(_MARKS)
    return (xxhash.xxh64_intdigest(word.encode()) >> 2 << 1 or 2) | (word in ANCHORS) if word else 0


_WORDS = WordCache(_word, 2 * CACHE_BYTES)


def _own_worker() -> None:
    use_worker("spots", _WORDS.reset)


def signatures(text: str) -> np.ndarray:
    """The text's distinct signatures, ascending. Without any chain, one signature of all its words (or marks); none if it has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.int64, len(tokens))
    h = h[h != 0]
    place = np.arange(len(h))
    anchor = (h & 1).astype(bool)
    last = np.maximum.accumulate(np.where(anchor, place, -1)) if len(h) else place
    spot = anchor | ((h >> 1) % 4 == 0) & (place - last > DRY)
    content = np.flatnonzero(~anchor)
    before = np.cumsum(~anchor)  # content words up to here, this one included
    at = np.flatnonzero(spot)
    at = at[before[at] + CHAIN <= len(content)] if len(h) else at
    if not len(at):
        whole = xxhash.xxh64_intdigest(h.tobytes() or text.encode()) & 0xFFFFFFFF
        return np.array([whole], np.uint32)
    with np.errstate(over="ignore"):
        out = h[at].astype(np.uint64)
        for k in range(CHAIN):
            out = (out ^ (out >> np.uint64(31))) * _MIX + h[content[before[at] + k]].astype(np.uint64)
        out = (out ^ (out >> np.uint64(29))) * _MIX
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


def fingerprint(signed: np.ndarray) -> str:
    return base64.b64encode(signed.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 where it can't reach ``at_least``. Two empty sets are alike."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < at_least * len(large) or not len(small):
        return 0.0
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    value = both / (len(a) + len(b) - both)
    return value if value >= at_least else 0.0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_signatures, fingerprint`` of each whole text; a null text is an empty one, with an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        for batch in batches:
            signed = [signatures(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in signed], pa.int64()), pa.array([fingerprint(s) for s in signed], pa.string())], ["doc_id", "n_signatures", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, n_signatures long, fingerprint string")


def similar_fingerprints(marked: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs ``left_id, right_id, similarity`` of different fingerprints that are alike, from ``fingerprint_documents``.

    Equal fingerprints count once, by their smallest doc_id. Sets are dealt to partitions of set length whose bounds
    grow by ``1 / at_least``, so partners are in the same or the next partition. Within those, two sets of the wanted
    similarity share one of the ``n - ceil(at_least * n) + 1`` signatures that are rarest over all sets, so only such
    sharers are compared, whole set against whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, base64.b64decode(f)) for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            signed = [np.frombuffer(b, "<u4").astype(np.int64) for _, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tolist() for s in signed], pa.list_(pa.int64()))], ["doc_id", "signed"])

    sets = written(marked.where("n_signatures > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "spot-sets")
    rows = sets.select("doc_id", "fingerprint").mapInArrow(run, "doc_id long, signed array<long>")
    spread = rows.select("doc_id", F.size("signed").alias("n"), F.explode("signed").alias("s"))
    common = spread.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = spread.join(common, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("sorted"))  # a set's own signatures
    unique = F.col("n") - F.size("sorted")  # signatures of no other set, the rarest of all
    take = F.col("n") - F.ceil(F.lit(at_least) * F.col("n") - 1e-9) + 1 - unique
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / at_least)) + 1e-9)
    first = ranked.where(take > 0).select("doc_id", "n", band.alias("band"), F.explode(F.slice("sorted", 1, take.cast("int"))).alias("x")).select("doc_id", "n", "band", F.col("x.s").alias("s"))
    left = first.select(F.col("doc_id").alias("left_id"), F.col("n").alias("left_n"), "s", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("band").alias("own"))
    right = first.select(F.col("doc_id").alias("right_id"), F.col("n").alias("right_n"), "s", "band")
    fits = (F.col("left_n") >= at_least * F.col("right_n")) & (F.col("right_n") >= at_least * F.col("left_n")) & ((F.col("own") < F.col("band")) | (F.col("left_id") < F.col("right_id")))
    pairs = left.join(right, ["band", "s"]).where(fits).select("left_id", "right_id").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(base64.b64decode(x), "<u4") for x in batch.column(k).to_pylist()] for k in (2, 3))
            value = [likeness(x, y, at_least) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], ["left_id", "right_id", "similarity"])

    named = lambda side: sets.select(F.col("doc_id").alias(f"{side}_id"), F.col("fingerprint").alias(f"{side}_print"))
    both = pairs.join(named("left"), "left_id").join(named("right"), "right_id").select("left_id", "right_id", "left_print", "right_print")
    return both.mapInArrow(compare, "left_id long, right_id long, similarity double").where("similarity > 0").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")


def _range_of(bounds: list[int]) -> Column:
    """How many of the ascending bounds are below doc_id, by a coarse step and a fine one."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    fine = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    coarse = F.from_json(F.lit(json.dumps([p[-1] for p in parts[:-1]])), "array<bigint>")
    place = F.size(F.filter(coarse, lambda b: b < F.col("doc_id")))
    return (place * width + F.size(F.filter(F.get(fine, place), lambda b: b < F.col("doc_id")))).cast("int")


def _with_next(docs: DataFrame) -> DataFrame:
    """``bucket, role, doc_id, text``: ranges in descending order of doc_id, nulls last, within partitions, each ending with (role 1) the document that follows its last.

    A doc_id that fills several ranges is cut into as many by a hash of its rows, and so are the rows without one.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("spot", F.pmod(F.xxhash64("text", row_number()), F.lit(1 << 30)))
    known, missing = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    each = max(1, min(RANGE_ROWS, (known + missing) // (3 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1))
    ranges = -(-known // each)
    cuts = rows.agg(F.percentile_approx("doc_id", [(k + 1) / ranges for k in range(ranges - 1)], 10 * ranges)).first()[0] if ranges > 1 else []
    bounds = sorted(set(cuts))
    heavy = {b: n for b, n in Counter(cuts).items() if n > 1}
    # the range of a bound ends with it; what a heavy doc_id has by itself is cut by its spots
    at = _range_of(bounds) + 1
    slices = F.lit(1) if not heavy else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for p in heavy.items() for x in p]), F.col("doc_id")), F.lit(1))
    slices = F.when(F.col("doc_id").isNull(), F.lit(max(1, -(-missing // each)))).otherwise(slices)
    part = F.when(slices > 1, F.floor((F.lit((1 << 30) - 1) - F.col("spot")) * slices / (1 << 30)) + 1).otherwise(0)
    bucket = F.struct(F.when(F.col("doc_id").isNull(), 0).otherwise(at).cast("int").alias("at"), part.cast("int").alias("part"))
    rows = rows.withColumn("bucket", bucket)
    firsts = {tuple(r["bucket"]): (r["first"]["doc_id"], -r["first"]["back"]) for r in rows.select("bucket", F.struct("doc_id", (-F.col("spot")).alias("back")).alias("o")).groupBy("bucket").agg(F.max("o").alias("first")).collect()}
    order = sorted(firsts)
    told = [(*b, *firsts[b], *order[(i + 1) % len(order)]) for i, b in enumerate(order)]  # a range's first row follows the range above it
    ends = spark.createDataFrame(told, "at int, part int, first long, first_spot long, to_at int, to_part int")
    rows = rows.select("bucket.at", "bucket.part", "doc_id", "spot", "text").join(F.broadcast(ends), ["at", "part"])  # a row per range
    own = F.struct("at", "part", F.lit(0).alias("role"))
    copy = F.struct(F.col("to_at").alias("at"), F.col("to_part").alias("part"), F.lit(1).alias("role"))
    opens = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("spot") == F.col("first_spot"))
    rows = rows.select("doc_id", "spot", "text", F.inline(F.when(opens, F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select(F.struct("at", "part").alias("bucket"), "role", "doc_id", "text", "spot")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "role", F.col("doc_id").desc(), "spot").select(F.xxhash64("bucket").alias("bucket"), "role", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` whose last floor(n / 2) code points are replaced by as many first ones of ``following``, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each document.

    The next document has the next smaller doc_id; rows without one come last, and after the last row the first. Of a
    table with one row it is the row itself. Rows that share a doc_id, or have none, follow each other in the order of a
    hash of their text and place in the table, which has to be read in the same parts each time. A null text is an empty
    one. An empty table gives an empty result. One shuffle, of whole rows by range of doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        now = None  # bucket, doc_id, text, signatures: waits for the next
        for batch in batches:
            out: list[tuple] = []
            for bucket, role, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                if role and (now is None or now[0] != bucket):
                    continue  # only the first that follows the range
                text = text.as_py()
                own = signatures(text)
                if now is not None and now[0] == bucket:
                    _, first, before, signed = now
                    changed = edited(before, text)
                    other = signatures(changed)
                    out.append((first, len(before), sha256(changed.encode()).hexdigest(), fingerprint(signed), fingerprint(other), likeness(signed, other), likeness(signed, own)))
                now = None if role else (bucket, doc_id, text, own)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
