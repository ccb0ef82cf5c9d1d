"""Exact deduplication through an extendible-hash index kept in shared files. DataFrame operations only.

1. The directory comes first. It starts with one bucket and doubles while a bucket is overfull; only overfull buckets
   split. It is made from counts of distinct keys per key prefix, at most ``2 ** max_depth`` numbers whatever the input.
   A bucket that is overfull at the last depth has pages, by the rest of its keys.
2. The directory gives each text its bucket and page. Texts are put into their bucket after a partial pass within each
   scan task, so of a text that a third of all rows hold, each task sends one row. Under one key, texts are compared
   whole, byte by byte: equal ones become one entry, different ones are chained, each at its place.
3. Entries are dealt to owner tasks by bucket and page, each a range of keys, and written to the shared folder.
4. Documents look their entry up through the directory: in their bucket and page, by key, and along the chain by a
   second hash and the length. Where two entries of a chain share those, too, their SHA-256 tells them apart.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, free_name, row_number, texts, written

#: Entries a bucket holds before it splits.
CAPACITY = 8192
MAX_DEPTH = 16
_DIRECTORY = "array<struct<bucket:int,pages:int,first:bigint,last:bigint>>"


@dataclass
class HashIndex:
    entries: DataFrame  # bucket, page, key, chain, check, n_bytes, twins, text_sha256, keep (doc_id, row), group_size
    directory: list[tuple[int, int, int]]  # (key prefix, local depth, pages) of each bucket
    depth: int


def split_buckets(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[list[tuple[int, int]], int]:
    """Buckets and global depth for entry counts per ``max_depth``-bit prefix: doubles while a bucket is overfull."""
    buckets: dict[tuple[int, int], dict[int, int]] = {(0, 0): counts}
    done: list[tuple[int, int]] = []
    depth = 0
    while buckets:
        halves: dict[tuple[int, int], dict[int, int]] = {}
        for (prefix, local), cells in buckets.items():
            if local == max_depth or sum(cells.values()) <= capacity:
                done.append((prefix, local))
                continue
            shift = max_depth - local - 1
            for bit in (0, 1):
                halves[prefix * 2 + bit, local + 1] = {c: n for c, n in cells.items() if c >> shift & 1 == bit}
        buckets = halves
        depth += bool(halves)
    return sorted(done, key=lambda b: b[0] << (max_depth - b[1])), depth


def _keyed(docs: DataFrame) -> DataFrame:
    rows = texts(docs).withColumn("row", row_number())
    return rows.select("doc_id", "row", "text", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("check"), F.octet_length("text").cast("long").alias("n_bytes"))


def _placed(rows: DataFrame, directory: list[tuple[int, int, int]], depth: int) -> DataFrame:
    """``rows`` with the bucket and page that the directory has for their key."""
    told = [{"bucket": i, "pages": n, "first": p << (depth - d), "last": (p + 1 << (depth - d)) - 1} for i, (p, d, n) in enumerate(directory)]
    spark = rows.sparkSession
    cells = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(told)), _DIRECTORY))).select("bucket", "pages", F.explode(F.sequence("first", "last")).alias("prefix"))
    prefix = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    found = rows.withColumn("prefix", prefix).join(F.broadcast(cells), "prefix")  # at most 2 ** max_depth rows
    return found.withColumn("page", F.pmod("key", F.col("pages")).cast("int")).drop("prefix", "pages")


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> HashIndex:
    """An entry for each distinct text; ``keep`` is the largest doc_id that has it, and of rows with that doc_id the last."""
    rows = _keyed(docs)
    cell = F.shiftrightunsigned("key", 64 - max_depth) if max_depth else F.lit(0).cast("long")
    counts = {r[0]: r[1] for r in rows.select("key").distinct().groupBy(cell.alias("cell")).count().collect()}
    buckets, depth = split_buckets(counts, capacity, max_depth)
    # at the last depth a bucket is one cell, and may need pages
    directory = [(p, d, max(1, -(-counts.get(p, 0) // capacity)) if d == max_depth else 1) for p, d in buckets]
    slots = (
        _placed(rows, directory, depth)
        .groupBy("bucket", "page", "key", "check", "n_bytes", "text")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "page", "key", "check", "n_bytes", F.sha2("text", 256).alias("text_sha256"), "keep", "group_size")
    )
    under = Window.partitionBy("bucket", "page", "key")
    entries = slots.repartition("bucket", "page").select(
        "bucket", "page", "key", F.row_number().over(under.orderBy("check", "n_bytes", "text_sha256")).alias("chain"), "check", "n_bytes",
        F.count(F.lit(1)).over(Window.partitionBy("bucket", "page", "key", "check", "n_bytes")).alias("twins"), "text_sha256", "keep", "group_size",
    )
    return HashIndex(written(entries.sortWithinPartitions("bucket", "page", "key", "chain"), "dedup-index"), directory, depth)


def look_up(docs: DataFrame, index: HashIndex) -> DataFrame:
    """``doc_id, row, keep, group_size, text_sha256`` of each row of ``docs`` whose text the index has, through its directory."""
    on = ["bucket", "page", "key", "check", "n_bytes"]
    rows = _placed(_keyed(docs), index.directory, index.depth)
    found = index.entries.select(*on, "keep", "group_size", "text_sha256", "twins")
    if not found.where("twins > 1").isEmpty():  # two texts of a chain share both hashes and their length
        on = [*on, "text_sha256"]
        rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    return rows.drop("text").join(found, on).select("doc_id", "row", "keep", "group_size", "text_sha256")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each row; of equal texts the largest doc_id stays.

    A null text is an empty one, and all empty texts are equal. Rows that repeat both doc_id and text are one
    document: each is reported, with the same decision. A null doc_id is smaller than any other. An empty table gives an
    empty result. Columns other than doc_id and text are not read.
    """
    found = look_up(docs, build_index(docs, capacity, max_depth))
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: that of the largest doc_id, and of rows that repeat it the last; all columns stay.

    Rows are told apart by their place in the table, so a doc_id with several texts keeps one row for each, unless
    another has that text; rows without a doc_id stay where no other row has their text. ``docs`` has to be a table that
    is read in the same parts each time. An empty table stays empty.
    """
    name = free_name(docs, "_row")
    keep = written(build_index(docs).entries.select(F.col("keep.row").alias(name)), "dedup-kept")
    if keep.count() <= BROADCAST_IDS:
        keep = F.broadcast(keep)
    return docs.withColumn(name, row_number()).join(keep, name, "left_semi").drop(name)
