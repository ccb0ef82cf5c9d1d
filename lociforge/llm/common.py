"""What the operators share: input columns, shared storage and bounded per-worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, about, that a Python worker keeps per cache of words; frequent words arrive early and stay.
CACHE_BYTES = 64 << 20
#: Ids up to which a set of them is broadcast (8 bytes each); beyond, rows are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Rows and bytes that Python gets at a time, at most, where an operator's step is written to the shared folder.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a null text as the empty one; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_number() -> Column:
    """A number of each row of a table, the same whenever the table is scanned in the same parts."""
    return F.monotonically_increasing_id()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a single machine whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lociforge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_batches_lock = threading.Lock()
_batches: dict[SparkSession, tuple[int, dict[str, str]]] = {}  # uses now, and the session's own values


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The session's batches for Python are small inside; of uses at the same time the first sets and the last restores."""
    with _batches_lock:
        uses, own = _batches.get(spark, (0, {}))
        if not uses:
            own = {k: spark.conf.get(k) for k in BATCH}
            for k, most in BATCH.items():
                now = int(re.sub(r"\D*$", "", own[k]))
                spark.conf.set(k, str(min(now, most) if now > 0 else most))
        _batches[spark] = uses + 1, own
    try:
        yield
    finally:
        with _batches_lock:
            uses, own = _batches.pop(spark)
            if uses > 1:
                _batches[spark] = uses - 1, own
            else:
                for k, v in own.items():
                    spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once no result that is still to be computed reads them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_in_use: dict[str, Callable[[], object]] = {}


def release() -> None:
    """Gives memory that is no longer in use back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's
        ctypes.CDLL(None).malloc_trim(0)


def use_worker(name: str, drop: Callable[[], object]) -> None:
    """Says whose caches this Python worker holds from now on; another operator's are dropped, so they never add up."""
    others = [n for n in _in_use if n != name]
    for other in others:
        _in_use.pop(other)()
    _in_use[name] = drop
    if others:
        release()


def entry_bytes(word, value) -> int:
    """About what a dict's entry takes, its key and value included."""
    size = 100 + getsizeof(word) + getsizeof(value)
    return size + sum(map(getsizeof, value)) if value.__class__ is tuple else size


class WordCache(dict):
    """word -> ``make(word)``, computed once while there is room (in bytes, about) and each time after that."""

    def __init__(self, make, room: int = CACHE_BYTES):
        super().__init__()
        self.make, self.room, self.size = make, room, room

    def reset(self) -> None:
        self.clear()
        self.room = self.size

    def __missing__(self, word):
        value = self.make(word)
        if self.room > 0 and (size := entry_bytes(word, value)) <= self.room:
            self.room -= size
            self[word] = value
        return value
