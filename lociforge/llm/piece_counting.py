"""Token counts by heap-and-linked-list merging: initial symbols less merges, without any identifier."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, WordCache, texts, use_worker
from .merges import parts, vocabulary

MODEL = "piece_bpe_32k.model"
LIMIT = 4096


@lru_cache(maxsize=2)
def _counted_parts(model: str) -> WordCache:
    return WordCache(vocabulary(model).merge_count, 2 * CACHE_BYTES)


def count_text(text: str, model: str = MODEL) -> int:
    return sum(vocabulary(model).merge_count(p) for p in parts(text))


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each text.

    Null and empty texts have 0 bytes and 0 tokens. Strings that look like special tokens are ordinary text. Rows
    are independent: repeated rows are counted again, extra columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("counting", _counted_parts.cache_clear)
        count = _counted_parts(model).__getitem__
        for batch in batches:
            n = [sum(map(count, parts(x.as_py()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
