"""The operators' registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .exact_dedup import exact_duplicates
from .language_id import identify_languages
from .maxent_lm import score_held_out
from .near_dedup import near_duplicates
from .packing import pack
from .piece_counting import count_tokens
from .piece_encoding import encode_digests
from .quality import classify_quality
from .sharding import shard_documents
from .spotsigs import fingerprint_edits


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_encoding": lambda spark, sf_dir: encode_digests(documents(spark, sf_dir)),
    "op2_sharding": lambda spark, sf_dir: shard_documents(documents(spark, sf_dir)),
    "op3_piece_counting": lambda spark, sf_dir: count_tokens(documents(spark, sf_dir)),
    "op4_exact_dedup": lambda spark, sf_dir: exact_duplicates(documents(spark, sf_dir)),
    "op5_near_dedup": lambda spark, sf_dir: near_duplicates(documents(spark, sf_dir), words=4),
    "op6_packing": lambda spark, sf_dir: pack(documents(spark, sf_dir)),
    "op7_language_id": lambda spark, sf_dir: identify_languages(documents(spark, sf_dir)),
    "op8_spotsigs": lambda spark, sf_dir: fingerprint_edits(documents(spark, sf_dir)),
    "op9_quality": lambda spark, sf_dir: classify_quality(documents(spark, sf_dir), _labels(spark, sf_dir)),
    "op10_maxent_lm": lambda spark, sf_dir: score_held_out(documents(spark, sf_dir)),
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
          from documents window same as (partition by coalesce(text, ''))""",
    "op5_near_dedup": r"""
        with recursive words as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), sets as (
          select doc_id, list_distinct(case when len(w) = 0 then cast([] as varchar[]) when len(w) < 4 then [array_to_string(w, ' ')]
                                            else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words
        ), flat as (
          select doc_id, len(s) as n, unnest(s) as g from sets
        ), links as (
          select a.doc_id as a, b.doc_id as b from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id
           group by 1, 2, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach as (
          select doc_id as a, doc_id as b from sets
           union select r.a, l.b from reach r join links l on r.b = l.a
        )
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.least as component_id, s.doc_id = r.least as kept
          from sets s join (select a, min(b) as least from reach group by a) r on r.a = s.doc_id""",
}
