"""Text sources: variant tables, VCF, and count reports. Schemas are given, never inferred, so contig "22" stays text.

Positions and counts that are no numbers read as null. Everything is a plain text scan with columns cut from the line, so a query that doesn't ask for the samples doesn't split
them. Compressed input works as far as the reader's codecs go (gzip and BGZF members, zstd).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path if isinstance(path, str) else list(path))


def _field(k: int) -> Column:
    return F.split_part(F.col("value"), F.lit("\t"), F.lit(k))


def read_variants(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``chrom, pos, id, ref, alt`` of a tab-separated variant table; the ``#CHROM`` line names the columns."""
    header = _lines(spark, path).where(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError(f"no #CHROM line in {path}")
    at = {name: k for k, name in enumerate(header[0].split("\t"), 1)}
    get = lambda name: _field(at[name])
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    return rows.select(get("#CHROM").alias("chrom"), get("POS").try_cast("bigint").alias("pos"), get("ID").alias("id"), get("REF").alias("ref"), get("ALT").alias("alt"))


def _head(spark: SparkSession, path: str, mark: str, room: int = 10_000) -> list[str]:
    """The lines that a table starts with as long as they start with ``mark``; only its head is read."""
    while True:
        head = [r[0] for r in _lines(spark, path).take(room)]
        n = next((k for k, line in enumerate(head) if not line.startswith(mark)), len(head))
        if n < room:
            return head[:n]
        room *= 4  # the header goes on


def count_meta_lines(spark: SparkSession, path: str) -> int:
    """How many ``##`` lines a table starts with."""
    return len(_head(spark, path, "##"))


def info_value(info: Column | str, key: str) -> Column:
    """The text of an INFO key, null where it is missing or a flag."""
    c = F.col(info) if isinstance(info, str) else info
    return F.nullif(F.regexp_extract(c, rf"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def read_vcf(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``chrom, pos, id, ref, alt, qual, filter, info, format, samples`` of VCF lines; samples are their columns' texts."""
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
    fixed = [_field(k).try_cast("bigint").alias(n) if n == "pos" else (F.nullif(_field(k), F.lit("")) if n == "format" else _field(k)).alias(n) for k, n in enumerate(names, 1)]
    cells = F.split("value", "\t")
    return rows.select(*fixed, F.when(F.size(cells) > 9, F.slice(cells, 10, F.size(cells))).otherwise(F.array().cast("array<string>")).alias("samples"))


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """The lines at the head of a file that start with ``#``, in order."""
    return _head(spark, path, "#")


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    return vcf_header(spark, path)[-1].split("\t")[9:]


def read_sites(spark: SparkSession, path: str | Sequence[str], contigs: Sequence[str] | None = None) -> DataFrame:
    """``chrom, pos, id, ref, alt, ac, an`` of records that passed all filters, with ``.`` for every id."""
    rows = read_vcf(spark, path).where("filter = 'PASS'")
    if contigs:
        rows = rows.where(F.col("chrom").isin(*contigs))
    return rows.select("chrom", "pos", F.lit(".").alias("id"), "ref", "alt", info_value("info", "AC").try_cast("bigint").alias("ac"), info_value("info", "AN").try_cast("bigint").alias("an"))


def explode_genotypes(records: DataFrame, keys: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """``keys, sample_idx, gt`` of each sample's first FORMAT value."""
    return records.select(*keys, F.posexplode("samples").alias("sample_idx", "cell")).select(*keys, "sample_idx", F.split_part("cell", F.lit(":"), F.lit(1)).alias("gt"))


def read_allele_counts(spark: SparkSession, path: str) -> DataFrame:
    """A count report ``#CHROM ID REF ALT ALT_CTS OBS_CT``; the counts stay comma-joined."""
    schema = "chrom string, id string, ref string, alt string, ALT_CTS string, OBS_CT bigint"
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True)


def read_missing_counts(spark: SparkSession, path: str) -> DataFrame:
    """A missingness report with ``MISSING_CT`` and ``OBS_CT`` columns, wherever they stand."""
    head = _lines(spark, path).first()[0].split("\t")
    schema = ", ".join(f"`{n}` {'bigint' if n in ('MISSING_CT', 'OBS_CT') else 'string'}" for n in head)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True).select("MISSING_CT", "OBS_CT")


def count_samples(spark: SparkSession, path: str) -> int:
    """Lines of a sample table that are neither comments nor blank."""
    return _lines(spark, path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).count()
