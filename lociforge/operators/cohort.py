"""Statistics of a cohort: from variant rows and genotypes to a profile.

Variant rows are ``chrom, pos, id, ref, alt`` with a comma-joined ALT. Each grain is aggregated in one pass with partial
aggregation; what reaches the driver is bounded by bins, classes and contigs.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import FIT_CLASSES, fit_class, indel_length, is_transition
from . import histograms as H

TOOL_VERSION = "1"


def explode_alleles(variants: DataFrame) -> DataFrame:
    """One row per ALT allele, with its place and class."""
    others = [c for c in variants.columns if c != "alt"]
    rows = variants.select(*others, F.posexplode(F.split("alt", ",")).alias("allele_idx", "alt"))
    return rows.withColumn("class", fit_class("ref", "alt"))


def contig_stats(variants: DataFrame) -> DataFrame:
    """``chrom, n, pos_min, pos_max, span, density_per_kb``, by contig name."""
    span = F.greatest(F.max("pos") - F.min("pos"), F.lit(1).cast("bigint"))
    out = variants.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"), span.alias("span"))
    return out.withColumn("density_per_kb", F.col("n").cast("double") / (F.col("span").cast("double") / F.lit(1000.0).cast("double"))).orderBy("chrom")


def class_counts(alleles: DataFrame) -> DataFrame:
    """``class, n`` for all classes, those without alleles too."""
    every = alleles.sparkSession.createDataFrame([(c,) for c in FIT_CLASSES], "class string")
    counts = alleles.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counts), "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_mix(alleles: DataFrame) -> DataFrame:
    """``class, share``."""
    counts = class_counts(alleles)
    return counts.select("class", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # six rows


def class_mix_from_counts(counts: Mapping[str, int]) -> dict[str, float]:
    missing = [c for c in FIT_CLASSES if c not in counts]
    if missing:
        raise ValueError(f"class counts lack {missing}")
    total = sum(counts[c] for c in FIT_CLASSES)
    if total <= 0:
        raise ValueError("no alleles to make a class mix of")
    return {c: counts[c] / total for c in FIT_CLASSES}


#: Base pairs to a stretch; gaps are taken inside stretches, and across their ends by a row for each stretch.
STRETCH = 1 << 20


def gaps(variants: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``chrom, gap``: positive distances of neighbours by position in a contig; equal positions give none.

    Rows are dealt by stretches of a contig, so one contig isn't one task; a stretch's first position looks for the last
    of the stretches before it in a table with a row per stretch.
    """
    part = F.floor(F.col("pos") / stretch)
    rows = variants.select("chrom", "pos", part.alias("stretch"))
    inner = rows.select("chrom", (F.col("pos") - F.lag("pos").over(Window.partitionBy("chrom", "stretch").orderBy("pos"))).alias("gap"))
    ends = rows.groupBy("chrom", "stretch").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    across = ends.select("chrom", (F.col("first") - F.lag("last").over(Window.partitionBy("chrom").orderBy("stretch"))).alias("gap"))
    return inner.unionByName(across).where("gap > 0")


def gap_histogram(variants: DataFrame) -> DataFrame:
    return H.binned(gaps(variants), F.col("gap"), H.gap_edges())


def indel_histogram(alleles: DataFrame) -> DataFrame:
    return H.binned(alleles.where(F.col("class").isin("insertion", "deletion")), indel_length("ref", "alt"), H.INDEL_EDGES)


def multiallelic_rate(variants: DataFrame) -> DataFrame:
    """``rate``: the share of records with several ALTs, 0 without records."""
    n = F.count(F.lit(1))
    return variants.agg(F.when(n > 0, F.count_if(F.instr("alt", ",") > 0) / n).otherwise(0.0).alias("rate"))


def titv(alleles: DataFrame) -> DataFrame:
    """``n_ts, n_tv, titv`` over SNP alleles; titv is null without a transversion."""
    snp = F.col("class") == "snp"
    ts, tv = F.count_if(snp & is_transition("ref", "alt")), F.count_if(snp & ~is_transition("ref", "alt"))
    return alleles.agg(ts.alias("n_ts"), tv.alias("n_tv"), F.when(tv > 0, ts / tv).alias("titv"))


def titv_value(n_snps: int, n_transitions: int) -> float:
    if n_snps <= 0:
        raise ValueError("no SNPs to estimate Ti/Tv from")
    if n_snps == n_transitions:
        raise ValueError("no transversions; Ti/Tv isn't finite")
    return n_transitions / (n_snps - n_transitions)


def allele_counts(genotypes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, allele, ac``: how often each ALT is called; genotypes has a row per record, sample and slot with ``allele``."""
    return genotypes.where("allele > 0").groupBy(*keys, "allele").agg(F.count(F.lit(1)).alias("ac"))


def sfs_histogram(counts: DataFrame, ac: str, n_samples: int) -> DataFrame:
    return H.binned(counts, F.col(ac), H.sfs_edges(n_samples))


def split_allele_counts(acount: DataFrame) -> DataFrame:
    """``ac`` per allele from comma-joined ``ALT_CTS``."""
    return acount.select(F.explode(F.split("ALT_CTS", ",")).alias("ac")).select(F.col("ac").cast("double").alias("ac"))


def missing_rate(missing: DataFrame) -> DataFrame:
    """``rate`` from ``MISSING_CT`` and ``OBS_CT`` columns, 0 without observations."""
    return missing.agg(F.coalesce(F.try_divide(F.sum("MISSING_CT").cast("double"), F.sum("OBS_CT")), F.lit(0.0)).alias("rate"))


def missing_rate_sites(sites: DataFrame, n_samples: int) -> DataFrame:
    """``rate`` from called allele numbers ``an``: what is short of all, in [0, 1]; 0 without sites."""
    rate = F.lit(1.0) - F.avg(F.col("an").cast("double")) / F.lit(float(2 * n_samples))
    return sites.agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)), F.lit(0.0)).alias("rate"))


def phased_rate(calls: DataFrame, chrom: str, start: int, window: int = 1_000_000) -> DataFrame:
    """``rate``: the share of calls ``gt`` with a bar, in a window that both ends belong to; null without calls."""
    inside = calls.where((F.col("chrom") == chrom) & F.col("pos").between(start, start + window))
    return inside.agg(F.try_divide(F.count_if(F.col("gt").contains("|")).cast("double"), F.count(F.lit(1))).alias("rate"))


def sortedness_violations(variants: DataFrame, order: Column | str) -> DataFrame:
    """Rows that go back in position against the row before them, in the input's order, within a contig."""
    before = Window.partitionBy("chrom").orderBy(order)
    return variants.withColumn("previous", F.lag("pos").over(before)).where("pos < previous")


def scan_violations(variants: DataFrame) -> DataFrame:
    """``chrom, pos, previous``: where a table that is read from files goes back in position within a contig.

    Rows are taken in the order of the scan, each scan task by itself, so one contig isn't one task; across tasks a row
    per contig and task tells the first and last positions.
    """
    at = F.monotonically_increasing_id()  # task and place in it
    rows = variants.select("chrom", "pos", at.alias("at")).withColumn("part", F.shiftright("at", 33))
    inner = rows.select("chrom", "pos", F.lag("pos").over(Window.partitionBy("chrom", "part").orderBy("at")).alias("previous"))
    ends = rows.groupBy("chrom", "part").agg(F.min_by("pos", "at").alias("pos"), F.max_by("pos", "at").alias("last"))
    across = ends.select("chrom", "pos", F.lag("last").over(Window.partitionBy("chrom").orderBy("part")).alias("previous"))
    return inner.unionByName(across).where("pos < previous")


def assert_sorted(variants: DataFrame, order: Column | str | None = None) -> None:
    """Raises unless positions ascend within each contig, in the order of a column or else of the scan."""
    found = scan_violations(variants) if order is None else sortedness_violations(variants, order)
    if not found.isEmpty():
        raise ValueError("variants must be sorted by position within each contig")


def record_stats(variants: DataFrame) -> DataFrame:
    """Contig rows with ``multi``, the number of records with several ALTs: the record grain in one aggregate."""
    stats = variants.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"), F.count_if(F.instr("alt", ",") > 0).alias("multi"))
    span = F.greatest(F.col("pos_max") - F.col("pos_min"), F.lit(1).cast("bigint"))
    return stats.withColumn("density_per_kb", F.col("n").cast("double") / (span.cast("double") / F.lit(1000.0).cast("double")))


def allele_stats(alleles: DataFrame) -> DataFrame:
    """One row: counts per class, transitions among SNPs, and indel lengths by bin (``indel_0`` ...): the allele grain in one aggregate."""
    c = F.col("class")
    bins = H.bin_index(indel_length("ref", "alt"), H.INDEL_EDGES)
    indel = c.isin("insertion", "deletion")
    return alleles.agg(
        *[F.count_if(c == k).alias(k) for k in FIT_CLASSES], F.count_if((c == "snp") & is_transition("ref", "alt")).alias("n_ts"),
        *[F.count_if(indel & (bins == k)).alias(f"indel_{k}") for k in range(len(H.INDEL_EDGES) - 1)], F.count_if(indel & bins.isNull()).alias("indel_out"),
    )


def variant_stats(variants: DataFrame) -> dict:
    """What a profile takes from variant rows: contigs, gaps, indel lengths, classes, Ti/Tv, multiallelic rate."""
    contigs = record_stats(variants).orderBy("chrom").collect()
    alleles = allele_stats(explode_alleles(variants)).first()
    n = sum(r["n"] for r in contigs)
    bins = [alleles[f"indel_{k}"] for k in range(len(H.INDEL_EDGES) - 1)]
    return {
        "contigs": [{"id": r["chrom"], "n_variants": r["n"], "density_per_kb": r["density_per_kb"]} for r in contigs],
        "contig_pos_min": {r["chrom"]: r["pos_min"] for r in contigs},
        "gap_dist": H.collected(gap_histogram(variants), H.gap_edges()),
        "indel_length": H.Edges(H.INDEL_EDGES).shares(bins, alleles["indel_out"]),
        "class_counts": {c: alleles[c] for c in FIT_CLASSES},
        "titv": titv_value(alleles["snp"], alleles["n_ts"]),
        "multiallelic_rate": sum(r["multi"] for r in contigs) / n if n else 0.0,
    }


def build_profile(
    *, name: str, source: str, n_samples: int, contigs: list[dict], gap_dist: dict, sfs: dict, indel_length: dict, class_counts: Mapping[str, int], titv: float, multiallelic_rate: float,
    missing_rate: float, phased_rate: float, ploidy: int, supplied: Sequence[str], payload: str = "gt-only", n_variants_source: int | None = None,
) -> dict:
    """A profile: what was measured under ``fitted``, what was chosen under ``dialed``; ``supplied`` names what was given, not measured."""
    return {
        "name": name,
        "provenance": {
            "source": source, "n_samples_source": n_samples, "n_variants_source": sum(c["n_variants"] for c in contigs) if n_variants_source is None else n_variants_source,
            "fitted_on": datetime.date.today().isoformat(), "fit_tool_version": TOOL_VERSION, "supplied": sorted(supplied),
        },
        "fitted": {
            "contigs": contigs, "gap_dist": gap_dist, "sfs": sfs, "variant_classes": class_mix_from_counts(class_counts), "indel_length": indel_length,
            "titv": titv, "multiallelic_rate": multiallelic_rate, "missing_rate": missing_rate, "phased_rate": phased_rate,
        },
        "dialed": {"payload": payload, "ploidy": ploidy},
    }


def _from_variants(variants: DataFrame) -> tuple[dict, dict[str, int]]:
    stats = variant_stats(variants)
    if not stats["contigs"]:
        raise ValueError("the input has no variants in these contigs")
    return stats, stats.pop("contig_pos_min")


def fit_genotyped(records: DataFrame, n_samples: int, name: str, source: str, ploidy: int = 2, payload: str = "gt-only", contigs: Sequence[str] | None = None, phase_window: int = 1_000_000, in_order: bool = False) -> dict:
    """A profile from ``sources.vcf.read_vcf`` records: allele counts, missing and phased rates come from their genotypes.

    ``in_order``: records come straight from files, and must be sorted there.
    """
    if contigs:
        records = records.where(F.col("chrom").isin(*contigs))
    if in_order:
        assert_sorted(records)
    stats, first = _from_variants(records.select("chrom", "pos", "id", "ref", "alt"))
    calls = F.transform("samples", lambda s: F.split_part(s, F.lit(":"), F.lit(1)))
    known = records.select("chrom", "pos", F.size(F.split("alt", ",")).alias("n_alt"), calls.alias("calls"))
    slots = F.flatten(F.transform("calls", lambda g: F.split(g, "[|/]")))
    per_allele = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("n_alt")), lambda k: F.size(F.filter(slots, lambda s: s == k.cast("string"))))).alias("ac"))
    missing = known.select(F.size(F.filter("calls", lambda g: g.contains("."))).alias("MISSING_CT"), F.size("calls").alias("OBS_CT"))
    start = stats["contigs"][0]["id"]
    phased = phased_rate(known.where((F.col("chrom") == start) & F.col("pos").between(first[start], first[start] + phase_window)).select("chrom", "pos", F.explode("calls").alias("gt")), start, first[start], phase_window).first()[0]
    if phased is None:
        raise ValueError("the window that phasing is measured in has no calls")
    return build_profile(
        name=name, source=source, n_samples=n_samples, sfs=H.collected(sfs_histogram(per_allele, "ac", n_samples), H.sfs_edges(n_samples)), missing_rate=missing_rate(missing).first()[0],
        phased_rate=phased, ploidy=ploidy, payload=payload, supplied=["ploidy"], **stats,
    )


def fit_sites(sites: DataFrame, n_samples: int, phased_rate: float, name: str, source: str, ploidy: int = 2, payload: str = "gt-only", in_order: bool = False) -> dict:
    """A profile from sites with ``ac`` and ``an``; the cohort's size and phasing are supplied; ``in_order`` as above."""
    if in_order:
        assert_sorted(sites)
    stats, _ = _from_variants(sites.select("chrom", "pos", "id", "ref", "alt"))
    return build_profile(
        name=name, source=source, n_samples=n_samples, sfs=H.collected(sfs_histogram(sites, "ac", n_samples), H.sfs_edges(n_samples)), missing_rate=missing_rate_sites(sites, n_samples).first()[0],
        phased_rate=phased_rate, ploidy=ploidy, payload=payload, supplied=["n_samples", "phased_rate", "ploidy"], **stats,
    )
