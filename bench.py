"""Times headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from lociforge.operators import cohort
from lociforge.operators import histograms as H
from lociforge.operators.generate import CohortSpec
from lociforge.operators.sizing import Size
from lociforge.plans import queries
from lociforge.plans.views import variants
from lociforge.sources.profiles import Profile
from lociforge.sources.writers import write_cohort

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("contig_stats", "class_counts", "gap_histogram", "indel_length_histogram", "titv", "sfs_histogram", "missing_rate", "phased_rate", "profile_scalars", "genotype_render", "field_validation", "sv_truth", "render_record", "exact_ac_placement", "summary_totals")


def fit(spark: SparkSession) -> None:
    """All statistics of a profile that come from variant rows."""
    stats = cohort.variant_stats(variants(spark, SF_DIR))
    H.Edges(stats["gap_dist"]["edges"])


def bulk(spark: SparkSession) -> None:
    """80 million genotype cells: 2000 samples, 20,000 records, two contigs, BCF with index."""
    with tempfile.TemporaryDirectory() as folder:
        write_cohort(spark, CohortSpec(Profile.builtin("germline-1kgp"), 2000, ("chr1", "chr2"), Size.records(20_000), seed=42), Path(folder) / "bench.bcf")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    runs = {n: (lambda n=n: queries.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()) for n in NAMES}
    runs |= {"fit_variant_stats": lambda: fit(spark), "bulk_bcf_80m_cells": lambda: bulk(spark)}
    for f in runs.values():  # compile and load once
        f()
    took = {}
    for name, f in runs.items():
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            f()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1],
        "fit_rows_per_sec": round(rows / took["fit_variant_stats"]), "generated_cells_per_sec": round(80e6 / took["bulk_bcf_80m_cells"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
