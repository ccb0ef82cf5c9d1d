"""Commands: ``bulk`` generates a cohort, ``fit`` makes a profile, ``validate-profile`` checks one."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from .operators import cohort
from .operators.generate import FORMATS, CohortSpec
from .operators.sizing import Size, SpecError, parse_records_for, parse_size
from .sources import vcf
from .sources.profiles import PAYLOADS, Profile, ProfileError, write_profile
from .sources.writers import write_cohort


def _threads(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be >= 1")
    return int(text)


def _session(threads: int | None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("lociforge")
    if not SparkSession.getActiveSession():
        builder = builder.master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lociforge", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    bulk = commands.add_parser("bulk", help="generate a cohort with index and summary")
    bulk.add_argument("--profile", default="germline-1kgp", help="a built-in profile's name, or a JSON file")
    bulk.add_argument("--samples", type=int, default=1)
    bulk.add_argument("--contigs", help="names, comma-separated, in output order")
    size = bulk.add_mutually_exclusive_group()
    size.add_argument("--target-size", help="stop at this compressed size, as 100MB")
    size.add_argument("--records", type=int, help="in all, split as the profile's contigs are")
    size.add_argument("--records-per-contig", type=int)
    size.add_argument("--records-for", action="append", help="NAME=COUNT, comma-separated, repeatable")
    bulk.add_argument("--payload", choices=PAYLOADS)
    bulk.add_argument("--format", choices=FORMATS, default="bcf")
    bulk.add_argument("--seed", type=int, default=0)
    bulk.add_argument("--compression-level", type=int, default=6)
    bulk.add_argument("--threads", type=_threads)
    bulk.add_argument("-o", "--output", required=True, type=Path)
    check = commands.add_parser("validate-profile", help="check a profile JSON")
    check.add_argument("path", type=Path)
    fit = commands.add_parser("fit", help="make a profile from a cohort")
    source = fit.add_mutually_exclusive_group(required=True)
    source.add_argument("--vcf", help="a genotyped VCF")
    source.add_argument("--sites-vcf", help="a VCF with AC and AN in INFO and no genotypes")
    fit.add_argument("--n-samples", type=int, help="the cohort's size, for --sites-vcf")
    fit.add_argument("--phased-rate", type=float, help="for --sites-vcf")
    fit.add_argument("--contigs", nargs="*")
    fit.add_argument("--phase-sample-mb", type=float, default=1.0)
    fit.add_argument("--ploidy", type=int, default=2)
    fit.add_argument("--payload", choices=PAYLOADS, default="gt-only")
    fit.add_argument("--name", required=True)
    fit.add_argument("-o", "--out", required=True, type=Path)
    return top


def cohort_spec(args: argparse.Namespace) -> CohortSpec:
    pairs = parse_records_for([x for token in args.records_for for x in token.split(",")]) if args.records_for else None
    contigs = args.contigs.split(",") if args.contigs else [n for n, _ in pairs] if pairs else ["chr1", "chr2", "chr3"]
    if args.target_size is not None:
        size = Size.target(parse_size(args.target_size))
    elif args.records is not None:
        size = Size.records(args.records)
    elif args.records_per_contig is not None:
        size = Size.records_per_contig(args.records_per_contig)
    else:
        size = Size.per_contig(dict(pairs)) if pairs else Size.records_per_contig(1000)
    return CohortSpec(Profile.resolve(args.profile), args.samples, tuple(contigs), size, args.payload, args.seed, args.format, None, args.compression_level)


def _bulk(args: argparse.Namespace) -> None:
    spec = cohort_spec(args)
    spec.validate()
    began = time.monotonic()
    summary = write_cohort(_session(args.threads), spec, args.output)
    print(f"wrote {args.output} ({args.output.stat().st_size} bytes, {summary.n_records_total()} records) in {time.monotonic() - began:.2f}s", file=sys.stderr)


def _fit(args: argparse.Namespace) -> None:
    spark = _session(None)
    if args.sites_vcf:
        sites = vcf.read_sites(spark, args.sites_vcf, args.contigs)
        profile = cohort.fit_sites(sites, args.n_samples, args.phased_rate, args.name, args.sites_vcf, args.ploidy, args.payload, in_order=True)
    else:
        n = len(vcf.vcf_samples(spark, args.vcf))
        profile = cohort.fit_genotyped(vcf.read_vcf(spark, args.vcf), n, args.name, args.vcf, args.ploidy, args.payload, args.contigs, int(args.phase_sample_mb * 1_000_000), in_order=True)
    write_profile(profile, args.out)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "fit" and args.sites_vcf and (args.n_samples is None or args.phased_rate is None):
        top.error("--sites-vcf needs --n-samples and --phased-rate")
    if args.command == "fit" and args.vcf and (args.n_samples is not None or args.phased_rate is not None):
        top.error("--n-samples and --phased-rate go with --sites-vcf; --vcf measures them")
    try:
        if args.command == "validate-profile":
            profile = Profile.from_json(args.path.read_text())
            profile.validate()
            print(f"OK: {profile.name}, {len(profile.fitted['contigs'])} contigs")
        else:
            (_bulk if args.command == "bulk" else _fit)(args)
    except (ProfileError, SpecError, OSError) as bad:
        print(f"INVALID: {bad}" if args.command == "validate-profile" else f"error: {bad}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
