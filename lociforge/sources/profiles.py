"""Profiles: what generation draws from. JSON with fitted (measured) and dialed (chosen) values kept apart."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import FIT_CLASSES
from ..operators import histograms as H

PAYLOADS = ("gt-only", "gt-vaf", "gatk", "mutect2")
#: Payloads whose values only exist for two calls per sample.
DIPLOID = ("gatk", "mutect2")
RATES = ("multiallelic_rate", "missing_rate", "phased_rate")

_HIST = "struct<edges:array<double>,weights:array<double>>"
SCHEMA = (
    "name string, provenance struct<source:string,n_samples_source:bigint,n_variants_source:bigint,fitted_on:string,fit_tool_version:string,supplied:array<string>>, "
    f"fitted struct<contigs:array<struct<id:string,n_variants:bigint,density_per_kb:double>>,gap_dist:{_HIST},sfs:{_HIST},indel_length:{_HIST},"
    "variant_classes:struct<snp:double,insertion:double,deletion:double,mnp:double,complex:double,symbolic:double>,titv:double,multiallelic_rate:double,missing_rate:double,phased_rate:double>, "
    "dialed struct<payload:string,ploidy:int>"
)


class ProfileError(ValueError):
    """A profile can't be loaded or used; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _invalid(reason: str) -> ProfileError:
    return ProfileError("InvalidProfile", reason)


def check_histogram(h: dict) -> None:
    edges, weights = h["edges"], h["weights"]
    if len(edges) < 2:
        raise _invalid("histogram needs >= 2 edges")
    if len(weights) + 1 != len(edges):
        raise _invalid(f"histogram weights ({len(weights)}) must be edges ({len(edges)}) - 1")
    if not all(map(math.isfinite, [*weights, *edges])):
        raise _invalid("histogram edges and weights must be finite")
    if min(weights) < 0 or sum(weights) <= 0:
        raise _invalid("histogram weights must be >= 0 and sum > 0")
    if any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise _invalid("histogram edges must be increasing")


@dataclass
class Profile:
    name: str
    provenance: dict
    fitted: dict
    dialed: dict

    @staticmethod
    def from_json(text: str) -> Profile:
        """Parses without checking the values; JSON that lacks a part raises ProfileError."""
        try:
            d = json.loads(text)
            d["provenance"].setdefault("supplied", [])
            profile = Profile(d["name"], d["provenance"], d["fitted"], d["dialed"])
            if profile.dialed["payload"] not in PAYLOADS:
                raise ValueError(profile.dialed["payload"])
            _ = profile.dialed["ploidy"], [profile.fitted[k] for k in ("contigs", "gap_dist", "sfs", "indel_length", "variant_classes", "titv", *RATES)], profile.provenance["n_samples_source"]
        except (KeyError, TypeError, ValueError) as bad:
            raise ProfileError("ProfileParse", str(bad)) from bad
        return profile

    @staticmethod
    def builtin(name: str) -> Profile:
        from .cohorts import COHORTS

        if name not in COHORTS:
            raise ProfileError("UnknownProfile", name)
        c = COHORTS[name]
        hist = lambda edges, key: {"edges": list(edges), "weights": list(c[key])}
        profile = Profile(
            name,
            {"source": c["source"], "n_samples_source": c["n_samples"], "n_variants_source": c["n_variants"], "fitted_on": c["fitted_on"], "fit_tool_version": "0.1.0", "supplied": list(c["supplied"])},
            {
                "contigs": [dict(zip(("id", "n_variants", "density_per_kb"), x, strict=True)) for x in c["contigs"]],
                "gap_dist": hist(H.gap_edges(), "gap_weights"), "sfs": hist(H.sfs_edges(c["n_samples"]), "sfs_weights"), "indel_length": hist(H.INDEL_EDGES, "indel_weights"),
                "variant_classes": dict(c["variant_classes"]), "titv": c["titv"], **{r: c[r] for r in RATES},
            },
            {"payload": c["payload"], "ploidy": c["ploidy"]},
        )
        profile.validate()
        return profile

    @staticmethod
    def resolve(name_or_path: str) -> Profile:
        """A built-in profile by name, else a JSON file."""
        try:
            return Profile.builtin(name_or_path)
        except ProfileError as unknown:
            if unknown.code != "UnknownProfile":
                raise
        try:
            text = Path(name_or_path).read_text()
        except OSError as bad:
            raise ProfileError("ProfileLoad", f"{name_or_path}: {bad}") from bad
        return Profile.from_json(text)

    def validate(self, payload: str | None = None) -> None:
        """Checks values, for the payload that is going to be written (the profile's own by default)."""
        payload = payload or self.dialed["payload"]
        for k in ("gap_dist", "sfs", "indel_length"):
            check_histogram(self.fitted[k])
        mix = [self.fitted["variant_classes"][c] for c in FIT_CLASSES]
        if not all(map(math.isfinite, mix)):
            raise _invalid("variant_classes must be finite")
        if abs(sum(mix) - 1) > 1e-6:
            raise _invalid(f"variant_classes must sum to 1.0, got {sum(mix)}")
        if self.dialed["ploidy"] < 1:
            raise _invalid("ploidy must be >= 1")
        if payload in DIPLOID and self.dialed["ploidy"] != 2:
            raise ProfileError("PayloadPloidy", f"{payload} needs ploidy 2, not {self.dialed['ploidy']}")
        for k in RATES:
            if not 0 <= self.fitted[k] <= 1:
                raise _invalid(f"{k} must be in [0, 1]")
        if not self.fitted["contigs"]:
            raise _invalid("need >= 1 contig")

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "provenance": self.provenance, "fitted": self.fitted, "dialed": self.dialed}, indent=2) + "\n"


def write_profile(profile: dict | Profile, path: str | Path) -> None:
    """JSON at ``path``, folders made as needed, then read back and checked."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(profile.to_json() if isinstance(profile, Profile) else json.dumps(profile, indent=2) + "\n")
    Profile.from_json(path.read_text()).validate()


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles as rows, with the given schema."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def histogram_valid(h: Column) -> Column:
    """Whether a histogram column could be sampled from."""
    edges, weights = h["edges"], h["weights"]
    finite = lambda xs: F.forall(xs, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    rising = F.forall(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.get(edges, i) > F.get(edges, i - 1))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return (F.size(edges) >= 2) & (F.size(weights) + 1 == F.size(edges)) & finite(edges) & finite(weights) & F.forall(weights, lambda x: x >= 0) & (total > 0) & rising
