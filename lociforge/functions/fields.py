"""Field declarations: the reserved registry, Number tokens, versions, ids."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = ("VCFv4.1", "VCFv4.2", "VCFv4.3", "VCFv4.4", "VCFv4.5")
TYPES = ("Integer", "Float", "Flag", "Character", "String")
FIELD_ID = r"\A(?:1000G|[A-Za-z_][0-9A-Za-z_.]*)\z"

# The reserved fields of the format, as kind, id, Number, Type, description, first version.
RESERVED = (
    ("INFO", "AA", "1", "String", "Ancestral allele", "VCFv4.1"),
    ("INFO", "AC", "A", "Integer", "Allele count", "VCFv4.1"),
    ("INFO", "AF", "A", "Float", "Allele frequency", "VCFv4.1"),
    ("INFO", "AN", "1", "Integer", "Total allele number", "VCFv4.1"),
    ("INFO", "DP", "1", "Integer", "Combined depth", "VCFv4.1"),
    ("INFO", "DB", "0", "Flag", "dbSNP membership", "VCFv4.1"),
    ("INFO", "H2", "0", "Flag", "HapMap2 membership", "VCFv4.1"),
    ("INFO", "END", "1", "Integer", "End position (deprecated)", "VCFv4.1"),
    ("INFO", "SVTYPE", "1", "String", "Type of structural variant", "VCFv4.1"),
    ("INFO", "SVLEN", "A", "Integer", "Length of structural variant", "VCFv4.1"),
    ("INFO", "SVCLAIM", "A", "String", "Structural variant claim", "VCFv4.4"),
    ("INFO", "CIPOS", ".", "Integer", "Confidence interval around POS", "VCFv4.1"),
    ("INFO", "CIEND", ".", "Integer", "Confidence interval around END", "VCFv4.1"),
    ("INFO", "CILEN", ".", "Integer", "Confidence interval around SVLEN", "VCFv4.1"),
    ("INFO", "MATEID", "A", "String", "ID of mate breakend", "VCFv4.1"),
    ("INFO", "PARID", "A", "String", "ID of partner breakend", "VCFv4.1"),
    ("INFO", "IMPRECISE", "0", "Flag", "Imprecise structural variant", "VCFv4.1"),
    ("FORMAT", "GT", "1", "String", "Genotype", "VCFv4.1"),
    ("FORMAT", "GQ", "1", "Integer", "Genotype quality", "VCFv4.1"),
    ("FORMAT", "DP", "1", "Integer", "Read depth", "VCFv4.1"),
    ("FORMAT", "AD", "R", "Integer", "Allelic depths", "VCFv4.1"),
    ("FORMAT", "PL", "G", "Integer", "Phred genotype likelihoods", "VCFv4.1"),
    ("FORMAT", "GL", "G", "Float", "Log10 genotype likelihoods", "VCFv4.1"),
    ("FORMAT", "PS", "1", "Integer", "Phase set", "VCFv4.1"),
    ("FORMAT", "CN", "1", "Float", "Copy number", "VCFv4.1"),
    ("FORMAT", "LEN", "1", "Integer", "Length of <*> reference block", "VCFv4.4"),
)
#: SVLEN before VCFv4.4.
OLD_SVLEN = (".", "Integer", "Difference in length between REF and ALT alleles")


class FieldError(ValueError):
    """A declaration is wrong; ``code`` says how."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


def version_rank(version: str) -> int:
    return VERSIONS.index(version)


def number_kind(number: str) -> tuple[str, int | None]:
    """kind and count of a Number token; 0 is the token of flags."""
    if number in ("A", "R", "G"):
        return number, None
    if number == ".":
        return "dot", None
    return ("flag", None) if number in ("0", "flag") else ("fixed", int(number))


@dataclass(frozen=True)
class FieldDef:
    kind: str
    id: str
    number: str
    type: str
    description: str

    def __post_init__(self):
        if not re.match(FIELD_ID.replace(r"\z", r"\Z"), self.id):
            raise FieldError("BadFieldId", self.id)
        if self.type == "Flag" and self.kind != "INFO":
            raise FieldError("FlagNotInfo", self.id)
        if self.type == "Flag" and self.number != "0":
            raise FieldError("FlagNumberNotZero", self.id)
        if self.type != "Flag" and self.number == "0":
            raise FieldError("ZeroNumberNotFlag", self.id)

    def header_line(self) -> str:
        return f'##{self.kind}=<ID={self.id},Number={self.number},Type={self.type},Description="{self.description}">'


def reserved(id: str, kind: str, version: str) -> FieldDef:
    """The registry's definition for a version of the format."""
    for k, i, number, type_, description, since in RESERVED:
        if (k, i) == (kind, id):
            if version_rank(version) < version_rank(since):
                raise FieldError("FieldTooNew", f"{kind} {id} is since {since}, not in {version}")
            if (kind, id) == ("INFO", "SVLEN") and version_rank(version) < version_rank("VCFv4.4"):
                number, type_, description = OLD_SVLEN
            return FieldDef(kind, id, number, type_, description)
    raise FieldError("UnknownReserved", f"{kind} {id}")


def registry(spark: SparkSession) -> DataFrame:
    """``kind, id, number, type, description, since`` (an ordinal): 26 rows, to broadcast."""
    rows = [(*r[:5], version_rank(r[5])) for r in RESERVED]
    return spark.createDataFrame(rows, "kind string, id string, number string, type string, description string, since int")


def resolve_reserved(declared: DataFrame, version: str) -> DataFrame:
    """Declarations ``kind, id`` with the registry's number, type, description, and a code where they don't resolve."""
    rank = version_rank(version)
    found = declared.join(F.broadcast(registry(declared.sparkSession)), ["kind", "id"], "left")
    old = (F.col("kind") == "INFO") & (F.col("id") == "SVLEN") & F.lit(rank < version_rank("VCFv4.4"))
    error = F.when(F.col("since").isNull(), "UnknownReserved").when(F.col("since") > rank, "FieldTooNew")
    return found.select("kind", "id", *[F.when(old, v).otherwise(F.col(c)).alias(c) for c, v in zip(("number", "type", "description"), OLD_SVLEN, strict=True)], error.alias("error"))


def declaration_error(kind: Column, id: Column, number: Column, type_: Column) -> Column:
    """The code of what is wrong with a declaration, null if nothing is."""
    return (
        F.when(~id.rlike(FIELD_ID), "BadFieldId")
        .when((type_ == "Flag") & (kind != "INFO"), "FlagNotInfo")
        .when((type_ == "Flag") & (number != "0"), "FlagNumberNotZero")
        .when((type_ != "Flag") & (number == "0"), "ZeroNumberNotFlag")
    )


def header_line(kind: Column, id: Column, number: Column, type_: Column, description: Column) -> Column:
    return F.concat(F.lit("##"), kind, F.lit("=<ID="), id, F.lit(",Number="), number, F.lit(",Type="), type_, F.lit(',Description="'), description, F.lit('">'))
