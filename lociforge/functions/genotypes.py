"""Column expressions over genotype strings and call arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Alleles are unsigned 32-bit numbers, a leading plus included: fewer than ten digits, or ten up to 4294967295.
_NUMBER = (
    r"\+?0*(?:[0-9]{1,9}|[1-3][0-9]{9}|4[01][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}"
    r"|4294967[01][0-9]{2}|42949672[0-8][0-9]|429496729[0-5])"
)
_CALL = rf"\A(?:\.|{_NUMBER})(?:[|/](?:\.|{_NUMBER}))*\z"


def _tokens(gt: Column) -> Column:
    return F.split(gt, "[|/]", -1)


def is_genotype(gt: Column | str) -> Column:
    return _col(gt).rlike(_CALL)


def parse_genotype(gt: Column | str) -> Column:
    """``alleles, phased`` of a GT string, with null for a missing allele; null if the string is malformed."""
    g = _col(gt)
    alleles = F.transform(_tokens(g), lambda t: t.try_cast("bigint"))
    marks = F.translate(g, ".+0123456789", "")
    phased = F.when(F.length(marks) > 0, F.transform(F.split(marks, ""), lambda s: s == "|")).otherwise(F.array().cast("array<boolean>"))
    return F.when(is_genotype(g), F.struct(alleles.alias("alleles"), phased.alias("phased")))


def ploidy(gt: Column | str) -> Column:
    return F.size(_tokens(_col(gt)))


def is_phased(gt: Column | str) -> Column:
    """Some separator, and every one a bar; so a haploid call isn't phased."""
    g = _col(gt)
    return g.contains("|") & ~g.contains("/")


def render_genotype(alleles: Column | str, phased: Column | str) -> Column:
    a, p = _col(alleles), _col(phased)
    texts = F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit(".")))
    separators = F.concat(F.array(F.lit("")), F.transform(p, lambda x: F.when(x, "|").otherwise("/")))
    return F.array_join(F.zip_with(separators, texts, lambda s, t: F.concat(s, t)), "")


def render_calls(calls: Column | str, phased: Column | str) -> Column:
    """A GT string from a sample's calls with -1 for missing, with one separator for all."""
    texts = F.transform(_col(calls), lambda x: F.when(x < 0, ".").otherwise(x.cast("string")))
    return F.when(_col(phased), F.array_join(texts, "|")).otherwise(F.array_join(texts, "/"))


def call_stats(calls: Column | str) -> Column:
    """``n_ref, n_alt, dp, vaf`` of a sample's calls; vaf is 0 without a call, in single precision."""
    c = _col(calls)
    count = lambda test: F.size(F.filter(c, test)).cast("int")
    n_alt, dp = count(lambda x: x == 1), count(lambda x: x != -1)
    vaf = F.when(dp > 0, n_alt.cast("float") / dp.cast("float")).otherwise(0.0).cast("float")
    return F.struct(count(lambda x: x == 0).alias("n_ref"), n_alt.alias("n_alt"), dp.alias("dp"), vaf.alias("vaf"))


def payload_fields(calls: Column | str) -> Column:
    """All FORMAT values that payloads draw on, from a sample's calls."""
    s = call_stats(calls)
    half = lambda c: F.floor(c / 2).cast("int")
    r, a = s["n_ref"], s["n_alt"]
    return F.struct(
        s["dp"].alias("DP"), F.lit(99).alias("GQ"), s["vaf"].alias("VAF"), F.array(r, a).alias("AD"), F.array(F.lit(0), F.lit(30), F.lit(60)).alias("PL"),
        F.array(half(r), half(a)).alias("F1R2"), F.array(r - half(r), a - half(a)).alias("F2R1"), F.array(*[F.lit(0)] * 4).alias("SB"),
    )


def cardinality(kind: Column | str, count: Column | str, n_alt: Column | str, ploidy: Column | str) -> Column:
    """How many values a Number stands for; null for ``.``. kind is fixed, flag, A, R, G or dot."""
    k, n, p = _col(kind), _col(n_alt).cast("bigint"), _col(ploidy).cast("bigint")
    # C(n + p, p) as a running product, exact at each step
    ways = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(p, F.lit(1).cast("bigint"))), F.lit(1).cast("bigint"), lambda acc, i: F.when(i > p, acc).otherwise((acc * (n + i)).cast("decimal(38,0)") / i).cast("bigint"))
    return F.when(k == "fixed", _col(count).cast("bigint")).when(k == "flag", F.lit(0).cast("bigint")).when(k == "A", n).when(k == "R", n + 1).when(k == "G", ways)


def genotype_order(ploidy: int, n_alleles: int) -> list[list[int]]:
    """Genotypes in the order of Number=G values: ascending inside, sorted by their last allele first."""
    from itertools import combinations_with_replacement

    if ploidy < 1:
        raise ValueError("ploidy must be >= 1")
    return [list(g) for g in sorted(combinations_with_replacement(range(n_alleles), ploidy), key=lambda g: g[::-1])]
