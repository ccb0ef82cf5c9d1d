"""How many records each contig gets: sizes, apportionment, matching of contig names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class SpecError(ValueError):
    """A generation request is wrong; ``code`` says how."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Size:
    """``records`` in all, ``per_contig`` each, ``counts`` by name, or a ``target`` of bytes."""

    mode: str
    value: object

    @staticmethod
    def records(n: int) -> Size:
        return Size("records", n)

    @staticmethod
    def records_per_contig(n: int) -> Size:
        return Size("per_contig", n)

    @staticmethod
    def per_contig(counts: Mapping[str, int]) -> Size:
        return Size("counts", dict(counts))

    @staticmethod
    def target(size: int) -> Size:
        return Size("target", size)


_UNITS = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


def _count(text: str) -> int:
    text = text.strip()
    digits = text.removeprefix("+")
    if not (digits.isascii() and digits.isdigit()) or int(digits) >= 1 << 64:
        raise ValueError(text)
    return int(digits)


def parse_size(text: str) -> int:
    """Bytes of ``100MB``, ``512KB``, ``1GB`` (powers of 1024, capitals) or a bare number."""
    t = text.strip()
    unit = _UNITS.get(t[-2:])
    try:
        return _count(t[:-2] if unit else t) * (unit or 1)
    except ValueError:
        raise SpecError("BadSize", text) from None


def parse_records_for(tokens: Sequence[str]) -> list[tuple[str, int]]:
    """Pairs of ``NAME=COUNT`` tokens, in their order."""
    out: dict[str, int] = {}
    for token in tokens:
        name, equals, count = token.partition("=")
        name = name.strip()
        if not equals or not name or name in out:
            raise SpecError("BadRecordsFor", token)
        try:
            out[name] = _count(count)
        except ValueError:
            raise SpecError("BadRecordsFor", token) from None
    return list(out.items())


def normalized_contig(name: str) -> str:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)
    return lower.removeprefix("chr")


def contig_stat(contigs: Sequence[dict], place: int, name: str) -> dict:
    """The fitted statistics for an output contig: by name, by name without ``chr``, or by place, going round."""
    for test in (lambda c: c["id"] == name, lambda c: normalized_contig(c["id"]) == normalized_contig(name)):
        for c in contigs:
            if test(c):
                return c
    return contigs[place % len(contigs)]


def match_contigs(requested: DataFrame, fitted: DataFrame) -> DataFrame:
    """The same over frames ``place, name`` and ``place, id, n_variants``: a count for each requested contig; the first match wins."""
    bare = lambda c: F.regexp_replace(F.lower(c), "^chr", "")
    n = fitted.count()
    least = lambda key: fitted.groupBy(key.alias("key")).agg(F.min_by("n_variants", "place").alias("n"))
    exact, loose = least(F.col("id")), least(bare(F.col("id")))
    turn = fitted.select(F.col("place").alias("turn"), F.col("n_variants").alias("by_place"))
    r = requested.withColumn("bare", bare(F.col("name"))).withColumn("turn", F.pmod("place", F.lit(n)))
    r = r.join(F.broadcast(exact.select(F.col("key").alias("name"), F.col("n").alias("by_name"))), "name", "left").join(F.broadcast(loose.select(F.col("key").alias("bare"), F.col("n").alias("by_bare"))), "bare", "left")
    return r.join(F.broadcast(turn), "turn", "left").select("place", "name", F.coalesce("by_name", "by_bare", "by_place").alias("n_variants"))


def apportion(weights: Sequence[float], total: int) -> list[int]:
    """Whole numbers that sum to ``total`` in proportion to weights; what is left goes to the largest remainders, ties in order."""
    every = sum(weights)
    if every <= 0:
        base, rest = divmod(total, len(weights))
        return [base + (i < rest) for i in range(len(weights))]
    raw = [w / every * total for w in weights]
    counts = [int(r) for r in raw]
    rest = max(0, total - sum(counts))
    for i in sorted(range(len(raw)), key=lambda i: -(raw[i] - int(raw[i])))[:rest]:
        counts[i] += 1
    return counts


def apportion_frame(weights: DataFrame, total: int) -> DataFrame:
    """The same over a frame ``place, weight`` (tens of rows): ``place, records``."""
    raw = F.col("weight") / F.sum("weight").over(Window.partitionBy()) * F.lit(float(total))
    parts = weights.withColumn("raw", raw).withColumn("base", F.floor("raw")).withColumn("part", F.col("raw") - F.col("base"))
    rank = F.row_number().over(Window.orderBy(F.desc("part"), "place"))
    rest = F.lit(total) - F.sum("base").over(Window.partitionBy())
    return parts.select("place", (F.col("base") + F.when(rank <= rest, 1).otherwise(0)).alias("records"))


def distribute(fitted: dict, names: Sequence[str], total: int) -> list[int]:
    return apportion([float(contig_stat(fitted["contigs"], i, n)["n_variants"]) for i, n in enumerate(names)], total)


def named_counts(counts: Mapping[str, int], names: Sequence[str]) -> list[int]:
    """Counts in the contigs' order; both sets of names must be the same."""
    if missing := [n for n in names if n not in counts]:
        raise SpecError("PerContigMissing", ", ".join(missing))
    if unknown := sorted(n for n in counts if n not in names):
        raise SpecError("PerContigUnknown", ", ".join(unknown))
    return [counts[n] for n in names]
