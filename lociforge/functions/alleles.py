"""Column expressions over REF and ALT strings: parsing, classes, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SV_TYPES = ("DEL", "INS", "DUP", "INV", "CNV")
#: Structural types that span reference bases and so have an end.
SPANNING = ("DEL", "DUP", "INV", "CNV")
FIT_CLASSES = ("snp", "insertion", "deletion", "mnp", "complex", "symbolic")

SEQUENCE = r"\A[ACGTNacgtn]+\z"
SINGLE_BREAKEND = r"\A(?:\.[ACGTNacgtn]+|[ACGTNacgtn]+\.)\z"
#: One side holds the replacement sequence; the mate is a contig and digits after the last colon.
PAIRED_BREAKEND = r"(?s)\A(?:[ACGTNacgtn]+([\[\]])([^\[\]]+):([0-9]+)\1|([\[\]])([^\[\]]+):([0-9]+)\4[ACGTNacgtn]+)\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def allele_kind(alt: Column | str) -> Column:
    """SEQ, STAR, UNSPECIFIED, SYMBOLIC or BREAKEND by an ALT's form; null where it is none of them."""
    a = _col(alt)
    return (
        F.when(a == "*", "STAR")
        .when(a == "<*>", "UNSPECIFIED")
        .when(a.startswith("<") & a.endswith(">") & (F.length(a) > 1), F.when(symbolic_first(a).isin(*SV_TYPES), "SYMBOLIC"))
        .when(a.contains("[") | a.contains("]"), F.when(a.rlike(PAIRED_BREAKEND), "BREAKEND"))
        .when((F.length(a) > 1) & (a.startswith(".") | a.endswith(".")), F.when(a.rlike(SINGLE_BREAKEND), "BREAKEND"))
        .when(a.rlike(SEQUENCE), "SEQ")
    )


def allele_error(alt: Column | str) -> Column:
    """The code of what is wrong with an ALT, null if nothing is."""
    a = _col(alt)
    named = a.startswith("<") & a.endswith(">") & (F.length(a) > 1)
    dotted = (F.length(a) > 1) & (a.startswith(".") | a.endswith("."))
    reason = F.when(named, "BadSvType").when(a.contains("[") | a.contains("]") | dotted, "BadBreakend").otherwise("BadAlleleBases")
    return F.when(allele_kind(a).isNull(), reason)


def symbolic_type(alt: Column | str) -> Column:
    """The token of a symbolic ALT with its subtypes, as ``DUP:TANDEM``; null for other alleles."""
    a = _col(alt)
    return F.when(allele_kind(a) == "SYMBOLIC", a.substr(F.lit(2), F.length(a) - 2))


def symbolic_first(alt: Column | str) -> Column:
    a = _col(alt)
    return F.split_part(a.substr(F.lit(2), F.greatest(F.length(a) - 2, F.lit(0))), F.lit(":"), F.lit(1))


def parse_allele(alt: Column | str) -> Column:
    """``kind, bases, first_type, subtypes, raw, single, mate_chrom, mate_pos`` of an ALT; null if it is malformed."""
    a = _col(alt)
    kind = allele_kind(a)
    parts = F.split(symbolic_type(a), ":")
    single = a.rlike(SINGLE_BREAKEND)
    mate = lambda i, j: F.when((kind == "BREAKEND") & ~single, F.coalesce(F.nullif(F.regexp_extract(a, PAIRED_BREAKEND, i), F.lit("")), F.nullif(F.regexp_extract(a, PAIRED_BREAKEND, j), F.lit(""))))
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("kind"), F.when(kind == "SEQ", a).alias("bases"), F.when(kind == "SYMBOLIC", F.get(parts, F.lit(0))).alias("first_type"),
            F.when(kind == "SYMBOLIC", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("subtypes"), F.when(kind == "BREAKEND", a).alias("raw"), F.when(kind == "BREAKEND", single).alias("single"),
            mate(2, 5).alias("mate_chrom"), mate(3, 6).try_cast("bigint").alias("mate_pos"),
        ),
    )


def render_allele(allele: Column | str) -> Column:
    """The ALT string of a parsed allele."""
    x = _col(allele)
    token = F.concat_ws(":", F.concat(F.array(x["first_type"]), x["subtypes"]))
    return F.when(x["kind"] == "STAR", "*").when(x["kind"] == "UNSPECIFIED", "<*>").when(x["kind"] == "SYMBOLIC", F.concat(F.lit("<"), token, F.lit(">"))).when(x["kind"] == "BREAKEND", x["raw"]).otherwise(x["bases"])


def symbolic(first: str, *subtypes: str) -> str:
    """``<FIRST:SUB>``; ValueError for a type that isn't structural."""
    if first not in SV_TYPES:
        raise ValueError(f"BadSvType: {first!r}")
    return f"<{':'.join((first, *subtypes))}>"


def classify_sequence(ref: Column | str, alt: Column | str) -> Column:
    """SPANNING_DEL, SNP, MNP, INS, DEL or DELINS of one allele."""
    r, a = _col(ref), _col(alt)
    lr, la = F.length(r), F.length(a)
    return (
        F.when(a == "*", "SPANNING_DEL").when((lr == 1) & (la == 1), "SNP").when(lr == la, "MNP")
        .when((la > lr) & a.startswith(r), "INS").when((lr > la) & r.startswith(a), "DEL").otherwise("DELINS")
    )


def record_class(ref: Column | str, alts: Column | str) -> Column:
    """A record's class from its ALT array: MULTIALLELIC unless there is exactly one; null where that one is malformed."""
    r, xs = _col(ref), _col(alts)
    a = F.get(xs, F.lit(0))
    kind, first = allele_kind(a), symbolic_first(a)
    return (
        F.when(F.size(xs) != 1, "MULTIALLELIC").when(kind == "SEQ", classify_sequence(r, a)).when(kind == "STAR", "SPANNING_DEL")
        .when(kind == "UNSPECIFIED", "UNSPECIFIED").when(kind == "BREAKEND", "BND")
        .when(kind == "SYMBOLIC", F.when(first == "CNV", "CNV").otherwise(F.concat(F.lit("SV_"), first)))
    )


def truth_kind(ref: Column | str, alt: Column | str) -> Column:
    """An allele's kind in decoded records: the sequence class, or SPANNING_DEL, UNSPECIFIED, BND, SYMBOLIC."""
    kind = allele_kind(alt)
    return F.when(kind == "SEQ", classify_sequence(ref, alt)).when(kind == "STAR", "SPANNING_DEL").when(kind == "BREAKEND", "BND").otherwise(kind)


def fit_class(ref: Column | str, alt: Column | str) -> Column:
    """The class that cohort statistics use, of one allele (a joined ALT must be exploded first)."""
    r, a = _col(ref), _col(alt)
    lr, la = F.length(r), F.length(a)
    return (
        F.when(a.startswith("<") | a.contains("[") | a.contains("]"), "symbolic").when((lr == 1) & (la == 1), "snp").when((lr == la) & (lr > 1), "mnp")
        .when((la > lr) & a.startswith(r), "insertion").when((lr > la) & r.startswith(a), "deletion").otherwise("complex")
    )


def is_transition(ref: Column | str, alt: Column | str) -> Column:
    r, a = _col(ref), _col(alt)
    return ((r == "A") & (a == "G")) | ((r == "G") & (a == "A")) | ((r == "C") & (a == "T")) | ((r == "T") & (a == "C"))


def indel_length(ref: Column | str, alt: Column | str) -> Column:
    return F.abs(F.length(_col(alt)) - F.length(_col(ref)))


def next_base(base: Column | str, offset: int) -> Column:
    """The base ``offset`` steps on in ACGT; what is no base counts as A."""
    from_, to = "ACGT", "".join("ACGT"[(i + offset) % 4] for i in range(4))
    b = _col(base)
    return F.when(b.isin(*from_), F.translate(b, from_, to)).otherwise(to[0])


def snp_alt(base: Column | str, u: Column, pick: Column, titv: float) -> Column:
    """A SNP's ALT from two uniforms: the transition with probability titv / (titv + 1), else one of two transversions."""
    b = _col(base)
    purine = b.isin("A", "G")
    transition = F.when(b == "A", "G").when(b == "G", "A").when(b == "C", "T").when(b == "T", "C").otherwise("A")
    other = F.when(purine, F.when(pick < 0.5, "C").otherwise("T")).otherwise(F.when(pick < 0.5, "A").otherwise("G"))
    return F.when(u < F.lit(titv / (titv + 1)), transition).otherwise(other)
