"""Hypothesis strategies for valid inputs: alleles, genotypes, values, documents and references.

A drawn document is a ``DocumentPlan``: what to declare and the records' specs, free of any session until ``builder``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from hypothesis import strategies as st

from .functions.fields import FieldDef, number_kind
from .operators.records import CLAIM_REQUIRED, CLAIMS, Field, FieldValue, RecordSpec, VcfBuilder
from .operators.reference import ReferenceBuilder, ReferenceSpec

CLASSES = ("SNP", "MNP", "INS", "DEL", "DELINS", "SPANNING_DEL")
BASES = "ACGT"


def _turn(bases: str, by: int = 1) -> str:
    return "".join(BASES[(BASES.index(b) + by) % 4] for b in bases)


def number_type_combos() -> list[tuple[str, str, str]]:
    """Number, Type and kind of every sort of field; flags are INFO's alone."""
    out = [(n, t, k) for k, n, t in product(("INFO", "FORMAT"), ("1", "2", "A", "R", "G", "."), ("Integer", "Float", "Character", "String"))]
    return [*out, ("0", "Flag", "INFO")]


@st.composite
def ref_alts(draw, klass: str) -> tuple[str, str]:
    """REF and ALT of a class."""
    one, two = draw(st.sampled_from(BASES)), draw(st.text(BASES, min_size=2, max_size=2))
    tail = draw(st.text(BASES, min_size=1, max_size=3))
    return {
        "SNP": (one, _turn(one, draw(st.integers(1, 3)))), "MNP": (two, _turn(two)), "INS": (one, one + tail), "DEL": (one + tail, one), "DELINS": (two, tail), "SPANNING_DEL": (one, "*"),
    }[klass]


@st.composite
def genotypes(draw, ploidy: int, n_alt: int, missing_rate: float = 0.1) -> str:
    calls = ["." if draw(st.floats(0, 1, exclude_max=True)) < missing_rate else str(draw(st.integers(0, n_alt))) for _ in range(ploidy)]
    return draw(st.sampled_from("|/")).join(calls)


def scalars(type_: str) -> st.SearchStrategy:
    return {
        "Integer": st.integers(-1000, 1000), "Float": st.floats(-1e6, 1e6, width=32), "Character": st.text("abcxyzABCXYZ0123456789", min_size=1, max_size=1), "String": st.text("abcxyzABCXYZ0123456789", min_size=1, max_size=6),
    }[type_]


def cardinality_of(number: str, n_alt: int, ploidy: int) -> int | None:
    from math import comb

    kind, count = number_kind(number)
    return {"fixed": count, "flag": 0, "A": n_alt, "R": n_alt + 1, "G": comb(n_alt + ploidy, ploidy), "dot": None}[kind]


@st.composite
def field_values(draw, number: str, type_: str, n_alt: int, ploidy: int) -> FieldValue:
    """A list of as many values as the Number asks for, one to three where it leaves that open."""
    if type_ == "Flag":
        return FieldValue.flag()
    n = cardinality_of(number, n_alt, ploidy)
    return FieldValue.of(draw(st.lists(scalars(type_), min_size=1 if n is None else n, max_size=3 if n is None else n)))


@dataclass
class DocumentPlan:
    samples: list[str]
    contigs: list[tuple[str, int]]
    version: str
    infos: list[Field] = field(default_factory=list)
    formats: list[Field] = field(default_factory=list)
    specs: list[RecordSpec] = field(default_factory=list)

    def builder(self, spark) -> VcfBuilder:
        return VcfBuilder(spark, self.samples, self.contigs, self.version, list(self.infos), list(self.formats), specs=list(self.specs))


@st.composite
def _site(draw, n_alt: int) -> tuple[str, list[str]]:
    """One REF and its ALTs; a spanning deletion is the last one only."""
    ref, first = draw(ref_alts(draw(st.sampled_from(CLASSES[:-1] if n_alt > 1 else CLASSES))))
    anchor, alts = ref[0], [first]
    for k in range(1, n_alt):
        klass = draw(st.sampled_from(CLASSES if k == n_alt - 1 else CLASSES[:-1]))
        alts.append({"SNP": _turn(anchor), "MNP": _turn(anchor) + _turn(anchor, 2), "INS": anchor + "T", "SPANNING_DEL": "*"}.get(klass) or draw(ref_alts(klass))[1])
    return ref, alts


EXTRA = (FieldDef("INFO", "AF", "A", "Float", ""), FieldDef("INFO", "NS", "1", "Integer", ""), FieldDef("INFO", "DB", "0", "Flag", ""), FieldDef("FORMAT", "GQ", "1", "Integer", ""), FieldDef("FORMAT", "AD", "R", "Integer", ""))


@st.composite
def documents(draw, max_samples: int = 3, max_records: int = 4, max_alt: int = 1, version: str = "VCFv4.5", extra: tuple[FieldDef, ...] = ()) -> DocumentPlan:
    """Sequence variants on one contig, positions rising, with values for the extra fields."""
    n, ploidy = draw(st.integers(1, max_samples)), draw(st.integers(1, 2))
    plan = DocumentPlan([f"s{i}" for i in range(n)], [("chr1", 100_000)], version, formats=[Field.reserved("GT")])
    for d in extra:
        (plan.infos if d.kind == "INFO" else plan.formats).append(Field.typed(d.id, d.number, d.type))
    pos = 1000
    for _ in range(draw(st.integers(1, max_records))):
        n_alt = draw(st.integers(1, max_alt))
        ref, alts = draw(_site(n_alt))
        spec = RecordSpec.at("chr1", pos).ref_(ref).alt(alts).gt([draw(genotypes(ploidy, n_alt)) for _ in range(n)])
        for d in extra:
            value = lambda d=d: draw(field_values(d.number, d.type, n_alt, ploidy))
            spec = spec.info(d.id, value()) if d.kind == "INFO" else spec.format(d.id, [value() for _ in range(n)])
        plan.specs.append(spec)
        pos += draw(st.integers(1, 50))
    return plan


def documents_with_fields(**options) -> st.SearchStrategy[DocumentPlan]:
    return documents(extra=EXTRA, **options)


@st.composite
def symbolic_documents(draw, max_samples: int = 3, max_records: int = 4, version: str = "VCFv4.5") -> DocumentPlan:
    """One structural ALT a record, with its length and, where it must, its claim."""
    n = draw(st.integers(1, max_samples))
    plan = DocumentPlan([f"s{i}" for i in range(n)], [("chr1", 100_000)], version, [Field.reserved("SVLEN")], [Field.reserved("GT")])
    modern = version >= "VCFv4.4"
    if modern:
        plan.infos.append(Field.reserved("SVCLAIM"))
    for k in range(draw(st.integers(1, max_records))):
        kind = draw(st.sampled_from(tuple(CLAIMS)))
        spec = RecordSpec.at("chr1", 1000 + 100 * k).ref_(draw(st.sampled_from(BASES))).alt([f"<{kind}>"]).gt([draw(genotypes(2, 1, 0))] * n).info("SVLEN", [draw(st.integers(100, 10_000))])
        plan.specs.append(spec.info("SVCLAIM", [CLAIMS[kind][0]]) if modern and kind in CLAIM_REQUIRED else spec)
    return plan


@st.composite
def references(draw, n_contigs: int = 2, length: int = 500) -> ReferenceSpec:
    b = ReferenceBuilder(draw(st.integers(0, 2**63)))
    for k in range(draw(st.integers(1, n_contigs))):
        b.add_contig(f"chr{k + 1}", length)
    for k, motif in enumerate(("CAG", "AC", "T")[: draw(st.integers(0, 3))]):
        b.tandem_repeat("chr1", max(0, min(20 * k, length - 20)), motif, 3)
    return b.build()


@st.composite
def references_and_documents(draw, max_samples: int = 3, max_records: int = 4, version: str = "VCFv4.5") -> tuple[ReferenceSpec, DocumentPlan]:
    """A document whose REFs are the reference's bases."""
    ref = draw(references())
    n, ploidy = draw(st.integers(1, max_samples)), draw(st.integers(1, 2))
    plan = DocumentPlan([f"s{i}" for i in range(n)], [(c, len(s)) for c, s in ref.contigs.items()], version, formats=[Field.reserved("GT")])
    for _ in range(draw(st.integers(1, max_records))):
        contig = draw(st.sampled_from(sorted(ref.contigs)))
        pos0, klass = draw(st.integers(0, ref.length(contig) - 9)), draw(st.sampled_from(CLASSES))
        own, two, three = (ref.seq(contig, pos0, k) for k in (1, 2, 3))
        r, a = {"SNP": (own, _turn(own)), "MNP": (two, _turn(two)), "INS": (own, own + "A"), "DEL": (three, own), "DELINS": (two, "A"), "SPANNING_DEL": (own, "*")}[klass]
        plan.specs.append(RecordSpec.at(contig, pos0 + 1).ref_(r).alt([a]).gt(["|".join(["0"] * (ploidy - 1) + ["1"])] * n))
    return ref, plan
