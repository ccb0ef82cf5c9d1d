"""Records: building, checking, decoding and rendering them as DataFrame operations.

A staged record has ordered entries for INFO and FORMAT, so what prints in insertion order stays in it, and an entry
knows whether it was given as a flag, a lone value or a list, which decides whether its length is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import fields as D
from ..functions import genotypes as G
from ..functions import text as T

VALUE = "struct<form:string,type:string,values:array<string>>"
SCHEMA = (
    "rec_id bigint, chrom string, pos bigint, ids array<string>, ref string, alts array<string>, qual double, filters array<string>, gt array<string>, "
    f"info array<struct<key:string,value:{VALUE}>>, fmt array<struct<key:string,per_sample:array<{VALUE}>>>, labels array<string>"
)
#: Claims a symbolic allele of each type may make, and the types that must make one from VCFv4.4 on.
CLAIMS = {"DEL": ("D", "J", "DJ"), "DUP": ("D", "J", "DJ"), "CNV": ("D",), "INS": ("J",), "INV": ("J",)}
CLAIM_REQUIRED = ("DEL", "DUP")
#: Types whose lengths a copy number ties together.
COPY_TYPES = ("CNV", "DEL", "DUP")


class BuildError(ValueError):
    """What is wrong, as a code, and the place of the record that has it."""

    def __init__(self, code: str, index: int | None = None, detail: str = ""):
        super().__init__((f"record {index}: " if index is not None else "") + code + (f" ({detail})" if detail else ""))
        self.code, self.index, self.detail = code, index, detail


# -- values and specs on the driver


@dataclass(frozen=True)
class FieldValue:
    """A flag, a lone value, or a list; values are kept as their text, strings not yet escaped."""

    form: str
    type: str
    values: tuple[str | None, ...]

    @staticmethod
    def flag() -> FieldValue:
        return FieldValue("flag", "flag", ())

    @staticmethod
    def of(value) -> FieldValue:
        """Of an int, float or str, or a list of one of those with None for missing."""
        items = list(value) if isinstance(value, (list, tuple)) else [value]
        kinds = {"float" if isinstance(v, float) else "int" if isinstance(v, int) else "str" for v in items if v is not None}
        kind = "float" if kinds == {"int", "float"} else next(iter(kinds), "str")
        texts = tuple(None if v is None else T.format_float_text(float(v)) if kind == "float" else str(v) for v in items)
        return FieldValue("list" if isinstance(value, (list, tuple)) else "scalar", kind, texts)

    def list_len(self) -> int | None:
        return len(self.values) if self.form == "list" else None

    def row(self) -> tuple:
        return self.form, self.type, list(self.values)


def _value(v) -> FieldValue:
    return v if isinstance(v, FieldValue) else FieldValue.flag() if v is True else FieldValue.of(v)


@dataclass(frozen=True)
class RecordSpec:
    chrom: str
    pos: int
    ref: str = ""
    alts: tuple[str, ...] = ()
    id_list: tuple[str, ...] | None = None
    qual_value: float | None = None
    filter_list: tuple[str, ...] | None = None
    gts: tuple[str, ...] | None = None
    info_items: tuple = ()
    format_items: tuple = ()
    label_set: tuple[str, ...] = ()

    @staticmethod
    def at(chrom: str, pos: int) -> RecordSpec:
        return RecordSpec(chrom, pos)

    def ref_(self, ref: str) -> RecordSpec:
        return replace(self, ref=ref)

    def alt(self, alts: Iterable[str]) -> RecordSpec:
        return replace(self, alts=tuple(alts))

    def ids(self, ids: Iterable[str]) -> RecordSpec:
        return replace(self, id_list=tuple(ids))

    def qual(self, qual: float) -> RecordSpec:
        return replace(self, qual_value=float(qual))

    def filter(self, filters: Iterable[str]) -> RecordSpec:
        return replace(self, filter_list=tuple(filters))

    def gt(self, gts: Iterable[str]) -> RecordSpec:
        return replace(self, gts=tuple(gts))

    def info(self, id: str, value=True) -> RecordSpec:
        """Adds a key or, in its place, gives it another value; True is a flag."""
        items = dict(self.info_items) | {id: _value(value)}
        return replace(self, info_items=tuple(items.items()))

    def format(self, id: str, per_sample: Iterable) -> RecordSpec:
        items = dict(self.format_items) | {id: tuple(map(_value, per_sample))}
        return replace(self, format_items=tuple(items.items()))

    def labels(self, labels: Iterable[str]) -> RecordSpec:
        return replace(self, label_set=tuple(sorted(set(labels))))

    def row(self, index: int) -> tuple:
        opt = lambda x: None if x is None else list(x)
        return (
            index, self.chrom, self.pos, opt(self.id_list), self.ref, list(self.alts), self.qual_value, opt(self.filter_list), opt(self.gts),
            [(k, v.row()) for k, v in self.info_items], [(k, [v.row() for v in vs]) for k, vs in self.format_items], list(self.label_set),
        )


@dataclass(frozen=True)
class Field:
    """A declaration, resolved when a document is built."""

    id: str
    number: str | None = None  # None: from the registry
    type: str | None = None
    text: str | None = None

    @staticmethod
    def reserved(id: str) -> Field:
        return Field(id)

    @staticmethod
    def typed(id: str, number: str, type: str) -> Field:
        return Field(id, number, type)

    @staticmethod
    def flag(id: str) -> Field:
        return Field(id, "0", "Flag")

    def description(self, text: str) -> Field:
        return replace(self, text=text)

    def resolve(self, kind: str, version: str) -> D.FieldDef:
        found = D.reserved(self.id, kind, version) if self.number is None else D.FieldDef(kind, self.id, self.number, self.type, "")
        return found if self.text is None else replace(found, description=self.text)


# -- columns


def value_text(value: Column) -> Column:
    """A value as it prints; null for a flag."""
    encode = value["type"].isin("str", "char")
    items = F.transform(value["values"], lambda x: F.coalesce(F.when(encode, T.percent_encode(x)).otherwise(x), F.lit(".")))
    return F.when(value["form"] != "flag", F.when(F.size(items) == 0, ".").otherwise(F.array_join(items, ",")))


def entry(entries: Column, key: str) -> Column:
    """The value of a key, null without it."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]


def per_allele_int(value: Column, i: Column) -> Column:
    """The i-th of a list, with fractions cut off; a lone integer counts for the first allele only."""
    number = F.get(value["values"], i).try_cast("double").cast("bigint")
    whole = F.coalesce(F.get(value["values"], i).try_cast("bigint"), number)
    return F.when(value["type"].isin("int", "float") & ((value["form"] == "list") | ((value["form"] == "scalar") & (value["type"] == "int") & (i == 0))), whole)


def per_allele_text(value: Column, i: Column) -> Column:
    return F.when((value["type"] == "str") & ((value["form"] == "list") | ((value["form"] == "scalar") & (i == 0))), F.get(value["values"], i))


def _declared(defs: Sequence[D.FieldDef]) -> Column:
    """id -> kind and count of its Number."""
    if not defs:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<kind:string,count:int>>"))
    parts = [(d.id, *D.number_kind(d.number)) for d in defs]
    return F.map_from_arrays(F.array(*[F.lit(p[0]) for p in parts]), F.array(*[F.struct(F.lit(p[1]).alias("kind"), F.lit(p[2]).cast("int").alias("count")) for p in parts]))


def _fault(code: str | Column, detail: Column | None = None) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def record_ploidy(gt: Column | str = "gt") -> Column:
    """The largest ploidy among a record's genotypes, 2 without any."""
    g = F.col(gt) if isinstance(gt, str) else gt
    return F.coalesce(F.array_max(F.transform(g, G.ploidy)), F.lit(2))


def record_faults(version: str, n_samples: int, info: Sequence[D.FieldDef], formats: Sequence[D.FieldDef]) -> Column:
    """All that is wrong with a staged record, as an array of ``code, detail`` in the order of the checks."""
    alts, entries, fmt, gt = F.col("alts"), F.col("info"), F.col("fmt"), F.col("gt")
    n_alt, ploidy = F.size(alts), record_ploidy()
    infos, fmts = _declared(info), _declared(formats)
    svlen, claim = entry(entries, "SVLEN"), entry(entries, "SVCLAIM")
    modern = D.version_rank(version) >= D.version_rank("VCFv4.4")
    none = F.array().cast("array<struct<code:string,detail:string>>")

    malformed = F.transform(F.filter(alts, lambda a: A.allele_error(a).isNotNull()), lambda a: _fault(A.allele_error(a), a))
    padded = F.exists(alts, lambda a: F.coalesce(A.allele_kind(a).isin("SYMBOLIC", "BREAKEND"), F.lit(False)))
    padding = F.when(padded & (F.length("ref") != 1), F.array(_fault("MissingRefPadding", F.col("ref")))).otherwise(none)

    def allele(a: Column, i: Column) -> Column:
        kind, first = A.allele_kind(a), A.symbolic_first(a)
        length, said = per_allele_int(svlen, i), per_allele_text(claim, i)
        allowed = F.when(first.isin("DEL", "DUP"), said.isin(*CLAIMS["DEL"])).when(first == "CNV", said.isin(*CLAIMS["CNV"])).otherwise(said.isin(*CLAIMS["INS"]))
        return F.when(
            kind == "SYMBOLIC",
            F.when(length.isNull(), _fault("MissingSvlen", a)).when(said.isNotNull() & ~allowed, _fault("BadSvclaim", said)).when(F.lit(modern) & first.isin(*CLAIM_REQUIRED) & said.isNull(), _fault("SvclaimRequired", a)),
        ).when(kind.isin("BREAKEND", "UNSPECIFIED", "STAR") & length.isNotNull(), _fault("SvlenMustBeMissing", a))

    some = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    structural = some(F.transform(alts, allele))

    def call(g: Column) -> Column:
        top = F.array_max(G.parse_genotype(g)["alleles"])
        return F.when(~G.is_genotype(g), _fault("BadGenotype", g)).when(top > n_alt, _fault("AlleleIndexOutOfRange", top))

    has_gt = any(d.id == "GT" for d in formats)
    calls = (
        F.when(gt.isNull(), none).when(F.lit(not has_gt), F.array(_fault("GtNotDeclared")))
        .when(F.size(gt) != n_samples, F.array(_fault("SampleCountMismatch", F.lit("GT")))).otherwise(some(F.transform(gt, call)))
    )

    def fits(key: Column, number: Column, value: Column) -> Column:
        want = G.cardinality(number["kind"], number["count"], n_alt, ploidy)
        return F.when((number["kind"] != "flag") & (value["form"] == "list") & (F.size(value["values"]) != want), _fault("Cardinality", key))

    def sampled(e: Column) -> Column:
        number = F.try_element_at(fmts, e["key"])
        return (
            F.when(number.isNull(), F.array(_fault("UndeclaredField", F.concat(F.lit("FORMAT "), e["key"]))))
            .when(F.size(e["per_sample"]) != n_samples, F.array(_fault("SampleCountMismatch", e["key"])))
            .otherwise(some(F.transform(e["per_sample"], lambda v: fits(e["key"], number, v))))
        )

    def informed(e: Column) -> Column:
        number = F.try_element_at(infos, e["key"])
        return F.when(number.isNull(), _fault("UndeclaredField", F.concat(F.lit("INFO "), e["key"]))).otherwise(fits(e["key"], number, e["value"]))

    lengths = F.filter(
        F.transform(alts, lambda a, i: F.when((A.allele_kind(a) == "SYMBOLIC") & A.symbolic_first(a).isin(*COPY_TYPES), F.coalesce(per_allele_int(svlen, i).cast("string"), F.lit("-")))), lambda x: x.isNotNull()
    )
    copies = F.when(F.exists(fmt, lambda e: e["key"] == "CN") & (F.size(F.array_distinct(lengths)) > 1), F.array(_fault("CnSvlenMismatch"))).otherwise(none)
    return F.concat(malformed, padding, structural, calls, F.flatten(F.transform(fmt, sampled)), some(F.transform(entries, informed)), copies)


def decoded(records: DataFrame, n_samples: int, max_ploidy: int | Column) -> DataFrame:
    """What a parser should find in each record: calls padded with -1, phasing, per-allele truth, values by key."""
    gt = F.coalesce("gt", F.array_repeat(F.lit(None).cast("string"), n_samples))
    width = F.lit(max_ploidy) if isinstance(max_ploidy, int) else max_ploidy
    numbers = lambda g: F.transform(F.coalesce(G.parse_genotype(g)["alleles"], F.array().cast("array<bigint>")), lambda a: F.coalesce(a, F.lit(-1)).cast("int"))
    padded = F.transform(gt, lambda g: F.slice(F.concat(numbers(g), F.array_repeat(F.lit(-1), width)), F.lit(1), width))
    return records.withColumn("alts_truth", allele_truth()).select(
        "rec_id", "chrom", "pos", "ref", "alts", A.record_class("ref", "alts").alias("variant_class"), padded.alias("genotypes"), F.transform(gt, lambda g: F.coalesce(G.is_phased(g), F.lit(False))).alias("phasing"),
        F.map_from_entries(F.transform("info", lambda e: F.struct(e["key"], e["value"]))).alias("info"),
        F.map_from_entries(F.transform("fmt", lambda e: F.struct(e["key"], e["per_sample"]))).alias("format"),
        "labels", "alts_truth", F.transform("alts", lambda a: F.coalesce(A.allele_kind(a) == "SEQ", F.lit(False))).alias("is_sequence"),
    )


def allele_truth() -> Column:
    """Per ALT: ``kind, is_sequence, sv_type, svlen`` (absolute) and ``sv_end`` for types that span the reference."""
    svlen = entry(F.col("info"), "SVLEN")

    def one(a: Column, i: Column) -> Column:
        symbolic = A.allele_kind(a) == "SYMBOLIC"
        length = F.when(symbolic, F.abs(per_allele_int(svlen, i)))
        return F.struct(
            A.truth_kind(F.col("ref"), a).alias("kind"), (A.allele_kind(a) == "SEQ").alias("is_sequence"), A.symbolic_type(a).alias("sv_type"), length.alias("svlen"),
            F.when(A.symbolic_first(a).isin(*A.SPANNING), F.col("pos") + length).alias("sv_end"),
        )

    return F.transform("alts", one)


def record_line() -> Column:
    """A record's line; FORMAT and sample columns only if it has FORMAT keys."""
    keys = F.concat(F.when(F.col("gt").isNotNull(), F.array(F.lit("GT"))).otherwise(F.array().cast("array<string>")), F.transform("fmt", lambda e: e["key"]))
    n = F.greatest(F.coalesce(F.size("gt"), F.lit(0)), F.coalesce(F.array_max(F.transform("fmt", lambda e: F.size(e["per_sample"]))), F.lit(0)))

    def sample(i: Column) -> Column:
        own = F.transform("fmt", lambda e: F.coalesce(value_text(F.get(e["per_sample"], i)), F.lit("1")))
        return F.array_join(F.concat(F.when(F.col("gt").isNotNull(), F.array(F.get("gt", i))).otherwise(F.array().cast("array<string>")), own), ":")

    info = F.transform("info", lambda e: F.struct(e["key"].alias("key"), value_text(e["value"]).alias("value")))
    fixed = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), T.or_dot("ids", ";"), "ref", T.or_dot("alts", ","), F.coalesce(T.format_float("qual"), F.lit(".")), T.filter_text("filters"), T.info_text(info),
    )
    samples = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), sample)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(keys) == 0, fixed).otherwise(F.concat_ws("\t", fixed, F.array_join(keys, ":"), samples))


def auto_alt_definitions(records: DataFrame, given: dict[str, str]) -> DataFrame:
    """``id, description`` of symbolic types in order of first use; given descriptions replace made ones in place, others follow."""
    used = records.select("rec_id", F.posexplode("alts").alias("i", "alt")).select("rec_id", "i", A.symbolic_type("alt").alias("id")).where("id is not null")
    first = used.groupBy("id").agg(F.min(F.struct("rec_id", "i")).alias("first"))
    own = first.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(given.items())], "id string, given string, place int")
    both = first.join(F.broadcast(own), "id", "full")
    text = F.coalesce("given", F.concat("id", F.lit(" structural variant")))
    return both.orderBy(F.col("first").asc_nulls_last(), "place").select("id", text.alias("description"))


# -- documents


@dataclass
class Document:
    version: str
    samples: list[str]
    contigs: list[tuple[str, int | None]]
    info_defs: list[D.FieldDef]
    format_defs: list[D.FieldDef]
    filter_defs: list[tuple[str, str]]
    alt_defs: list[tuple[str, str]]
    records: DataFrame

    def header_lines(self) -> list[str]:
        lines = [f"##fileformat={self.version}"]
        lines += [f"##contig=<ID={i}{'' if n is None else f',length={n}'}>" for i, n in self.contigs]
        lines += [d.header_line() for d in self.info_defs]
        lines += [f'##FILTER=<ID={i},Description="{d}">' for i, d in self.filter_defs]
        lines += [d.header_line() for d in self.format_defs]
        lines += [f'##ALT=<ID={i},Description="{d}">' for i, d in self.alt_defs]
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
        sampled = bool(self.format_defs) or not self.records.where(F.col("gt").isNotNull() | (F.size("fmt") > 0)).isEmpty()
        return [*lines, "\t".join(columns + (["FORMAT", *self.samples] if sampled else []))]

    def lines(self) -> DataFrame:
        """``rec_id, line``."""
        return self.records.select("rec_id", record_line().alias("line"))

    def render(self) -> str:
        """The whole text, for documents that fit the driver; ``write`` does without."""
        return "\n".join([*self.header_lines(), *(r[0] for r in self.lines().orderBy("rec_id").select("line").collect())]) + "\n"

    def write(self, path: str | Path, bgzip: bool = False, index: bool = False) -> Path:
        from ..sources.writers import write_document

        return write_document(self, path, bgzip or index, index)

    def max_ploidy(self) -> int:
        found = self.records.select(F.explode("gt").alias("g")).agg(F.max(G.ploidy("g"))).first()[0]
        return max(1, found or 1)

    def truth(self) -> DataFrame:
        return decoded(self.records, len(self.samples), self.max_ploidy())


@dataclass
class VcfBuilder:
    """Gathers declarations and records; everything is checked in ``build``."""

    spark: SparkSession
    samples: Sequence[str] = ()
    contigs: Sequence[tuple[str, int | None]] = ()
    version: str = "VCFv4.5"
    infos: list[Field] = field(default_factory=list)
    formats: list[Field] = field(default_factory=list)
    filters: list[tuple[str, str]] = field(default_factory=list)
    alts: dict[str, str] = field(default_factory=dict)
    specs: list[RecordSpec] = field(default_factory=list)

    def info(self, declared: Field | str) -> VcfBuilder:
        self.infos.append(Field.reserved(declared) if isinstance(declared, str) else declared)
        return self

    def format(self, declared: Field | str) -> VcfBuilder:
        self.formats.append(Field.reserved(declared) if isinstance(declared, str) else declared)
        return self

    def filter(self, id: str, description: str) -> VcfBuilder:
        self.filters.append((id, description))
        return self

    def alt(self, id: str, description: str) -> VcfBuilder:
        self.alts[id] = description
        return self

    def record(self, spec: RecordSpec) -> VcfBuilder:
        self.specs.append(spec)
        return self

    def build(self) -> Document:
        """Raises FieldError for a declaration, BuildError for the first record with a fault, by its first fault."""
        info = list({d.id: d for d in (f.resolve("INFO", self.version) for f in self.infos)}.values())  # the last one wins, in the first one's place
        formats = list({d.id: d for d in (f.resolve("FORMAT", self.version) for f in self.formats)}.values())
        records = self.spark.createDataFrame([s.row(i) for i, s in enumerate(self.specs)], SCHEMA)
        faults = records.select("rec_id", F.get(record_faults(self.version, len(self.samples), info, formats), F.lit(0)).alias("fault")).where("fault is not null")
        if first := faults.orderBy("rec_id").first():
            raise BuildError(first["fault"]["code"], first["rec_id"], first["fault"]["detail"])
        alts = [(r["id"], r["description"]) for r in auto_alt_definitions(records, self.alts).collect()]
        return Document(self.version, list(self.samples), [c if isinstance(c, tuple) else (c, None) for c in self.contigs], info, formats, list(self.filters), alts, records)

    def render(self) -> str:
        return self.build().render()

    def write(self, path: str | Path, bgzip: bool = False, index: bool = False) -> Path:
        return self.build().write(path, bgzip, index)

    def truth(self) -> DataFrame:
        return self.build().truth()
