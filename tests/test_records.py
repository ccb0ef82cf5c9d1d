"""Documents: rendering, checks in order, decoding, files."""

import gzip

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lociforge.functions.fields import FieldError
from lociforge.operators.records import BuildError, Field, FieldValue, RecordSpec, VcfBuilder
from lociforge.operators.reference import ReferenceBuilder
from lociforge.sources import bgzf, vcf


def builder(spark, samples=("s1", "s2"), version="VCFv4.5"):
    return VcfBuilder(spark, samples, [("chr1", 100_000)], version)


def at(pos=100, ref="A", alts=("T",)):
    return RecordSpec.at("chr1", pos).ref_(ref).alt(alts)


def test_minimal_document(spark):
    text = builder(spark).info("AF").format("GT").record(at(1000).gt(["0|1", "1|1"]).info("AF", [0.25])).render()
    assert text == (
        '##fileformat=VCFv4.5\n##contig=<ID=chr1,length=100000>\n##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n'
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t1000\t.\tA\tT\t.\t.\tAF=0.25\tGT\t0|1\t1|1\n"
    )


def test_rendering(spark):
    b = builder(spark).info("DP").info("AF").info(Field.flag("SOMATIC")).info(Field.typed("NOTE", "1", "String").description("n")).format("GT").format("AD").filter("q10", "low")
    b.record(at().ids(["rs1", "rs2"]).qual(29.5).filter([]).info("DP", 42).info("SOMATIC").info("NOTE", "a;b").gt(["0/1", "./."]).format("AD", [[3, 4], [None, 5]]))
    b.record(at(200).filter(["q10"]).info("AF", [0.5]))
    b.record(RecordSpec.at("chr1", 300).ref_("A"))
    doc = b.build()
    lines = doc.render().splitlines()
    assert lines[-3].split("\t")[2:] == ["rs1;rs2", "A", "T", "29.5", "PASS", "DP=42;SOMATIC;NOTE=a%3Bb", "GT:AD", "0/1:3,4", "./.:.,5"]
    assert lines[-2].split("\t")[5:] == [".", "q10", "AF=0.5"]
    assert lines[-1].split("\t")[4:] == [".", ".", ".", "."]
    assert [x.split("=")[0] for x in lines if x.startswith("##")] == ["##fileformat", "##contig", "##INFO", "##INFO", "##INFO", "##INFO", "##FILTER", "##FORMAT", "##FORMAT"]


def test_structural_headers_and_truth(spark):
    b = builder(spark, version="VCFv4.4").info("SVLEN").info("SVCLAIM").format("GT").alt("DEL", "mine").alt("CNV", "other")
    b.record(at(100, alts=["<INS>"]).info("SVLEN", [50]).info("SVCLAIM", ["J"]).gt(["0", "1"]))
    b.record(at(100, alts=["<DEL>", "G]chr2:321]"]).info("SVLEN", [-250, None]).info("SVCLAIM", ["D", None]).gt(["0|1", "./2"]))
    doc = b.build()
    assert doc.alt_defs == [("INS", "INS structural variant"), ("DEL", "mine"), ("CNV", "other")]
    truth = doc.truth().orderBy("rec_id").collect()
    assert truth[0]["genotypes"] == [[0, -1], [1, -1]] and truth[1]["genotypes"] == [[0, 1], [-1, 2]]
    assert truth[1]["phasing"] == [True, False] and truth[0]["phasing"] == [False, False]
    assert [a["kind"] for a in truth[1]["alts_truth"]] == ["SYMBOLIC", "BND"] and truth[1]["variant_class"] == "MULTIALLELIC"
    assert (truth[1]["alts_truth"][0]["svlen"], truth[1]["alts_truth"][0]["sv_end"]) == (250, 350)
    assert truth[0]["alts_truth"][0]["sv_end"] is None and truth[0]["is_sequence"] == [False]


FAULTS = [
    ("BadAlleleBases", at(alts=["xyz"])), ("BadBreakend", at(alts=["T[chr2["])), ("BadSvType", at(alts=["<NO>"])), ("MissingRefPadding", at(ref="AC", alts=["<DEL>"])), ("MissingRefPadding", at(ref="AC", alts=["A."])),
    ("MissingSvlen", at(alts=["<DEL>"])), ("BadSvclaim", at(alts=["<CNV>"]).info("SVLEN", [5]).info("SVCLAIM", ["J"])), ("SvclaimRequired", at(alts=["<DUP>"]).info("SVLEN", [5])), ("SvlenMustBeMissing", at(alts=["*"]).info("SVLEN", [5])),
    ("SampleCountMismatch", at().gt(["0/1"])), ("BadGenotype", at().gt(["0/1", "0|x"])), ("AlleleIndexOutOfRange", at().gt(["0/1", "0/2"])), ("UndeclaredField", at().format("GQ", [1, 2])), ("SampleCountMismatch", at().format("AD", [[1, 2]])),
    ("Cardinality", at().format("AD", [[1, 2], [1, 2, 3]])), ("UndeclaredField", at().info("DP", 1)), ("Cardinality", at().info("AC", [1, 2])), ("Cardinality", at().gt(["0/1/1", "0"]).format("PL", [[1, 2, 3], [1, 2, 3]])),
    ("CnSvlenMismatch", at(alts=["<DEL>", "<CNV>"]).info("SVLEN", [5, 6]).info("SVCLAIM", ["D", "D"]).format("CN", [1, 2])),
]


@pytest.mark.parametrize(("code", "spec"), FAULTS, ids=[f"{c}{i}" for i, (c, _) in enumerate(FAULTS)])
def test_faults(spark, code, spec):
    b = builder(spark).record(at(1))
    for f in ("SVLEN", "SVCLAIM", "AC"):
        b.info(f)
    for f in ("GT", "AD", "PL", "CN"):
        b.format(f)
    b.record(spec).record(at(3, alts=["bad"]))
    with pytest.raises(BuildError) as bad:
        b.build()
    assert (bad.value.code, bad.value.index) == (code, 1)


def test_other_checks(spark):
    with pytest.raises(BuildError) as bad:
        builder(spark).record(at().gt(["0/1", "0/1"])).build()
    assert bad.value.code == "GtNotDeclared"
    with pytest.raises(FieldError):
        builder(spark, version="VCFv4.3").info("SVCLAIM").build()
    # lone values aren't checked for length, the last declaration wins in the first one's place, declarations may come late
    doc = builder(spark).record(at().info("AC", 5)).info("AC").info("DP").info(Field.typed("AC", "2", "Integer")).build()
    assert [d.number for d in doc.info_defs] == ["2", "1"]
    builder(spark, version="VCFv4.3").info("SVLEN").record(at(alts=["<DEL>"]).info("SVLEN", [5])).build()
    assert FieldValue.of([1, None]).list_len() == 2 and FieldValue.of(1).list_len() is None


def test_files(spark, tmp_path):
    b = builder(spark).format("GT")
    for k in range(3000):
        b.record(at(1 + 37 * k, ref="ACG" if k % 5 == 0 else "A").gt(["0|1", "./."]))
    doc = b.build()
    text = doc.render()
    assert doc.write(tmp_path / "a.vcf").read_text() == text
    path = doc.write(tmp_path / "b.vcf", bgzip=True, index=True)
    assert path.name == "b.vcf.gz" and gzip.decompress(path.read_bytes()).decode() == text
    found = vcf.read_vcf(spark, str(path)).collect()
    assert len(found) == 3000 and found[0]["samples"] == ["0|1", "./."]
    (bins,) = bgzf.read_csi(tmp_path / "b.vcf.gz.csi")
    data = path.read_bytes()
    lines = []
    for begin, end in sorted(c for chunks in bins.values() for c in chunks):
        whole = bgzf.decompress(data[begin >> 16 :])
        size = sum(bgzf.MEMBER for _ in ()) + len(bgzf.decompress(data[begin >> 16 : end >> 16])) + (end & 0xFFFF) - (begin & 0xFFFF)
        lines += whole[begin & 0xFFFF : (begin & 0xFFFF) + size].decode().splitlines()
    assert sorted(lines) == sorted(x for x in text.splitlines() if not x.startswith("#"))


GTS = st.lists(st.one_of(st.none(), st.integers(0, 2)), min_size=1, max_size=3)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 9999), st.lists(GTS, min_size=2, max_size=2), st.booleans(), st.sampled_from([("A", "T", "AG"), ("AC", "GT", "*"), ("A", "C", "<*>")])), min_size=1, max_size=5))
def test_a_parser_finds_the_truth(spark, rows):
    """An independent reading of the rendered text gives the decoded calls, phases and padding."""
    b = builder(spark).format("GT")
    for pos, calls, bar, (ref, *alts) in rows:
        b.record(at(pos, ref, alts).gt([("|" if bar else "/").join("." if a is None else str(a) for a in c) for c in calls]))
    doc = b.build()
    truth = doc.truth().orderBy("rec_id").collect()
    lines = [x.split("\t") for x in doc.render().splitlines() if not x.startswith("#")]
    width = max(1, max(len(c) for _, calls, _, _ in rows for c in calls))
    assert len(truth) == len(lines) == len(rows)
    for t, line in zip(truth, lines, strict=True):
        assert (t["chrom"], t["pos"], t["ref"], ",".join(t["alts"])) == (line[0], int(line[1]), line[3], line[4])
        for own, phase, cell in zip(t["genotypes"], t["phasing"], line[9:], strict=True):
            got = [-1 if x == "." else int(x) for x in cell.replace("|", "/").split("/")]
            assert own == got + [-1] * (width - len(got)) and phase == ("|" in cell)


def test_reference(spark, tmp_path):
    b = ReferenceBuilder(7).add_contig("c1", 130).add_contig("c2", 5)
    b.set_base("c1", 0, "N").set_seq("c1", 3, "ACGT").tandem_repeat("c1", 10, "CAG", 4)
    spec = b.build()
    assert (spec.base("c1", 0), spec.seq("c1", 3, 4), spec.seq("c1", 10, 12), spec.length("c1")) == ("N", "ACGT", "CAGCAGCAGCAG", 130)
    assert ReferenceBuilder(7).add_contig("c2", 5).build().contigs["c2"] == spec.contigs["c2"]
    for wrong, code in ((lambda: b.add_contig("c1", 1), "ContigExists"), (lambda: b.set_seq("c2", 3, "AAA"), "OutOfBounds"), (lambda: b.set_base("c9", 0, "A"), "ContigNotFound"), (lambda: b.set_base("c1", 0, "AA"), "BadAlleleBases"), (lambda: spec.seq("c2", 4, 2), "OutOfBounds")):
        with pytest.raises(BuildError) as bad:
            wrong()
        assert bad.value.code == code
    text = spec.write(tmp_path / "r.fa").read_text()
    assert [len(x) for x in text.splitlines()] == [3, 60, 60, 10, 3, 5]
    assert gzip.decompress(spec.write(tmp_path / "r.fa.bgz", bgzip=True).read_bytes()).decode() == text
