"""What the strategies draw is valid, and an independent reading of it finds the truth."""

from hypothesis import HealthCheck, given, settings

from lociforge import strategies as S
from lociforge.functions.fields import FieldDef

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def check(doc):
    truth = doc.truth().orderBy("rec_id").collect()
    lines = [x.split("\t") for x in doc.render().splitlines() if not x.startswith("#")]
    assert len(truth) == len(lines)
    for t, line in zip(truth, lines, strict=True):
        for own, phased, cell in zip(t["genotypes"], t["phasing"], line[9:], strict=True):
            gt = cell.split(":")[0]
            got = [-1 if x == "." else int(x) for x in gt.replace("|", "/").split("/")]
            assert own[: len(got)] == got and set(own[len(got) :]) <= {-1} and phased == ("|" in gt)


@QUICK
@given(S.documents(max_alt=3))
def test_documents(spark, plan):
    check(plan.builder(spark).build())


@QUICK
@given(S.documents_with_fields(max_alt=2))
def test_fields(spark, plan):
    doc = plan.builder(spark).build()
    check(doc)
    lines = [x.split("\t") for x in doc.render().splitlines() if not x.startswith("#")]
    for line in lines:
        info = dict(x.partition("=")[::2] for x in line[7].split(";"))
        assert list(info) == ["AF", "NS", "DB"] and len(info["AF"].split(",")) == len(line[4].split(",")) and info["DB"] == ""
        assert line[8] == "GT:GQ:AD" and all(len(c.split(":")[2].split(",")) == len(line[4].split(",")) + 1 for c in line[9:])


@QUICK
@given(S.symbolic_documents())
def test_symbolic(spark, plan):
    doc = plan.builder(spark).build()
    check(doc)
    for t, spec in zip(doc.truth().orderBy("rec_id").collect(), plan.specs, strict=True):
        (a,) = t["alts_truth"]
        assert a["kind"] == "SYMBOLIC" and not a["is_sequence"] and f"<{a['sv_type']}>" == spec.alts[0]
        assert a["sv_end"] == (None if spec.alts[0] == "<INS>" else spec.pos + a["svlen"])


@QUICK
@given(S.references_and_documents())
def test_refs_are_the_references(spark, drawn):
    ref, plan = drawn
    doc = plan.builder(spark).build()
    for r in doc.records.collect():
        assert ref.seq(r["chrom"], r["pos"] - 1, len(r["ref"])) == r["ref"]


def test_combos():
    combos = S.number_type_combos()
    assert len(combos) == len(set(combos)) == 49
    for number, type_, kind in combos:
        FieldDef(kind, "X", number, type_, "")
