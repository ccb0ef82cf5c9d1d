"""Scalar functions against tables and plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociforge.functions import alleles as A
from lociforge.functions import fields as D
from lociforge.functions import genotypes as G
from lociforge.functions import text as T


def column(spark, values, expr, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_allele_kinds(spark):
    want = {
        "*": "STAR", "<*>": "UNSPECIFIED", "<DEL>": "SYMBOLIC", "<DUP:TANDEM>": "SYMBOLIC", "T[chr2:5[": "BREAKEND", "]chr2:5]T": "BREAKEND", ".A": "BREAKEND", "A.": "BREAKEND", "ACGTN": "SEQ", "acgtn": "SEQ",
        "[HLA:A:1[G": "BREAKEND", "<UNKNOWN>": None, "<del>": None, "xyz": None, "": None, ".": None, "A.C": None, "T[chr2:5]": None, "T[chr2:5[A": None, "[chr2:5[": None, "T[chr2[": None, "T[:5[": None, "A\n": None, "<>": None,
    }
    assert column(spark, list(want), A.allele_kind) == list(want.values())
    errors = dict(zip(want, column(spark, list(want), A.allele_error), strict=True))
    assert (errors["<UNKNOWN>"], errors["xyz"], errors[""], errors["T[chr2[" ]) == ("BadSvType", "BadAlleleBases", "BadAlleleBases", "BadBreakend")
    good = [k for k, v in want.items() if v]
    assert column(spark, good, lambda v: A.render_allele(A.parse_allele(v))) == good
    assert A.symbolic("DUP", "TANDEM") == "<DUP:TANDEM>"
    with pytest.raises(ValueError):
        A.symbolic("BAD")


def test_classes(spark):
    pairs = [("A", "T"), ("AC", "GT"), ("A", "AT"), ("AT", "A"), ("AT", "C"), ("A", "*"), ("A", "<DEL>"), ("A", ".A"), ("A", "G]chr2:3]")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, a string").orderBy("i")
    got = rows.select(A.classify_sequence("r", "a"), A.fit_class("r", "a"), A.record_class(F.col("r"), F.array("a")), A.truth_kind("r", "a")).collect()
    assert [r[0] for r in got[:6]] == ["SNP", "MNP", "INS", "DEL", "DELINS", "SPANNING_DEL"]
    assert [r[1] for r in got] == ["snp", "mnp", "insertion", "deletion", "complex", "snp", "symbolic", "complex", "symbolic"]
    assert [r[2] for r in got[5:]] == ["SPANNING_DEL", "SV_DEL", "BND", "BND"]
    assert spark.range(1).select(A.record_class(F.lit("A"), F.array().cast("array<string>")), A.record_class(F.lit("A"), F.array(F.lit("C"), F.lit("G")))).first()[:] == ("MULTIALLELIC", "MULTIALLELIC")


def test_genotypes(spark):
    values = ["0|1", "1/1", "./.", "0", ".|1", "0/1|2", "0|x", "A/A", "", "0|", "+1/0", "4294967296"]
    parsed = column(spark, values, G.parse_genotype)
    assert [None if p is None else (p["alleles"], p["phased"]) for p in parsed] == [
        ([0, 1], [True]), ([1, 1], [False]), ([None, None], [False]), ([0], []), ([None, 1], [True]), ([0, 1, 2], [False, True]), None, None, None, None, ([1, 0], [False]), None,
    ]
    assert column(spark, values[:6], G.is_phased) == [True, False, False, False, True, False]
    assert column(spark, values[:6], lambda v: G.render_genotype(G.parse_genotype(v)["alleles"], G.parse_genotype(v)["phased"])) == values[:6]
    assert column(spark, values[:6], G.ploidy) == [2, 2, 2, 1, 2, 3]


def test_cardinality_and_order(spark):
    rows = spark.createDataFrame([("A", None, 2, 2), ("R", None, 2, 2), ("fixed", 1, 2, 2), ("dot", None, 2, 2), ("G", None, 2, 2), ("G", None, 2, 1), ("flag", None, 1, 2), ("G", None, 3, 4)], "k string, c int, n int, p int")
    assert [r[0] for r in rows.select(G.cardinality("k", "c", "n", "p")).collect()] == [2, 3, 1, None, 6, 3, 0, 35]
    assert G.genotype_order(2, 2) == [[0, 0], [0, 1], [1, 1]]
    assert G.genotype_order(2, 3) == [[0, 0], [0, 1], [1, 1], [0, 2], [1, 2], [2, 2]]
    with pytest.raises(ValueError):
        G.genotype_order(0, 2)


def test_registry(spark):
    assert D.reserved("SVLEN", "INFO", "VCFv4.4").number == "A" and D.reserved("SVLEN", "INFO", "VCFv4.3").number == "."
    for id, kind, version, code in (("SVCLAIM", "INFO", "VCFv4.3", "FieldTooNew"), ("LEN", "FORMAT", "VCFv4.1", "FieldTooNew"), ("NOPE", "INFO", "VCFv4.5", "UnknownReserved")):
        with pytest.raises(D.FieldError) as bad:
            D.reserved(id, kind, version)
        assert bad.value.code == code
    cases = [("INFO", "1000G", "0", "Flag", None), ("INFO", "1bad", "1", "Float", "BadFieldId"), ("FORMAT", "X", "0", "Flag", "FlagNotInfo"), ("INFO", "X", "1", "Flag", "FlagNumberNotZero"), ("INFO", "X", "0", "Integer", "ZeroNumberNotFlag")]
    for kind, id, number, type_, code in cases:
        if code is None:
            D.FieldDef(kind, id, number, type_, "")
        else:
            with pytest.raises(D.FieldError) as bad:
                D.FieldDef(kind, id, number, type_, "")
            assert bad.value.code == code
    rows = spark.createDataFrame([c[:4] for c in cases], "k string, i string, n string, t string")
    assert [r[0] for r in rows.select(D.declaration_error(*map(F.col, "kint"))).collect()] == [c[4] for c in cases]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(), min_size=1, max_size=40))
def test_floats_round_trip(spark, values):
    got = column(spark, values, T.format_float, "v double")
    for v, text in zip(values, got, strict=True):
        assert text == "." if not math.isfinite(v) else (float(text) == v and "e" not in text.lower())


def test_text(spark):
    values = [1.0, 0.0001, 1e7, -2.5, 0.1, 123456.789, 1e-10, 1e22, 0.0, -0.0, float("nan"), None]
    assert column(spark, values, T.format_float, "v double") == ["1", "0.0001", "10000000", "-2.5", "0.1", "123456.789", "0.0000000001", "10000000000000000000000", "0", "-0", ".", None]
    assert column(spark, ["a;b", "100%", "%3B", "x\t\r\n"], T.percent_encode) == ["a%3Bb", "100%25", "%253B", "x%09%0D%0A"]
    assert column(spark, ["A" * 60, "A" * 61, "", "ACG"], T.fasta) == ["A" * 60, "A" * 60 + "\nA", "", "ACG"]
    assert column(spark, ["A", "C", "G", "T", "N", "a"], lambda v: A.next_base(v, 1)) == ["C", "G", "T", "A", "C", "C"]
