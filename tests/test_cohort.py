"""Cohort statistics, generation and the loop between them."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge import cli
from lociforge.operators import cohort, generate, sizing, summary
from lociforge.operators import histograms as H
from lociforge.operators.sizing import Size, SpecError
from lociforge.sources import bcf, bgzf, vcf
from lociforge.sources.profiles import Profile, ProfileError, read_profiles, write_profile
from lociforge.sources.writers import write_cohort


def variants(spark, rows):
    return spark.createDataFrame([(c, p, ".", r, a) for c, p, r, a in rows], "chrom string, pos bigint, id string, ref string, alt string")


def test_histograms(spark):
    rng = np.random.default_rng(1)
    values = [*rng.uniform(-1, 12, 500).tolist(), 0.0, 10.0, 2.5]
    for edges in ([0, 1, 2.5, 10], [0, 10]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        with pytest.warns(UserWarning):
            assert H.collected(H.binned(df, F.col("v"), edges), edges) == H.histogram(values, edges)
    assert H.sfs_edges(3) == [1, 2, 4, 6] and H.sfs_edges(1) == [1, 2] and H.sfs_edges(4) == [1, 2, 4, 8]
    assert len(H.gap_edges()) == 25 and H.gap_edges()[-1] == pytest.approx(1e5)
    for bad in (lambda: H.Edges([1]), lambda: H.Edges([1, 1]), lambda: H.Edges.geometric(5, 1, 3), lambda: H.sfs_edges(0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        H.histogram([50], [0, 1])


def test_variant_stats(spark):
    rows = variants(spark, [("1", 100, "A", "AG,ATT"), ("1", 250, "A", "C"), ("1", 251, "A", "G"), ("1", 251, "A", "T"), ("2", 5, "AT", "A"), ("2", 30, "C", "T")])
    stats = cohort.variant_stats(rows)
    assert stats["class_counts"] == {"snp": 4, "insertion": 2, "deletion": 1, "mnp": 0, "complex": 0, "symbolic": 0}
    assert stats["titv"] == 1 and stats["multiallelic_rate"] == pytest.approx(1 / 6)
    assert [c["id"] for c in stats["contigs"]] == ["1", "2"] and stats["contigs"][0]["density_per_kb"] == pytest.approx(4 / 0.151)
    assert sorted(r["gap"] for r in cohort.gaps(rows).collect()) == [1, 25, 150]
    assert sorted(r["gap"] for r in cohort.gaps(rows, stretch=50).collect()) == [1, 25, 150]
    with pytest.raises(ValueError):
        cohort.titv_value(3, 3)
    with pytest.raises(ValueError):
        cohort.assert_sorted(variants(spark, [("1", 200, "A", "C"), ("1", 100, "A", "C")]).coalesce(1).withColumn("line", F.monotonically_increasing_id()), "line")


def test_order_of_the_scan(spark):
    """Within a task's rows and across tasks."""
    cohort.assert_sorted(variants(spark, [("1", p, "A", "C") for p in range(50)] + [("2", p, "A", "C") for p in range(50)]).coalesce(1))
    for positions in ([5, 9, 7, 8, 9, 10, 11, 12], [50, 60, 70, 80, 10, 20, 30, 40]):
        rows = spark.sparkContext.parallelize([("1", p) for p in positions], 4).toDF("chrom string, pos bigint")
        with pytest.raises(ValueError):
            cohort.assert_sorted(rows)
    cohort.assert_sorted(spark.sparkContext.parallelize([("1", p) for p in range(40)], 4).toDF("chrom string, pos bigint"))


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.pvar").write_text("##x\n##y\n#CHROM\tPOS\tID\tREF\tALT\tINFO\n1\t10\t.\tA\tG\t.\n22\t20\t.\tC\tT,G\t.\n")
    assert vcf.count_meta_lines(spark, str(tmp_path / "a.pvar")) == 2
    assert [tuple(r) for r in vcf.read_variants(spark, str(tmp_path / "a.pvar")).collect()] == [("1", 10, ".", "A", "G"), ("22", 20, ".", "C", "T,G")]
    (tmp_path / "a.acount").write_text("#CHROM\tID\tREF\tALT\tALT_CTS\tOBS_CT\n1\t.\tA\tG\t1\t6\n1\t.\tA\tG,T\t2,3\t6\n")
    assert H.collected(cohort.sfs_histogram(cohort.split_allele_counts(vcf.read_allele_counts(spark, str(tmp_path / "a.acount"))), "ac", 3), H.sfs_edges(3)) == {"edges": [1, 2, 4, 6], "weights": [1 / 3, 2 / 3, 0]}
    (tmp_path / "a.vmiss").write_text("#CHROM\tID\tMISSING_CT\tOBS_CT\tF_MISS\n1\t.\t1\t4\t.25\n1\t.\t0\t4\t0\n")
    assert cohort.missing_rate(vcf.read_missing_counts(spark, str(tmp_path / "a.vmiss"))).first()[0] == 1 / 8
    (tmp_path / "a.psam").write_text("#IID\tSEX\ns1\t1\n\ns2\t2\n")
    assert vcf.count_samples(spark, str(tmp_path / "a.psam")) == 2
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    (tmp_path / "s.vcf").write_text(head + "".join(f"21\t{p}\trs\t{r}\t{a}\t.\t{f}\tAN={n};AC={c};XAC=9\n" for p, r, a, f, c, n in ((100, "A", "G", "PASS", 1, 8), (120, "A", "G", "VQSR", 3, 8), (150, "A", "C", "PASS", 50, 6), (180, "AT", "A", "PASS", 2, 8))))
    assert [(r["pos"], r["ac"], r["an"]) for r in vcf.read_sites(spark, str(tmp_path / "s.vcf"), ["21"]).collect()] == [(100, 1, 8), (150, 50, 6), (180, 2, 8)]
    with pytest.warns(UserWarning):
        assert cli.main(["fit", "--sites-vcf", str(tmp_path / "s.vcf"), "--n-samples", "4", "--phased-rate", "0.5", "--name", "t", "-o", str(tmp_path / "out/p.json")]) == 0
    made = json.loads((tmp_path / "out/p.json").read_text())
    assert made["provenance"]["supplied"] == ["n_samples", "phased_rate", "ploidy"] and made["fitted"]["missing_rate"] == pytest.approx(1 - 22 / 3 / 8)


def test_genotyped_fit(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n"
    rows = [("1", 100, "A", "G,T", ["1/2", "0/0", "0|1"]), ("1", 200, "C", "T", ["0/1", "./.", "0|0"]), ("1", 300, "AT", "A", ["0/0", "0/1", "1|1"])]
    (tmp_path / "g.vcf").write_text(head + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\t.\t.\tGT:DP\t" + "\t".join(f"{g}:7" for g in gs) + "\n" for c, p, r, a, gs in rows))
    p = cohort.fit_genotyped(vcf.read_vcf(spark, str(tmp_path / "g.vcf")), 3, "g", "test")
    f = p["fitted"]
    assert f["variant_classes"]["snp"] == 0.75 and f["variant_classes"]["deletion"] == 0.25 and f["multiallelic_rate"] == pytest.approx(1 / 3)
    assert f["missing_rate"] == pytest.approx(1 / 9) and f["phased_rate"] == pytest.approx(3 / 9) and f["sfs"]["weights"] == [0.5, 0.5, 0.0]


def test_profiles(spark, tmp_path):
    for name in ("germline-1kgp", "germline-1kgp-unphased", "somatic-gdc"):
        p = Profile.builtin(name)
        write_profile(p, tmp_path / f"{name}.json")
        assert Profile.resolve(str(tmp_path / f"{name}.json")) == p
    assert read_profiles(spark, str(tmp_path)).count() == 3
    p = Profile.builtin("germline-1kgp")
    for change, code in (
        (lambda f, d: f["gap_dist"]["weights"].append(1), "InvalidProfile"), (lambda f, d: f["sfs"]["weights"].__setitem__(0, float("nan")), "InvalidProfile"), (lambda f, d: f["variant_classes"].update(snp=0.1), "InvalidProfile"),
        (lambda f, d: f.update(missing_rate=1.5), "InvalidProfile"), (lambda f, d: f.update(contigs=[]), "InvalidProfile"), (lambda f, d: d.update(ploidy=3, payload="gatk"), "PayloadPloidy"), (lambda f, d: d.update(ploidy=0), "InvalidProfile"),
    ):
        q = Profile.from_json(p.to_json())
        change(q.fitted, q.dialed)
        with pytest.raises(ProfileError) as bad:
            q.validate()
        assert bad.value.code == code
    for call, code in ((lambda: Profile.builtin("x"), "UnknownProfile"), (lambda: Profile.from_json("{}"), "ProfileParse"), (lambda: Profile.resolve("/nowhere"), "ProfileLoad")):
        with pytest.raises(ProfileError) as bad:
            call()
        assert bad.value.code == code


def test_sizing():
    assert [sizing.parse_size(x) for x in ("100MB", "512KB", " 1GB", "7")] == [100 << 20, 512 << 10, 1 << 30, 7]
    for bad in ("", "1.5MB", "MB", "-1", "1mb"):
        with pytest.raises(SpecError):
            sizing.parse_size(bad)
    assert sizing.parse_records_for(["b=2", " a = 0 "]) == [("b", 2), ("a", 0)]
    for bad in (["a"], ["=1"], ["a=1", "a=2"], ["a=x"]):
        with pytest.raises(SpecError):
            sizing.parse_records_for(bad)
    assert sizing.apportion([6, 2, 1], 900) == [600, 200, 100] and sizing.apportion([0, 0, 0], 5) == [2, 2, 1] and sum(sizing.apportion([1, 1, 1], 100)) == 100
    stats = [{"id": "1", "n_variants": 5}, {"id": "chr1", "n_variants": 7}, {"id": "X", "n_variants": 9}]
    assert [sizing.contig_stat(stats, i, n)["n_variants"] for i, n in enumerate(["chr1", "CHR1", "chrX", "zz", "yy"])] == [7, 5, 9, 5, 7]
    with pytest.raises(SpecError) as bad:
        sizing.named_counts({"a": 1}, ["a", "b"])
    assert bad.value.code == "PerContigMissing"
    with pytest.raises(SpecError) as bad:
        sizing.named_counts({"a": 1, "c": 2}, ["a"])
    assert bad.value.code == "PerContigUnknown"


def spec(**changes):
    return generate.CohortSpec(Profile.builtin("germline-1kgp"), 8, ("chr1", "chr2"), Size.records(2400), seed=42).with_(**changes)


def rows_of(spark, s):
    return [tuple(map(str, r)) for r in generate.generate(spark, s).orderBy("contig_idx", "local_block", "rec_idx").collect()]


def test_generation_depends_on_the_request_only(spark):
    base = rows_of(spark, spec(partitions=1))
    assert base == rows_of(spark, spec(partitions=7)) and base != rows_of(spark, spec(seed=1)) and len({r[2] for r in base}) >= 2
    positions = lambda rows: [(r[1], r[4]) for r in rows]
    assert positions(base) == positions(rows_of(spark, spec(payload="gatk", n_samples=20)))
    assert all(int(b[4]) > int(a[4]) for a, b in zip(base, base[1:], strict=False) if a[1] == b[1])


@pytest.mark.parametrize("payload", ["gt-only", "gt-vaf", "gatk", "mutect2"])
def test_files_agree(spark, tmp_path, payload):
    sums = {}
    for form in ("bcf", "vcf-gz", "vcf"):
        path = tmp_path / f"x.{form}"
        sums[form] = write_cohort(spark, spec(payload=payload, format=form, partitions=3), path)
        assert json.loads((tmp_path / f"x.{form}.summary.json").read_text())["genotype_checksum"] == sums[form].genotype_checksum
    assert sums["bcf"] == sums["vcf"] == sums["vcf-gz"] and sums["bcf"].n_records_total() == 2400
    text = (tmp_path / "x.vcf").read_text()
    assert gzip.decompress((tmp_path / "x.vcf-gz").read_bytes()).decode() == text
    lines, records = bcf.read_records(bgzf.decompress((tmp_path / "x.bcf").read_bytes()))
    body = [x.split("\t") for x in text.splitlines() if not x.startswith("#")]
    assert lines == [x for x in text.splitlines() if x.startswith("#")] and len(records) == len(body) == 2400
    for r, x in zip(records, body, strict=True):
        assert (r["chrom"], str(r["pos"]), r["ref"], ",".join(r["alts"])) == (x[0], x[1], x[3], x[4])
        assert ["|".join(map(str, c)) if r["phased"] else "/".join(map(str, c)) for c in r["calls"].tolist()] == [c.split(":")[0].replace(".", "-1") for c in x[9:]]
    bins = bgzf.read_csi(tmp_path / "x.bcf.csi")
    data = (tmp_path / "x.bcf").read_bytes()
    for contig, own in zip(("chr1", "chr2"), bins, strict=True):
        spans = []
        for begin, end in sorted(c for chunks in own.values() for c in chunks):
            plain = bgzf.decompress(data[begin >> 16 : end >> 16] or b"")
            tail = bgzf.decompress(data[end >> 16 :])[: end & 0xFFFF] if end & 0xFFFF else b""
            spans.append((plain + tail)[begin & 0xFFFF :])
        _, found = bcf.read_records(bcf.file_header(lines) + b"".join(spans))
        assert sorted(r["pos"] for r in found) == sorted(int(x[1]) for x in body if x[0] == contig) and {r["chrom"] for r in found} == {contig}
    spans = [int(x.split("length=")[1].rstrip(">")) for x in lines if x.startswith("##contig")]
    assert spans == [max(int(x[1]) for x in body if x[0] == c) for c in ("chr1", "chr2")]
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith(".")) == []


def test_generated_values(spark):
    p = Profile.builtin("germline-1kgp")
    p.fitted["missing_rate"] = 0.3
    s = generate.CohortSpec(p, 50, ("c",), Size.records(1500), seed=3)
    rows = generate.generate(spark, s).collect()
    for r in rows:
        g = np.array(r["gts"]).reshape(50, 2)
        assert ((g[:, 0] == -1) == (g[:, 1] == -1)).all() and (g == 1).sum() >= 1
        ref, alt = r["ref"], r["alts"][0]
        assert {"snp": len(ref) == len(alt) == 1 and ref != alt, "insertion": alt.startswith(ref) and len(alt) > 1, "deletion": ref.startswith(alt) and len(ref) > 1, "mnp": len(ref) == len(alt) > 1, "complex": len(ref) != len(alt), "symbolic": alt == "<DEL>"}[r["class"]]
    assert abs(np.mean([np.mean(np.array(r["gts"]) == -1) for r in rows]) - 0.3) < 0.02
    data = np.array([-1, 0, 0, 1, 0, 2, -1, 0], np.int8)
    h = 0xCBF29CE484222325
    for b in data.view(np.uint8).tolist():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert summary.fnv1a(data) == h and summary.fnv1a(data[:0]) == 0xCBF29CE484222325


def test_sizes_of_files(spark, tmp_path):
    s = spec(size=Size.per_contig({"chr1": 30, "chr2": 0}), format="vcf")
    made = write_cohort(spark, s, tmp_path / "a.vcf")
    assert made.per_contig.keys() == {"chr1"} and "##contig=<ID=chr2,length=1>" in (tmp_path / "a.vcf").read_text()
    write_cohort(spark, spec(size=Size.target(150_000)), tmp_path / "b.bcf")
    assert 150_000 <= (tmp_path / "b.bcf").stat().st_size < 190_000


def test_failures_leave_the_destination(spark, tmp_path):
    (tmp_path / "a.bcf").write_text("before")
    for bad in (spec(contigs=("c", "c")), spec(contigs=()), spec(n_samples=0), spec(compression_level=10)):
        with pytest.raises(SpecError):
            write_cohort(spark, bad, tmp_path / "a.bcf")
    assert (tmp_path / "a.bcf").read_text() == "before" and len(list(tmp_path.iterdir())) == 1


def test_samplers_follow_the_profile():
    p = Profile.builtin("germline-1kgp")
    s = generate.Samplers(p.fitted, 2 * 3202)
    rng = np.random.Generator(np.random.Philox(key=1))
    n = 20_000
    assert abs((s.allele_counts(rng, n, 6404) == 1).mean() - p.fitted["sfs"]["weights"][0]) < 0.02
    assert abs((s.classes(rng, n) == 0).mean() - p.fitted["variant_classes"]["snp"]) < 0.02
    refs, alts = generate.sites(rng, s, np.zeros(n, int))
    ts = np.mean([a + b in ("AG", "GA", "CT", "TC") for a, b in zip(refs, alts, strict=True)])
    assert abs(ts - p.fitted["titv"] / (p.fitted["titv"] + 1)) < 0.02 and s.gaps(rng, n).min() >= 1
    assert s.allele_counts(rng, n, 20).mean() / 20 < 0.15
    with pytest.raises(SpecError):
        generate.Samplers({**p.fitted, "titv": 0}, 1)


def test_the_loop_keeps_the_profile(spark, tmp_path):
    """Generate from a profile, fit what was made, compare."""
    p = Profile.builtin("germline-1kgp")
    p.provenance["n_samples_source"] = 100
    p.fitted["sfs"] = {"edges": H.sfs_edges(100), "weights": [0.5, 0.2, 0.1, 0.08, 0.05, 0.04, 0.02, 0.01]}
    s = generate.CohortSpec(p, 100, ("chr1", "chr2"), Size.records(6000), seed=5, format="vcf-gz")
    write_cohort(spark, s, tmp_path / "c.vcf.gz")
    assert cli.main(["fit", "--vcf", str(tmp_path / "c.vcf.gz"), "--name", "again", "-o", str(tmp_path / "p.json")]) == 0
    again = Profile.resolve(str(tmp_path / "p.json")).fitted
    assert abs(again["titv"] - p.fitted["titv"]) < 0.15 and abs(again["sfs"]["weights"][0] - 0.5) < 0.06 and again["phased_rate"] == p.fitted["phased_rate"]
    for c in ("snp", "insertion", "deletion"):
        assert abs(again["variant_classes"][c] - p.fitted["variant_classes"][c]) < 0.05


def test_commands(tmp_path, capsys):
    out = str(tmp_path / "x.vcf")
    assert cli.main(["bulk", "--samples", "2", "--records-for", "c1=5,c2=3", "--format", "vcf", "-o", out]) == 0
    assert [x.split("\t")[0] for x in open(out) if x[0] != "#"] == ["c1"] * 5 + ["c2"] * 3
    assert cli.main(["bulk", "--records-for", "c1=5", "--contigs", "c1,c2", "-o", str(tmp_path / "y.bcf")]) == 1
    assert cli.main(["bulk", "--target-size", "5xB", "-o", str(tmp_path / "y.bcf")]) == 1 and not (tmp_path / "y.bcf").exists()
    for wrong in (["bulk", "--records", "1", "--target-size", "1KB", "-o", "z"], ["bulk", "--threads", "0", "-o", "z"], ["fit", "--name", "n", "-o", "z"], ["fit", "--sites-vcf", "v", "--name", "n", "-o", "z"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
    (tmp_path / "p.json").write_text(Profile.builtin("somatic-gdc").to_json())
    assert cli.main(["validate-profile", str(tmp_path / "p.json")]) == 0 and "OK" in capsys.readouterr().out
    (tmp_path / "p.json").write_text("{}")
    assert cli.main(["validate-profile", str(tmp_path / "p.json")]) == 1


def test_long_headers_are_counted_to_their_end(spark, tmp_path):
    (tmp_path / "long.vcf").write_text("##contig=<ID=c>\n" * 10_500 + "#CHROM\tPOS\n##late\n")
    assert vcf.count_meta_lines(spark, str(tmp_path / "long.vcf")) == 10_500
