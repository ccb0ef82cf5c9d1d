"""Synthetic cohorts from profiles.

Work is cut into blocks that are a property of the request alone: a contig's records, so many at a time. Each block has
two random streams, keyed by seed, block and purpose, so its positions don't depend on the cohort's width or payload and
nothing depends on how blocks are dealt to tasks. One pass draws the gaps only, for the blocks' spans; prefix sums place
the blocks; a second pass makes the records.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alleles import FIT_CLASSES
from ..sources.profiles import PAYLOADS, Profile
from .sizing import Size, SpecError, distribute, named_counts

#: Genotype cells and records in a block, at most.
BLOCK_CELLS, BLOCK_RECORDS = 4_000_000, 500
#: Block numbers that a contig may use.
STRIDE = 1_000_000
POSITION, CONTENT = 1, 2
PAYLOAD_KEYS = {"gt-only": ("GT",), "gt-vaf": ("GT", "VAF"), "gatk": ("GT", "AD", "DP", "GQ", "PL"), "mutect2": ("GT", "AD", "AF", "DP", "F1R2", "F2R1", "SB")}
FORMATS = ("bcf", "vcf-gz", "vcf")
_MASK = (1 << 64) - 1


def block_records(n_samples: int, ploidy: int) -> int:
    return min(BLOCK_RECORDS, max(1, BLOCK_CELLS // max(1, n_samples * max(1, ploidy))))


def mix(z: int) -> int:
    """The splitmix64 finalizer."""
    z &= _MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    return z ^ z >> 31


def block_rng(seed: int, block: int, stream: int) -> np.random.Generator:
    """A counter-based generator that depends on nothing but its three arguments."""
    return np.random.Generator(np.random.Philox(key=np.array([mix(seed), block << 2 | stream], np.uint64)))


class HistogramSampler:
    def __init__(self, histogram: dict):
        self.edges = np.asarray(histogram["edges"], float)
        weights = np.asarray(histogram["weights"], float)
        self.cdf = np.cumsum(weights / weights.sum())

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Values uniform in a bin drawn by weight; floored, they stay in their bin."""
        k = self.bins(rng.random(n))
        return self.within(k, rng.random(n))

    def bins(self, u: np.ndarray) -> np.ndarray:
        """The bin of each uniform number."""
        return np.minimum(np.searchsorted(self.cdf, u, "left"), len(self.cdf) - 1)

    def within(self, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The value at ``v`` of the way through bin ``k``."""
        return self.edges[k] + v * (self.edges[k + 1] - self.edges[k])


class Samplers:
    def __init__(self, fitted: dict, an_source: int):
        if fitted["titv"] <= 0:
            raise SpecError("InvalidProfile", "titv must be > 0")
        self.gap_hist, self.sfs, self.indel = (HistogramSampler(fitted[k]) for k in ("gap_dist", "sfs", "indel_length"))
        self.class_cdf = np.cumsum([fitted["variant_classes"][c] for c in FIT_CLASSES])
        self.transition = fitted["titv"] / (fitted["titv"] + 1)
        self.an_source = an_source

    def gaps(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return np.maximum(1, np.floor(self.gap_hist.draw(rng, n)).astype(np.int64))

    def allele_counts(self, rng: np.random.Generator, n: int, alleles: int) -> np.ndarray:
        """Drawn counts, scaled from the source's allele number to this cohort's; as they are where the two are equal."""
        raw = np.floor(self.sfs.draw(rng, n))
        if self.an_source and alleles != self.an_source:
            raw = np.floor(raw / self.an_source * alleles)
        return np.clip(raw, 1, max(1, alleles)).astype(np.int64)

    def indel_lengths(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return np.maximum(1, np.floor(self.indel.draw(rng, n)).astype(np.int64))

    def classes(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return np.minimum(np.searchsorted(self.class_cdf, rng.random(n), "left"), len(FIT_CLASSES) - 1)


_BASES = np.frombuffer(b"ACGT", np.uint8)
_TRANSITION = np.array([2, 3, 0, 1])  # A-G, C-T
_TRANSVERSIONS = np.array([[1, 3], [0, 2], [1, 3], [0, 2]])


def sites(rng: np.random.Generator, s: Samplers, classes: np.ndarray) -> tuple[list[str], list[str]]:
    """REF and the one ALT of each record."""
    n = len(classes)
    first = rng.integers(0, 4, n)
    turned = np.where(rng.random(n) < s.transition, _TRANSITION[first], _TRANSVERSIONS[first, rng.integers(0, 2, n)])
    lengths = s.indel_lengths(rng, n)
    bases = lambda k: _BASES[rng.integers(0, 4, k)].tobytes().decode()
    refs, alts = [chr(b) for b in _BASES[first]], [chr(b) for b in _BASES[turned]]
    for i in np.flatnonzero(classes):
        name, anchor = FIT_CLASSES[classes[i]], refs[i]
        if name == "insertion":
            alts[i] = anchor + bases(lengths[i])
        elif name == "deletion":
            refs[i], alts[i] = anchor + bases(lengths[i]), anchor
        elif name == "mnp":
            r = rng.integers(0, 4, rng.integers(2, 4))
            a = (r + rng.integers(1, 4, len(r))) % 4
            refs[i], alts[i] = _BASES[r].tobytes().decode(), _BASES[a].tobytes().decode()
        elif name == "complex":
            k = int(rng.integers(2, 5))
            refs[i], alts[i] = bases(k), bases([x for x in (2, 3, 4) if x != k][int(rng.integers(0, 2))])
        else:
            alts[i] = "<DEL>"
    return refs, alts


def calls(rng: np.random.Generator, counts: np.ndarray, n_samples: int, ploidy: int, missing_rate: float) -> np.ndarray:
    """[record, slot]: exactly ``counts`` alternate calls (at most as many as there are called slots) among the samples that aren't missing."""
    n, slots = len(counts), n_samples * ploidy
    out = np.zeros((n, slots), np.int8)
    missing = rng.random((n, n_samples), dtype=np.float32) < missing_rate if missing_rate > 0 else None
    if missing is not None:
        out[np.repeat(missing, ploidy, axis=1)] = -1
    for i, ac in enumerate(counts.tolist()):
        free = None if missing is None or not missing[i].any() else np.flatnonzero(out[i] == 0)
        room = slots if free is None else len(free)
        ac = min(ac, room)
        if ac == 1:
            chosen = rng.integers(0, room, 1)
        elif 2 * ac <= room:  # draw until enough are distinct, in the order of drawing
            chosen = np.zeros(0, np.int64)
            while len(chosen) < ac:
                drawn = np.concatenate([chosen, rng.integers(0, room, ac - len(chosen) + ac // 8 + 4)])
                _, at = np.unique(drawn, return_index=True)
                chosen = drawn[np.sort(at)][:ac]
        else:
            chosen = rng.permutation(room)[:ac]
        out[i, chosen if free is None else free[chosen]] = 1
    return out


@dataclass(frozen=True)
class Block:
    positions: np.ndarray
    refs: list[str]
    alts: list[str]
    classes: np.ndarray
    calls: np.ndarray
    phased: np.ndarray


@dataclass(frozen=True)
class CohortSpec:
    """A request: one sample, three contigs of 1000 records, the profile's payload, seed 0, BCF, level 6."""

    profile: Profile
    n_samples: int = 1
    contigs: tuple[str, ...] = ("chr1", "chr2", "chr3")
    size: Size = Size.records_per_contig(1000)
    payload: str | None = None
    seed: int = 0
    format: str = "bcf"
    partitions: int | None = None
    compression_level: int = 6

    def with_(self, **changes) -> CohortSpec:
        return replace(self, **changes)

    @property
    def effective_payload(self) -> str:
        return self.payload or self.profile.dialed["payload"]

    @property
    def ploidy(self) -> int:
        return self.profile.dialed["ploidy"]

    def validate(self) -> None:
        if self.effective_payload not in PAYLOADS or self.format not in FORMATS:
            raise SpecError("BadOption", f"{self.effective_payload}, {self.format}")
        self.profile.validate(self.effective_payload)
        if not self.contigs:
            raise SpecError("NoContigs")
        if self.n_samples < 1:
            raise SpecError("NoSamples")
        if twice := [c for i, c in enumerate(self.contigs) if c in self.contigs[:i]]:
            raise SpecError("DuplicateContig", twice[0])
        if not 0 <= self.compression_level <= 9:
            raise SpecError("BadCompressionLevel", str(self.compression_level))
        self.samplers()

    def samplers(self) -> Samplers:
        return Samplers(self.profile.fitted, 2 * self.profile.provenance["n_samples_source"])

    def counts(self) -> list[int]:
        """Records of each contig; a target size has none until it is searched for."""
        mode, value = self.size.mode, self.size.value
        if mode == "per_contig":
            return [value] * len(self.contigs)
        if mode == "records":
            return distribute(self.profile.fitted, self.contigs, value)
        if mode == "counts":
            return named_counts(value, self.contigs)
        raise SpecError("BadOption", "a target size is resolved by the writer")

    def block(self, number: int, n: int, offset: int) -> Block:
        """Block ``number`` of ``n`` records, after ``offset``."""
        s, fitted = self.samplers(), self.profile.fitted
        positions = offset + np.cumsum(s.gaps(block_rng(self.seed, number, POSITION), n))
        rng = block_rng(self.seed, number, CONTENT)
        classes = s.classes(rng, n)
        refs, alts = sites(rng, s, classes)
        counts = s.allele_counts(rng, n, self.n_samples * self.ploidy)
        made = calls(rng, counts, self.n_samples, self.ploidy, fitted["missing_rate"])
        return Block(positions, refs, alts, classes, made, rng.random(n) < fitted["phased_rate"])


def blocks(spark: SparkSession, spec: CohortSpec, counts: Sequence[int]) -> DataFrame:
    """``contig_idx, local_block, n``, in order."""
    size = block_records(spec.n_samples, spec.ploidy)
    parts = [-(-n // size) for n in counts]
    for contig, k in zip(spec.contigs, parts, strict=True):
        if k > STRIDE:
            raise SpecError("TooManyBlocks", f"{contig}: {k} blocks, at most {STRIDE}")
    rows = [(i, k, n) for i, (k, n) in enumerate(zip(parts, counts, strict=True)) if k]
    table = spark.createDataFrame(rows, "contig_idx int, k bigint, total bigint")
    local = table.select("contig_idx", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("local_block"))
    return local.select("contig_idx", "local_block", F.least(F.lit(size).cast("bigint"), F.col("total") - F.col("local_block") * size).alias("n"))


def layout(spark: SparkSession, spec: CohortSpec, counts: Sequence[int]) -> DataFrame:
    """``contig_idx, local_block, n, span, offset``: where each block starts, from gap draws alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = spec.samplers()
        for b in batches:
            c, k, n = (b.column(i).to_pylist() for i in range(3))
            spans = [int(s.gaps(block_rng(spec.seed, ci * STRIDE + ki, POSITION), ni).sum()) for ci, ki, ni in zip(c, k, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(spans, pa.int64())], ["contig_idx", "local_block", "n", "span"])

    spans = blocks(spark, spec, counts).repartition("contig_idx", "local_block").mapInArrow(run, "contig_idx int, local_block bigint, n bigint, span bigint")
    return placed_blocks(spans, "contig_idx", "local_block", "offset")


def placed_blocks(spans: DataFrame, contig: str, block: str, name: str) -> DataFrame:
    """``spans`` with a column ``name``: the spans of the contig's blocks before this one."""
    before = Window.partitionBy(contig).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn(name, F.coalesce(F.sum("span").over(before), F.lit(0)).cast("bigint"))


def dealt(placed: DataFrame, partitions: int | None) -> DataFrame:
    """Blocks in order, dealt evenly to tasks."""
    n = partitions or placed.sparkSession.sparkContext.defaultParallelism * 4
    return placed.repartitionByRange(n, "contig_idx", "local_block").sortWithinPartitions("contig_idx", "local_block")


def generate(spark: SparkSession, spec: CohortSpec, counts: Sequence[int] | None = None) -> DataFrame:
    """Records: ``contig_idx, chrom, local_block, rec_idx, pos, ref, alts, class, gts, phased``; gts has a sample's calls side by side, -1 for missing."""
    spec.validate()
    counts = spec.counts() if counts is None else counts
    names = np.array(FIT_CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, k, n, _, offset in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                b = spec.block(c * STRIDE + k, n, offset)
                width = b.calls.shape[1]
                gts = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(b.calls.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, c, np.int32)), pa.array([spec.contigs[c]] * n), pa.array(np.full(n, k, np.int64)), pa.array(np.arange(n, dtype=np.int64)), pa.array(b.positions), pa.array(b.refs),
                        pa.array([[a] for a in b.alts]), pa.array(names[b.classes].tolist()), gts, pa.array(b.phased),
                    ],
                    ["contig_idx", "chrom", "local_block", "rec_idx", "pos", "ref", "alts", "class", "gts", "phased"],
                )

    schema = "contig_idx int, chrom string, local_block bigint, rec_idx bigint, pos bigint, ref string, alts array<string>, class string, gts array<tinyint>, phased boolean"
    return dealt(layout(spark, spec, counts), spec.partitions).mapInArrow(run, schema)
