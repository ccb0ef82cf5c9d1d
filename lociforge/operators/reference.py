"""Reference sequences: seeded contigs, edits, slices, and REF/ALT pairs drawn from them."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import next_base
from .records import BuildError


def slices(loci: DataFrame, reference: DataFrame, length: Column | int = 1) -> DataFrame:
    """Loci ``chrom, pos0, ...`` with ``seq`` of that length from the reference ``chrom, sequence``, and ``error`` where there is none."""
    n = F.lit(length) if isinstance(length, int) else length
    both = loci.join(F.broadcast(reference.select("chrom", "sequence")), "chrom", "left")  # a genome's contigs
    error = F.when(F.col("sequence").isNull(), "ContigNotFound").when(F.col("pos0") + n > F.length("sequence"), "OutOfBounds")
    return both.withColumn("error", error).withColumn("seq", F.when(error.isNull(), F.substring("sequence", F.col("pos0").cast("int") + 1, n))).drop("sequence")


def draw_ref_alt(klass: Column, sequence: Column, pos0: Column, alt_index: int = 1, mnp_len: int = 2, ins_seq: str = "A", del_len: int = 1) -> Column:
    """``ref, alt`` of a class at a place of a sequence."""
    cut = lambda n: F.substring(sequence, pos0.cast("int") + 1, F.lit(n))
    base, several = cut(1), cut(mnp_len)
    turned = F.array_join(F.transform(F.split(several, ""), lambda b: F.when(b == "", "").otherwise(next_base(b, alt_index))), "")
    ref = F.when(klass == "DEL", cut(del_len + 1)).when(klass.isin("MNP", "DELINS"), several).otherwise(base)
    alt = (
        F.when(klass == "SNP", next_base(base, alt_index)).when(klass == "MNP", turned).when(klass == "INS", F.concat(base, F.lit(ins_seq)))
        .when(klass == "DEL", base).when(klass == "DELINS", F.lit(ins_seq)).when(klass == "SPANNING_DEL", "*")
    )
    return F.struct(ref.alias("ref"), alt.alias("alt"))


@dataclass
class ReferenceSpec:
    contigs: dict[str, str]
    repeats: list[tuple[str, int, str, int]] = field(default_factory=list)

    def length(self, contig: str) -> int:
        return len(self._of(contig))

    def _of(self, contig: str) -> str:
        if contig not in self.contigs:
            raise BuildError("ContigNotFound", detail=contig)
        return self.contigs[contig]

    def seq(self, contig: str, start0: int, length: int) -> str:
        s = self._of(contig)
        if start0 + length > len(s):
            raise BuildError("OutOfBounds", detail=f"{contig}:{start0}+{length} of {len(s)}")
        return s[start0 : start0 + length]

    def base(self, contig: str, pos0: int) -> str:
        return self.seq(contig, pos0, 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.contigs.items()), "chrom string, sequence string")

    def repeat_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.repeats, "contig string, pos0 int, motif string, count int")

    def fasta(self, width: int = 60) -> str:
        lines = [x for c, s in self.contigs.items() for x in (f">{c}", *(s[i : i + width] for i in range(0, len(s), width)))]
        return "\n".join(lines) + "\n" if lines else ""

    def write(self, path: str | Path, bgzip: bool = False, index: bool = False) -> Path:
        """FASTA at exactly ``path``; there is no index to write."""
        from ..sources.bgzf import compress

        path, data = Path(path), self.fasta().encode()
        path.write_bytes(compress(data) if bgzip else data)
        return path


class ReferenceBuilder:
    """Random contigs that depend on the seed and the contig's name only, and edits to them."""

    def __init__(self, seed: int = 0):
        self.seed, self.sequences, self.repeats = seed, {}, []

    def add_contig(self, contig: str, length: int) -> ReferenceBuilder:
        if contig in self.sequences:
            raise BuildError("ContigExists", detail=contig)
        rng = np.random.Generator(np.random.Philox(key=[self.seed, zlib.crc32(contig.encode())]))
        self.sequences[contig] = bytearray(np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, length)].tobytes())
        return self

    def set_seq(self, contig: str, pos0: int, seq: str) -> ReferenceBuilder:
        if contig not in self.sequences:
            raise BuildError("ContigNotFound", detail=contig)
        own = self.sequences[contig]
        if pos0 + len(seq) > len(own):
            raise BuildError("OutOfBounds", detail=f"{contig}:{pos0}+{len(seq)} of {len(own)}")
        own[pos0 : pos0 + len(seq)] = seq.encode()
        return self

    def set_base(self, contig: str, pos0: int, base: str) -> ReferenceBuilder:
        if len(base.encode()) != 1:
            raise BuildError("BadAlleleBases", detail=base)
        return self.set_seq(contig, pos0, base)

    def tandem_repeat(self, contig: str, pos0: int, motif: str, n: int) -> ReferenceBuilder:
        self.set_seq(contig, pos0, motif * n)
        self.repeats.append((contig, pos0, motif, n))
        return self

    def build(self) -> ReferenceSpec:
        return ReferenceSpec({c: bytes(s).decode() for c, s in self.sequences.items()}, list(self.repeats))
