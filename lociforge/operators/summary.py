"""Summaries of generated cohorts: a partial for each block, merged in block order."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import FIT_CLASSES

_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    """The prime's powers from 0 to n, modulo 2 ** 64."""
    out = np.full(n + 1, _PRIME, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def fnv1a(data: np.ndarray, start: int = _OFFSET) -> int:
    """FNV-1a over bytes (-1 is 255). A run of zero bytes is one multiplication by a power of the prime."""
    data = np.ascontiguousarray(data).view(np.uint8).ravel()
    at = np.flatnonzero(data)
    powers = _powers(1 << max(10, int(len(data)).bit_length()))
    runs = powers[np.diff(at, prepend=-1) - 1].tolist()
    h = start
    for p, b in zip(runs, data[at].tolist(), strict=True):
        h = ((h * p & _MASK) ^ b) * _PRIME & _MASK
    rest = len(data) - 1 - (int(at[-1]) if len(at) else -1)
    return h * int(powers[rest]) & _MASK


@dataclass
class Summary:
    n_samples: int
    per_contig: dict[str, dict[str, int]] = field(default_factory=dict)
    n_alleles_total: int = 0
    n_alleles_nonref: int = 0
    class_counts: dict[str, int] = field(default_factory=dict)
    genotype_checksum: int = _OFFSET

    def merge_block(self, contig: str, n: int, low: int, high: int, classes: list[int], alleles: int, nonref: int, checksum: int) -> None:
        """Adds a block; an empty one changes nothing, the checksum included."""
        if not n:
            return
        own = self.per_contig.setdefault(contig, {"n_records": 0, "pos_min": low, "pos_max": high})
        own["n_records"] += n
        own["pos_min"], own["pos_max"] = min(own["pos_min"], low), max(own["pos_max"], high)
        for name, k in zip(FIT_CLASSES, classes, strict=True):
            if k:
                self.class_counts[name] = self.class_counts.get(name, 0) + k
        self.n_alleles_total += alleles
        self.n_alleles_nonref += nonref
        self.genotype_checksum = fnv1a(np.frombuffer(checksum.to_bytes(8, "little"), np.uint8), self.genotype_checksum)

    def n_records_total(self) -> int:
        return sum(c["n_records"] for c in self.per_contig.values())

    def to_json(self) -> str:
        d = {k: getattr(self, k) for k in ("n_samples", "per_contig", "n_alleles_total", "n_alleles_nonref", "class_counts", "genotype_checksum")}
        return json.dumps(d | {k: dict(sorted(d[k].items())) for k in ("per_contig", "class_counts")}, indent=2)


def block_partial(positions: np.ndarray, classes: np.ndarray, calls: np.ndarray) -> tuple[int, int, int, list[int], int, int, int]:
    """``n, low, high, classes, alleles, nonref, checksum`` of a block; missing calls count among the alleles."""
    n = len(positions)
    if not n:
        return 0, 0, 0, [0] * len(FIT_CLASSES), 0, 0, _OFFSET
    return n, int(positions.min()), int(positions.max()), np.bincount(classes, minlength=len(FIT_CLASSES)).tolist(), calls.size, int((calls > 0).sum()), fnv1a(calls)


def summarize(records: DataFrame) -> DataFrame:
    """``chrom, n_records, pos_min, pos_max, n_alleles, n_nonref`` of records with ``gts`` arrays: partial, then final aggregation."""
    count = lambda test: F.sum(F.size(F.filter("gts", test))).cast("bigint")
    return records.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_records"), F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"), F.sum(F.size("gts")).cast("bigint").alias("n_alleles"), count(lambda a: a > 0).alias("n_nonref"))


def checksums(records: DataFrame) -> DataFrame:
    """``contig_idx, local_block, checksum`` (16 hex digits) of records with ``gts``, ``rec_idx``: a block is one group of bounded size."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        data = np.concatenate([np.asarray(g, np.int8) for g in frame.sort_values("rec_idx")["gts"]])
        return pd.DataFrame({"contig_idx": [key[0]], "local_block": [key[1]], "checksum": [f"{fnv1a(data):016x}"]})

    return records.select("contig_idx", "local_block", "rec_idx", "gts").groupBy("contig_idx", "local_block").applyInPandas(one, "contig_idx int, local_block bigint, checksum string")
