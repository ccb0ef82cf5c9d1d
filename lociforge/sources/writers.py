"""Sinks: rendered documents, and generated cohorts as VCF, VCF.gz or BCF with index and summary.

A cohort's tasks encode their blocks as BGZF members into part files beside the destination (which must be on storage
that executors share, as for any file sink); the driver joins the parts in order, adds header and end marker, and moves
the result into place, so a failed run leaves what was there. Part files are renamed into place by the task, so repeated
attempts do no harm.
"""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import PAYLOAD_KEYS, STRIDE, Block, CohortSpec, dealt, layout
from ..operators.sizing import SpecError, distribute
from ..operators.summary import Summary, block_partial
from . import bcf, bgzf

#: Rounds in which a target size is approached.
CORRECTIONS = 6


def _publish(temporary: Path, path: Path) -> None:
    try:
        os.replace(temporary, path)
    except OSError:  # another file system
        shutil.copyfile(temporary, path)
        temporary.unlink()


def write_document(doc, path: str | Path, bgzip: bool, index: bool) -> Path:
    """Text, BGZF (``.gz`` is appended if missing) or BGZF with a ``.csi``; returns the final path. Records stream through the driver in order."""
    path = Path(path)
    if bgzip and path.suffix != ".gz":
        path = path.with_name(path.name + ".gz")
    header = ("\n".join(doc.header_lines()) + "\n").encode()
    names = {c: i for i, (c, _) in enumerate(doc.contigs)}
    rows = doc.lines().join(doc.records.select("rec_id", "chrom", "pos", F.length("ref").alias("n")), "rec_id").orderBy("rec_id")
    temporary = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        if not bgzip:
            with temporary.open("wb") as out:
                out.write(header)
                for r in rows.toLocalIterator():
                    out.write(r["line"].encode() + b"\n")
        else:
            lines = [(names.get(r["chrom"], 0), r["pos"] - 1, r["pos"] - 1 + max(1, r["n"]), r["line"].encode() + b"\n") for r in rows.toLocalIterator()]
            body, starts = bgzf.members(header + b"".join(x[3] for x in lines))
            temporary.write_bytes(body + bgzf.EOF)
            if index:
                made = bgzf.index_lines(lines, list(names), len(header), starts, len(body)) if names else bgzf.CsiIndex([], vcf=True)
                path.with_name(path.name + ".csi").write_bytes(made.dump())
        _publish(temporary, path)
    finally:
        temporary.unlink(missing_ok=True)
    return path


def text_block(block: Block, chrom: str, ploidy: int, payload: str) -> list[bytes]:
    """A VCF line each."""
    keys = PAYLOAD_KEYS[payload]
    values = bcf.sample_values(block.calls, ploidy) if len(keys) > 1 else {}
    by_sample = block.calls.reshape(len(block.calls), -1, ploidy)
    names = {}  # a sample's calls -> their text
    out = []
    for i in range(len(block.positions)):
        bar = "|" if block.phased[i] else "/"
        cells = []
        codes = [tuple(c) for c in by_sample[i].tolist()]
        for c in codes:
            if (bar, c) not in names:
                names[bar, c] = bar.join("." if a < 0 else str(a) for a in c)
            cells.append(names[bar, c])
        for key in keys[1:]:
            v = values[key][i]
            shown = [",".join(np.format_float_positional(x, trim="-") for x in row) for row in v] if v.dtype == np.float32 else [",".join(map(str, row)) for row in v.tolist()]
            cells = [f"{a}:{b}" for a, b in zip(cells, shown, strict=True)]
        out.append("\t".join([chrom, str(block.positions[i]), ".", block.refs[i], block.alts[i], ".", ".", ".", ":".join(keys), *cells]).encode() + b"\n")
    return out


_PARTIAL = "contig_idx int, local_block bigint, n bigint, low bigint, high bigint, classes array<bigint>, alleles bigint, nonref bigint, checksum binary, part string, at bigint, size bigint, chunks binary, windows binary"


def encode_parts(placed: DataFrame, spec: CohortSpec, folder: str) -> DataFrame:
    """Writes a part file per task and returns a row per block: its partial summary, its place in the part, its index entries."""
    packed, payload, ploidy, level = spec.format != "vcf", spec.effective_payload, spec.ploidy, spec.compression_level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/{context.partitionId():08d}"
        mine, rows, at = f"{name}.{context.taskAttemptId()}", [], 0
        with open(mine, "wb") as out:
            for batch in batches:
                for c, k, n, _, offset in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    block = spec.block(c * STRIDE + k, n, offset)
                    records = bcf.encode_block(block, c, ploidy, payload) if spec.format == "bcf" else text_block(block, spec.contigs[c], ploidy, payload)
                    data, chunks, windows = b"".join(records), b"", b""
                    if packed:
                        body, starts = bgzf.members(data, level)
                    else:
                        body, starts = data, []
                    if spec.format == "bcf":
                        ends = np.cumsum([len(r) for r in records])
                        spots = [bgzf.virtual(starts, len(body), int(e)) for e in [0, *ends]]
                        own = bgzf.CsiIndex([""], vcf=False)
                        for p, r, begin, end in zip(block.positions.tolist(), block.refs, spots, spots[1:], strict=False):
                            own.add(0, p - 1, p - 1 + len(r), begin, end)
                        found = own.entries(0)
                        chunks, windows = b"".join([struct.pack("<3Q", *x) for x in found[0]]), b"".join([struct.pack("<2Q", *x) for x in found[1]])
                    out.write(body)
                    m, low, high, classes, alleles, nonref, checksum = block_partial(block.positions, block.classes, block.calls)
                    rows.append((c, k, m, low, high, classes, alleles, nonref, checksum.to_bytes(8, "little"), name, at, len(body), chunks, windows))
                    at += len(body)
        os.replace(mine, name)
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _PARTIAL.replace("array<bigint>", "a").split(", ")])

    return placed.mapInArrow(run, _PARTIAL)


def _write_once(spark: SparkSession, spec: CohortSpec, counts: Sequence[int], folder: Path) -> tuple[Path, bytes | None, Summary]:
    """The finished file in ``folder``, its index, its summary."""
    placed = layout(spark, spec, counts)
    spans = {r[0]: r[1] for r in placed.groupBy("contig_idx").agg(F.sum("span")).collect()}
    lines = bcf.header_lines(spec.effective_payload, list(spec.contigs), [spans.get(i, 0) for i in range(len(spec.contigs))], [f"s{i}" for i in range(spec.n_samples)])
    parts = folder / uuid.uuid4().hex
    parts.mkdir()
    rows = sorted(encode_parts(dealt(placed, spec.partitions), spec, str(parts)).collect(), key=lambda r: (r["contig_idx"], r["local_block"]))
    head = bcf.file_header(lines) if spec.format == "bcf" else ("\n".join(lines) + "\n").encode()
    if spec.format != "vcf":
        head = bgzf.members(head, spec.compression_level)[0]
    summary, index, path, at = Summary(spec.n_samples), bgzf.CsiIndex(list(spec.contigs), vcf=False), folder / uuid.uuid4().hex, len(head)
    with path.open("wb") as out:
        out.write(head)
        for part in dict.fromkeys(r["part"] for r in rows):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 22)
        if spec.format != "vcf":
            out.write(bgzf.EOF)
    shutil.rmtree(parts)
    for r in rows:
        summary.merge_block(spec.contigs[r["contig_idx"]], r["n"], r["low"], r["high"], r["classes"], r["alleles"], r["nonref"], int.from_bytes(r["checksum"], "little"))
        index.merge(r["contig_idx"], list(struct.iter_unpack("<3Q", r["chunks"])), list(struct.iter_unpack("<2Q", r["windows"])), at << 16)
        at += r["size"]
    return path, index.dump() if spec.format == "bcf" else None, summary


def _for_target(spark: SparkSession, spec: CohortSpec, folder: Path) -> tuple[Path, bytes | None, Summary]:
    """A file of the target size at least: a line through two small runs gives the number of records, and each further run the local slope."""
    target, names, fitted = spec.size.value, spec.contigs, spec.profile.fitted
    sizes = []
    for each in (1000, 2000):
        path, _, summary = _write_once(spark, spec, distribute(fitted, names, each * len(names)), folder)
        sizes.append((summary.n_records_total(), path.stat().st_size))
        path.unlink()
    (r1, b1), (r2, b2) = sizes
    slope = max(1e-9, (b2 - b1) / (r2 - r1))
    counts = distribute(fitted, names, max(r2, int(np.ceil((target - (b1 - slope * r1)) / slope))))
    last: tuple[int, int, int] | None = None
    for _ in range(CORRECTIONS):
        path, index, summary = _write_once(spark, spec, counts, folder)
        size, records = path.stat().st_size, sum(counts)
        if size >= target:
            return path, index, summary
        path.unlink()
        here = (size - last[1]) / (records - last[0]) if last and records != last[0] else 0
        more = int(np.ceil((target - size) / (here if here > 0 else slope) * 1.02)) + 1
        if last and size <= last[1]:
            more = max(more, 2 * last[2])
        counts = [a + b for a, b in zip(counts, distribute(fitted, names, more), strict=True)]
        last = records, size, more
    raise SpecError("TargetNotReached", f"{target} bytes after {CORRECTIONS} corrections")


def write_cohort(spark: SparkSession, spec: CohortSpec, path: str | Path) -> Summary:
    """Writes the file, for BCF its ``.csi``, and ``.summary.json``; nothing at ``path`` changes unless all of it is done."""
    spec.validate()
    path = Path(path)
    counts = None if spec.size.mode == "target" else spec.counts()
    folder = Path(tempfile.mkdtemp(prefix=f".{path.name}.", dir=path.parent))  # beside the destination, so the move is a rename
    try:
        made, index, summary = _for_target(spark, spec, folder) if counts is None else _write_once(spark, spec, counts, folder)
        if index is not None:
            (folder / "csi").write_bytes(index)
            _publish(folder / "csi", path.with_name(path.name + ".csi"))
        _publish(made, path)
        (folder / "summary").write_text(summary.to_json())
        _publish(folder / "summary", path.with_name(path.name + ".summary.json"))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return summary
