"""BGZF members and CSI indexes. Members written one after the other, with one end marker, are one valid file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from pathlib import Path

#: Uncompressed bytes in a member.
MEMBER = 65_280
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MIN_SHIFT, DEPTH = 14, 5


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) > 65_500:  # doesn't compress: store it
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def members(data: bytes, level: int = 6) -> tuple[bytes, list[int]]:
    """Members of the data, and where each starts."""
    out, starts, at = [], [], 0
    for i in range(0, len(data), MEMBER):
        starts.append(at)
        out.append(member(data[i : i + MEMBER], level))
        at += len(out[-1])
    return b"".join(out), starts


def compress(data: bytes, level: int = 6) -> bytes:
    return members(data, level)[0] + EOF


def decompress(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        out.append(zlib.decompress(data[at + 18 : at + size - 8], -15))
        at += size
    return b"".join(out)


def virtual(starts: list[int], end: int, offset: int) -> int:
    """The virtual offset of a byte of the uncompressed data."""
    k, inside = divmod(offset, MEMBER)
    return (starts[k] << 16 | inside) if k < len(starts) else end << 16


def bin_of(start0: int, end0: int) -> int:
    """The smallest bin that holds [start0, end0)."""
    end0 = max(end0, start0 + 1) - 1
    level, shift = DEPTH, MIN_SHIFT
    while level > 0:
        if start0 >> shift == end0 >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start0 >> shift)
        level, shift = level - 1, shift + 3
    return 0


class CsiIndex:
    """Chunks per contig and bin, from records in file order."""

    def __init__(self, names: list[str], vcf: bool):
        self.names, self.vcf = names, vcf
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in names]
        self.windows: list[dict[int, int]] = [{} for _ in names]
        self.first: list[int | None] = [None] * len(names)

    def add(self, contig: int, start0: int, end0: int, begin: int, end: int) -> None:
        chunks = self.bins[contig].setdefault(bin_of(start0, end0), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for w in range(start0 >> MIN_SHIFT, (max(end0, start0 + 1) - 1 >> MIN_SHIFT) + 1):
            self.windows[contig].setdefault(w, begin)
        if self.first[contig] is None:
            self.first[contig] = begin

    def entries(self, contig: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Chunks as bin, begin, end, and windows with their first offset: what a block passes on."""
        return [(b, *c) for b, chunks in self.bins[contig].items() for c in chunks], list(self.windows[contig].items())

    def merge(self, contig: int, chunks: list[tuple[int, int, int]], windows: list[tuple[int, int]], shift: int) -> None:
        """Adds the entries of the next block in file order, whose data starts ``shift`` further on."""
        for b, begin, end in chunks:
            own = self.bins[contig].setdefault(b, [])
            if own and own[-1][1] == begin + shift:
                own[-1][1] = end + shift
            else:
                own.append([begin + shift, end + shift])
        for w, begin in windows:
            self.windows[contig].setdefault(w, begin + shift)
        if windows and self.first[contig] is None:
            self.first[contig] = min(begin for _, begin in windows) + shift

    def _least(self, contig: int, b: int) -> int:
        """The first record over a bin's range; of wide bins, the contig's first."""
        leaf = b - ((1 << 3 * DEPTH) - 1) // 7
        return self.windows[contig].get(leaf, self.first[contig]) if leaf >= 0 else self.first[contig]

    def dump(self) -> bytes:
        aux = b""
        if self.vcf:
            names = b"".join(n.encode() + b"\0" for n in self.names)
            aux = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
        out = [b"CSI\1", struct.pack("<3i", MIN_SHIFT, DEPTH, len(aux)), aux, struct.pack("<i", len(self.names))]
        for contig, bins in enumerate(self.bins):
            out.append(struct.pack("<i", len(bins)))
            for b, chunks in sorted(bins.items()):
                out.append(struct.pack("<IQi", b, self._least(contig, b), len(chunks)))
                out += [struct.pack("<QQ", *c) for c in chunks]
        out.append(struct.pack("<Q", 0))
        return compress(b"".join(out))


def read_csi(path: str | Path) -> list[dict[int, list[tuple[int, int]]]]:
    """Chunks per contig and bin."""
    data = decompress(Path(path).read_bytes())
    if data[:4] != b"CSI\1":
        raise ValueError("no CSI index")
    at = 12 + 4 + struct.unpack_from("<i", data, 12)[0]
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    out = []
    for _ in range(n):
        k, at = struct.unpack_from("<i", data, at)[0], at + 4
        bins = {}
        for _ in range(k):
            b, _, c = struct.unpack_from("<IQi", data, at)
            at += 16
            bins[b] = [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(c)]
            at += 16 * c
        out.append(bins)
    return out


def index_lines(lines: Iterable[tuple[int, int, int, bytes]], names: list[str], before: int, starts: list[int], end: int) -> CsiIndex:
    """The index of text lines ``contig, start0, end0, bytes`` that follow ``before`` bytes of header."""
    index, at = CsiIndex(names, vcf=True), before
    for contig, start0, end0, line in lines:
        index.add(contig, start0, end0, virtual(starts, end, at), virtual(starts, end, at + len(line)))
        at += len(line)
    return index
