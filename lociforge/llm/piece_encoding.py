"""SentencePiece encoding and decoding by backtracking over longest matches.

A part of a text is encoded left to right with the longest piece at each place. A piece stays only if it is
compatible with the one before it, which re-merging the two shows: they must come out as the same two. A piece
that fails gives way to the next shorter one at its place; a place where all fail is marked in a bit field and
never tried again. A sequence whose neighbours are all compatible is the one that merging by rank gives, so the
result is exact, with work in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHE_BYTES, WordCache, texts, use_worker
from .merges import PieceVocabulary, parts, vocabulary

MODEL = "piece_bpe_32k.model"
#: Pairs of neighbours whose compatibility a worker remembers.
PAIRS = 300_000


class PieceEncoder:
    def __init__(self, pieces: PieceVocabulary):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        #: A piece that merging never makes is of no use to a text.
        self.useful = {p for p in pieces.ids if pieces.merged(p) == [p]}
        known = {c for p in pieces.ids for c in p}
        for p in self.useful | known:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.useful |= known
        self.fits: dict[tuple[str, str], bool] = {}

    def _compatible(self, left: str, right: str) -> bool:
        known = self.pieces.merged(left + right) == [left, right]
        if len(self.fits) < PAIRS:
            self.fits[left, right] = known
        return known

    def split(self, part: str) -> list[str]:
        """The pieces of a part, by backtracking. A code point in no piece stands alone."""
        useful, fits = self.useful, self.fits
        n = len(part)
        if part in useful or n < 2:
            return [part] if part else []
        longest = [1] * (n + 1)
        for end, size in self.automaton.iter(part):
            # shorter pieces that end at the same place start later, so each start sees its sizes in order
            longest[end + 1 - size] = size
        failed = 0  # bit i: nothing that starts at i leads to an end
        out: list[str] = []
        last = None
        at, size = 0, longest[0]
        while at < n:
            while size:
                if not failed >> (at + size) & 1:
                    piece = part[at : at + size]
                    if piece in useful or size == 1:
                        if last is None:
                            break
                        fit = fits.get((last, piece))
                        if self._compatible(last, piece) if fit is None else fit:
                            break
                size -= 1
            if size:
                out.append(piece)
                last = piece
                at += size
                size = longest[at]
            else:
                failed |= 1 << at
                if not out:
                    raise AssertionError("no sequence of pieces fits")
                size = len(out.pop()) - 1
                last = out[-1] if out else None
                at -= size + 1
        return out

    def ids(self, part: str) -> list[int]:
        get = self.pieces.ids.get
        out = [get(piece, piece) for piece in self.split(part)]
        if any(i.__class__ is str for i in out):
            spelled: list[int] = []
            for i in out:
                spelled += [i] if isinstance(i, int) else [self.pieces.byte_ids[b] for b in i.encode()]
            return spelled
        return out

    def encode(self, text: str) -> list[int]:
        """The library's ``encode(text)``: a dummy space first, no begin or end ids; an empty text has none."""
        return [i for part in parts(text) for i in self.ids(part)]

    def spell(self, ids: Iterable[int]) -> str:
        """Pieces put together; runs of byte pieces are read as UTF-8, a stray byte as U+FFFD; control ids are silent."""
        text = self.pieces.text
        pieces = [text[i] for i in ids]
        try:
            return "".join(pieces)  # no bytes, no control ids
        except TypeError:
            pass
        out: list[str] = []
        run = bytearray()
        for piece in pieces:
            if isinstance(piece, int):
                run.append(piece)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(piece or "")
        return "".join(out) + (_utf8(bytes(run)) if run else "")

    def decode(self, ids: Iterable[int]) -> str:
        """The library's ``decode(ids)``: as spelled, less the dummy space."""
        return self.spell(ids).removeprefix(" ")


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append("�")
            at += size
        return "".join(out)


@lru_cache(maxsize=2)
def encoder(model: str = MODEL) -> PieceEncoder:
    """Once per process."""
    return PieceEncoder(vocabulary(model))


@lru_cache(maxsize=2)
def _encoded_parts(model: str) -> WordCache:
    """part -> its ids as text, each with a comma after it, and what they decode to."""
    own = encoder(model)

    def make(part: str) -> tuple[str, str]:
        ids = own.ids(part)
        spelled = own.spell(ids)
        return ",".join(map(str, ids)) + "," if ids else "", part if spelled == part else spelled

    return WordCache(make, 2 * CACHE_BYTES)


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded`` of each text; the ids as decimals joined by commas.

    Null and empty texts have no ids and decode to the empty text. Rows are independent, so repeated rows give
    repeated results; columns other than doc_id and text are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("encoding", _encoded_parts.cache_clear)
        cache = _encoded_parts(model)
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                found = [cache[p] for p in parts(text)]
                ids.append("".join([x[0] for x in found])[:-1])
                decoded.append("".join([x[1] for x in found]).removeprefix(" "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids string, decoded string")


def encode_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encode_pieces`` returns, digested in the worker.

    The ids of a long corpus are several times its size as text, so the digests are taken before anything leaves
    Python. Null and empty texts: no tokens, and the digest of the empty text, twice.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("encoding", _encoded_parts.cache_clear)
        cache = _encoded_parts(model)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                found = [cache[p] for p in parts(value.as_py())]
                line = "".join([x[0] for x in found])
                counts.append(line.count(","))
                ids.append(sha256(line[:-1].encode()).hexdigest())
                decoded.append(sha256("".join([x[1] for x in found]).removeprefix(" ").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
