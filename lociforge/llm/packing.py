"""Sum-of-squares packing of tokenized documents into sequences.

Documents longer than a sequence are cut into full pieces and a rest; full pieces are sequences of their own. What is
left is dealt evenly to blocks of bounded size, and each block is packed by itself: a piece goes where the
sum over gaps of the squared number of open sequences with that gap becomes smallest. The state is one count per gap,
and a block costs a few sequences over a single run of all, a share that falls with the block's size.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHE_BYTES, entry_bytes, texts, use_worker, written
from .merges import model_path

MODEL = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces in a block, on average.
BLOCK_PIECES = 65_536
#: What settles the order of a block's pieces; pieces that agree in it are the same.
ORDER = ("doc_id", "piece", "ids_crc32", "length")
#: Equal rows that are numbered at a time.
LOT = 4096
#: Characters that a worker tokenizes at a time, at least one text.
CHUNK_CHARS = 1 << 20
#: Marks for words that were met once, per cache.
MET = 1 << 22
#: Words that the tokenizer gets at a time.
ENCODED = 4096

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100), 0xDF]))
_CORE_CHARACTERS = _LETTERS + _MARKS
#: Of each line, its lower-case letters if nothing but punctuation without apostrophes follows: the tokenizer splits there.
_LETTERS_BEFORE_MARKS = re.compile(f"^(?:([{_LETTERS}]++)[{re.escape(_MARKS)}]*+$|.+)", re.MULTILINE)
#: Texts that show whether a tokenizer takes each word by itself and splits letters from marks.
_PROBES = (
    "The quick  Brown fox\njumps", " \tÉcole Straße señor", "x" * 300 + " Zz", "it's o'clock 'quoted' don't", "a1b2 3.14 1,000 x_y", "\u4f60\u597d \u0644\u0627 caf\u0065\u0301",
    *(f"Ab{m} cd{m}{m} {m}ef A{m}b" for m in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), *(f"Wort{c}x {c}" for c in map(chr, range(0xC0, 0x100))),
)


class WordTokens:
    """Ids of a text as little-endian bytes, from the ids of its words if the tokenizer takes each word by itself."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_path(model))
        self.known, self.cores = _Known({"": b""}), {"": b""}
        self.room = {"known": CACHE_BYTES // 2, "cores": CACHE_BYTES // 2}
        self.met = {name: (np.zeros(MET, bool), 0) for name in self.room}
        own = self.tokenizer.pre_tokenizer
        self.alphabet = {ord(c): "".join(part for part, _ in own.pre_tokenize_str(c)) for c in _CORE_CHARACTERS} if own else {}
        # another tokenizer may drop no white space or split elsewhere; it gets whole texts
        self.by_word = self._from_words(list(_PROBES)) == self._encode(list(_PROBES))

    def _encode(self, words: list[str]) -> list[bytes]:
        parts = (words[i : i + ENCODED] for i in range(0, len(words), ENCODED))
        return [array("I", e.ids).tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _encode_cores(self, cores: list[str]) -> list[bytes]:
        """Those of runs of letters or of marks, by the tokenizer's model: its other steps only spell such runs in its alphabet."""
        merged = self.tokenizer.model.tokenize
        return [array("I", [x.id for x in merged(c)]).tobytes() for c in "\n".join(cores).translate(self.alphabet).split("\n")] if cores else []

    def _keep(self, name: str, found: dict[str, bytes]) -> None:
        """Puts those that were met before, about, into a cache while there is room; the many that come once would only fill it."""
        if self.room[name] <= 0:
            return
        met, marks = self.met[name]
        spots = np.fromiter(map(hash, found), np.int64, len(found)) & MET - 1
        again = met[spots]
        met[spots] = True
        marks += len(found) - int(again.sum())
        self.met[name] = (met, marks) if marks <= MET // 4 else (np.zeros(MET, bool), 0)
        old = dict(compress(found.items(), again.tolist()))
        self.room[name] -= sum(map(entry_bytes, old, old.values()))
        getattr(self, name).update(old)

    def learn(self, words: set[str]) -> None:
        """Ids of words that aren't known yet, until the next call at least."""
        own = list(words)
        letters = _LETTERS_BEFORE_MARKS.findall("\n".join(own).lower())  # one for each word
        marks = [w[len(a) :] if a else "" for w, a in zip(own, letters, strict=True)]
        rest = [w for w, a in zip(own, letters, strict=True) if not a]
        cores, known = {*letters, *marks}, self.cores
        new = list(cores - known.keys())
        found = dict(zip(new, self._encode_cores(new), strict=True))
        get = ({c: known[c] for c in cores & known.keys()} | found).__getitem__
        self.known.extra = new = dict(zip(own, map(add, map(get, letters), map(get, marks)), strict=True))
        new.update(zip(rest, self._encode(rest), strict=True))
        self._keep("cores", found)
        self._keep("known", new)

    def _from_words(self, batch: list[str]) -> list[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in batch]
        if new := set().union(*words) - self.known.keys():
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def __call__(self, batch: list[str]) -> list[bytes]:
        return self._from_words(batch) if self.by_word else self._encode(batch)


class _Known(dict):
    """Falls back on a second dict."""

    def __init__(self, first: dict):
        super().__init__(first)
        self.extra: dict = {}

    def __missing__(self, key):
        return self.extra[key]


@lru_cache(maxsize=2)
def _tokens(model: str) -> WordTokens:
    return WordTokens(model)


def document_pieces(docs: DataFrame, model: str = MODEL, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut after every ``capacity``.

    A null or empty text is the end id alone. Repeated rows give repeated pieces, a null doc_id stays null, an empty
    table has no pieces; columns other than doc_id and text are not read. No shuffle.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker("packing", _tokens.cache_clear)
        tokens = _tokens(model)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            doc_ids, at = batch.column(0).to_pylist(), 0
            while at < len(doc_ids):
                chunk, size, first = [], 0, at
                while at < len(doc_ids) and (not chunk or size < CHUNK_CHARS):
                    chunk.append(batch.column(1)[at].as_py())
                    size += len(chunk[-1])
                    at += 1
                for doc_id, ids in zip(doc_ids[first:at], tokens(chunk), strict=True):
                    ids += end
                    view = memoryview(ids)
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = view[4 * start : 4 * (start + capacity)]
                        for column, value in zip(rows, (doc_id, k, start, len(own) // 4, zlib.crc32(own)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int, eager: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, placed in the given order, and the number of bins.

    ``eager``: a new bin may be opened whenever that makes the sum smallest; else only when no open bin has room.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    after = np.zeros(capacity + 1)  # open bins per gap; a closed bin counts nowhere
    after[0] = -0.5
    have = np.full(capacity + 1, -1e18)  # the same, where there are any
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k, s in enumerate(lengths.tolist()):
        gain = after[: capacity - s] - have[s:capacity]
        new = after[capacity - s] - 0.5
        g = -1
        if len(gain):
            j = int(gain.argmin())
            if gain[j] < 1e17 and (not eager or gain[j] <= new):
                g = j + s
        if g < 0:
            g, own = capacity, used
            used += 1
        else:
            own = by_gap[g].pop()
            after[g] -= 1
            have[g] = after[g] or -1e18
        bins[k], offsets[k] = own, capacity - g
        if g > s:
            by_gap[g - s].append(own)
            after[g - s] += 1
            have[g - s] = after[g - s]
    return bins, offsets, used


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of three runs of ``sum_of_squares``: as given, and longest first with new bins at will or at need."""
    longest = np.argsort(-lengths, kind="stable")
    best = None
    for order, eager in ((np.arange(len(lengths)), True), (longest, True), (longest, False)):
        bins, offsets, used = sum_of_squares(lengths[order], capacity, eager)
        if best is None or used < best[0]:
            best = used, order, bins, offsets
    _, order, bins, offsets = best
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return bins[back], offsets[back]


def _dealt(pieces: DataFrame, blocks: int) -> DataFrame:
    """The same rows with ``block``, from a hash of the row, and of a number among equal rows: they are dealt like others."""
    own = pieces.columns
    some = pieces.groupBy(own).agg(F.count(F.lit(1)).alias("rows"))
    lots = some.select("*", F.explode(F.expr(f"sequence(0L, (rows - 1) div {LOT})")).alias("lot"))
    each = lots.select("*", F.explode(F.expr(f"sequence(lot * {LOT}, least(rows, (lot + 1) * {LOT}) - 1)")).alias("copy"))
    return each.select(*own, F.pmod(F.xxhash64(*own, "copy"), F.lit(blocks)).alias("block"))


def pack(docs: DataFrame, model: str = MODEL, capacity: int = CAPACITY, end_id: int = END_ID, block_pieces: int = BLOCK_PIECES, block_documents: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece.

    Null and empty texts are a piece of length 1. Repeated rows and rows with a null doc_id are packed as any other. An
    empty table gives an empty result; columns other than doc_id and text are not read. Pieces are written to the shared
    folder. Full ones, the only ones whose id is negative, are only numbered; the others are dealt evenly to blocks, of about
    ``block_pieces`` or, where that is given, of the pieces of about ``block_documents`` documents. Blocks and places in them
    depend on the pieces alone, so the result doesn't depend on how the input is split. Two shuffles, of a row per piece.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    pieces = written(document_pieces(docs, model, capacity, end_id), "pack-pieces")
    short, full = pieces.where(F.col("length") < capacity), pieces.where(F.col("length") == capacity)
    n = pieces.agg(F.count_if(F.col("length") < capacity).alias("short"), F.count_if(F.col("length") == capacity).alias("full"), F.count_if(F.col("piece") == 0).alias("documents")).first()
    blocks = max(1, round(n["documents"] / block_documents if block_documents else n["short"] / block_pieces))

    def own(key: tuple, table: pa.Table) -> pa.Table:
        use_worker("blocks", dict)  # the tokenizer's caches go
        table = table.sort_by([(name, "ascending") for name in ORDER])
        bins, offsets = pack_lengths(table.column("length").to_numpy(), capacity)
        return table.drop_columns("block").append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    place = F.row_number().over(Window.partitionBy("block").orderBy(*ORDER))
    alone = _dealt(full, max(1, round(n["full"] / block_pieces))).withColumn("sequence_id", -F.shiftleft("block", 32) - place)
    alone = alone.drop("block").withColumn("offset", F.lit(0).cast("long"))
    return _dealt(short, blocks).groupBy("block").applyInArrow(own, schema).unionByName(alone)
