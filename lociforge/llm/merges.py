"""Byte-pair merging over a sentencepiece vocabulary, with a heap of ranked pairs and a linked list of symbols.

The rules are those of merge-type models: symbols start as single code points; of all neighbours whose
concatenation is a piece, the best-scored merges first, the leftmost of equals; what ends as no piece
is spelled in byte pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

SPACE = "▁"
#: A break between parts of a text that no piece spans; texts that hold it take the slower way.
CUT = "\x1f"
_PLAIN_RUNS = re.compile(" +[^ \n]*|\n|[^ \n]+")


class PieceVocabulary:
    """Pieces of a merge-type sentencepiece model. Spaces stand for the meta symbol, in pieces too."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids: list[int] = [0] * 256
        self.text: list[str | int | None] = [None] * size  # a piece's text, or a byte, or nothing
        scores: dict[str, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.text[i] = i, value
            elif model.is_unknown(i):
                self.text[i] = " ⁇ "
            elif not model.is_control(i):
                plain = piece.replace(SPACE, " ")
                self.ids[plain], self.text[i], scores[plain] = i, plain, model.get_score(i)
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Rank of each piece; equal scores have equal ranks.
        self.ranks = {piece: order[s] for piece, s in scores.items()}
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.ranks if p.strip(" ")):
            raise ValueError("a piece spans words; texts can't be cut before spaces")

    def merged(self, part: str) -> list[str]:
        """The symbols that are left when no pair of neighbours merges."""
        n = len(part)
        if n < 2:
            return [part] if part else []
        ranks = self.ranks
        symbols, after, before = list(part), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left, j = symbols[i], after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue  # one of the two has merged since
            symbols[i] = left = left + symbols[j]
            symbols[j] = ""
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := ranks.get(left + symbols[j])) is not None:
                    heappush(heap, (r, i, len(left) + len(symbols[j])))
            if (h := before[i]) >= 0 and (r := ranks.get(symbols[h] + left)) is not None:
                heappush(heap, (r, h, len(symbols[h]) + len(left)))
        return [s for s in symbols if s]

    def merge_count(self, part: str) -> int:
        """Tokens of a part: its initial symbols less the merges; a code point outside the vocabulary starts as its bytes."""
        n = len(part)
        ranks = self.ranks
        tokens = n
        for c in part:
            if c not in ranks:
                tokens += len(c.encode()) - 1
        if n < 2:
            return tokens
        sizes, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if not sizes[i] or j >= n or sizes[i] + sizes[j] != size:
                continue
            tokens -= 1
            sizes[i], sizes[j] = size, 0
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := ranks.get(part[i : j + sizes[j]])) is not None:
                    heappush(heap, (r, i, size + sizes[j]))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h : i + size])) is not None:
                heappush(heap, (r, h, i + size - h))
        return tokens


def parts(text: str) -> list[str]:
    """Cuts a text, with its leading dummy space, where no piece can span: before runs of spaces and around line ends.

    The parts joined are the text; some may be empty.
    """
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or CUT in text:
        return _PLAIN_RUNS.findall(" " + text)
    return (" " + text).replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}").split(CUT)


def model_path(model: str) -> str:
    """A path as it is; the bare name of a public tokenizer is looked up on the machine that asks."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


@lru_cache(maxsize=4)
def vocabulary(model: str) -> PieceVocabulary:
    """Once per process."""
    return PieceVocabulary(model_path(model))
