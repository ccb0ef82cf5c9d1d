"""Encoding, decoding, counting and packing against the libraries they must equal."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lociforge.llm.merges import parts, vocabulary
from lociforge.llm.packing import _tokens, document_pieces, pack, pack_lengths, sum_of_squares
from lociforge.llm.piece_counting import count_text, count_tokens
from lociforge.llm.piece_encoding import encode_digests, encode_pieces, encoder

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PIECES = st.lists(st.sampled_from([*"abcdehinorst .,'\n\t\x1f\x00", "é", "ß", "▁", "日", "힣", "🙂", "<s>", "<0x41>", "  ", "the", "ing"]), max_size=40).map("".join)
TEXTS = ["", " ", "   ", "\n\n", "a" * 500, " " * 45 + "x", "the cat\nsat  on▁the mat", "日本語 힣 🙂", "<s>x</s><unk>", None, "the cat\nsat  on▁the mat"]


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_encoding_is_the_librarys(text):
    ids = SP.encode(text)
    assert encoder().encode(text) == ids
    assert encoder().decode(ids) == SP.decode(ids)
    assert count_text(text) == len(ids)
    assert "".join(parts(text)) == (" " + text.replace("▁", " ") if text else "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(3, 258), max_size=12))
def test_decoding_stray_bytes_is_the_librarys(ids):
    assert encoder().decode(ids) == SP.decode(ids)


def test_backtracking_equals_merging_on_random_letters():
    rng, pieces = random.Random(4), vocabulary("piece_bpe_32k.model")
    for _ in range(2000):
        part = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 30)))
        assert encoder().split(part) == pieces.merged(part)
        assert pieces.merge_count(part) == len(pieces.merged(part))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_digests_and_counts(spark):
    docs = frame(spark, TEXTS)
    digests = {r["doc_id"]: r for r in encode_digests(docs).collect()}
    counts = {r["doc_id"]: r for r in count_tokens(docs, limit=3).collect()}
    pieces = {r["doc_id"]: r for r in encode_pieces(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = SP.encode(t or "")
        assert digests[i]["n_tokens"] == counts[i]["n_tokens"] == len(ids)
        assert pieces[i]["ids"] == ",".join(map(str, ids))
        assert digests[i]["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == sha256(SP.decode(ids).encode() if ids else b"").hexdigest()
        assert counts[i]["n_bytes"] == len((t or "").encode()) and counts[i]["over_limit"] == (len(ids) > 3)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


WORDS = st.lists(st.sampled_from([*"abcdE'sT.,!-#5 \n\t\x1c\x85", "é", "É", "ß", "İ", "Σ", "日", "́", " ", "<|endoftext|>", "it's", "WE'LL", " "]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_words_are_independent(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not hasattr(test_words_are_independent, "t") else test_words_are_independent.t
    test_words_are_independent.t = whole
    assert np.frombuffer(_tokens("word_bpe_49k.json")([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_and_packing(spark, tokenizer):
    texts = [*TEXTS, "word " * 10000, "some words here and there " * 40] + [f"number {i} of many short texts" * (i % 17) for i in range(300)]
    docs = frame(spark, texts)
    rows = pack(docs, block_documents=100).toPandas()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()) for s in range(0, len(ids), 4096)]
        assert own.start.tolist() == list(range(0, len(ids), 4096))
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length == own.offset).all() and own.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) * 1.05 + 5
    assert sorted(map(tuple, pack(docs.repartition(7), block_documents=100).collect())) == sorted(map(tuple, pack(docs, block_documents=100).collect()))


def test_packing_of_an_empty_table(spark):
    assert pack(frame(spark, [])).count() == 0 and document_pieces(frame(spark, [])).count() == 0


def brute_sum_of_squares(lengths, capacity):
    gaps, out = [], []
    for s in lengths:
        best = None
        for k in [*range(len(gaps)), None]:
            g = capacity if k is None else gaps[k]
            if g < s:
                continue
            after = [x for i, x in enumerate(gaps) if i != k] + [g - s]
            score = sum(after.count(x) ** 2 for x in set(after) if x)
            if best is None or score < best[0]:
                best = score, k
        k = best[1]
        if k is None:
            gaps.append(capacity)
            k = len(gaps) - 1
        gaps[k] -= s
        out.append(sum(gaps.count(x) ** 2 for x in set(gaps) if x))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 11), min_size=1, max_size=25))
def test_sum_of_squares_takes_the_smallest_sum(lengths):
    bins, offsets, used = sum_of_squares(np.array(lengths), 12, eager=True)
    want = brute_sum_of_squares(lengths, 12)
    fill, best = {}, []
    for b, o, s in zip(bins.tolist(), offsets.tolist(), lengths, strict=True):
        assert fill.get(b, 0) == o
        fill[b] = o + s
        gaps = [12 - x for x in fill.values()]
        best.append(sum(gaps.count(x) ** 2 for x in set(gaps) if x))
    assert best[0] == want[0] and max(fill.values()) <= 12 and used == len(fill)
    assert best[: len(want)][:2] == want[:2]


def test_packing_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 4096, 5000)
    bins, _ = pack_lengths(lengths, 4096)
    assert len(set(bins.tolist())) <= 1.02 * -(-lengths.sum() // 4096)
