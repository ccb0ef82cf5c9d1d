"""Language identification, quality, fingerprints and language-model scores."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from lociforge.llm import language_id, maxent_lm, quality, spotsigs

WORDS = {"en": "the of and to in is that it for on with as was at by this from or".split(), "de": "der die und das von zu mit sich des auf für ist im dem nicht ein".split(), "fr": "le la les de des et en un une du que qui dans pour par sur".split()}


def text_in(rng, lang, n=60):
    syllables = {"en": ["th", "er", "ing", "on"], "de": ["sch", "ung", "ei", "ch"], "fr": ["eau", "oi", "tion", "é"]}[lang]
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, text_in(rng, lang := rng.choice(list(WORDS))), lang if i % 9 else None, "s", "x") for i in range(400)]
    return rows + [(400, None, None, "s", "x"), (401, "", "en", "s", "x"), (402, "123 !!", "en", "s", "x"), (403, rows[5][1], rows[5][2], "s", "x"), (404, "the " * 30_000, "en", "s", "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


def test_language_identification(spark, corpus):
    rows = {r["doc_id"]: r for r in language_id.identify_languages(frame(spark, corpus)).collect()}
    held = [r for r in corpus[:400] if rows[r[0]]["held_out"] and r[2]]
    assert len(held) > 80 and sum(rows[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held)
    for i in (400, 401, 402):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True)
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= rows[i]["score"] <= 1 for i in rows)
    assert rows[404]["lang_pred"] == "en" and sum(rows[i]["rejected"] for i in range(400)) <= 2


def test_character_models_are_distributions():
    counts = {"a": Counter(), "b": Counter()}
    for lang, words in (("a", ["abab", "ba", "aab"]), ("b", ["bbb", "ab"])):
        for w in words:
            w = language_id.BEGIN + w + language_id.END
            for end in range(2, len(w) + 1):
                counts[lang][w[max(0, end - language_id.ORDER) : end]] += 1
    model = language_id.fit_counts(counts)
    for history in ("", "a", "ab", "aba", "zz"):
        whole = np.zeros(2)
        for c in ("a", "b", language_id.END):  # with the share of one mark that was never seen, they sum to one
            both = model.score_words([history + c if c != language_id.END else history, history])
            if c == language_id.END:
                step = both[0]
                base = sum_prefix(model, history)
                whole += np.exp(step - base)
            else:
                whole += np.exp(sum_prefix(model, history + c) - sum_prefix(model, history))
        assert np.all(whole < 1) and np.all(whole > 0.5)


def sum_prefix(model, word):
    """log probability of a word's letters, without its end."""
    if not word:
        return np.zeros(len(model.languages))
    out = np.zeros(len(model.languages))
    codes = np.frombuffer((language_id.BEGIN + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
    for place in range(1, len(codes)):
        p = np.full(len(model.languages), 1 / model.marks)
        for k in range(min(language_id.ORDER, place + 1)):
            h = language_id._hashes(codes[: place + 1])[k][place]
            share = lookup(model, h, "share", 0.0)
            back = model.empty if k == 0 else lookup(model, language_id._hashes(codes[:place])[k - 1][place - 1], "back", 1.0)
            p = share + back * p
        out += np.log(p)
    return out


def lookup(model, key, name, default):
    """[language]: what each language's own table has for a hash."""
    places = [(g, int(np.searchsorted(g.keys, key))) for g in model.grams]
    return np.array([getattr(g, name)[at] if at < len(g.keys) and g.keys[at] == key else default for g, at in places], float)


def test_vectorised_scores_equal_one_by_one():
    counts = {"a": Counter({"\x02ab": 3, "\x02abc": 2, "b": 0}), "b": Counter({"\x02cb": 2})}
    model = language_id.fit_counts(counts)
    for w in ("abc", "cab", "zz"):
        whole = model.score_words(["x", w])[1]
        assert np.all(whole < sum_prefix(model, w) + 1e-9)


def test_no_labels_and_no_rows(spark):
    rows = [(1, "some text", None, "s", "x"), (2, None, None, "s", "x")]
    assert {r["lang_pred"] for r in language_id.identify_languages(frame(spark, rows)).collect()} == {"und"}
    assert language_id.identify_languages(frame(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        t = text_in(rng, "en")
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join([t.split()[0]] * 60), t.replace(" ", "### ")])
        rows.append((i, t, "en", "s", "x"))
        labels.append((i, int(good) if i % 50 else None))
    rows += [(500, None, None, None, "x"), (501, "", None, None, "x"), (502, "x" * 100_000, None, None, "x")]
    known = spark.createDataFrame([*labels, labels[1]], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.classify_quality(frame(spark, rows), known).collect()}
    held = [i for i, q in labels if q is not None and found[i]["held_out"]]
    assert len(held) > 60 and sum(found[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    assert found[500]["score"] == found[501]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert {r["predicted"] for r in quality.classify_quality(frame(spark, rows[:3]), known.limit(0)).collect()} == {1}


def test_interactions_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(2)
    size = quality.BUCKETS + len(quality.STATS) * (quality.BINS + 1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros((len(quality.STATS), quality.BINS - 1)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    at, x = rng.choice(size, 12, replace=False), rng.normal(size=12)
    margins, _ = m.margins(np.concatenate([at, at[:3]]), np.concatenate([x, x[:3]]), np.array([0, 12]))
    for got, k in zip(margins, (12, 3), strict=True):
        pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(k) for j in range(i))
        assert got == pytest.approx(0.3 + m.weights[at[:k]] @ x[:k] + pairs)


def test_fingerprints_of_edits(spark):
    rng = random.Random(8)
    texts = {i * 3 - 50: text_in(rng, rng.choice(list(WORDS)), rng.randrange(1, 90)) for i in range(60)}
    texts |= {1000: None, 1001: "", 1002: "||| ###", 1003: "x" * 70_000, 1004: texts[4], 1005: texts[4]}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, role string")
    rows = {r["doc_id"]: r for r in spotsigs.fingerprint_edits(docs).collect()}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(order)
    for k, i in enumerate(order):
        own, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        changed = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        a, b, c = (spotsigs.signatures(t) for t in (own, changed, following))
        assert rows[i]["n_chars"] == len(own) and rows[i]["edited_sha256"] == sha256(changed.encode()).hexdigest()
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (spotsigs.fingerprint(a), spotsigs.fingerprint(b))
        for got, u, v in ((rows[i]["near_edited"], a, b), (rows[i]["near_next"], a, c)):
            u, v = set(u.tolist()), set(v.tolist())
            assert got == pytest.approx(len(u & v) / len(u | v) if u | v else 1.0)


def test_similar_fingerprints_equal_brute_force(spark):
    rng = random.Random(9)
    base = text_in(rng, "en", 200).split()
    texts = []
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(len(own))] = rng.choice(WORDS["de"] + ["word"])
        texts.append(" ".join(own[: rng.randrange(120, 200)]))
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], None, ""])), "doc_id long, text string")
    signed = [spotsigs.signatures(t) for t in texts]
    first = {}
    for i, s in enumerate(signed):
        first.setdefault(s.tobytes(), i)
    ids = sorted(first.values())
    want = {(i, j) for i in ids for j in ids if i < j and spotsigs.likeness(signed[i], signed[j], 0.8)}
    got = {(r["left_id"], r["right_id"]) for r in spotsigs.similar_fingerprints(spotsigs.fingerprint_documents(docs)).collect()}
    assert want and got == want


def test_language_model(spark, corpus):
    docs = frame(spark, corpus)
    rows = {r["doc_id"]: r for r in maxent_lm.score_held_out(docs).collect()}
    words = {i: (t or "").encode().lower().split() + [b""] for i, t, *_ in corpus}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["score"] < 0
    held = [r for i, r in rows.items() if r["held_out"] and i < 400]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and rows[5]["score"] == pytest.approx(rows[403]["score"])


def test_class_factors_sum_to_one(spark, corpus):
    """Over all words and one unseen word of each cluster, given some history."""
    train = frame(spark, corpus).select("doc_id", "text").where("text is not null")
    model = maxent_lm.fit(train)
    v = model.vocabulary.prepare()
    words = [(bytes(r["word"]), r["n"]) for r in model.counts.collect()]
    total = np.zeros(maxent_lm.CLASSES)
    for w, n in words:
        own = v.words.index(w) if w in v.words else len(v.words) + v.cluster(w)
        total[v.classes[own]] += n + maxent_lm.SMOOTHING
    total[1 + maxent_lm.SINGLE + maxent_lm.BANDS - 1 :: maxent_lm.BANDS] += model.unseen
    assert np.all(total <= model.mass + 1e-6) and (model.mass - total).sum() <= maxent_lm.SMOOTHING * maxent_lm.CLASSES
    ids, sizes, rare, rares = maxent_lm.encode(v, pa.array(["the of and", "", "  \t", " Qqq  É the\x1cof "]))
    assert sizes.tolist() == [4, 1, 1, 4] and rare.to_pylist() == ["qqq", "É", "the\x1cof"] and rares.tolist() == [0, 0, 0, 3] and len(ids) == 11
    assert np.exp(maxent_lm.log_softmax(model.weights, model.bias, maxent_lm.features(v, ids))).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_group_sums():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, 3)).astype(np.float32)
    starts = np.array([0, 1, 2, 5, 100, 101, 390])
    assert np.allclose(maxent_lm.group_sums(rows, starts), np.add.reduceat(rows, starts, axis=0), atol=1e-4)


def test_contexts_back_off_to_the_classes_of_two_words(monkeypatch):
    """Contexts of new words share the row of their two classes, and no gradient step takes more than 4096 tokens."""
    words = [b"", *(b"w%d" % i for i in range(900))]
    v = maxent_lm.Vocabulary(words, np.arange(len(words), 0, -1).astype(float), maxent_lm.Letters(np.zeros(0, np.uint32), np.zeros((0, maxent_lm.CLUSTERS)))).prepare()
    near, far = (maxent_lm.features(v, np.array([first, two, one, 3]))[-1] for first, two, one in ((2, 700, 701), (5, 702, 703)))
    assert v.classes[700] == v.classes[703] and v.classes[2] != v.classes[5]
    assert len(near) == 6 and (near == far).sum() == 1
    sizes = []
    plain = maxent_lm.log_softmax
    monkeypatch.setattr(maxent_lm, "log_softmax", lambda w, b, rows: sizes.append(len(rows)) or plain(w, b, rows))
    weights, seen = np.zeros((1 << maxent_lm.ROW_BITS, maxent_lm.CLASSES), np.float32), np.ones(1 << maxent_lm.ROW_BITS, np.float32)
    maxent_lm.steps(v, weights, np.zeros(maxent_lm.CLASSES, np.float32), seen, np.zeros(len(seen)), np.arange(9001) % 900)
    assert sizes == [4096, 4096, 808]


def test_words_that_are_not_frequent_are_themselves_as_history():
    """Words of one cluster that aren't broadcast have features and a place in common with their kind only."""
    v = maxent_lm.Vocabulary([b"", b"the", b"of"], np.array([9.0, 5, 3]), maxent_lm.Letters(np.zeros(0, np.uint32), np.zeros((0, maxent_lm.CLUSTERS)))).prepare()
    ids, sizes, rare, _ = maxent_lm.encode(v, pa.array(["the zebra of", "the quagga of", "the zebra of"]))
    assert sizes.tolist() == [4, 4, 4] and rare.to_pylist() == ["zebra", "quagga", "zebra"]
    zebra, quagga, again = ids[2], ids[6], ids[10]
    assert zebra == again != quagga and v.places(ids).max() < len(v.classes) == len(v.log_counts)
    assert len(set(v.classes[v.places(np.array([zebra, quagga]))].tolist())) == 1
    rows = maxent_lm.features(v, ids)
    assert (rows[2] == rows[10]).all() and rows[2][0] != rows[6][0] and rows[2][3] != rows[6][3]
    assert (rows[2][4:] == rows[6][4:]).all()  # classes


def test_letters_of_all_whole_texts_are_counted(spark, monkeypatch):
    """Far into a text and outside the sample that the centers are fitted on, too."""
    monkeypatch.setattr(maxent_lm, "SAMPLE_DOCUMENTS", 2)
    rng = random.Random(6)
    rows = [(i, text_in(rng, rng.choice(list(WORDS))) + f" q{i:02d}z") for i in range(60)] + [(60, "the " * 6000 + "zqxzqv éé a"), (61, "")]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    v = maxent_lm.fit(train).vocabulary
    want = Counter(key for _, t in rows for w in t.encode().lower().split() for key in (b"<" + w[:3], b">" + w[-3:]))
    assert all(v.clusters.get(key) is not None for key in want) and v.clusters.get(b"<zzz") is None
    centers = np.eye(maxent_lm.CLUSTERS, 3)
    got = {bytes(r["key"]): sum(r[f"n{k}"] for k in range(maxent_lm.CLUSTERS)) for r in maxent_lm.count_letters(train, pa.array(["the", "der", "le"]), centers).collect()}
    assert got == want


def test_centers_are_of_all_texts(spark, monkeypatch):
    """Every text pulls its center, and how texts are dealt to tasks changes nothing."""
    monkeypatch.setattr(maxent_lm, "SAMPLE_DOCUMENTS", 2)  # no bound counts
    rng = random.Random(8)
    rows = [(i, text_in(rng, rng.choice(list(WORDS)))) for i in range(90)] + [(90, "the " * 70_000 + "of"), (91, ""), (92, "zz"), (None, "der die")]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    common = pa.array([w for own in WORDS.values() for w in own[:6]])
    x = maxent_lm.profiles(common, *maxent_lm.split_words(pa.array([t for _, t in rows])))
    got = maxent_lm.fit_centers(train.repartition(3), common, rounds=40)
    assert (got == maxent_lm.fit_centers(train.repartition(7), common, rounds=40)).all()
    near = (x @ got.T).argmax(axis=1)
    assert len(set(near.tolist())) > 2
    for k in set(near.tolist()):  # k-means has settled: each center is that of all its texts
        m = x[near == k].sum(axis=0)
        assert got[k] == pytest.approx(m / np.linalg.norm(m), abs=1e-5)
    seen = []
    plain = maxent_lm.count_letters
    monkeypatch.setattr(maxent_lm, "count_letters", lambda train, common, centers: seen.append((common, centers)) or plain(train, common, centers))
    maxent_lm.fit(train)
    assert (seen[0][1] == maxent_lm.fit_centers(train, seen[0][0])).all()


@pytest.mark.parametrize("n", [24, 90, 400])
def test_gibberish_of_letters_is_rejected_at_any_size(spark, n):
    """Languages with few texts have a limit, too; their own texts stay."""
    rng = random.Random(12)
    rows = [(i, text_in(rng, lang := list(WORDS)[i % 8 % 3]), lang) for i in range(n)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(WORDS) and np.all(np.isfinite(model.limit))
    wild = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(60)) for _ in range(20)]
    new = [(i, t) for i, t in enumerate(wild + [text_in(rng, x) for x in WORDS for _ in range(10)])]
    rows = language_id.identify(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert all(r["rejected"] == (r["doc_id"] < 20) for r in rows)
