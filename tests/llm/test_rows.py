"""Odd rows and tables: null and repeated doc_ids, hot groups, long words, many labels; and what an index or a store must hold."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

import corpus_pipeline
from lociforge.llm import exact_dedup, language_id, near_dedup, packing, quality, sharding, spotsigs
from lociforge.llm.common import WordCache, small_batches
from lociforge.llm.merges import model_path


def table(spark, path, rows, schema="doc_id long, text string, _row int"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "bb"), (2, "bb"), (3, "cc"), (None, "cc"), (None, "zz"), (None, None), (7, ""), (None, "")]


def test_one_row_of_each_text_stays(spark, tmp_path):
    docs = table(spark, tmp_path / "odd", [(i, t, k) for k, (i, t) in enumerate(ODD)])
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, "zz"), (1, "a b c d e f"), (2, "bb"), (3, "cc"), (7, "")]
    rest = near_dedup.drop_near_duplicates(docs).collect()
    assert Counter(r["text"] or "" for r in rest) == Counter({"a b c d e f": 1, "bb": 1, "cc": 1, "zz": 1, "": 3})


def test_the_directory_decides(spark, tmp_path):
    """Documents of a bucket that the directory lacks aren't found; pages hold what the last depth can't split."""
    docs = table(spark, tmp_path / "t", [(i, f"text {i % 300}", 0) for i in range(400)])
    index = exact_dedup.build_index(docs, capacity=8, max_depth=3)
    assert index.depth == 3 and len(index.directory) == 8 and all(pages > 1 for _, _, pages in index.directory)
    assert exact_dedup.look_up(docs, index).count() == 400 and index.entries.count() == 300
    held = {(r["bucket"], r["page"]): r["n"] for r in index.entries.groupBy("bucket", "page").count().withColumnRenamed("count", "n").collect()}
    assert len(held) > 20
    lost = sum(r["group_size"] for r in index.entries.where("bucket = 7").collect())
    index.directory.pop()
    assert exact_dedup.look_up(docs, index).count() == 400 - lost < 400
    one = exact_dedup.build_index(docs, capacity=1000)
    assert one.depth == 0 and one.directory == [(0, 0, 1)]


def test_chains_tell_texts_under_one_key_apart(spark, tmp_path, monkeypatch):
    plain = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda docs: plain(docs).selectExpr("doc_id", "row", "text", "5L as key", "n_bytes % 2 as check", "4L as n_bytes"))
    texts = ["a", "b", "aa", "a", "b", "cc", "a"]
    rows = exact_dedup.exact_duplicates(table(spark, tmp_path / "t", [(i, t, 0) for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == {i: (max(k for k, u in enumerate(texts) if u == t), texts.count(t)) for i, t in enumerate(texts)}


def test_edits_of_odd_rows(spark, tmp_path):
    """Every row is returned; nulls come last, hot doc_ids and nulls are cut into ranges, and the last row's next is the first."""
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rng.choice("the a of cat dog sun moon tree".split()) for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(7, f"hot {k} the sun is on") for k in range(150)] + [(None, f"none {k % 9} the cat") for k in range(150)] + [(None, None)] * 40
    docs = table(spark, tmp_path / "t", [(i, t, 0) for i, t in rows])
    got, texts = defaultdict(list), defaultdict(list)
    for r in spotsigs.fingerprint_edits(docs).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        texts[i].append(t or "")
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in texts.items()}
    order = [*sorted((i for i in texts if i is not None), reverse=True), None]
    for i, j in zip(order, order[1:] + order[:1]):
        if len(texts[i]) == 1:
            assert got[i][0]["edited_sha256"] in {sha256(spotsigs.edited(texts[i][0], u).encode()).hexdigest() for u in texts[j]}
        else:  # all but the last of a group are followed by one of it
            inner = {sha256(spotsigs.edited(t, u).encode()).hexdigest() for t in set(texts[i]) for u in set(texts[i])}
            assert sum(r["edited_sha256"] not in inner for r in got[i]) <= 1
    assert spotsigs.fingerprint_edits(docs.limit(0)).count() == 0


def plain_kneser_ney(model_counts, orders, marks, word):
    """One language's log-probability of a word, from the definition, in dicts."""
    levels = [Counter() for _ in range(orders + 1)]
    for s, n in model_counts.items():
        levels[len(s)][s] += n
    for k in range(orders, 1, -1):
        for s in list(levels[k]):
            levels[k - 1][s[1:]] += 1
    discounts = []
    for level in levels:
        once, twice = (sum(n == x for n in level.values()) for x in (1, 2))
        discounts.append(min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5)))

    def p(history, c):
        if not history and not levels[1]:
            return 1 / marks
        k = len(history) + 1
        after = {s: n for s, n in levels[k].items() if s[:-1] == history}
        lower = p(history[1:], c) if history else 1 / marks
        if not after:
            return lower
        total = sum(after.values())
        return max(0.0, after.get(history + c, 0) - discounts[k]) / total + discounts[k] * len(after) / total * lower

    w = language_id.BEGIN + word + language_id.END
    return sum(math.log(p(w[max(0, i - orders + 1) : i], w[i])) for i in range(1, len(w)))


def test_kneser_ney_equals_its_definition():
    counts = {"a": Counter(), "b": Counter()}
    for lang, words in (("a", ["abab", "ba", "aab", "abcab", "ba"]), ("b", ["bbb", "ab", "cabba"])):
        for w in words:
            w = language_id.BEGIN + w + language_id.END
            for end in range(2, len(w) + 1):
                counts[lang][w[max(0, end - language_id.ORDER) : end]] += 1
    model = language_id.fit_counts(counts)
    words = ["abab", "a", "cab", "xyz", "bbbbbbb", "abcabba"]
    got = model.score_words(words)
    for x, lang in enumerate(model.languages):
        assert got[:, x] == pytest.approx([plain_kneser_ney(counts[lang], language_id.ORDER, model.marks, w) for w in words], rel=1e-5)


def test_a_long_word_is_scored_in_slices(monkeypatch):
    counts = {"a": Counter({"\x02ab": 3, "\x02aba": 2, "abab\x03": 1, "\x02a": 4}), "b": Counter({"\x02b": 2, "\x02b\x03": 2})}
    model = language_id.fit_counts(counts)
    word = "ab" * 5000
    whole = model.score_words([word])
    monkeypatch.setattr(language_id, "SCORED", 64)
    assert model.score_words(["a", word, "b"])[1] == pytest.approx(whole[0])
    scored = language_id._Scored(model)
    texts = __import__("pyarrow").array([f"a {word} b", None, "ab", word])
    sums = scored.sums(texts)
    assert word not in scored.rows and sums[1].tolist() == [0, 0, 0] and sums[0, 2] == len(word) + 5
    assert sums[0, :2] == pytest.approx(whole[0] + model.score_words(["a"])[0] + model.score_words(["b"])[0], rel=1e-5)


def test_more_labels_than_a_model_takes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)] + [(100 + i, "zz qq", f"x{i}") for i in range(5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]


def test_filters_keep_rows_as_they_are(spark, tmp_path):
    """All columns, rows that share a doc_id or have none; decisions equal those text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("if(doc_id % 5 = 0, null, doc_id % 40) as doc_id", "text", "lang", "array(source) as _row", "n_chars as lang_pred")
    docs.write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    model = language_id.train(docs)
    kept = language_id.keep_languages(docs, model)
    assert kept.schema == docs.schema
    text = lambda rows: Counter(r["text"] for r in rows)
    scored = language_id._Scored(model)
    want = Counter(r["text"] for r in docs.collect() if not language_id._judged(scored, __import__("pyarrow").array([r["text"]]))[3][0])
    assert text(kept.collect()) == want
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    machine = quality.train(docs, labels)
    want = Counter(r["text"] for r in docs.collect() if quality._scores(machine, __import__("pyarrow").array([r["text"]]))[0] >= quality.THRESHOLD)
    assert text(quality.keep_good(docs, machine).collect()) == want and 0 < want.total() < docs.count()


def test_pieces_are_dealt_evenly_and_whole(spark, tmp_path):
    """Rows without a doc_id don't meet in one block; full pieces are alone in their sequences."""
    rows = [(None, "one two three") for _ in range(300)] + [(i, "word " * 9000) for i in range(3)]
    got = packing.pack(table(spark, tmp_path / "t", [(i, t, 0) for i, t in rows]), block_pieces=40).toPandas()
    assert len(got) == 300 + 3 * 3 and got.sequence_id.nunique() > 6
    own = got[got.sequence_id >= 0].groupby(got.sequence_id.floordiv(1 << 32)).size()
    assert len(own) == 8 and own.max() < 4 * own.min() + 20
    full = got[got.sequence_id < 0]
    assert len(full) == 6 and full.sequence_id.is_unique and (full.length == 4096).all() and (full.offset == 0).all()
    used = got.sort_values(["sequence_id", "offset"])
    assert (used.groupby("sequence_id").length.cumsum() - used.length == used.offset).all() and got.groupby("sequence_id").length.sum().max() <= 4096


def test_every_step_takes_the_smallest_sum_of_squares():
    rng = random.Random(4)
    for _ in range(40):
        capacity = rng.choice([7, 12, 30])
        lengths = np.array([rng.randrange(1, capacity) for _ in range(60)])
        for eager in (True, False):
            bins, offsets, used = packing.sum_of_squares(lengths, capacity, eager)
            levels: dict[int, int] = {}
            for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
                def total(at, levels=levels, s=s):
                    now = {**levels, at: levels.get(at, 0) + s}
                    return sum(n * n for n in Counter(capacity - x for x in now.values() if x < capacity).values())
                room = [x for x, n in levels.items() if n + s <= capacity]
                choices = [total(x) for x in room] + ([total(-1)] if eager or not room else [])
                assert o == levels.get(b, 0) and total(b) == min(choices)
                levels[b] = levels.get(b, 0) + s
            assert len(levels) == used and max(levels.values()) <= capacity


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    own = packing.WordTokens("byte_bpe_50k.json")
    texts = ["Two  spaces\nand lines", "", "it's o'clock"]
    plain = Tokenizer.from_file(model_path("byte_bpe_50k.json"))
    assert not own.by_word and packing.WordTokens(packing.MODEL).by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_cost_no_encoding_each(monkeypatch):
    """Runs of letters and of marks go to the tokenizer's model; only other words are encoded as texts. Ids are the library's."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(model_path(packing.MODEL))
    own, encoded, rng = packing.WordTokens(packing.MODEL), [], random.Random(6)
    encode = own._encode
    monkeypatch.setattr(own, "_encode", lambda words: encoded.extend(words) or encode(words))
    odd = ["\u212aelvin", "\u212bngstr\u00f6m,", "\u0178", "\u1e9e!", "\u0130stanbul", "J\u030c", "\u03a3\u03a3", "ab\u2028cd", "a\rb", "x_y", "don't", "...", "<|endoftext|>", "\x1c", "\u00b5m", "\u00d7", "12"]
    made = ["".join(rng.choice("abdeinorst\u00e9\u00f1\u00dfAEZ\u00c9") for _ in range(rng.randint(1, 12))) + rng.choice(["", ",", "!!", "%%%", ")-"]) for _ in range(3000)]
    texts = [" ".join(odd), "\n".join(odd), " ".join(made), *odd]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not set(encoded) & set(made) and set(encoded) <= set(odd)


def test_words_that_come_once_fill_no_cache():
    own = packing.WordTokens(packing.MODEL)
    held, room = len(own.cores) + len(own.known), dict(own.room)
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:10]]
    for at in range(0, len(words), 8000):
        own([" ".join(words[at : at + 8000])])
    assert len(own.cores) + len(own.known) - held < 0.2 * len(words)
    own([" ".join(words[:8000])])
    assert set(words[:8000]) <= own.cores.keys() and all(own.room[k] < room[k] for k in room)


def test_packing_depends_on_the_pieces_alone(spark, tmp_path):
    """However rows are dealt to tasks, repeated ones and full pieces included; one row's many copies are dealt like others."""
    rows = [(None, "one two three")] * 9000 + [(5, "word " * 9000)] * 6 + [(i, "some words " * (i % 40)) for i in range(500)]
    docs = table(spark, tmp_path / "t", [(i, t, 0) for i, t in rows])
    packed = [packing.pack(d, block_pieces=1000).toPandas().fillna(-1) for d in (docs, docs.repartition(5), docs.coalesce(1))]
    first, *others = [sorted(map(tuple, p.astype("int64").to_numpy().tolist())) for p in packed]
    assert len(first) == 9000 + 6 * 3 + 500 and all(p == first for p in others)
    short = packed[0][packed[0].sequence_id >= 0]
    each = short.groupby(short.sequence_id.floordiv(1 << 32)).size()
    assert len(each) >= 9 and each.max() < 1.5 * each.min()


def test_quality_holds_few_tokens_at_a_time(monkeypatch):
    """Many new tokens leave a worker little to keep, texts are read 1 M characters at a time, and scores don't depend on either."""
    import pyarrow as pa

    rng, made = random.Random(8), []
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300_000)]
    column = pa.array([" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)] + [None, "", "one text"])
    features = quality._features
    monkeypatch.setattr(quality, "_features", lambda chunk: made.append((len(quality._TOKENS.rows), sum(map(len, chunk)), len(chunk))) or features(chunk))
    n = quality.BUCKETS + len(quality.STATS) * (quality.BINS + 1)
    draw = np.random.default_rng(3)
    machine = quality.FactorisationMachine(0.1, draw.normal(size=n), draw.normal(size=(n, quality.RANK)), np.zeros((len(quality.STATS), quality.BINS - 1)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    quality._own_worker()
    together = quality._scores(machine, column)
    assert max(size for _, size, k in made) <= (1 << 20) + 10_000 and max(held for held, _, _ in made) <= 250_000
    assert len(quality._TOKENS.rows) < 250_000
    apart = [quality._scores(machine, column.slice(at, 1))[0] for at in (0, 150, 299, 300, 301, 302)]
    assert np.allclose(together[[0, 150, 299, 300, 301, 302]], apart, rtol=1e-12)


def test_retained_versions_stay_readable(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000, fan_in=3)
    rng = random.Random(2)
    want = {}
    for k in range(5):
        rows = [(100 * k + i, "".join(rng.choice("abcdefghij") for _ in range(300))) for i in range(40)]
        store.append(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
        store.compact()
        want[store.version()] = 40 * (k + 1)
        if len(store.shards(store.version() - 1)):
            want.setdefault(store.version() - 1, sum(s["rows"] for s in store.shards(store.version() - 1)))
    assert store.version() > 5  # something was merged
    assert all(store.read(v).count() == n for v, n in want.items())
    reader = store.read(store.version() - 1)
    rows = want[store.version() - 1]
    assert store.vacuum(retain=2) > 0 and reader.count() == rows and store.read().count() == 200
    files = {p.name for p in (tmp_path / "store/data").glob("*/*.parquet")}
    assert files == {s["path"].rpartition("/")[2] for v in (store.version() - 1, store.version()) for s in store.shards(v)}
    before = store.version()
    with pytest.raises(FileExistsError):
        store._publish(before - 1, [], store._write(spark.createDataFrame([(1, "x")], "doc_id long, text string")))
    assert store.version() == before and {p.name for p in (tmp_path / "store/data").glob("*/*.parquet")} == files


def test_groups_follow_the_tiers(spark, tmp_path):
    """Against the policy in plain words: within a tier, in order, groups up to 1.25 targets; a tier waits for a fan-in of shards."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1000, fan_in=3)
    rng = random.Random(5)
    for _ in range(60):
        shards = [{"path": f"p{k:03d}", "bytes": (n := rng.randrange(1, 1500)), "rows": 1, "tier": store.tier(n)} for k in range(rng.randrange(25))]
        for final in (False, True):
            groups = store._groups(shards, final)
            taken = [s["path"] for g in groups for s in g]
            assert len(set(taken)) == len(taken) and all(len(g) > 1 and len({s["tier"] for s in g}) == 1 and g[0]["tier"] for g in groups)
            assert all(sum(s["bytes"] for s in g) <= 1250 or len(g) == 1 for g in groups)
            for t in {s["tier"] for s in shards if s["tier"]}:
                alike = [s for s in shards if s["tier"] == t]
                if len(alike) < 3 and not final:
                    assert not any(s["tier"] == t for g in groups for s in g)


def test_one_file_makes_four_arrivals(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = sharding.shard_documents(spark.read.parquet(str(tmp_path / "one"))).collect()
    assert len(rows) == 500 and rows[0]["version"] >= 5  # four arrivals and a merge


def test_empty_tables(spark):
    from lociforge.llm import queries  # noqa: F401
    from lociforge.llm.maxent_lm import score_held_out
    from lociforge.llm.piece_counting import count_tokens
    from lociforge.llm.piece_encoding import encode_digests

    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    for f in (encode_digests, sharding.shard_documents, count_tokens, exact_dedup.exact_duplicates, near_dedup.near_duplicates, packing.pack, language_id.identify_languages, spotsigs.fingerprint_edits, score_held_out):
        assert f(none).count() == 0
    assert quality.classify_quality(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_odd_rows_go_through_the_pipeline(spark, tmp_path):
    """Rows without a doc_id are judged like any other, and rows that repeat doc_id and text leave one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.where("doc_id % 10 = 0").withColumn("doc_id", docs["doc_id"] * 0 + 3).unionByName(docs.where("doc_id % 7 = 1").selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:])).unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id < 50"))
    odd.write.parquet(str(tmp_path / "0"))
    now = spark.read.parquet(str(tmp_path / "0"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1], 1):
        stage(spark, now, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        if name == "exact":
            texts = [r["text"] for r in now.collect()]
            assert len(set(texts)) == len(texts) and set(texts) == {r["text"] for r in before.collect()}
    assert now.where("doc_id is null").count() > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
    assert pieces.where("piece = 0").count() == now.count()


def test_caches_are_bounded_in_bytes():
    cache = WordCache(len, 1000)
    assert [cache["x" * 5000], cache["ab"], cache["ab"]] == [5000, 2, 2] and "x" * 5000 not in cache and "ab" in cache
    for k in range(100):
        assert cache[str(k)] == len(str(k))
    assert len(cache) < 10


def test_small_batches_restore_the_session(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark):
        with small_batches(spark):
            assert spark.conf.get(key) == "1000"
        assert spark.conf.get(key) == "1000"
    assert spark.conf.get(key) == before
