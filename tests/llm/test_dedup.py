"""Exact and near duplicates against brute force, and the shard store."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociforge.llm.components import components
from lociforge.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, split_buckets
from lociforge.llm.near_dedup import near_duplicates, prefix_lengths, prefixes, shingles
from lociforge.llm.sharding import ShardStore, shard_documents

SCHEMA = "doc_id long, text string, keep_id string, key string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], SCHEMA)


def test_exact_duplicates(spark):
    texts = ["a", "b", "a", None, "", "a ", "x" * 200_000, "x" * 200_000, "A", None]
    rows = {r["doc_id"]: r for r in exact_duplicates(frame(spark, texts), capacity=1).collect()}
    for i, t in enumerate(texts):
        same = [k for k, u in enumerate(texts) if (u or "") == (t or "")]
        assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (max(same), len(same), i == max(same))
    assert {r["doc_id"] for r in drop_exact_duplicates(frame(spark, texts)).collect()} == {1, 2, 5, 7, 8, 9}
    assert exact_duplicates(frame(spark, [])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 9), min_size=1), st.integers(1, 40))
def test_directory_splits_only_overfull_buckets(counts, capacity):
    buckets, depth = split_buckets(counts, capacity, 8)
    cells = [range(p << (8 - d), (p + 1) << (8 - d)) for p, d in buckets]
    assert sorted(c for r in cells for c in r) == list(range(256))
    held = {b: sum(counts.get(c, 0) for c in r) for b, r in zip(buckets, cells, strict=True)}
    assert all(n <= capacity or d == 8 for (_, d), n in held.items())
    for (p, d), n in held.items():
        if d:
            assert sum(counts.get(c, 0) for c in range((p >> 1) << (9 - d), ((p >> 1) + 1) << (9 - d))) > capacity
    assert depth == max(d for _, d in buckets)


def sets_of(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def brute_components(texts, words, percent=80):
    sets = sets_of(texts, words)
    least = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0]
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            changed |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    return least, [len(s) for s in sets]


def mutated(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(k, f"w{rng.randrange(10**6)}"), lambda: words.pop(k), lambda: words.insert(k, f"w{rng.randrange(10**6)}")])()
    return words


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_equal_brute_force(spark, seed):
    """Chains of edits around the threshold, families of a hot text, shared passages, and odd texts."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(mutated(rng, base, rng.randrange(0, 9))) for _ in range(150)]
    chain = base[:80]
    for _ in range(40):
        chain = mutated(rng, chain, 2)
        texts.append(" ".join(chain))
    texts += [" ".join(base[: 120 - k]) for k in range(0, 60, 3)]
    texts += [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 60))]) for _ in range(60)]
    texts += [None, "", " \n", "one two", "ONE\ttwo", "one", "one two three", texts[3], texts[3], "İ ſ", "i s", "x" * 100_000]
    rng.shuffle(texts)
    rows = {r["doc_id"]: r for r in near_duplicates(frame(spark, texts), 4).collect()}
    least, sizes = brute_components(texts, 4)
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(texts))] == least
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows.values())


@settings(max_examples=400, deadline=None)
@given(st.sets(st.integers(0, 30), min_size=6), st.sets(st.integers(0, 30), min_size=1), st.sets(st.integers(0, 30), min_size=1), st.sampled_from([60, 80]))
def test_prefixes_of_differences_meet(center, x, y, percent):
    """Two linked sets of which not both are linked with the center share an element of the prefixes for each other's class."""
    like = lambda s, t: 100 * len(s & t) >= percent * len(s | t)
    if x == y or center in (x, y) or not like(x, y) or (like(x, center) and like(y, center)):
        return
    order = random.Random(len(center)).sample(range(31), 31)
    found = []
    for s in (x, y):
        d = sorted(s ^ center, key=order.index)
        own, lengths = prefix_lengths(len(d), len(s), len(center), like(s, center), percent)
        found.append((own, {k: (set(d[:n]), shown) for k, n, shown in lengths}))
    (cx, px), (cy, py) = found
    (dx, shown_x), (dy, shown_y) = px[cy], py[cx]
    assert len(dx & dy) >= min(shown_x, shown_y) >= 1


def test_prefixes_are_ordered_by_counts_over_the_whole_family(spark):
    """However few members hold an element; those that nobody of another component shares have places, but no rows."""
    rng = random.Random(4)
    d = {b: sorted({rng.randrange(10, 90) if rng.random() < 0.5 else rng.randrange(100, 4000) for _ in range(40)} | {1, 2, 5000 + b}) for b in range(1, 301)}
    part = {b: b if b % 3 else 0 for b in d}  # a third is in the center's component
    family = spark.createDataFrame([(0, b, 100, 100, not b % 3, part[b] != 0, part[b], 0, x) for b, x in d.items()], "a long, b long, a_n long, n long, linked boolean, apart boolean, part long, main long, d array<long>")
    holders = {}
    for b, x in d.items():
        for e in x:
            holders.setdefault(e, []).append(b)
    shared = {e for e, own in holders.items() if len({part[b] for b in own}) > 1}
    assert sum(2 <= len(holders[e]) <= 4 for e in shared) > 100  # too few for any sample
    rows = prefixes(family).collect()
    want = set()
    for b, x in d.items():
        order = sorted(x, key=lambda e: (e in shared, len(holders[e]) if e in shared else 0, e))
        own, found = prefix_lengths(len(x), 100, 100, not b % 3, 80)
        want |= {(b, own, other, shown, k, e) for other, length, shown in found for k, e in enumerate(order[:length]) if e in shared}
    got = [(r["b"], r["own"], r["other"], r["shown"], r["place"], r["e"]) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert all(r["size"] == len(d[r["b"]]) and r["apart"] == (r["part"] != 0) and r["n"] == 100 for r in rows)


def test_shingles_of_short_texts():
    assert len(shingles("", 4)) == 0 and len(shingles(" \t", 4)) == 0
    assert np.array_equal(shingles("A b", 4), shingles("a\nB", 4)) and not np.array_equal(shingles("a b", 4), shingles("b a", 4))
    assert len(shingles("a a a a a a", 4)) == 1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_store_merges_and_commits(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store", target_bytes=60_000, fan_in=3)
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice("abcdefghij ") for _ in range(400))) for i in range(600)]
    for k in range(6):
        store.append(spark.createDataFrame(docs[100 * k : 100 * k + 100], "doc_id long, text string").coalesce(2))
        store.compact()
    before = store.version()
    store.compact(final=True)
    assert sorted((r["doc_id"], r["text"]) for r in store.read().collect()) == docs
    shards = store.shards()
    assert sum(s["rows"] for s in shards) == 600 and len(shards) < 12 and store.version() >= before
    with pytest.raises(FileExistsError):
        store.commit(store.version() - 1, [])
    assert [s for s in (tmp_path / "store/manifest").iterdir() if s.name.startswith(".") and not s.name.endswith(".crc")] == []


def test_sharding_keeps_every_row(spark, tmp_path):
    rows = [(i % 50, None if i % 7 == 0 else f"t{i}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "in"))
    found = shard_documents(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    sizes = {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
    assert all(sizes[r["shard"]] == r["shard_rows"] for r in found)
