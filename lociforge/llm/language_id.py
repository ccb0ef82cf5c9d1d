"""Language identification with interpolated Kneser-Ney character models, one per language.

A model sees a word as its lower-cased letters between a begin and an end mark, with histories of up to four marks or
letters inside the word, so a word's score is the same wherever it stands and is worked out once. Each language has an
array of n-gram hashes in ascending order, with arrays of probability shares and back-off weights beside it. The
language with the lowest cross-entropy per letter wins; texts whose cross-entropy is far beyond what
the language's own texts show are marked as rejected. Each sampled text is measured by a model of the texts that aren't
in its fold; languages with few texts get the limit that the texts of all languages show together.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, use_worker, written

ORDER = 5
#: Labelled documents per language that a model is fitted on, about; all of them calibrate it, too.
SAMPLE_DOCUMENTS = 1500
#: Languages a model may have: those with the most labelled documents.
MAX_LANGUAGES = 200
#: Parts of the sample that are measured by a model of the others, and texts from which a language has its own limit.
FOLDS, OWN_TEXTS = 3, 20
#: Letters of evidence from which the posterior doesn't sharpen any more.
EVIDENCE = 100
#: Words whose scores a worker keeps.
WORDS = 250_000
#: Letters and marks that are scored at a time.
SCORED = 1 << 16
#: Letters of a word from which its score isn't kept.
LONG = 200
BEGIN, END = "\x02", "\x03"
UNKNOWN = "und"

_M = np.random.Generator(np.random.Philox(key=7)).integers(1, 2**63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hash of the k marks that end at each place, for k from 1 to ORDER; places before the k-th hold junk."""
    out, h = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            h = h.copy()
            h[k:] += codes[: max(0, len(codes) - k)] * _M[k]
            out.append((h ^ (h >> np.uint64(29))) * _M[ORDER] + np.uint64(k))
    return out


def words_of(token: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return (token if token.isalpha() else "".join([c if c.isalpha() else " " for c in token])).lower().split()


@dataclass
class Grams:
    """One language's n-grams: hashes in ascending order, and what each has."""

    keys: np.ndarray
    share: np.ndarray  # (count - discount) / count of the history
    back: np.ndarray  # weight of the shorter history, 1 where this one is unseen


@dataclass
class LanguageModel:
    languages: list[str]
    grams: list[Grams]
    empty: np.ndarray  # [language]: weight of the uniform distribution
    marks: int
    limit: np.ndarray  # [language]: cross-entropy beyond which a text is rejected
    width: np.ndarray

    def score_words(self, words: list[str]) -> np.ndarray:
        """[word, language]: natural log of the probability of the word's letters and end mark."""
        out = np.zeros((len(words), len(self.languages)))
        at = 0
        while at < len(words):
            first, size = at, 0
            while at < len(words) and (first == at or size + len(words[at]) + 2 <= SCORED):
                size += len(words[at]) + 2
                at += 1
            out[first:at] = self._score(words[first:at])
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        """Of words that fit a slice, or of one word of any length, whose slices overlap by a history."""
        joined = "".join([f"{BEGIN}{w}{END}" for w in words])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) + 2 for w in words])
        starts = np.cumsum(sizes) - sizes
        if len(codes) <= SCORED + ORDER:
            place = np.arange(len(codes)) - np.repeat(starts, sizes)
            return np.add.reduceat(self._logs(codes, place), starts, axis=0)
        sums = np.zeros((1, len(self.languages)))
        for at in range(0, len(codes), SCORED):
            first = max(0, at - ORDER)
            own = codes[first : at + SCORED]
            sums[0] += self._logs(own, np.arange(first, first + len(own)))[at - first :].sum(axis=0)
        return sums

    def _logs(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """[mark, language]: log-probability of each mark given those before it in its word; 0 for the first."""
        found = [np.unique(h, return_inverse=True) for h in _hashes(codes.astype(np.uint64))]  # a language looks each up once
        whole = [place >= max(k, 1) for k in range(ORDER)]
        out = np.empty((len(codes), len(self.languages)))
        for x, grams in enumerate(self.grams):
            p, before = np.full(len(codes), 1 / self.marks), np.full(len(codes), self.empty[x])
            for k, (kinds, back) in enumerate(found):
                at = np.minimum(np.searchsorted(grams.keys, kinds), len(grams.keys) - 1)
                hit = grams.keys[at] == kinds
                p = np.where(whole[k], np.where(hit, grams.share[at], 0)[back] + before * p, p)
                before = np.ones(len(codes))
                before[1:] = np.where(place >= k, np.where(hit, grams.back[at], 1)[back], 1)[:-1]
            p[place == 0] = 1
            out[:, x] = np.log(p)
        return out


def fit_counts(counts: dict[str, Counter]) -> LanguageModel:
    """From counts, per language, of the n-gram that ends at each place: of ORDER marks, or all from the begin mark."""
    languages = sorted(counts)
    marks = len({s[-1] for c in counts.values() for s in c}) + 1
    empty = np.ones(len(languages))
    tables = []
    for x, language in enumerate(languages):
        levels: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for s, n in counts[language].items():
            levels[len(s)][s] += n
        for k in range(ORDER, 1, -1):  # shorter n-grams count the distinct marks before them
            levels[k - 1].update(Counter(s[1:] for s in levels[k]))
        shares: dict[str, float] = {}
        backs: dict[str, float] = {}
        for k in range(1, ORDER + 1):
            level = levels[k]
            if not level:
                continue
            once, twice = sum(1 for n in level.values() if n == 1), sum(1 for n in level.values() if n == 2)
            discount = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
            total, kinds = defaultdict(int), Counter()
            for s, n in level.items():
                total[s[:-1]] += n
                kinds[s[:-1]] += 1
            for s, n in level.items():
                shares[s] = max(0.0, n - discount) / total[s[:-1]]
            for h, n in total.items():
                weight = discount * kinds[h] / n
                if h:
                    backs[h] = weight
                else:
                    empty[x] = weight
        tables.append(_table(shares, backs))
    return LanguageModel(languages, tables, empty, marks, np.full(len(languages), np.inf), np.ones(len(languages)))


def _table(shares: dict[str, float], backs: dict[str, float]) -> Grams:
    grams = list(shares.keys() | backs.keys())
    sizes = np.array([len(s) for s in grams])
    hashes = np.zeros(len(grams), np.uint64)
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(sizes == k)
        if len(at):
            codes = np.frombuffer("".join([grams[i] for i in at]).encode("utf-32-le"), np.uint32).astype(np.uint64)
            hashes[at] = _hashes(codes)[k - 1][k - 1 :: k]
    order = np.argsort(hashes)
    share, back = (np.array([found.get(s, none) for s in grams], np.float32)[order] for found, none in ((shares, 0.0), (backs, 1.0)))
    return Grams(hashes[order], share, back)


_scores: list[_Scored] = []


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    use_worker("language", _scores.clear)
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words[language].update(text.split())
        for language, found in words.items():
            own = counts[language]
            for token, n in found.items():
                for w in words_of(token):
                    w = BEGIN + w + END
                    for end in range(2, len(w) + 1):
                        own[w[max(0, end - ORDER) : end]] += n
    rows = [(language, s, n) for language, own in counts.items() for s, n in own.items()]
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])


def train(labelled: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> LanguageModel:
    """A model from ``doc_id, text, lang`` rows; those with a null lang or text are left out.

    About ``sample_documents`` rows of each language are read, chosen by hash of doc_id and text; n-grams are counted on
    the executors. Of more than MAX_LANGUAGES values of lang those with the most rows are learned (the first by name of
    equals). Without labelled text the model has no language; repeated rows count again; other columns are not read.
    """
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return fit_counts({})
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text")), F.lit(1_000_000))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, 1.1 * sample_documents / n)) + 1))])
    sample = written(rows.where(spot < share[F.col("lang")]), "language-sample")
    fold = F.pmod(F.xxhash64(F.lit("role"), F.col("doc_id"), F.col("text")), F.lit(FOLDS))
    parts = []
    for k in range(FOLDS):
        grams = sample.where(fold == k).select("lang", "text").mapInArrow(_counting, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        parts.append(grams.toArrow())
    seen = []
    for k in range(FOLDS):
        part = _fit_tables([p for x, p in enumerate(parts) if x != k])
        found = identify(sample.where(fold == k), part, keep="lang").where("lang = lang_pred and cross_entropy is not null").select("lang", "cross_entropy").toPandas()
        seen += zip(found["lang"], found["cross_entropy"], strict=True)
        del part
    model = _fit_tables(parts)
    _set_limits(model, seen, _marks(parts))
    del parts
    release()
    discard(sample)
    return model


def _fit_tables(tables: list[pa.Table]) -> LanguageModel:
    whole = pa.concat_tables(tables).group_by(["lang", "gram"]).aggregate([("n", "sum")])
    counts: dict[str, Counter] = defaultdict(Counter)
    for language, gram, n in zip(*(whole.column(c).to_pylist() for c in ("lang", "gram", "n_sum")), strict=True):
        counts[language][gram] = n
    return fit_counts(counts)


def _marks(tables: list[pa.Table]) -> dict[str, int]:
    """Different letters and marks in each language's texts, and one for those that never were in them."""
    found = defaultdict(set)
    for table in tables:
        last = pc.utf8_slice_codeunits(table.column("gram"), -1)
        for r in pa.table({"lang": table.column("lang"), "last": last}).group_by(["lang", "last"]).aggregate([]).to_pylist():
            found[r["lang"]].add(r["last"])
    return {language: len(last) + 1 for language, last in found.items()}


def _set_limits(model: LanguageModel, seen: list[tuple[str, float]], marks: dict[str, int]) -> None:
    """Limits from cross-entropies of texts that the measuring model hadn't read; languages with few share one of all.

    A share of the way from a language's texts to random marks of its own: what lies beyond is rejected. Without any
    text to measure, a text has to be nearer to the language than half-way from certain marks to random ones.
    """
    own: dict[str, list[float]] = defaultdict(list)
    for language, entropy in seen:
        own[language].append(entropy)
    random = {language: float(np.log(marks[language])) for language in model.languages}
    shares = [e / random[language] for language, found in own.items() for e in found]
    for x, language in enumerate(model.languages):
        found = np.array(own[language]) if len(own[language]) >= OWN_TEXTS else np.array(shares or [0.5]) * random[language]
        middle = float(np.median(found))
        spread = max(0.05 * middle, float(np.quantile(found, 0.99) - middle))
        # a text in two languages stays; what is nearer to random marks than to the language goes
        model.limit[x] = max(middle + 4 * spread, middle + 0.6 * (random[language] - middle))
        model.width[x] = spread


class _Scored:
    """word -> row of a growing matrix of log-probabilities and letter counts."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages) + 1), np.float32)

    def measure(self, tokens: list[str]) -> np.ndarray:
        """[token, language and letters]"""
        parts = [words_of(t) for t in tokens]
        words = [w for p in parts for w in p]
        out = np.zeros((len(tokens), len(self.model.languages) + 1))
        if words:
            owner = np.repeat(np.arange(len(tokens)), [len(p) for p in parts])
            np.add.at(out, owner, np.column_stack([self.model.score_words(words), [len(w) + 1 for w in words]]))
        return out

    def learn(self, tokens: set[str]) -> None:
        if len(self.rows) > WORDS:  # the older half has the frequent words
            self.rows = {w: i for w, i in self.rows.items() if i < WORDS // 2}
        names = list(tokens - self.rows.keys())
        if not names:
            return
        new = self.measure(names)
        first = len(self.rows)
        if first + len(names) > len(self.table):
            self.table = np.vstack([self.table, np.zeros((max(len(self.table), len(names)), self.table.shape[1]), np.float32)])
        self.table[first : first + len(names)] = new
        self.rows |= dict(zip(names, range(first, first + len(names)), strict=True))

    def sums(self, column: pa.Array) -> np.ndarray:
        """[text, language and letters]; a null text is an empty one. Texts are read a few at a time."""
        n = len(self.model.languages)
        out = np.zeros((len(column), n + 1))
        at = 0
        while n and at < len(column):
            tokens, first, size = [], at, 0
            while at < len(column) and (first == at or size < 1 << 21):
                text = column[at].as_py() or ""
                tokens.append(text.split())
                size += len(text)
                at += 1
            every = set().union(*tokens)
            long = [t for t in every if len(t) > LONG]
            self.learn(every.difference(long))
            apart = dict(zip(long, self.measure(long), strict=True)) if long else {}
            get, table = self.rows.__getitem__, self.table
            for k, own in enumerate(tokens, first):
                if apart:
                    out[k] = sum((apart[t] for t in own if t in apart), np.zeros(n + 1))
                    own = [t for t in own if t not in apart]
                if own:
                    out[k] += table[np.fromiter(map(get, own), np.int64, len(own))].sum(axis=0, dtype=np.float64)
        return out


def _scores_for(model: LanguageModel) -> _Scored:
    """Word scores that this process keeps from task to task."""
    use_worker("language", _scores.clear)
    if not _scores or _scores[0].model is not model:
        _scores[:] = [_Scored(model)]
    return _scores[0]


def _judged(scored: _Scored, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the nearest language (-1: no letter), the score, the cross-entropy, and whether it is rejected."""
    model, n = scored.model, len(scored.model.languages)
    sums = scored.sums(column)
    letters = sums[:, n]
    none = letters == 0
    if not n:
        return np.full(len(sums), -1), np.zeros(len(sums)), np.zeros(len(sums)), none
    entropy = -sums[:, :n] / np.maximum(letters, 1)[:, None]
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(best)), best]
    weight = np.exp(-(entropy - low[:, None]) * np.minimum(letters, EVIDENCE)[:, None])
    limit, width = model.limit[best], model.width[best]
    score = 1 / weight.sum(axis=1) / (1 + np.exp(np.clip((low - limit) / (0.25 * width), -50, 50)))
    return np.where(none, -1, best), np.where(none, 0.0, np.clip(score, 0, 1)), low, none | (low > limit)


def identify(docs: DataFrame, model: LanguageModel, keep: str | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` of each whole text (and the column ``keep``, as it is).

    ``und``, score 0, no cross-entropy and rejected: texts that are null, empty or without a letter, and all if the
    model has no language. score is the
    posterior of the chosen language from at most EVIDENCE letters, lowered where the text is unlike the calibration
    texts; ties go to the first language by name. Rows are independent: repeated rows are judged again, a null doc_id
    stays null, an empty table gives an empty result, other columns are not read; no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    extra = [F.col(keep).alias("_keep")] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scores_for(held.value)
        names = [*held.value.languages, UNKNOWN]
        for batch in batches:
            best, score, low, rejected = _judged(scored, batch.column(1))
            columns = {
                "doc_id": batch.column(0), "lang_pred": pa.array([names[b] for b in best], pa.string()), "score": pa.array(score),
                "cross_entropy": pa.array(low, mask=best < 0), "rejected": pa.array(rejected),
            }
            if keep:
                columns[keep] = batch.column(2)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean" + (f", {keep} string" if keep else ""))


def keep_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, with all columns as they are, whose text ``identify`` doesn't reject.

    Each row is judged by its own text: rows that share a doc_id or have none, too. Repeated rows all stay or all go; an
    empty table stays empty. No join, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scores_for(held.value)
        for batch in batches:
            yield batch.filter(pa.array(~_judged(scored, batch.column(place))[3]))

    return docs.mapInArrow(run, docs.schema)


def held_out(mod: int, remainder: int):
    """Whether a document's checksum puts it aside."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == remainder


def identify_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected``, learned from the documents that aren't held out.

    As ``identify`` and ``train`` have it; a null doc_id is not held out by any remainder, and held_out is null there.
    """
    model = train(docs.where(~held_out(3, 1)))
    return identify(docs, model).withColumn("held_out", held_out(3, 1))
