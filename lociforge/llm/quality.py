"""Quality scores from a factorisation machine over hashed words, structure statistics and their ranges.

The score of a text is linear weights plus all pairwise interactions of its features through low-rank factors; the sum
over pairs is half of (sum of factors) squared less the sum of squares, so a text costs time in proportion to its
features. The machine is fitted in numpy on a bounded sample of labelled texts, and texts are scored in batches.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, texts, use_worker
from .language_id import held_out

BUCKETS = 1 << 16
RANK = 8
BINS = 12
#: Labelled documents that the machine is fitted on, about.
SAMPLE_DOCUMENTS = 6000
THRESHOLD = 0.3
#: Tokens whose statistics a worker keeps.
TOKENS = 125_000
#: Characters that a worker scores at a time, at least one text.
CHUNK_CHARS = 1 << 20

#: Per token, summed over a text.
TOKEN_STATS = ("tokens", "chars", "letters", "upper", "digits", "marks", "other", "bare_marks", "mark_runs", "all_upper", "long")
STATS = (
    "log_tokens", "token_length", "letter_share", "upper_share", "digit_share", "mark_share", "other_share", "bare_mark_share", "mark_run_share", "all_upper_share",
    "long_share", "distinct_share", "repeat_share", "top_share", "log_lines", "line_tokens", "distinct_lines", "longest_run", "hashed_lines",
)


def _token(token: str) -> tuple[int, tuple[float, ...]]:
    letters = sum(map(str.isalpha, token))
    upper = sum(map(str.isupper, token))
    digits = sum(map(str.isdigit, token))
    marks = sum(c.isascii() and not c.isalnum() for c in token)
    run = any(a == b and not a.isalnum() for a, b in zip(token, token[1:], strict=False))
    core = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() or token
    n = len(token)
    return zlib.crc32(core.encode()) % BUCKETS, (1, n, letters, upper, digits, marks, n - letters - digits - marks, marks == n, run, letters > 1 and upper == letters, n > 20)


class _Tokens:
    """token -> row of growing arrays, kept from task to task."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.bucket = np.zeros(1024, np.int64)
        self.stats = np.zeros((1024, len(TOKEN_STATS)), np.float32)

    def learn(self, tokens: set[str]) -> None:
        if len(self.rows) > TOKENS:  # the older half has the frequent ones
            self.rows = {t: i for t, i in self.rows.items() if i < TOKENS // 2}
        new = list(tokens - self.rows.keys())
        first = len(self.rows)
        if first + len(new) > len(self.bucket):
            more = max(len(self.bucket), len(new))
            self.bucket = np.concatenate([self.bucket, np.zeros(more, np.int64)])
            self.stats = np.vstack([self.stats, np.zeros((more, len(TOKEN_STATS)), np.float32)])
        for i, t in enumerate(new, first):
            self.rows[t] = i
            self.bucket[i], self.stats[i] = _token(t)


_TOKENS = _Tokens()


def _own_worker() -> None:
    use_worker("quality", _TOKENS.__init__)


def _features(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, their values (of length 1 together), and STATS of each text."""
    tokens = [t.split() for t in batch]
    _TOKENS.learn(set().union(*tokens))
    get, bucket, stats = _TOKENS.rows.__getitem__, _TOKENS.bucket, _TOKENS.stats
    for text, own in zip(batch, tokens, strict=True):
        n = len(own)
        if not n:
            yield np.zeros(0, np.int64), np.zeros(0), np.zeros(len(STATS))
            continue
        rows = np.fromiter(map(get, own), np.int64, n)
        s = stats[rows].sum(axis=0, dtype=np.float64)
        rows_in_order = np.sort(rows)
        starts = np.flatnonzero(np.concatenate([[True], rows_in_order[1:] != rows_in_order[:-1]]))
        counts = np.diff(np.append(starts, n))
        same = rows[1:] == rows[:-1]
        gaps = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        lines = text.split("\n")
        buckets, back = np.unique(bucket[rows_in_order[starts]], return_inverse=True)
        values = np.log1p(np.bincount(back, weights=counts))
        chars = max(s[1], 1)
        yield (
            buckets,
            values / np.sqrt((values**2).sum()),
            np.array([
                np.log1p(n), s[1] / n, s[2] / chars, s[3] / max(s[2], 1), s[4] / chars, s[5] / chars, s[6] / chars, s[7] / n, s[8] / n, s[9] / n, s[10] / n,
                len(starts) / n, same.mean() if n > 1 else 0, counts.max() / n, np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines), np.log1p(np.diff(gaps).max()), sum(x.startswith(("#", "|", "*", "-")) for x in lines) / len(lines),
            ]),
        )


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray  # [feature]
    factors: np.ndarray  # [feature, RANK]
    edges: np.ndarray  # [stat, BINS - 1]: inner bounds of its ranges
    middle: np.ndarray
    spread: np.ndarray

    def row(self, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of a text: words, the range each statistic is in, and the statistic itself."""
        n = len(stats)
        ranges = np.array([np.searchsorted(e, x, side="right") for e, x in zip(self.edges, stats, strict=True)])
        at = np.concatenate([buckets, BUCKETS + np.arange(n) * BINS + ranges, BUCKETS + n * BINS + np.arange(n)])
        return at, np.concatenate([values, np.full(n, 0.3), np.clip((stats - self.middle) / self.spread, -3, 3) * 0.3])

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts whose features lie end to end, from ``starts`` on: the machine's sums, and the sums of factors."""
        scaled = self.factors[at] * x[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled**2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + ((sums**2).sum(axis=1) - squares) / 2, sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, visits: int = 50_000, batch: int = 64, rate: float = 0.05, decay: float = 2e-4, seed: int = 5) -> FactorisationMachine:
    """Logistic loss, adaptive step sizes per coordinate, ``visits`` to texts in all; without both labels, the machine is its bias."""
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, len(STATS)))
    size = BUCKETS + len(STATS) * (BINS + 1)
    rng = np.random.Generator(np.random.Philox(key=seed))
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = FactorisationMachine(
        float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)),
        np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T, stats.mean(axis=0), stats.std(axis=0) + 1e-6,
    )
    if len(set(labels.tolist())) < 2:
        return machine
    made = [machine.row(*r) for r in rows]
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(min(100, math.ceil(visits / len(made)))):
        order = rng.permutation(len(made))
        for first in range(0, len(order), batch):
            own = order[first : first + batch]
            sizes = np.array([len(made[i][0]) for i in own])
            starts = np.cumsum(sizes) - sizes
            at, x = (np.concatenate([made[i][k] for i in own]) for k in (0, 1))
            margins, sums = machine.margins(at, x, starts)
            pull = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - labels[own]) / len(own)
            each = np.repeat(pull, sizes)
            kinds, back = np.unique(at, return_inverse=True)
            slope = np.bincount(back, weights=each * x) + decay * machine.weights[kinds]
            inner = (each * x)[:, None] * (np.repeat(sums, sizes, axis=0) - machine.factors[at] * x[:, None])
            slopes = np.column_stack([np.bincount(back, weights=inner[:, f]) for f in range(RANK)]) + decay * machine.factors[kinds]
            seen_w[kinds] += slope**2
            seen_v[kinds] += slopes**2
            seen_b += pull.sum() ** 2
            machine.weights[kinds] -= rate * slope / np.sqrt(seen_w[kinds])
            machine.factors[kinds] -= rate * slopes / np.sqrt(seen_v[kinds])
            machine.bias -= rate * pull.sum() / np.sqrt(seen_b)
    return machine


def train(docs: DataFrame, labels: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> FactorisationMachine:
    """From ``doc_id, quality`` labels that aren't null, of about ``sample_documents`` documents chosen by hash of doc_id.

    Of several labels of a document the largest counts; of several rows with its doc_id one text, the first by hash. So
    what the driver gathers is bounded by the sample. Labels and rows without a doc_id are left out of the fit; a null
    text is an empty one.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    total = known.count()
    spot = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1_000_000))
    known = known.where(spot < int(1_000_000 * min(1.0, sample_documents / max(total, 1))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        for batch in batches:
            made = list(_features([x.as_py() for x in batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[k].tobytes() for r in made], pa.binary()) for k in range(3))], ["doc_id", "quality", "buckets", "values", "stats"])

    rows = texts(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # bounded by sample_documents
    found = rows.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, buckets binary, values binary, stats binary").toArrow().sort_by("doc_id")
    kinds = (("buckets", np.int64), ("values", np.float64), ("stats", np.float64))
    made = list(zip(*([np.frombuffer(x.as_py(), kind) for x in found.column(c)] for c, kind in kinds), strict=True))
    machine = fit(made, found.column("quality").to_numpy().astype(np.float64))
    del found, made
    release()
    return machine


def _scores(machine: FactorisationMachine, column: pa.Array) -> np.ndarray:
    """Of each text; a null text is an empty one. Texts are read a few at a time."""
    scores, at = np.zeros(len(column)), 0
    while at < len(column):
        chunk, size, first = [], 0, at
        while at < len(column) and (not chunk or size < CHUNK_CHARS):
            chunk.append(column[at].as_py() or "")
            size += len(chunk[-1])
            at += 1
        made = [machine.row(*r) for r in _features(chunk)]
        sizes = np.array([len(r[0]) for r in made])
        margins, _ = machine.margins(np.concatenate([r[0] for r in made]), np.concatenate([r[1] for r in made]), np.cumsum(sizes) - sizes)
        scores[first:at] = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
    return scores


def score_quality(docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each whole text.

    A null text is an empty one; empty texts have no words and all statistics at 0, and get the machine's score for
    that. Rows are independent: repeated rows are scored again, a null doc_id stays null, extra columns are not read; an
    empty table gives an empty result. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        for batch in batches:
            scores = _scores(held.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns as they are, whose text scores ``threshold`` or more.

    Each row is judged by its own text: rows that share a doc_id or have none, too. An empty table stays empty. No join,
    no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_worker()
        for batch in batches:
            yield batch.filter(pa.array(_scores(held.value, batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, learned from the labels of documents that aren't held out.

    As ``score_quality`` and ``train`` have it. Without labels of both kinds every text gets the machine's bias.
    """
    machine = train(docs, labels.where(~held_out(5, 0)))
    return score_quality(docs, machine).withColumn("held_out", held_out(5, 0))
