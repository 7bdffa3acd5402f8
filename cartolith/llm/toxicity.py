"""Toxicity by maximum-scoring segments of token log-odds.

A token is a word or, for rarer words, its first letters (its stem). Its score is its log-odds of toxic
against clean labelled documents under an informative Dirichlet prior, where that is significant, and a
small negative drift otherwise. One linear scan finds every maximal segment of a text's token scores. A
segment's score is turned into an expected number of such segments in clean text of that length
(extreme-value statistics: K n exp(-lambda S), both fitted on clean texts' best scores); significant
segments' evidence adds up, and a logistic curve turns it into a probability.

What is fitted after the words (lambda, K, the curve, and which stems are used) is fitted out of fold: a
sampled text is scored by words that were counted without it and its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import REMEMBERED, byte_rows, written

#: Bound of the training sample: labelled rows of each class, the smallest by hash of doc_id.
SAMPLE = 5_000
#: Least z and least log-odds of a word that counts, and how many different words must precede it in toxic texts.
LEAST_Z, LEAST_DELTA, LEAST_USES = 3.5, 2.0, 4
DRIFT, SIGNIFICANT = -0.25, 0.05
#: Letters of the stems that are counted, and the sets of them of which cross-validation chooses one: none and each length.
STEMS = tuple(range(3, 10))
CHOICES = ((), *((n,) for n in STEMS))
FOLDS = 5

_FLAT = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def tokens(text: bytes | None) -> list[str]:
    """A text's words: lower-cased (A-Z), split at white space and ASCII signs."""
    return (text or b"").translate(_FLAT).decode("utf-8", "replace").split()


def token_hash(token: str, letters: int = 0) -> int:
    """XXH64 of a word (letters 0), or of the stem of that many letters."""
    return xxhash.xxh64_intdigest((token[:letters] if letters else token).encode(), letters)


@dataclass
class Model:
    scores: dict[int, float] = field(default_factory=dict)  # by token_hash
    stems: tuple[int, ...] = ()
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 0.0
    shift: float = -5.0

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def _score(self, word: str) -> float:
        """The word's own score, or that of its longest listed stem."""
        found = self.scores.get(token_hash(word))
        for n in sorted(self.stems, reverse=True):
            if found is None and len(word) > n:
                found = self.scores.get(token_hash(word, n))
        return DRIFT if found is None else found

    def segments(self, text: bytes | None) -> tuple[list[tuple[int, int, float]], int]:
        """The maximal segments (first token, token after the last, score) of a text, and its tokens."""
        words, known = tokens(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        known.update((w, self._score(w)) for w in set(words).difference(known))
        score = np.fromiter(map(known.__getitem__, words), float, len(words))
        at = np.flatnonzero(score > DRIFT)
        return maximal_segments(at, score[at] - DRIFT, DRIFT) if len(at) else [], len(words)

    def log_expected(self, scores: np.ndarray, n: int) -> np.ndarray:
        """Log of the number of segments of at least such scores expected in n tokens of clean text."""
        return np.log(self.k * max(1, n)) - self.rate * scores

    def evidence(self, scores: np.ndarray, n: int) -> float:
        log_e = self.log_expected(scores, n)
        return float(-log_e[log_e < np.log(SIGNIFICANT)].sum())

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.shift, -30, 30)))


def maximal_segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time.

    Token at[i] scores gain[i] + drift, every other token drift < 0; only tokens in at can begin or end one.
    Each candidate remembers the nearest one before it that starts lower, and a search follows these links, so
    none is passed over twice."""
    kept: list[tuple[int, int, float, float, int]] = []  # first, after, cumulative score before and through it, link
    cumulative, seen = 0.0, 0
    for i, g in zip(at.tolist(), gain.tolist(), strict=True):
        cumulative += drift * (i - seen)
        seen = i + 1
        low, high = cumulative, cumulative + g + drift
        cumulative = high
        if high <= low:
            continue
        first = i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, i + 1, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and their z of counts in toxic and clean text; the prior is half a use plus the share of all uses."""
    prior = 0.5 + (toxic + clean) / max(1.0, all_toxic + all_clean)
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (all_toxic + 1 - toxic)) - np.log(b / (all_clean + 1 - clean))
    return np.minimum(delta, 12.0), delta / np.sqrt(1 / a + 1 / b)


def word_counts(sample: DataFrame) -> DataFrame:
    """token (its hash) and, for i from 0 to FOLDS, toxic_i and clean_i: its counts without fold i (FOLDS: in all of sample).

    What is counted is the different words that precede it, not its uses, so that a passage that is copied
    many times counts once. sample has text, toxic (0 or 1) and fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                found = []
                for text, label, fold in zip(byte_rows(part, "text"), part.column("toxic").to_pylist(), part.column("fold").to_pylist(), strict=True):
                    words = tokens(text)
                    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    of = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    hashes = np.array([[token_hash(w), *(token_hash(w, n) if len(w) > n else 0 for n in STEMS)] for w in number], np.uint64).reshape(-1, 1 + len(STEMS)).view(np.int64)
                    whole = hashes[of, 0]
                    before = np.append(0, whole[:-1])[: len(whole)]
                    for j in range(1 + len(STEMS)):
                        h = hashes[of, j]
                        use = h != 0
                        found.append(np.stack([h[use], before[use], np.full(use.sum(), label), np.full(use.sum(), fold)]))
                rows = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["token", "before", "toxic", "fold"])

    pairs = sample.mapInArrow(count, "token long, before long, toxic long, fold long").groupBy("token", "before", "toxic").agg(F.bit_or(F.expr("shiftleft(1L, int(fold))")).alias("folds"))
    counts = []
    for i in range(FOLDS + 1):
        seen = (F.col("folds").bitwiseAND(F.lit(~(1 << i) & (2**FOLDS - 1))) != 0).cast("long")
        counts += [F.sum(seen * F.col("toxic")).alias(f"toxic_{i}"), F.sum(seen * (1 - F.col("toxic"))).alias(f"clean_{i}")]
    return pairs.groupBy("token").agg(*counts)


def lists(counts: DataFrame) -> list[dict[int, float]]:
    """The significant tokens and their scores without each fold, and of all, from word_counts()."""
    names = [f"{c}_{i}" for i in range(FOLDS + 1) for c in ("toxic", "clean")]
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in names]).first()
    # as many rows as the bounded sample has tokens of LEAST_USES contexts
    rows = counts.filter(F.col(f"toxic_{FOLDS}") >= LEAST_USES).toArrow()
    token, out = rows.column("token").to_numpy().astype(np.int64).view(np.uint64), []
    for i in range(FOLDS + 1):
        toxic, clean = (rows.column(f"{c}_{i}").to_numpy().astype(float) for c in ("toxic", "clean"))
        delta, z = log_odds(toxic, clean, total[f"toxic_{i}"], total[f"clean_{i}"])
        good = (toxic >= LEAST_USES) & (z >= LEAST_Z) & (delta >= LEAST_DELTA)
        out.append(dict(zip(token[good].tolist(), delta[good].tolist(), strict=True)))
    return out


def extreme_values(n: np.ndarray, best: np.ndarray, low: float = 0.02, high: float = 5.0) -> tuple[float, float]:
    """lambda and K of P(best <= s) = exp(-K n exp(-lambda s)) that are likeliest for clean texts' tokens and best scores.

    A text without a segment has best 0 and counts as at most that. K follows from lambda; lambda is found by
    narrowing a grid. Half a text is added to those with a segment, so that K is never 0."""
    n, hit = np.maximum(n, 1.0), best > 0
    m = hit.sum() + 0.5

    def likelihood(rate: float) -> float:
        k = m / max(1e-300, float((n * np.exp(-rate * best)).sum()))
        return m * np.log(rate) + m * np.log(k) - rate * float(best[hit].sum()) - m

    for _ in range(6):
        grid = np.geomspace(low, high, 25)
        i = int(np.argmax([likelihood(r) for r in grid]))
        low, high = grid[max(0, i - 1)], grid[min(24, i + 1)]
    rate = float(np.sqrt(low * high))
    return rate, float(m / max(1e-300, (n * np.exp(-rate * best)).sum()))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample rows of each class of labels (doc_id, toxic), joined with docs (doc_id, text).

    A doc_id with several labels counts once, as toxic if any says so; null labels don't count. Without
    toxic labels every text scores low. Whole texts are used."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.when(F.max("toxic") > 0, 1).otherwise(0).cast("long").alias("toxic"))
    part = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    # the sample's bound is the size bound of this broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(part[0].unionByName(part[1])), "id")
    # a doc_id with several rows could pass the bound
    part = [texts.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(sample) for c in (0, 1)]
    # copies share a fold; few rows a task, as tokens take more time than bytes
    texts = part[0].unionByName(part[1]).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold")).repartition(16, F.xxhash64("text"))
    texts = written(texts, "toxicity-sample")
    scores = lists(written(word_counts(texts), "token-counts"))
    if not scores[FOLDS]:
        return Model()
    models = texts.sparkSession.sparkContext.broadcast([[Model(s, c) for c in CHOICES] for s in scores[:FOLDS]])

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, fold in zip(byte_rows(b, "text"), b.column("fold").to_pylist(), strict=True):
                found = [m.segments(text) for m in models.value[fold]]
                rows.append((found[0][1], [[s for *_, s in segments] for segments, _ in found]))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.list_(pa.float64())))], ["toxic", "n", "scores"])

    # a few numbers for each of the sample's rows
    rows = texts.mapInArrow(held_out, "toxic long, n long, scores array<array<double>>").toArrow()
    y, n = rows.column("toxic").to_numpy().astype(float), rows.column("n").to_numpy().astype(float)
    # the sample's rows stand for all labelled ones of their class
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weight = np.where(y > 0, totals.get(1, 0) / max(1.0, y.sum()), totals.get(0, 0) / max(1.0, (1 - y).sum()))
    weight *= len(y) / max(1e-12, weight.sum())
    per_row, best = rows.column("scores").to_pylist(), None
    for i, stems in enumerate(CHOICES):
        found = [np.array(r[i], float) for r in per_row]
        rate, k = extreme_values(n[y == 0], np.array([s.max(initial=0.0) for s, t in zip(found, y, strict=True) if t == 0]))
        model = Model(scores[FOLDS], stems, rate, k)
        x = np.log1p([model.evidence(s, int(m)) for s, m in zip(found, n, strict=True)])
        model.slope, model.shift = logistic(x, y, weight)
        loss = log_loss(model.slope * x + model.shift, y, weight)
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def log_loss(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    margin = np.clip(margin, -30, 30)
    return float((weight * (np.log1p(np.exp(-margin)) + (1 - y) * margin)).sum())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope (not negative) and shift of a weighted ridge logistic curve, by Newton's steps."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (y - p) * x).sum() - ridge * a, (weight * (y - p)).sum()])
        h = weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[(h * x * x).sum() + ridge, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]]), g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, n_segments, best_segment, segments (first, after, score).

    Null and empty texts have no segment and the lowest score. Whole texts are scanned. Rows with null or
    equal doc_id each keep a row; columns other than doc_id and text aren't read; an empty table gives an
    empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            evidence, spans = [], []
            for t in byte_rows(b, "text"):
                found, n = own.segments(t)
                log_e = own.log_expected(np.array([s for *_, s in found], float), n)
                strong = np.flatnonzero(log_e < np.log(SIGNIFICANT)).tolist()
                evidence.append(-sum(float(log_e[i]) for i in strong))
                spans.append([dict(zip(("first", "after", "score"), found[i], strict=True)) for i in strong])
            p = own.probability(np.array(evidence, float))
            cols = [b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(s) for s in spans], pa.int32()), pa.array([max((x["score"] for x in s), default=0.0) for s in spans], pa.float64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", "n_segments", "best_segment", "segments"])

    schema = "doc_id long, score double, predicted int, n_segments int, best_segment double, segments array<struct<first:long,after:long,score:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
