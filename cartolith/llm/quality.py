"""Quality rules: gradient-boosted trees over document statistics.

A document is first held against fixed rules (base_failed), then scored by trees that were boosted in
numpy on a bounded sample of labelled rows. The trees are flattened into node arrays, so a batch of
documents walks all trees by array indexing. The chance of being kept can't rise with the statistics
listed in FALLING: a split that would break this is refused, and children are bounded by the middle of
their parent's split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import as_row, byte_rows, covered, of_row, run_ranks, word_bounds, word_ids

#: Labelled rows that the trees are fitted on at most, the smallest by hash of doc_id.
SAMPLE = 20_000
#: The bare rules: fewest words, and the largest share in percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "distinct_share",
    "top_word_share", "words_a_line", "stop_end_share", "high_byte_share", "capital_word_share", "mark_word_share", "byte_entropy", "long_word_share", "next_equal_share",
]
#: Statistics of which more can't make a document better.
FALLING = ["symbol_share", "dup_line_share", "repeat_share", "upper_share", "top_word_share", "mark_word_share", "next_equal_share"]

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text; null counts as empty."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(raw)
    words, n_distinct = word_ids(text.split())
    n = len(words)
    per_byte = np.bincount(raw, minlength=256)
    chars = int(per_byte[~_SPACE].sum() - per_byte[128:192].sum())
    symbols = int(per_byte[_SYMBOL].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    windows = run_ranks(words, 8)
    twice = np.bincount(windows)[windows] > 1
    repeated = int(covered(twice, 8, n).sum()) if twice.any() else 0
    base = [n, chars, symbols, dup_lines, repeated]
    if not n:
        return base, [0.0] * len(FEATURES)
    size, counts = len(raw), np.bincount(words, minlength=n_distinct)
    share = per_byte[per_byte > 0] / size
    first, last = raw[starts], raw[ends - 1]
    letters = max(1, int(per_byte[_LETTER].sum()))
    features = [
        np.log1p(n), chars / n, symbols / size, dup_lines / max(1, len(lines)), repeated / n, per_byte[_UPPER].sum() / letters, per_byte[_DIGIT].sum() / size,
        (size - letters - per_byte[_DIGIT].sum() - per_byte[_SPACE].sum()) / size, len(counts) / n, counts.max() / n, np.log1p(n / max(1, len(lines))),
        np.isin(last, list(b".,;:")).mean(), per_byte[128:].sum() / size, _UPPER[first].mean(), (~_LETTER[last] & ~np.isin(last, list(b".,"))).mean(),
        -(share * np.log2(share)).sum(), (ends - starts > 14).mean(), (words[1:] == words[:-1]).mean() if n > 1 else 0.0,
    ]
    return base, [float(v) for v in features]


@dataclass
class Trees:
    """All trees as flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of being of good quality, for each row of features."""
        if not len(x):
            return np.empty(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms, with monotonic constraints on FALLING."""
    falling = np.array([f in FALLING for f in FEATURES])
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        for a, z in ((feature, 0), (threshold, np.inf), (left, i), (right, i), (value, v)):
            a.append(z)
        return i

    p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    start = float(np.log(p / (1 - p)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), start)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            grad, hess = y - q, np.maximum(q * (1 - q), 1e-9)
            roots.append(node(0.0))
            level = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
            for d in range(depth + 1):
                below = []
                for at, rows, low, high in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    own = float(np.clip(g / (h + l2), low, high))
                    value[at] = rate * own
                    best = (1e-6, None)
                    for j, e in enumerate(edges if d < depth else []):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(code[rows, j], grad[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(code[rows, j], hess[rows], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(code[rows, j], minlength=len(e) + 1))[:-1]
                        vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((g - gl) / (h - hl + l2), low, high)
                        gain = gl * vl - (hl + l2) * vl**2 / 2 + (g - gl) * vr - (h - hl + l2) * vr**2 / 2 - (g * own - (h + l2) * own**2 / 2)
                        ok = (nl >= least) & (len(rows) - nl >= least)
                        if falling[j]:
                            ok &= vl >= vr
                        if ok.any() and (k := int(np.argmax(np.where(ok, gain, -np.inf)))) >= 0 and gain[k] > best[0]:
                            best = (gain[k], (j, k, vl[k], vr[k]))
                    if best[1]:
                        j, k, vl, vr = best[1]
                        feature[at], threshold[at] = j, edges[j][k]
                        left[at], right[at] = node(0.0), node(0.0)
                        goes = code[rows, j] <= k
                        middle = (vl + vr) / 2
                        lows, highs = ((middle, high), (low, middle)) if falling[j] else ((low, high), (low, high))
                        below += [(left[at], rows[goes], *lows), (right[at], rows[~goes], *highs)]
                        value[at] = 0.0
                    else:
                        margin[rows] += value[at]
                level = below
    arrays = [np.array(a, t) for a, t in ((feature, np.int64), (threshold, float), (left, np.int64), (right, np.int64), (value, float), (roots, np.int64))]
    return Trees(*arrays, depth=depth + 1, start=start)


def measured(rows: DataFrame, extra: list[str]) -> DataFrame:
    """extra columns, the base counts and the features as an array, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [statistics(t) for t in byte_rows(b, "text")]
            base = np.array([x[0] for x in both], np.int64).reshape(-1, len(BASE))
            cols = [b.column(c) for c in extra] + [pa.array(base[:, i]) for i in range(len(BASE))] + [pa.array([x[1] for x in both], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*extra, *BASE, "features"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in extra] + [f"{c} long" for c in BASE] + ["features array<double>"])
    return rows.select(*extra, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most sample labelled rows; labels has doc_id and quality (null: no label).

    A doc_id with several labels counts once, as good only if all say so. Without both kinds of labels the
    trees are empty and the share of good ones decides."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("double").alias("good"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # the sample's bound is the size bound of this broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = measured(chosen.withColumn("text_hash", F.xxhash64("text")), ["id", "good", "text_hash"]).orderBy(F.xxhash64("id"), "id", "text_hash").limit(sample).select("good", "features").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return boost(x, (rows["good"].to_numpy(float) > 0.5).astype(float))


def verdicts(batch_stats: list[tuple[list[int], list[float]]], model: Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, score and kept of a batch."""
    base = np.array([s[0] for s in batch_stats], np.int64).reshape(-1, len(BASE))
    score = model.score(np.array([s[1] for s in batch_stats], float).reshape(-1, len(FEATURES)))
    failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
    return base, failed, score, ~failed & (score >= threshold)


def judge(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept and score.

    A null text counts as empty, which fails the base rules. Rows with null or equal doc_id each keep a
    row; other columns are left aside; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, failed, score, kept = verdicts([statistics(t) for t in byte_rows(b, "text")], model, threshold)
            cols = [b.column("doc_id"), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = verdicts([statistics(t) for t in byte_rows(b, "text")], model, threshold)[3]
            yield b.select(["row"]).filter(pa.array(kept))

    rows = docs.select(as_row(docs, docs.columns), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("row").schema).select(*of_row(docs.columns))
