"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are its words and its byte n-grams of 2 to 4 (white space marks word borders), each
hashed to a row of an embedding table; their mean goes through a linear layer to a softmax. Table and layer
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows, whose whole texts
are reduced to bucket counts by Spark's tasks. A part of the sample is held back to calibrate a temperature,
and below which probability an answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.llm.common import byte_rows, mixed, word_hashes, written

#: Bounds of the training sample: labelled rows of each language, the smallest by hash, rows of all languages together, and languages, the most frequent.
SAMPLE, ALL, LANGUAGES = 1_000, 20_000, 500
BUCKETS, WIDTH = 1 << 16, 16
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_ASCII = regex.compile(rb"[A-Za-z]")
_PLAIN = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII.search(text) is not None or _LETTER.search(text.decode("utf-8", "replace")) is not None)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text between two spaces, cut after white space into pieces of at most AT_ONCE bytes; a longer word is cut."""
    text = b" " + text.translate(_PLAIN) + b" "
    at = 0
    while at < len(text) - 1:
        end = min(len(text), at + AT_ONCE)
        if end < len(text):
            cut = text.rfind(b" ", at + 1, end)
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end - 1 if end < len(text) else len(text)


def _buckets(piece: bytes, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners and bucket numbers of a piece's features; owner holds one entry a byte.

    No feature has a space inside, so texts that follow each other in a piece don't mix."""
    raw = np.frombuffer(piece, np.uint8)
    space = raw == 32
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    owners, found = [owner[starts]], [word_hashes([w for w in piece.split(b" ") if w])]
    code = raw.astype(np.uint64)
    gram = code.copy()
    inner = np.zeros(len(raw), bool)  # of a gram that starts here: a space that is neither its first nor its last byte
    for n in (2, 3, 4):
        if len(raw) < n:
            break
        gram = gram[: len(raw) - n + 1] * np.uint64(257) + code[n - 1 :]
        if n > 2:
            inner = inner[: len(raw) - n + 1] | space[n - 2 : len(raw) - 1]
        ok = ~inner[: len(gram)] & ~(space[: len(gram)] & space[n - 1 :])
        owners.append(owner[: len(gram)][ok])
        found.append(mixed(gram[ok] + np.uint64(n << 48)))
    return np.concatenate(owners), (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which of texts, and which bucket, for every feature of all texts; about AT_ONCE bytes at a time."""
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            held.append(piece)
            owner.append((i, len(piece)))
            size += len(piece)
            if size >= AT_ONCE:
                yield _buckets(b"".join(held), np.repeat(*np.array(owner).T))
                held, owner, size = [], [], 0
    if held:
        yield _buckets(b"".join(held), np.repeat(*np.array(owner).T))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages): embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    reject: float

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for owner, bucket in features(texts):
            n += np.bincount(owner, minlength=len(texts))
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(owner, self.table[bucket, j], len(texts))
        return total / np.maximum(1, n)[:, None] + self.bias

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its calibrated probability; und and 0 without a letter."""
        letter = np.array([has_letter(t) for t in texts], bool)
        if not self.langs or not letter.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        return [self.langs[i] if ok else "und" for i, ok in zip(p.argmax(axis=1).tolist(), letter.tolist(), strict=True)], np.where(letter, p.max(axis=1), 0.0)


def train(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], steps: int = 800, rate: float = 2.0, batch: int = 32, seed: int = 1, precision: float = 0.99) -> Model:
    """SGD over minibatches of texts given as buckets and their counts; about steps minibatches, and 4 epochs at least.

    Every fifth text is held back for the temperature and the rejection threshold."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([names.index(x) for x in langs])
    use = np.array([len(b) > 0 for b, _ in counts])
    shares = [(b, c / max(1, c.sum())) for b, c in counts]
    back = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(use & ~back)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    number = np.zeros(BUCKETS, np.int64)
    epochs = max(4, min(60, -(-steps * batch // max(1, len(fit)))))
    all_steps, step = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            flat = np.concatenate([shares[i][0] for i in rows])
            seen = np.flatnonzero(np.bincount(flat, minlength=BUCKETS))
            number[seen] = np.arange(len(seen))
            x = np.zeros((len(rows), len(seen)))  # each text's share of each bucket that the minibatch has
            x[np.repeat(np.arange(len(rows)), [len(shares[i][0]) for i in rows]), number[flat]] = np.concatenate([shares[i][1] for i in rows])
            mean = x @ emb[seen]
            error = softmax(mean @ layer + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            now = rate * (1 - step / all_steps)
            # a text's own step on the embeddings, the minibatch's mean step on the layer
            change = now * (x.T @ (error @ layer.T))
            layer -= now / len(rows) * mean.T @ error
            bias -= now / len(rows) * error.sum(axis=0)
            emb[seen] -= change
            step += 1
    model = Model(names, (emb @ layer).astype(np.float32), bias, 1.0, 0.0)
    held = np.flatnonzero(use & back)
    if len(held):
        logits = np.array([shares[i][1] @ model.table[shares[i][0]] + bias for i in held])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == y[held]
        order = np.argsort(-p.max(axis=1))
        good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(held) + 1))
        model.reject = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, together: int = ALL, languages: int = LANGUAGES) -> Model:
    """A model of docs' text and non-null lang, from at most sample rows of each of the most frequent languages and together rows in all; their whole texts are used."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    named = written(rows.select("id", "lang", "text_hash").distinct(), "labelled-languages")
    spread = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not spread:
        return train([], [])
    each = max(1, min(sample, together // len(spread)))
    # a bound on the hash leaves each language little more than its share, whatever its size; then comes the exact cut
    bounds = docs.sparkSession.createDataFrame([(r.lang, (each + 6 * each**0.5 + 30) / r["count"]) for r in spread], "lang string, bound double")
    u = F.shiftrightunsigned(F.xxhash64("id", "text_hash"), 11) / float(2**53)
    near = named.join(F.broadcast(bounds), "lang").withColumn("u", u).filter("u < bound")
    place = F.row_number().over(W.partitionBy("lang").orderBy("u", "id", "text_hash"))
    ids = near.withColumn("place", place).filter(F.col("place") <= each).select("id", "lang", "text_hash")
    # at most together rows, or one of each language
    chosen = rows.join(F.broadcast(ids), ["id", "lang", "text_hash"]).dropDuplicates(["id", "lang", "text_hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for owner, bucket in features(byte_rows(part, "text")):
                    k, c = np.unique(owner * BUCKETS + bucket, return_counts=True)
                    keys.append(k)
                    times.append(c)
                key, where = np.unique(np.concatenate(keys), return_inverse=True)  # a long text comes in several pieces
                n = np.bincount(where, np.concatenate(times), len(key)).astype(np.int32)
                cuts = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * BUCKETS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), part.column("text_hash"), pa.ListArray.from_arrays(cuts, pa.array((key % BUCKETS).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(n))], ["id", "lang", "text_hash", "bucket", "n"])

    found = chosen.mapInArrow(count, "id long, lang string, text_hash long, bucket array<int>, n array<int>").toArrow().sort_by([("text_hash", "ascending"), ("id", "ascending"), ("lang", "ascending")])
    both = zip(found.column("bucket"), found.column("n"), strict=True)
    return train([(b.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64)) for b, n in both], found.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the calibrated probability), accepted.

    A text that is null or has no letter gets und, score 0, not accepted. An answer whose score is below the
    calibrated threshold is still given, with accepted false. Rows with null or equal doc_id each keep a row;
    columns other than doc_id and text aren't read; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            langs, score = own.predict(byte_rows(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array((score >= own.reject) & (score > 0))], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
