"""Spelling variant grouping: words one edit apart, found by Aho-Corasick automata over halves of words.

A word is cut into two halves. One inserted, deleted or replaced code point leaves one half whole, so a near
word holds that half: the first one at its start, the second one at its end. Halves are dealt out to shards
by their hash, and a shard's automaton holds its halves. Words are sent to the shards that can hold a half of
a word of compatible length and scanned there; a match counts if its offset and the lengths fit, and the rest
of the two words is compared. So shards stay of one size however many words there are, and a word is scanned
in four shards at most. A half that more than CROWD words share would make its shard large: its words are met by an
equality join on their rests with one code point left out.

A word's form is its far more frequent near word, its root the end of the chain of forms. Frequency at least
doubles at each step, so a chain has at most 63 steps and is followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import REMEMBERED, byte_rows, dropped, width, written

#: Code points and occurrences of a word at least.
LEAST_LENGTH, LEAST_USES = 5, 3
#: Halves in an automaton, words that may share a half there, and numbers in one comparison.
SHARD, CROWD, AT_ONCE = 20_000, 2_000, 1 << 22

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in lower-cased UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs(text: bytes | None, doc_id: str | None, damage: int = 0) -> Counter[bytes]:
    """A text's runs of letters, A-Z lower-cased, and how often each occurs.

    damage: where it divides the CRC-32 h of <doc_id>:<run>, the run's code point h % length is left out. A
    missing doc_id is written as nothing."""
    found = Counter(_RUN.findall((text or b"").lower()))
    if not damage:
        return found
    seed, out = zlib.crc32(f"{doc_id or ''}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run, seed)
        if h % damage == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += n
    return out


def vocabulary(docs: DataFrame, damage: int = 0, least_length: int = LEAST_LENGTH, least_uses: int = LEAST_USES) -> DataFrame:
    """word and n of the words with that many code points and occurrences in all texts; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), byte_rows(b, "text"), strict=True):
                for word, n in runs(text, doc_id, damage).items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > REMEMBERED:
                    yield emit()
        yield emit()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").filter(F.char_length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_uses)


def _rests(words: list[str]) -> np.ndarray:
    """Code points of strings of one length, (string, place)."""
    size = len(words[0])
    return np.array(words, f"U{size}").view(np.uint32).reshape(len(words), size) if size else np.empty((len(words), 0), np.uint32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which strings of a (one length) are one edit from which of b (one length), (a, b)."""
    if a.shape[1] < b.shape[1]:
        return one_edit(b, a).T
    if a.shape[1] == b.shape[1]:
        return (a[:, None] != b[None]).sum(axis=2) == 1
    size = b.shape[1]
    front, back = a[:, None, :size] == b[None], (a[:, None, 1:] == b[None])[:, :, ::-1]
    return np.logical_and.accumulate(front, axis=2).sum(axis=2) + np.logical_and.accumulate(back, axis=2).sum(axis=2) >= size


class Halves:
    """An automaton over one shard's halves; role 0: a word's first half, role 1: its second."""

    def __init__(self, roles: list[int], words: list[str], uses: list[int]) -> None:
        tables: dict[str, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (role, word) in enumerate(zip(roles, words, strict=True)):
            half = len(word) // 2
            tables[word[half:] if role else word[:half]][role, len(word)].append(i)
        self.words, self.uses = words, uses
        self.automaton = ahocorasick.Automaton()
        for half, held in tables.items():
            self.automaton.add_word(half, (half, dict(held)))
        self.automaton.make_automaton()

    def near(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Positions of texts and of words that are one edit apart and share a half, each pair by its first half where it can be."""
        meet = defaultdict(list)
        for t, text in enumerate(texts):
            size = len(text)
            for end, (half, held) in self.automaton.iter(text):
                fits = [0] * (end + 1 == len(half)) + [1] * (end + 1 == size)
                for role in fits:
                    for length in (size - 1, size, size + 1):
                        if (role, length) in held:
                            meet[half, role, length, size].append(t)
        tables = {half: held for half, held in (self.automaton.get(h) for h in {k[0] for k in meet})}
        left, right = [], []
        for (half, role, length, size), asking in meet.items():
            words = tables[half][role, length]
            cut = (lambda w, k=len(half): w[:-k]) if role else (lambda w, k=len(half): w[k:])
            held = _rests([cut(self.words[i]) for i in words])
            step = max(1, AT_ONCE // max(1, held.size))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                x, y = np.nonzero(one_edit(_rests([cut(texts[t]) for t in some]), held))
                for t, w in zip(x.tolist(), y.tolist(), strict=True):
                    text, word = texts[some[t]], self.words[words[w]]
                    if not role or not text.startswith(word[: len(word) // 2]):
                        left.append(some[t])
                        right.append(words[w])
        return left, right


def _half(word: str, length: Column, role: int) -> Column:
    """The half of a word of that length that a word near it would hold."""
    cut = F.floor(length / 2).cast("int")
    return F.substring(F.col(word), F.col("size") - (length - cut) + 1, length - cut) if role else F.substring(F.col(word), F.lit(1), cut)


def _places(words: DataFrame, near: bool) -> DataFrame:
    """word, n and each role and half by which the word is held, or, near, could meet others."""
    lengths = [F.col("size") + d for d in ((-1, 0, 1) if near else (0,))]
    halves = [F.struct(F.lit(role).alias("role"), _half("word", length, role).alias("half")) for role in (0, 1) for length in lengths]
    return words.withColumn("size", F.char_length("word")).select("word", "n", F.explode(F.array_distinct(F.array(*halves))).alias("at")).select("word", "n", "at.*")


def _scanned(held: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """word, n_near, best: how many words are near and the best of them, by shard, from the automata."""
    shard = F.pmod(F.xxhash64("role", "half"), F.lit(shards)).cast("int").alias("shard")
    patterns = held.select(shard, F.lit(0).alias("side"), "role", "word", "n")
    texts = _places(words, near=True).select(shard, F.lit(1).alias("side"), F.lit(0).alias("role"), "word", F.lit(0).cast("long").alias("n")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, halves = None, [], None  # the shard that is being read, its patterns, and their automaton

        def scan(texts: list[str]) -> pa.RecordBatch:
            found: dict[int, list] = {}
            for t, w in zip(*halves.near(texts), strict=True):
                mine = found.setdefault(t, [0, 0, ""])
                mine[0] += 1
                if (-halves.uses[w], halves.words[w]) < (-mine[1], mine[2]):
                    mine[1:] = halves.uses[w], halves.words[w]
            cols = list(zip(*found.values(), strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array([texts[t] for t in found], pa.string()), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["word", "n_near", "most", "near"])

        for b in batches:
            shard, side = b.column("shard").to_numpy(), b.column("side").to_numpy()
            turns = np.flatnonzero((shard[1:] != shard[:-1]) | (side[1:] != side[:-1])) + 1
            for s, e in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
                if s == e:
                    continue
                if shard[s] != now:
                    now, held, halves = shard[s], [], None
                some = b.slice(s, e - s)
                if side[s] == 0:
                    held.append(some.select(["role", "word", "n"]))
                elif held:
                    halves = halves or Halves(*(c.to_pylist() for c in pa.Table.from_batches(held).columns))
                    yield scan(some.column("word").to_pylist())

    dealt = patterns.unionByName(texts).repartition(width(words.sparkSession), "shard").sortWithinPartitions("shard", "side")
    return dealt.mapInArrow(run, "word string, n_near long, most long, near string")


def _joined(held: DataFrame, words: DataFrame) -> DataFrame:
    """As _scanned(), by equality of the rests that one edit leaves; held has the words of crowded halves."""

    def rest(df: DataFrame) -> DataFrame:
        k = F.char_length("half")
        tail = F.when(F.col("role") == 0, F.substring("word", k + 1, F.char_length("word"))).otherwise(F.substring("word", F.lit(1), F.char_length("word") - k))
        return df.withColumn("rest", tail)

    def shorter(df: DataFrame) -> DataFrame:
        """Each rest with one code point left out, and its place."""
        places = F.sequence(F.lit(1), F.char_length("rest"))
        less = F.transform(places, lambda i: F.struct(i.alias("place"), F.concat(F.substring(F.col("rest"), F.lit(1), i - 1), F.substring(F.col("rest"), i + 1, F.char_length("rest"))).alias("less")))
        return df.filter("rest <> ''").select("role", "half", "word", "n", F.explode(less).alias("l")).select("role", "half", "word", "n", "l.*")

    mine = rest(held).select("role", "half", "word", "n", "rest")
    halves = mine.select("role", "half").distinct()
    asking = rest(_places(words, near=True).join(halves, ["role", "half"], "left_semi")).select("role", "half", F.col("word").alias("text"), "rest")
    asked = shorter(asking.withColumnRenamed("text", "word").withColumn("n", F.lit(0))).withColumnRenamed("word", "text").drop("n")
    pairs = shorter(mine).join(asked, ["role", "half", "place", "less"]).filter("text <> word").select("role", "text", "word", "n")
    pairs = pairs.union(shorter(mine).withColumnRenamed("less", "rest").join(asking, ["role", "half", "rest"]).select("role", "text", "word", "n"))
    pairs = pairs.union(asked.withColumnRenamed("less", "rest").join(mine, ["role", "half", "rest"]).select("role", "text", "word", "n")).distinct()
    once = (F.col("role") == 0) | ~F.expr("startswith(text, substring(word, 1, char_length(word) div 2))")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("near")))
    return pairs.filter(once).groupBy(F.col("text").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("most"), "best.near")


def near_words(words: DataFrame, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """word, n_near, most, near of each of the distinct words (word, n) that has near words: their number, and the most frequent one, of equals the first in code-point order, with its n."""
    held = written(_places(words, near=False), "halves")
    shards = max(width(words.sparkSession), -(-held.count() // shard))
    crowded = written(held.groupBy("role", "half").count().filter(F.col("count") > crowd).select("role", "half"), "crowded-halves")
    if crowded.isEmpty():
        found = _scanned(held, words, shards)
    else:
        found = _scanned(held.join(crowded, ["role", "half"], "left_anti"), words, shards)
        found = found.unionByName(_joined(held.join(crowded, ["role", "half"], "left_semi"), words))
    best = F.min(F.struct((-F.col("most")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("most"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each row (word, form): what the chain of forms ends with. Chains must have an end."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, now = now, written(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(last)
    return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of words (distinct word, n > 0).

    Near words differ by one inserted, deleted or replaced code point. form is the most frequent of them (of
    equals the first in code-point order), if its n is ratio times the word's at least, else null; root is what
    following forms ends with, the word itself if it has no form. An empty table gives an empty result."""
    found = written(words.join(near_words(words, shard, crowd), "word", "left"), "near-words")
    form = F.col("most") >= ratio * F.col("n")
    forms = written(found.select("word", F.when(form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("most")).alias("form_n")), "forms")
    ends = roots(forms.filter("form IS NOT NULL"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
