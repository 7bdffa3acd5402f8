"""Substring dedup by prefix-partitioned suffix trees.

A window is SIZE consecutive words; each word that some repeated window covers is removed. Suffixes that
begin at windows' first words are the leaves of suffix trees over words; windows that are equal lie under
one node at depth SIZE or deeper. A tree's group is told by a prefix of its suffixes' words:

1. Prefixes. Of the runs of PREFIX words in a window, the one with the smallest hash (the leftmost of
   equal ones) is the window's prefix. Equal windows have the same one at the same place, and neighbouring
   windows mostly share theirs, so their suffixes travel as one row with their words. A prefix that occurs
   once in all documents can't belong to a repeated window, so its suffixes go at once.
2. Groups. Suffixes are split by prefix. A prefix with more than HEAVY rows is lengthened, step by step
   through LENGTHS up to the whole window, and only its rows are split again, until groups fit in memory.
3. Subtrees. A task sorts its groups' suffixes by their words, down to depth SIZE, by rank doubling.
   Suffixes of one rank are the leaves below an internal node of depth SIZE or more: repeated windows.
   Neighbouring ones are joined into maximal repeats.

Hashes only choose prefixes and deal rows out: what is removed is told by the words themselves, so a
collision costs time and never a word. Equal rows are sent once: before each shuffle a task keeps one as
their representative and marks the others as repeated, and these are dealt out evenly. Where a group is
heavy its rows are thinned once more over all tasks, to at most SALTS of each kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import as_row, byte_rows, covered, row_keys, run_ranks, width, window_hashes, word_hashes, word_ids, written

SIZE, PREFIX = 35, 12
#: Lengths to which a heavy prefix grows, as shares of what is between PREFIX and SIZE.
STEPS = (1 / 3, 2 / 3, 1)
#: Rows up to which a prefix's suffixes stay in one group, and rows of one kind that thinning leaves.
HEAVY, SALTS = 2_000, 16
#: Windows whose prefixes are chosen at once, and bytes of words that a task sorts at once, but for a larger group.
AT_ONCE, SORTED = 1 << 20, 4 << 20

_LOW = np.uint64((1 << 24) - 1)
_PLACES = "gram long, k1 long, k2 long, at long"
_LEAVES = _PLACES + ", n int, words binary"


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each run of span entries."""
    have, out, done = 1, None, 0
    while span:
        if span & 1:
            part = key[done : len(key) if out is None else None]
            out = part if out is None else np.minimum(out[: len(part)], part[: len(out)])
            done += have
        span >>= 1
        if span:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
    return out


def prefixes(words: np.ndarray, size: int = SIZE, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of prefix words, and at which run each window's prefix is."""
    grams = window_hashes(words, prefix)
    n, span = len(words) - size + 1, size - prefix + 1
    if n <= 0:
        return grams, np.empty(0, np.int64)
    parts = []
    for at in range(0, n, AT_ONCE):
        g = grams[at : min(at + AT_ONCE, n) + span - 1]
        # the place is in the low bits, so the minimum tells where it is and equal hashes go to the left
        parts.append((_least((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), span) & _LOW).astype(np.int64) + at)
    return grams, np.concatenate(parts)


def _firsts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the first of their value, and which have a value that occurs more than once."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(values)]
    many = ~new
    many[:-1] |= ~new[1:]
    first, repeated = np.empty(len(values), bool), np.empty(len(values), bool)
    first[order], repeated[order] = new, many
    return first, repeated


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _filled(sizes: list[int], k1: list, k2: list) -> list[pa.Array]:
    return [pa.array(np.repeat(np.array(k, np.int64), sizes)) for k in (k1, k2)]


def _places(keyed: DataFrame, size: int) -> DataFrame:
    """gram, k1, k2, at: the places of windows' prefixes. Low bits of at: 2 if it needn't meet others, 1 if it is known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, sizes, at, k1, k2 = [], [], [], [], []
            for a, z, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), byte_rows(b, "text"), strict=True):
                words = (text or b"").split()
                if len(words) < size:
                    continue
                grams, owner = prefixes(word_hashes(words), size)
                owner = owner[np.append(True, owner[1:] != owner[:-1])]
                gram.append(grams[owner])
                at.append(owner << 2)
                for x, v in ((sizes, len(owner)), (k1, a), (k2, z)):
                    x.append(v)
            if gram:
                gram, at = np.concatenate(gram), np.concatenate(at)
                first, repeated = _firsts(gram)
                at |= np.where(repeated, np.where(first, 1, 3), 0)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *_filled(sizes, k1, k2), pa.array(at)], ["gram", "k1", "k2", "at"])

    return keyed.select("k1", "k2", "text").mapInArrow(run, _PLACES)


def _route() -> Column:
    """Representatives go by prefix, the others evenly."""
    return F.when(F.col("at").bitwiseAND(2) == 0, F.col("gram")).otherwise(F.xxhash64("k1", "k2", "at"))


def _repeated_places(places: DataFrame, parts: int) -> DataFrame:
    """gram, k1, k2, at (low bits 0) of the places whose prefix occurs elsewhere. Rows come sorted and pass as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, stays = None, None, False  # the row that ends the batch before, its prefix, and whether that is repeated

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:3], rows[3] & ~np.int64(3))], ["gram", "k1", "k2", "at"])

        for b in batches:
            rows = np.stack([_column(b, c) for c in ("gram", "k1", "k2", "at")])
            dealt = (rows[3] & 2) == 2
            if dealt.any():
                yield out(rows[:, dealt])
            rows = rows[:, ~dealt]
            if not rows.shape[1]:
                continue
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            gram, known = rows[0], (rows[3] & 1) == 1
            new = np.append(gram[0] != last, gram[1:] != gram[:-1])
            if held is not None:
                new[0] = True
            group = np.cumsum(new)
            group -= group[0]
            many = (np.bincount(group) > 1) | (np.bincount(group, known) > 0)
            many[0] |= last == gram[0] and stays
            keep = many[group]
            # the last row waits, as its prefix may go on in the next batch
            keep[-1], last, stays = False, gram[-1], bool(many[-1])
            held = rows[:, -1:]
            yield out(rows[:, keep])
        if held is not None and stays:
            yield out(held)

    return places.repartition(parts, _route()).sortWithinPartitions("gram").mapInArrow(run, _PLACES)


def _leaf_rows(gram: np.ndarray, keys: list[pa.Array], at: np.ndarray, count: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    """A batch of leaves in which the first of equal rows stands for all: the others are marked and lose their words."""
    number = {}
    kind = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    first, repeated = _firsts(kind)
    at = at | np.where(repeated, np.where(first, 1, 3), 0)
    sent = [w if keep else None for w, keep in zip(words, (first | ~repeated).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *keys, pa.array(at), pa.array(count.astype(np.int32)), pa.array(sent, pa.binary())], ["gram", "k1", "k2", "at", "n", "words"])


def _leaves(marked: DataFrame, size: int) -> DataFrame:
    """gram, k1, k2, at, n, words: for each place that stays, its n suffixes from the one at, and the n + size - 1 words they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, sizes, k1, k2, at, count, rows = [], [], [], [], [], [], []
            for a, z, text, marks in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), byte_rows(b, "text"), b.column("marks"), strict=True):
                words = (text or b"").split()
                grams, owner = prefixes(word_hashes(words), size)
                places = np.sort(marks.values.to_numpy())
                window = np.flatnonzero(places[np.minimum(np.searchsorted(places, owner), len(places) - 1)] == owner)
                if not len(window):
                    continue
                begin = np.flatnonzero(np.append(True, np.diff(owner[window]) != 0))
                n = np.diff(np.append(begin, len(window)))
                flat = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.append(0, ends[:-1] + 1)
                rows += [flat[s:e] for s, e in zip(starts[window[begin]].tolist(), ends[window[begin] + n + size - 2].tolist(), strict=True)]
                gram.append(grams[owner[window[begin]]])
                at.append(window[begin] << 2)
                count.append(n)
                for x, v in ((sizes, len(begin)), (k1, a), (k2, z)):
                    x.append(v)
            if rows:
                yield _leaf_rows(np.concatenate(gram), _filled(sizes, k1, k2), np.concatenate(at), np.concatenate(count), rows)

    return marked.mapInArrow(run, _LEAVES)


def _lengthened(leaves: DataFrame, size: int, prefix: int) -> DataFrame:
    """The suffixes of leaves under longer prefixes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, sizes, k1, k2, at, count, rows = [], [], [], [], [], [], []
            for a, z, place, text in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "at", "words")), strict=True):
                words = text.split(b" ")
                grams, owner = prefixes(word_hashes(words), size, prefix)
                begin = np.flatnonzero(np.append(True, np.diff(owner) != 0))
                n = np.diff(np.append(begin, len(owner)))
                rows += [b" ".join(words[s : s + k + size - 1]) for s, k in zip(begin.tolist(), n.tolist(), strict=True)]
                gram.append(grams[owner[begin]])
                at.append(((place >> 2) + begin) << 2 | place & 1)
                count.append(n)
                for x, v in ((sizes, len(begin)), (k1, a), (k2, z)):
                    x.append(v)
            if rows:
                yield _leaf_rows(np.concatenate(gram), _filled(sizes, k1, k2), np.concatenate(at), np.concatenate(count), rows)

    return leaves.mapInArrow(run, _LEAVES)


def _thinned(leaves: DataFrame, parts: int) -> DataFrame:
    """leaves with at most SALTS undealt rows of the same words; the others are marked as repeated and dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, of which it isn't known yet whether the next one equals it

        def out(b: pa.RecordBatch, words: list, same_before: list[bool], same_after: list[bool]) -> pa.RecordBatch:
            at = _column(b, "at") | np.where(same_before, 3, np.where(same_after, 1, 0))
            sent = [None if s else w for w, s in zip(words, same_before, strict=True)]
            return pa.RecordBatch.from_arrays([b.column("gram"), b.column("k1"), b.column("k2"), pa.array(at), b.column("n"), pa.array(sent, pa.binary())], ["gram", "k1", "k2", "at", "n", "words"])

        before = None  # the words ahead of the held row
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if b.num_rows < 2:
                held = b if b.num_rows else held
                continue
            words = b.column("words").to_pylist()
            same = [x == y for x, y in zip(words, words[1:], strict=False)]
            first = before is not None and before == words[0]
            yield out(b.slice(0, b.num_rows - 1), words[:-1], [first, *same[:-1]], same)
            held, before = b.slice(b.num_rows - 1), words[-2]
        if held is not None and held.num_rows:
            words = held.column("words").to_pylist()
            yield out(held, words, [before is not None and before == words[0]], [False])

    live, dealt = leaves.filter("words IS NOT NULL"), leaves.filter("words IS NULL")
    kind, salt = F.xxhash64("words"), F.pmod(F.xxhash64("k1", "k2", "at"), F.lit(SALTS))
    sorted_rows = live.repartition(parts, kind, salt).sortWithinPartitions(kind, "words")
    return sorted_rows.mapInArrow(run, _LEAVES).unionByName(dealt)


def _groups(leaves: DataFrame, parts: int, size: int, prefix: int) -> DataFrame:
    """leaves, in which prefixes of more than HEAVY rows were lengthened until none is left or the prefix is the window."""
    done, rest = [], leaves
    for step in STEPS:
        heavy = written(rest.filter("words IS NOT NULL").groupBy("gram").count().filter(F.col("count") > HEAVY).select("gram"), "heavy-prefixes")
        if heavy.isEmpty():
            break
        crowded = F.col("words").isNotNull()
        done += [rest.filter(~crowded), rest.filter(crowded).join(heavy, "gram", "left_anti").select(*leaves.columns)]
        longer = _lengthened(rest.filter(crowded).join(heavy, "gram", "left_semi").select(*leaves.columns), size, prefix + round(step * (size - prefix)))
        rest = written(_thinned(longer, parts), "lengthened-prefixes")
    for part in done:
        rest = rest.unionByName(part)
    return rest


def _nodes(groups: DataFrame, parts: int, size: int) -> DataFrame:
    """k1, k2, first, n: runs of n repeated windows from the one at first, from the subtrees of groups."""

    def subtree(rows: pa.Table) -> pa.RecordBatch:
        """The suffixes of whole groups, sorted by their words down to depth size; those that share a rank are under one node."""
        k1, k2, at, n = (rows.column(c).to_numpy() for c in ("k1", "k2", "at", "n"))
        words = b" ".join(rows.column("words").to_pylist()).split(b" ")
        rank = run_ranks(word_ids(words, ordered=True)[0], size)
        base = np.cumsum(n + size - 1) - (n + size - 1)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        leaf = rank[base[row] + place]
        # equal words of one row reach here twice only as two rows, so a node's leaves are its rank's
        node = (np.bincount(leaf)[leaf] > 1) | ((at[row] & 1) == 1)
        row, place = row[node], place[node]
        begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))[: len(row)])
        count = np.diff(np.append(begin, len(row)))
        rows = row[begin]
        return pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(k2[rows]), pa.array((at[rows] >> 2) + place[begin]), pa.array(count.astype(np.int64))], ["k1", "k2", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size_held = 0
        for b in batches:
            dealt = (_column(b, "at") & 2) == 2
            if dealt.any():
                d = b.filter(pa.array(dealt))
                yield pa.RecordBatch.from_arrays([d.column("k1"), d.column("k2"), pa.array(_column(d, "at") >> 2), pa.array(_column(d, "n").astype(np.int64))], ["k1", "k2", "first", "n"])
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                part = part.filter(pa.array(~dealt[at : at + 2048]))
                if not part.num_rows:
                    continue
                held.append(part)
                size_held += part.nbytes
                if size_held < SORTED:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks()
                gram = whole.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield subtree(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                size_held = sum(x.nbytes for x in held)
        if held:
            yield subtree(pa.Table.from_batches(held))

    return groups.repartition(parts, _route()).sortWithinPartitions("gram").mapInArrow(run, "k1 long, k2 long, first long, n long")


def remove_repeats(docs: DataFrame, size: int = SIZE, prefix: int = PREFIX) -> DataFrame:
    """docs' columns, with n_words, n_removed, spans (first and after word of each maximal repeat) and kept.

    kept is the words that stay, joined by one space. A null text has no words and an empty kept. Rows with
    equal doc_id and text are copies of each other. Columns of docs with the added names are replaced; all
    others stay, whatever their names. An empty table gives an empty result."""
    parts = width(docs.sparkSession)
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))), T.StructField("kept", T.StringType())]
    names = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    text = F.col("text").cast("string")
    others = [c for c in names if c != "text"]
    keyed = docs.select(*row_keys(), text.alias("text"), as_row(docs, others))

    stay = written(_repeated_places(_places(keyed, size), parts), "repeated-prefixes")
    marks = stay.groupBy("k1", "k2").agg(F.collect_set(F.shiftright("at", 2)).alias("marks"))
    # the texts are shuffled once: both joins read this exchange, which is why the first one keeps all columns
    dealt = keyed.repartition(parts, "k1", "k2")
    marked = dealt.join(marks.hint("shuffle_hash"), ["k1", "k2"])
    leaves = written(_leaves(marked, size), "suffixes")
    runs = _nodes(_groups(leaves, parts, size, prefix), parts, size).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    schema = T.StructType([*keyed.select("row", "text").schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, found in zip(byte_rows(b, "text"), b.column("runs"), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                gone = np.zeros(len(words), bool)
                if found.is_valid:
                    starts = np.zeros(len(words), bool)
                    for first, n in zip(found.values.field("first").to_numpy(), found.values.field("n").to_numpy(), strict=True):
                        starts[first : first + n] = True
                    gone = covered(starts, size, len(words))
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
                n_removed.append(int(gone.sum()))
                spans.append([{"first": a, "after": z} for a, z in zip(turn[::2], turn[1::2], strict=True)])
                kept.append(b" ".join(words) if not len(turn) else b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
            cols = [b.column("row"), b.column("text"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    joined = dealt.join(runs.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "text", "runs").mapInArrow(run, schema)
    mine = {c: F.col("row").getField(c).alias(c) for c in others}
    return joined.select(*[mine.get(c, F.col("text")) for c in names], *[f.name for f in added])


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with text cut to what stays; a text that loses nothing is left as it is. n_chars, if there, follows the text.

    All columns of docs stay, whatever their names."""
    names = docs.columns
    inner = docs.select(F.col("doc_id"), F.col("text"), as_row(docs, [c for c in names if c != "text"]))
    out = remove_repeats(inner, size)
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(kind)).otherwise(F.col("row").getField("n_chars"))
    return out.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in names])
