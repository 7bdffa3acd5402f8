"""SimHash near-dedup by deletion-variant signatures.

Fingerprints within 3 bits of each other are found without comparing all pairs. A fingerprint is cut
into two 32-bit segments; of 3 differing bits at most one lies in one of the segments. Each segment is
indexed under its 32 one-wildcard variants (the segment with one bit left out), so linked fingerprints
meet in an equality join on some variant and are then verified over all 64 bits.

Only distinct fingerprints are indexed, so exact copies cost nothing. Inside a variant's bucket links are
verified from a moving pivot against members not yet reached: a dense bucket gives a spanning tree of
verified links, not all its pairs. Buckets past BLOCK members are dealt out as pairs of blocks.

Texts of similarity 0.8 differ in about 15 % of a fingerprint's bits, far more than 3 of 64. near_dedup(),
which links by similarity, therefore takes fingerprints of 256 bits or more over five-word shingles and many
segments of them, of which some one is likely to be equal in two similar texts. A segment's bits follow the number
of texts, so that a bucket holds few unrelated ones, and the number of segments follows from the bits and the
wanted recall. Rows of a bucket carry the whole fingerprint, which tells pairs that are too far apart; the others
are verified by the shingles themselves.

Large groups of near copies would give all their pairs in every bucket. So most of such a group is joined first,
by the middles of neighbourhoods. Then all near pairs of texts of different components are verified, inside their
buckets: what travels is a row for each text that has such a partner in a bucket, with its shingles, and what leaves
are links that join components. Rows so follow the texts, also in a group of texts that are similar but not linked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.llm.common import as_row, byte_rows, dropped, of_row, row_keys, width, written

#: Members of a bucket that one task compares; larger buckets are split into pairs of blocks of this size.
BLOCK = 20_000
#: near_dedup(): chance that one of the segments of two texts of just the wanted similarity passes, and a segment's least bits.
RECALL, LEAST_BITS = 0.95, 16
#: Members up to which all pairs of a bucket are compared at once; buckets hold up to half as many unrelated texts on average. Near pairs a member that make a bucket dense.
CROWD, DENSE = 64, 2
#: Members of other components that a text meets in each of its buckets in candidates(): all.
NEAREST = 1 << 62
#: Members, and bytes of their shingle hashes, of a bucket that one task verifies; larger buckets are split into pairs of blocks of this size.
MEMBERS, SHINGLE_BYTES = 1024, 1 << 24
#: Bits of a fingerprint that segments are made of; more of them share bits.
MOST_BITS = 960
#: Least longs of near_dedup()'s fingerprints.
LONGS = 11
#: Bits by which tasks tell texts that aren't wanted.
WANTED_BITS = 1 << 26
#: Nearest partners of a text that are verified first; others only if they would still join two components.
FIRST = 3


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles: bit b is 1 if it is set in more than half of the shingles' XXH64."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    counts, n = np.zeros(64, np.int64), len(hashes) // 8
    for at in range(0, len(hashes), 8 << 16):
        counts += np.unpackbits(np.frombuffer(hashes[at : at + (8 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in byte_rows(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of each fingerprint."""
    parts = []
    for segment in (0, 1):
        half = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            rest = half.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit)))
            parts.append(rest.bitwiseOR(F.lit((segment * 32 + bit) << 32)))
    return fps.select(F.explode(F.array(*parts)).alias("key"), "fp")


def _crowded(fps: DataFrame) -> DataFrame:
    """(key, blocks): variants whose bucket may pass BLOCK members, from counts of the segments themselves."""
    halves = fps.select(F.explode(F.array(*[F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(s << 32)) for s in (0, 1)])).alias("half"))
    full = halves.groupBy("half").count().filter(F.col("count") > BLOCK // 2)
    bits = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")
    key = (F.col("half").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))).bitwiseOR(F.expr("shiftleft(shiftright(half, 32) * 32 + bit, 32)"))
    # a bucket joins two segments, of which only the larger is sure to be counted here: twice the larger bounds it
    return full.select("half", "count", bits).select(key.alias("key"), "count").groupBy("key").agg(F.ceil(2 * F.max("count") / BLOCK).cast("int").alias("blocks"))


def _tree(fp: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links that join what is linked among the distinct fingerprints fp."""
    left, right, rest = [], [], fp
    while len(rest) > 1:
        pivots, rest = rest[:1], rest[1:]
        while len(pivots) and len(rest):
            near = np.bitwise_count(rest ^ pivots[0]) <= bits
            if near.any():
                reached = rest[near]
                left.append(np.full(len(reached), pivots[0]))
                right.append(reached)
                rest, pivots = rest[~near], np.concatenate([pivots, reached])
            pivots = pivots[1:]
    return left, right


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at most bits <= 3 apart whose closure is that of all such pairs."""
    crowded = written(_crowded(fps), "crowded")
    spark = fps.sparkSession
    # distinct fingerprints are a small file: they are spread before they are multiplied
    index = variants(fps.repartition(width(spark), "fp"))
    if crowded.isEmpty():
        index = index.withColumns({"x": F.lit(0), "y": F.lit(0)})
    else:
        block = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        index = index.join(crowded, "key", "left").select("key", "fp", block.alias("own"), other.alias("other"))
        index = index.select("key", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            """rows: key, block pair, fp in order, whole buckets."""
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(rows)))
            fp = rows[:, 2].view(np.uint64)
            twos = at[size == 2]
            near = np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= bits
            left, right = [fp[twos[near]]], [fp[twos[near] + 1]]
            for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                a, b = _tree(fp[s : s + n], bits)
                left += a
                right += b
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]).view(np.int64), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for b in batches:
            key, xy, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = np.concatenate([*held, np.stack([key, xy, fp], axis=1)])
            held = []
            last = rows[-1, :2] if len(rows) else None
            whole = int(np.flatnonzero((rows[:, :2] != last).any(axis=1))[-1]) + 1 if len(rows) and (rows[0, :2] != last).any() else 0
            if whole:
                yield emit(rows[:whole])
            held = [rows[whole:]]
        if held and len(held[0]):
            yield emit(held[0])

    packed = index.select("key", (F.col("x").cast("long") * F.lit(1 << 31) + F.col("y")).alias("xy"), "fp")
    return packed.repartition(width(spark), "key", "xy").sortWithinPartitions("key", "xy", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node of edges (a, b) with the smallest node of its component.

    Alternates the large-star and small-star steps until the edges stand still; each round is written to
    the shared folder, and the round before is deleted. Only a row count and a checksum reach the driver."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = _sum(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "stars")
        large = both.filter("b > a").join(stars, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        last, now = now, written(small.filter("a <> b").distinct(), "edges")
        before, state = state, _sum(now)
        dropped(last, stars, large, least)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of each row, and (fp, root) of each distinct fingerprint; both written."""
    marked = written(fingerprints(docs), "fingerprints")
    ids = written(marked.select("fp").distinct(), "distinct-fingerprints")
    linked = written(components(links(ids)), "components")
    roots = ids.join(linked, ids.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return marked, written(roots, "roots")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    docs needs doc_id and text; other columns, whatever their names, are left aside. Null, empty and
    all-space texts have fingerprint zero and are linked like any other. Rows with the same or a null
    doc_id each keep a row; component_id is the smallest non-null doc_id of the component, null if there is
    none. An empty table gives an empty result."""
    marked, roots = _grouped(docs)
    least = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    of_root = written(least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    of_fp = written(roots.join(of_root, "root").select("fp", "component_id"), "component-of")
    return marked.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes | None, shingle: int) -> tuple[bytes, set[bytes]]:
    """A text's words (A-Z lower-cased) joined by one space, and its distinct shingles; fewer words are one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if not words:
        return b"", set()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    return joined, {joined[s:e] for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)}


def sizes(n: int, similarity: float = 0.8, recall: float = RECALL) -> tuple[int, int]:
    """How many segments of how many bits n texts take."""
    apart = _apart(similarity)
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n))) + 2 - int(math.log2(CROWD)))
    passes = (1 - apart) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - passes)), bits


def _apart(similarity: float) -> float:
    """The share of a fingerprint's bits in which texts of that similarity are expected to differ: the angle between their sets, over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near_bits(bits: int, similarity: float = 0.8) -> int:
    """Differing bits up to which candidates stay: three standard deviations over what is expected."""
    apart = _apart(similarity)
    return math.floor(bits * apart + 3 * math.sqrt(bits * apart * (1 - apart)))


def wide_fingerprint(found: set[bytes], longs: int = 4) -> bytes:
    """SimHash of 64 bits for each of longs over distinct shingles, each hashed by XXH3 and, for each long, mixed as SplitMix64 does."""
    counts = np.zeros(64 * longs, np.int64)
    own = np.array([xxhash.xxh3_64_intdigest(s, 1) for s in found], np.uint64)
    step = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), 1 << 12):
        z = own[at : at + (1 << 12), None] + step
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.view(np.uint8), axis=1)
        for part in range(0, len(bits), 255):  # sums of bytes, which are quick, stay within bytes
            counts += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found)).tobytes()


def _longs(df: DataFrame) -> list[str]:
    """The columns f0, f1 and so on of a fingerprint."""
    return [f"f{i}" for i in range(sum(c[0] == "f" and c[1:].isdigit() for c in df.columns))]


def sketches(docs: DataFrame, shingle: int, longs: int = LONGS) -> DataFrame:
    """doc_id, k1, k2 (which tell rows apart), text_id (a hash of the text's words) and f0, f1 and so on, its fingerprint, of each row."""
    names = [f"f{i}" for i in range(longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            ids, fps = [], []
            for t in byte_rows(b, "text"):
                joined, found = shingles(t, shingle)
                ids.append(xxhash.xxh64_intdigest(joined, 7))
                fps.append(wide_fingerprint(found, longs))
            fp = np.frombuffer(b"".join(fps), np.int64).reshape(-1, longs)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(np.array(ids, np.uint64).view(np.int64)), *(pa.array(fp[:, i]) for i in range(longs))], ["doc_id", "k1", "k2", "text_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, text_id long, " + ", ".join(f"{f} long" for f in names))


def _segments(batch: pa.RecordBatch, names: list[str], segments: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints (row, long) of a batch and their segments' bits (row, segment, bit), none of the last 64; segments past the others' bits take these again in another order."""
    fp = np.ascontiguousarray(np.stack([batch.column(f).to_numpy() for f in names], axis=1))
    flat = np.unpackbits(fp.view(np.uint8), axis=1)[:, :-64]
    rounds = range(-(-segments * bits // flat.shape[1]))
    at = np.concatenate([np.random.default_rng(r).permutation(flat.shape[1]) if r else np.arange(flat.shape[1]) for r in rounds])[: segments * bits]
    return fp, flat[:, at].reshape(-1, segments, bits)


def segment_keys(texts: DataFrame, segments: int, bits: int) -> DataFrame:
    """key, check (the last 64 bits of the fingerprint, in no segment), text_id, root if texts has it, and the fingerprint: each text's segments."""
    names = _longs(texts)
    more = [c for c in ("text_id", "root") if c in texts.columns] + names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            fp, flat = _segments(b, names, segments, bits)
            key = np.arange(segments) << bits | flat.astype(np.int64) @ (1 << np.arange(bits))
            rest = [np.repeat(x, segments) for x in (fp[:, -1], *(b.column(c).to_numpy() for c in more))]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *map(pa.array, rest)], ["key", "check", *more])

    return texts.select(*more).mapInArrow(run, "key long, check long, " + ", ".join(f"{c} long" for c in more))


def _stars(check: np.ndarray, near: int) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Positions of pairs: middles of neighbourhoods with all that is near them; and the middles."""
    left, right, middles, rest = [], [], [], np.arange(len(check))
    while len(rest):
        bits = np.unpackbits(check[rest].view(np.uint8).reshape(-1, 8), axis=1)
        most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(rest)).view(np.uint64)[0]
        # of several neighbourhoods the majority may be in none: look from the member that is nearest to it
        middle = rest[np.argmin(np.bitwise_count(check[rest] ^ most))]
        close = np.bitwise_count(check[rest] ^ check[middle]) <= near
        reached = rest[close & (rest != middle)]
        middles.append(int(middle))
        rest = rest[~close]
        if not len(reached) and len(middles) >= CROWD:  # no neighbourhoods left
            break
        left.append(np.full(len(reached), middle))
        right.append(reached)
    return left, right, middles


def _near_pairs(key: np.ndarray, check: np.ndarray, near: int, usable) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the near pairs of buckets of up to CROWD rows, in order of key, of which usable(x, y) holds."""
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    same = np.flatnonzero(np.repeat(size <= CROWD, size))
    for d in range(1, CROWD):
        same = same[same + d < len(key)]
        same = same[key[same + d] == key[same]]
        if not len(same):
            break
        close = same[(np.bitwise_count(check[same] ^ check[same + d]) <= near) & usable(same, same + d)]
        left.append(close)
        right.append(close + d)
    return np.concatenate(left), np.concatenate(right)


def _alike(fp: np.ndarray, x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Whether positions differ in at most `most` bits of the fingerprint."""
    out = np.empty(len(x), bool)
    for at in range(0, len(x), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.bitwise_count(fp[x[part]] ^ fp[y[part]]).sum(axis=1, dtype=np.int64) <= most
    return out


def _pairs(text: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], fp: np.ndarray, most: float) -> pa.RecordBatch:
    """Distinct (a, b), a < b, of positions that differ in at most `most` bits."""
    left, right = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    near = _alike(fp, left, right, most)
    pairs = np.unique(np.sort(text[np.stack([left[near], right[near]])], axis=0), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def stars(index: DataFrame, near: int, most: float = math.inf) -> DataFrame:
    """(a, b): text_ids a < b of segment_keys() that share a key and differ in at most near bits of check and most of all, enough to join most of a group of near copies.

    A bucket of up to CROWD members whose near pairs are no more than DENSE times its members gives all of them.
    Another one gives pairs with the middles of its neighbourhoods; one past BLOCK members is taken in blocks,
    each with the middles of those before."""

    # check is the fingerprint's last long
    names = _longs(index)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key: np.ndarray, check: np.ndarray, text: np.ndarray, *longs: np.ndarray) -> tuple[pa.RecordBatch, list[int]]:
            """Pairs of whole buckets, and the middles of the last one if it is large."""
            check = check.view(np.uint64)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(new, len(key)))
            of = np.repeat(np.arange(len(new)), size)
            x, y = _near_pairs(key, check, near, lambda x, y: True)
            dense = (np.bincount(of[x], minlength=len(new)) > DENSE * size)[of[x]]
            left, right, middles = [x[~dense]], [y[~dense]], []
            inside = np.unique(np.concatenate([x[dense], y[dense]]))
            parts = np.split(inside, np.flatnonzero(np.diff(of[inside])) + 1) if len(inside) else []
            for part in [*parts, *(np.arange(s, s + n) for s, n in zip(new[size > CROWD].tolist(), size[size > CROWD].tolist(), strict=True))]:
                a, b, found = _stars(check[part], near)
                left += [part[v] for v in a]
                right += [part[v] for v in b]
                middles = part[found].tolist()
            return _pairs(text, left, right, np.stack([check, *(f.view(np.uint64) for f in longs)], axis=1), most), middles

        columns = ["key", "check", "text_id", *names]
        held = [np.empty(0, np.int64)] * len(columns)
        for b in batches:
            rows = [np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, columns, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield emit(*(r[:cut] for r in rows))[0]
            held = [r[cut:] for r in rows]
            if len(held[0]) > max(BLOCK, CROWD):
                found, middles = emit(*held)
                yield found
                held = [h[middles] for h in held]
        if len(held[0]):
            yield emit(*held)[0]

    return index.select("key", "check", "text_id", *names).repartition(width(index.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def crowded_variants(index: DataFrame, bits: int, block: int) -> DataFrame:
    """key, blocks: one-wildcard variants whose buckets may pass block members, from counts of the whole segments of segment_keys(); for indexes by variants."""
    full = index.groupBy("key").count().filter(F.col("count") > block // 2).select(F.col("key").alias("whole"), "count")
    wild = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("wild")
    segment, value = F.shiftright("whole", bits), F.col("whole").bitwiseAND(F.lit((1 << bits) - 1))
    key = F.shiftleft(segment * bits + F.col("wild"), bits).bitwiseOR(value.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, wild)"))))
    # a bucket joins two segments, of which only the larger is sure to be counted here: twice the larger bounds it
    return full.select("whole", "count", wild).select(key.alias("key"), "count").groupBy("key").agg(F.ceil(2 * F.max("count") / block).cast("int").alias("blocks"))


def crowded_keys(index: DataFrame, block: int) -> DataFrame:
    """key, blocks: keys of segment_keys() of more than block members."""
    return index.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))


def _in_cells(index: DataFrame, crowded: DataFrame) -> DataFrame:
    """index with own, a row's block, and cell: a pair of blocks (x << 31 | y, x <= y) of a key that crowded lists with its number of blocks, 0 for other keys."""
    if crowded.isEmpty():
        return index.withColumns({"own": F.lit(0).cast("long"), "cell": F.lit(0).cast("long")})
    columns = index.columns
    index = index.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
    own = F.pmod(F.xxhash64("text_id"), F.col("blocks"))
    index = index.select(*columns, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return index.select(*columns, "own", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).alias("cell"))


def _by_cell(index: DataFrame, columns: list[str], emit: Callable[..., pa.RecordBatch], kind: str) -> DataFrame:
    """What emit gives for the columns (key and cell are the first two) of whole cells of index, in order of key and cell; each cell meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            rows = rows if held is None else [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = (rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield emit(*(r[:cut] for r in rows))
            held = [r[cut:] for r in rows]
        if held is not None and len(held[0]):
            yield emit(*held)

    return index.select(*columns).repartition(width(index.sparkSession), "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, kind)


def _cells(key: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first positions of cells, and their sizes."""
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
    return new, np.diff(np.append(new, len(key)))


def candidates(index: DataFrame, near: int, crowded: DataFrame, most: float = math.inf) -> DataFrame:
    """(a, b): text_ids a < b of different roots that meet under a key of segment_keys() and differ in at most near bits of check and most of all, of which one is among the other's NEAREST there.

    crowded is a table of crowded_keys(): their buckets are dealt out as pairs of blocks. index may have a side of each row: pairs of one side other than 2 are left out.
    Pairs may grow with the square of a bucket: near_dedup() takes partnered() and bucket_links()."""
    names = _longs(index)[:-1]
    if "side" not in index.columns:
        index = index.withColumn("side", F.lit(2).cast("byte"))

    def emit(key: np.ndarray, cell: np.ndarray, side: np.ndarray, check: np.ndarray, text: np.ndarray, root: np.ndarray, *longs: np.ndarray) -> pa.RecordBatch:
        """Pairs of whole buckets."""
        check = check.view(np.uint64)
        fp = np.stack([check, *(f.view(np.uint64) for f in longs)], axis=1)
        new, size = _cells(key, cell)
        x, y = _near_pairs(np.repeat(np.arange(len(new)), size), check, near, lambda x, y: (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == 2)))
        alike = _alike(fp, x, y, most)
        both, other = np.concatenate([x[alike], y[alike]]), np.concatenate([y[alike], x[alike]])
        order = np.lexsort((text[other], np.bitwise_count(check[both] ^ check[other]), both))
        both, other = both[order], other[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        place = np.arange(len(both)) - np.repeat(first, np.diff(np.append(first, len(both))))
        left, right = [both[place < NEAREST]], [other[place < NEAREST]]
        for s, n in zip(new[size > CROWD].tolist(), size[size > CROWD].tolist(), strict=True):
            own, ids, roots = check[s : s + n], text[s : s + n], root[s : s + n]
            kinds, count = np.unique(roots, return_counts=True)
            # where all pairs are wanted, those of the largest component are found from their other ends
            for m in np.flatnonzero(roots != kinds[np.argmax(count)]).tolist() if n <= NEAREST else range(n):
                off = np.bitwise_count(own ^ own[m])
                found = np.flatnonzero((off <= near) & (roots != roots[m]))
                found = found[_alike(fp, s + found, np.full(len(found), s + m), most)]
                found = found[np.lexsort((ids[found], off[found]))[:NEAREST]]
                left.append(np.full(len(found), s + m))
                right.append(s + found)
        return _pairs(text, left, right, fp, most)

    return _by_cell(_in_cells(index, crowded), ["key", "cell", "side", "check", "text_id", "root", *names], emit, "a long, b long").distinct()


def partnered(index: DataFrame, near: int, crowded: DataFrame, most: float = math.inf) -> DataFrame:
    """key, text_id: the rows of segment_keys() that have a partner under their key: a text of another root that differs in at most near bits of check and most of all.

    crowded is a table of crowded_keys(): their buckets are dealt out as pairs of blocks."""
    names = _longs(index)[:-1]

    def emit(key: np.ndarray, cell: np.ndarray, check: np.ndarray, text: np.ndarray, root: np.ndarray, *longs: np.ndarray) -> pa.RecordBatch:
        check = check.view(np.uint64)
        fp = np.stack([check, *(f.view(np.uint64) for f in longs)], axis=1)
        new, size = _cells(key, cell)
        x, y = _near_pairs(np.repeat(np.arange(len(new)), size), check, near, lambda x, y: root[x] != root[y])
        alike = _alike(fp, x, y, most)
        has = np.zeros(len(key), bool)
        has[x[alike]] = has[y[alike]] = True
        for s, n in zip(new[size > CROWD].tolist(), size[size > CROWD].tolist(), strict=True):
            own, roots = check[s : s + n], root[s : s + n]
            kinds, count = np.unique(roots, return_counts=True)
            # members of the largest component are found from their partners
            for m in np.flatnonzero(roots != kinds[np.argmax(count)]).tolist():
                found = s + np.flatnonzero((np.bitwise_count(own ^ own[m]) <= near) & (roots != roots[m]))
                found = found[_alike(fp, found, np.full(len(found), s + m), most)]
                has[found] = True
                has[s + m] |= len(found) > 0
        return pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(text[has])], ["key", "text_id"])

    return _by_cell(_in_cells(index, crowded), ["key", "cell", "check", "text_id", "root", *names], emit, "key long, text_id long").distinct()


def _joining(root: np.ndarray, own: np.ndarray, apart: bool, fp: np.ndarray, sets: list[np.ndarray], near: int, most: float, similarity: float) -> list[tuple[int, int]]:
    """Positions of links that join all roots that links among the texts of a cell join: as many as there are roots at most.

    Links are pairs that partnered() counts and whose sets have that similarity; apart: of different blocks only."""
    number, sizes = np.unique(np.concatenate(sets), return_inverse=True)[1], np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    mark, now, out = np.zeros(int(number.max(initial=0)) + 1, bool), np.unique(root, return_inverse=True)[1], []
    for x in range(len(sets) - 1):
        other = x + 1 + np.flatnonzero((now[x + 1 :] != now[x]) & (np.bitwise_count(fp[x + 1 :, 0] ^ fp[x, 0]) <= near) & (not apart or own[x + 1 :] != own[x]))
        other = other[_alike(fp, other, np.full(len(other), x), most)]
        if not len(other):
            continue
        start, stop = ends[x] - sizes[x], ends[other[-1]]
        mark[number[start : ends[x]]] = True
        shared = np.append(0, np.cumsum(mark[number[ends[x] : stop]]))
        mark[number[start : ends[x]]] = False
        both = shared[ends[other] - ends[x]] - shared[ends[other] - sizes[other] - ends[x]]
        linked = other[both >= similarity * (sizes[x] + sizes[other] - both)]
        kinds, first = np.unique(now[linked], return_index=True)
        out += [(x, int(y)) for y in linked[first]]
        now[np.isin(now, kinds)] = now[x]
    return out


def bucket_links(met: DataFrame, texts: DataFrame, sets: DataFrame, near: int, most: float, similarity: float) -> DataFrame:
    """(a, b): pairs a < b of partnered() of at least that Jaccard similarity, whose closure, with roots, is that of all such pairs.

    met is a table of partnered(), texts has text_id, root and the fingerprint, sets the shingle_sets() of the texts in met.
    Each bucket verifies its own pairs and gives links that join roots, so that rows in and out follow the rows of met. Buckets
    past MEMBERS rows or SHINGLE_BYTES are dealt out as pairs of blocks."""
    names = _longs(texts)
    size = met.join(sets.select("text_id", F.length("shingles").alias("size")), "text_id").groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("rows") / MEMBERS), F.ceil(F.col("size") / SHINGLE_BYTES)).cast("int")
    crowded = written(size.select("key", blocks.alias("blocks")).filter("blocks > 1"), "crowded-buckets")
    index = _in_cells(met.join(sets.join(texts, "text_id"), "text_id"), crowded)

    def emit(key: np.ndarray, cell: np.ndarray, own: np.ndarray, text: np.ndarray, root: np.ndarray, shingles: np.ndarray, *longs: np.ndarray) -> pa.RecordBatch:
        # check, the last long, first
        fp = np.stack([f.view(np.uint64) for f in (longs[-1], *longs[:-1])], axis=1)
        pairs = []
        for s, n in zip(*(x.tolist() for x in _cells(key, cell)), strict=True):
            part, apart = slice(s, s + n), cell[s] >> 31 != cell[s] & (1 << 31) - 1
            pairs += [(s + x, s + y) for x, y in _joining(root[part], own[part], apart, fp[part], [np.frombuffer(h, np.uint64) for h in shingles[part]], near, most, similarity)]
        found = np.unique(np.sort(text[np.array(pairs, np.int64).reshape(-1, 2)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return _by_cell(index, ["key", "cell", "own", "text_id", "root", "shingles", *names], emit, "a long, b long").distinct()


def _marks(wanted: DataFrame) -> np.ndarray:
    """WANTED_BITS bits, packed, of which those of the wanted text_ids are set: 8 MB, whatever there is."""
    place = F.pmod("text_id", F.lit(WANTED_BITS)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((WANTED_BITS >> 15, 1 << 12), np.uint8)
    for r in maps.collect():
        out[r["at"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """text_id and its sorted shingle hashes (binary, 8 bytes each) of the wanted texts of docs.

    Tasks leave out most texts that aren't wanted before any are shuffled, by a bit for each hash of a wanted one."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            joined = [b" ".join((t or b"").lower().split()) for t in byte_rows(b, "text")]
            own = np.array([xxhash.xxh64_intdigest(j, 7) for j in joined], np.uint64).view(np.int64)
            place = own % WANTED_BITS
            some = pa.array(marks.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(joined, pa.binary())], ["text_id", "words"]).filter(some)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found = [np.sort(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(t, shingle)[1]], np.uint64)).tobytes() for t in byte_rows(b, "words")]
            yield pa.RecordBatch.from_arrays([b.column("text_id"), pa.array(found, pa.binary())], ["text_id", "shingles"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(ids, "text_id long, words binary")
    return rows.join(wanted, "text_id", "left_semi").dropDuplicates(["text_id"]).mapInArrow(sets, "text_id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("text_id").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("text_id").alias("b"), F.col("shingles").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_texts(docs: DataFrame, marked: DataFrame, similarity: float, shingle: int, segments: int, bits: int) -> DataFrame:
    """(node, root): text_ids of sketches(docs) that links join, with their component's smallest."""
    names = _longs(marked)
    texts = written(marked.select("text_id", *names).distinct(), "distinct-texts")
    spread = texts.repartition(width(docs.sparkSession), "text_id")
    near, most = near_bits(64, similarity), near_bits(64 * len(names), similarity)

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs that are near by all bits, and how many differ."""
        sides = [texts.select(F.col("text_id").alias(s), *[F.col(f).alias(s + f) for f in names]) for s in ("a", "b")]
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("a" + f).bitwiseXOR(F.col("b" + f))) for f in names])
        return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", differ.cast("int").alias("bits")).filter(F.col("bits") <= most)

    def linked_by(pairs: DataFrame, found: list[DataFrame]) -> DataFrame:
        """Components of the links in found and of those pairs that are links, too, which are added to found.

        The nearest partners of each text are verified first, others only where their ends aren't in one component already."""
        both = pairs.select("a", "b", "bits").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
        wanted = written(both.select(F.col("a").alias("text_id")).distinct(), "wanted-texts")
        sets = written(shingle_sets(docs, wanted, shingle), "shingle-sets")
        place = F.row_number().over(W.partitionBy("a").orderBy("bits", "b"))
        first = both.withColumn("place", place).filter(F.col("place") <= FIRST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found.append(written(verified(first, sets, similarity), "links"))
        linked = written(components(reduce(DataFrame.unionByName, found)), "components")
        root = [linked.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in ("a", "b")]
        rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(root[0], "a", "left").join(root[1], "b", "left")
        rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        more = written(verified(rest, sets, similarity), "more-links")
        dropped(sets)
        if more.isEmpty():
            return linked
        found.append(more)
        return written(components(reduce(DataFrame.unionByName, found)), "components")

    found: list[DataFrame] = []
    whole = segment_keys(spread, segments, bits)
    linked = linked_by(written(close(stars(whole, near, most)), "star-candidates"), found)
    rooted = texts.join(linked, texts["text_id"] == linked["node"], "left").select(*texts.columns, F.coalesce("root", "text_id").alias("root"))
    rooted = written(rooted, "rooted-texts")
    index = segment_keys(rooted.repartition(width(docs.sparkSession), "text_id"), segments, bits)
    met = written(partnered(index, near, written(crowded_keys(whole, BLOCK), "crowded-keys"), most), "partnered")
    sets = written(shingle_sets(docs, written(met.select("text_id").distinct(), "wanted-texts"), shingle), "shingle-sets")
    more = written(bucket_links(met, rooted, sets, near, most, similarity), "more-links")
    dropped(sets)
    if more.isEmpty():
        return linked
    found.append(more)
    return written(components(reduce(DataFrame.unionByName, found)), "components")


def near_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = RECALL) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without one last.

    Texts are linked whose sets of word shingles have that Jaccard similarity at least; every link was
    verified. Links of barely that similarity may be missed, of those of just that similarity a share of
    1 - recall. Null, empty and all-space texts are copies of each other, as are texts with the same words.
    Columns stay as they are, whatever their names; an empty table gives an empty result."""
    names = docs.columns
    segments, bits = sizes(docs.count(), similarity, recall)
    # 64 bits outside the segments are left for the check
    longs = max(LONGS, -(-(min(segments * bits, MOST_BITS) + 64) // 64))
    marked = written(sketches(docs, shingle, longs), "sketches")
    linked = similar_texts(docs, marked, similarity, shingle, segments, bits)
    best = marked.groupBy("text_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best"))
    best = best.join(linked, best["text_id"] == linked["node"], "left").groupBy(F.coalesce("root", "text_id")).agg(F.min("best").alias("best"))
    chosen = written(best.select("best.k1", "best.k2"), "chosen")
    kept = docs.select(as_row(docs, names), *row_keys()).join(chosen, ["k1", "k2"], "left_semi")
    if not marked.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["k1", "k2"])
    return kept.select(*of_row(names))
