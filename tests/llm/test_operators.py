"""The ten training-data operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartolith.llm import bpe, language, mixing, near_dedup, quality, sharding, substring_dedup, token_counts, topk, toxicity
from cartolith.llm import queries as registered
from cartolith.llm.common import shared_dir, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts, ids=None):
    return [(i if ids is None else ids[i], t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def awkward():
    """Nulls in every column, empty, blank and long texts, repeated rows and repeated ids."""
    rng = random.Random(3)
    rows = [(None, "no id here", None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, text_of(rng, 30_000), "en", "a", None)]
    rows += [(5, "the same row twice over", "en", "b", 23)] * 2 + [(6, "one id", "de", "b", 6), (6, "two texts", "de", None, 9), (7, "héllo wörld ñ 日本語 <|endoftext|> x", "xx", "b", None)]
    return rows + [(8 + i, text_of(rng, 60), "en", "c", None) for i in range(12)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit(c) for c in ("fp", "key", "root", "marks", "gram", "Copy", "Rate", "IDS", "n_words", "kept", "shard", "features", "size", "score", "labels")}
    return spark.createDataFrame(awkward(), DOCS).withColumns(extra).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# near-dedup


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_groups(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(set(fps))
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True))
    assert Counter(map(tuple, got)) == want


def near_texts():
    rng = random.Random(1)
    texts = [text_of(rng, n) for n in (1, 2, 3, 50, 400)]
    for _ in range(60):
        base = texts[4].split()
        for _ in range(rng.choice([1, 2, 5, 60])):
            base[rng.randrange(len(base))] = rng.choice(WORDS)
        texts.append(" ".join(base))
    return texts + texts[:5] + [t.upper() for t in texts[:5]] + [None, "", " "]


def test_simhash_against_all_pairs(spark):
    rows = rows_of(near_texts())
    got = near_dedup.simhash_groups(spark.createDataFrame(rows, DOCS)).select("doc_id", "fingerprint", "component_id").collect()
    check_groups([r[:2] for r in rows], got)


@pytest.mark.parametrize("block", [20_000, 8])
def test_links_close_as_all_pairs_do(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                f ^= 1 << b
    fps |= {rng.getrandbits(32) | 7 << 40 for _ in range(80)}  # one segment is equal throughout
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    mask = (1 << 64) - 1
    linked = {r.node & mask: r.root & mask for r in near_dedup.components(near_dedup.links(df)).collect()}
    want = brute_components(fps)
    groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == r) for r in {m.get(f, f) for f in fps})
    assert groups(linked) == groups(want)


def test_simhash_on_awkward_tables(spark, odd, none):
    got = near_dedup.simhash_groups(odd).select("doc_id", "fingerprint", "component_id").collect()
    check_groups([r[:2] for r in awkward()], got)
    assert near_dedup.simhash_groups(none).count() == 0


def brute_similar(texts, similarity=0.8):
    """The component of each text (its first member's place), by all pairs of shingle sets."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(len(texts))], [(i, j) for i, j in links if sets[i] != sets[j]]


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), round(share * len(words))):
        words[i] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("hot", [False, True])
def test_near_copies_are_found_by_similarity(spark, monkeypatch, hot):
    """At least nine in ten links of similarity 0.8 or more, and none of less; hot: most texts are copies of one, in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 150)
    rng = random.Random(25)
    bases = [text_of(rng, rng.choice([60, 200, 500])) for _ in range(60)]
    texts = [edited(rng, b, rng.choice([0.005, 0.01, 0.02])) for b in bases for _ in range(4)] + bases
    if hot:
        texts += [edited(rng, bases[1], 0.018) for _ in range(300)]
    rows = rows_of(texts, ids=rng.sample(range(10_000), len(texts)))
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    root, links = brute_similar(texts)
    marked = near_dedup.sketches(docs, 5).select("doc_id", "text_id").collect()
    text_id = {r.doc_id: r.text_id for r in marked}
    linked = {r.node: r.root for r in near_dedup.similar_texts(docs, near_dedup.sketches(docs, 5), 0.8, 5, *near_dedup.sizes(len(texts))).collect()}
    of = [text_id[r[0]] for r in rows]
    own = [linked.get(t, t) for t in of]
    assert len(links) > 200 and sum(own[i] == own[j] for i, j in links) >= 0.9 * len(links)
    together = {}
    for i, r in enumerate(own):
        assert root[together.setdefault(r, i)] == root[i]
    kept = near_dedup.near_dedup(docs).collect()
    least = {}
    for i, r in enumerate(own):
        least[r] = min(rows[i][0], least.get(r, 10_000))
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_crowded_buckets_lose_few_links(spark, monkeypatch):
    """Most rows are in buckets past CROWD, by unrelated texts and by a family of half-similar ones: nearly all components are those of buckets that offer all their pairs."""
    rng = random.Random(31)
    base = text_of(rng, 150)
    texts = [text_of(rng, rng.randrange(60, 160)) for _ in range(250)] + [edited(rng, base, rng.uniform(0.01, 0.06)) for _ in range(150)]
    texts += [edited(rng, t, 0.01) for t in rng.sample(texts, 150)]
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(6)
    marked = written(near_dedup.sketches(docs, 5), "marked")
    names = [f"f{i}" for i in range(4)]
    members = near_dedup.segment_keys(marked.select("text_id", *names).distinct(), 9, 7).groupBy("key").count().collect()
    assert sum(r["count"] for r in members if r["count"] > 3) > sum(r["count"] for r in members) / 2
    found = []
    for crowd, block, nearest in ((3, 20_000, 2), (3, 40, 2), (10**6, 20_000, 10**6)):
        for name, value in (("CROWD", crowd), ("BLOCK", block), ("NEAREST", nearest)):
            monkeypatch.setattr(near_dedup, name, value)
        found.append({r.node: r.root for r in near_dedup.similar_texts(docs, marked, 0.8, 5, 9, 7).collect()})
    merges = [len(f) - len(set(f.values())) for f in found]
    assert min(merges[:2]) >= 0.98 * merges[2] > 100
    of = [r.text_id for r in sorted(marked.collect(), key=lambda r: r.doc_id)]
    _, links = brute_similar(texts)
    joined = sum(found[0].get(of[i], of[i]) == found[0].get(of[j], of[j]) for i, j in links)
    assert len(links) > 150 and joined >= 0.9 * len(links)


@pytest.mark.parametrize("crowd,blocks", [(64, 1), (4, 1), (4, 3)])
def test_pairs_of_different_roots(spark, monkeypatch, crowd, blocks):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = random.Random(6)
    rows = [(rng.randrange(4), 2, rng.randrange(2**12), 100 + i, rng.choice([1, 1, 1, 2, 3, 100 + i])) for i in range(200)]
    rows += [(9, 2, 5, 1000 + i, 7) for i in range(50)] + [(10, i % 2, 5, 2000 + i, 2000 + i) for i in range(3)]
    crowded = spark.createDataFrame([(k, blocks) for k in (0, 1, 9)] if blocks > 1 else [], "key long, blocks int")
    df = spark.createDataFrame(rows, "key long, side byte, check long, text_id long, root long")
    monkeypatch.setattr(near_dedup, "NEAREST", 10**6)
    got = [(r.a, r.b) for r in near_dedup.candidates(df, 3, crowded).collect()]
    want = {(x[3], y[3]) for x in rows for y in rows if x[3] < y[3] and x[0] == y[0] and x[4] != y[4] and (x[2] ^ y[2]).bit_count() <= 3 and (x[1] != y[1] or x[1] == 2)}
    assert set(got) == want and len(got) == len(want) and len(want) > 100
    # each text's nearest partners are among the few
    monkeypatch.setattr(near_dedup, "NEAREST", 2)
    few = {(r.a, r.b) for r in near_dedup.candidates(df, 3, crowded).collect()}
    check = {r[3]: r[2] for r in rows}
    off = lambda pair: (check[pair[0]] ^ check[pair[1]]).bit_count()
    nearest = {t: min(off(p) for p in want if t in p) for t in {t for p in want for t in p}}
    assert few < want and all(min(off(p) for p in few if t in p) == n for t, n in nearest.items())


def test_crowded_variants(spark):
    """Every variant of more members than a block is listed with blocks enough."""
    rng = random.Random(7)
    values = [rng.choice([5, 5, 5, 4, 7, rng.randrange(16)]) for _ in range(300)]
    index = spark.createDataFrame([(3 << 4 | v, 0, i) for i, v in enumerate(values)], "key long, check long, text_id long")
    got = {r.key: r.blocks for r in near_dedup.crowded_variants(index, 4, 40).collect()}
    members = Counter((3 * 4 + w) << 4 | v & ~(1 << w) for v in values for w in range(4))
    assert all(got[k] * 40 >= n for k, n in members.items() if n > 40) and len(got) < len(members)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_shingle_sets_of_wanted_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(near_dedup, "WANTED_BITS", bits)
    rng = random.Random(12)
    texts = [text_of(rng, rng.randrange(12)) for _ in range(400)] + [None, "", "A b c d e f"] * 2
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    ids = [xxhash.xxh64_intdigest(" ".join((t or "").lower().split()).encode(), 7) for t in texts]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    wanted = {signed(i) for i in rng.sample(ids, 60)} | {signed(ids[-1]), signed(ids[-2]), 12345}
    got = near_dedup.shingle_sets(docs, spark.createDataFrame([(i,) for i in wanted], "text_id long"), 5).collect()
    assert sorted(r.text_id for r in got) == sorted(wanted - {12345})
    of = dict(zip(map(signed, ids), texts, strict=True))
    for r in got:
        words = (of[r.text_id] or "").lower().split()
        want = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))} if words else set()
        assert np.frombuffer(r.shingles, np.uint64).tolist() == sorted(want)


def test_sizes_of_the_index():
    for n in (0, 1, 100, 10**6, 10**9, 10**11):
        segments, bits = near_dedup.sizes(n)
        assert n / 2 ** (bits - 1) <= near_dedup.CROWD / 2  # unrelated texts in a bucket, on average
        passes = 0.8485**bits + bits * 0.1515 * 0.8485 ** (bits - 1)
        assert 1 - (1 - passes) ** segments >= 0.949


def test_near_dedup_on_awkward_tables(spark, odd, none):
    wide = odd.withColumns({c: F.lit(1) for c in ("row", "k1", "k2", "text_id", "f0", "a", "b", "bits", "best", "__id", "__hash", "__text")})
    kept = near_dedup.near_dedup(wide)
    root, _ = brute_similar([r[1] for r in awkward()])
    assert kept.columns == wide.columns and kept.count() == len(set(root)) and near_dedup.near_dedup(none).count() == 0
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id in (2, 3)").count() == 0


CLASHES = ("row", "text_hash", "k1", "k2", "words", "spans_", "marks", "runs", "at", "gram", "id", "md5", "place", "of", "cum", "draws", "__text", "__source", "__salt", "__order", "__id", "__hash", "__doc", "__crc", "a.b", "c`d")


def test_no_name_of_a_column_is_lost(spark, odd):
    """Columns that are named as operators' own, or oddly, come through with their values."""
    wide = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"kept {i}").alias(c) for i, c in enumerate(CLASHES)])
    labels = spark.createDataFrame([(8, 1), (9, 0), (10, 1)], "doc_id long, quality int")
    model = quality.fit(wide, labels)
    outs = [near_dedup.near_dedup(wide), substring_dedup.without_repeats(wide), substring_dedup.remove_repeats(wide), mixing.mix(wide), quality.keep_good(wide, model), bpe.encode(wide, decoded=True), bpe.decode(bpe.encode(wide))]
    for out in outs:
        assert set(CLASHES) <= set(out.columns)
        for r in out.collect():
            assert all(r[c] == f"kept {i}" for i, c in enumerate(CLASHES))


# substring dedup


def brute_repeats(texts, size=35):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def passages():
    rng = random.Random(4)
    shared = [text_of(rng, n) for n in (34, 35, 36, 60, 200)]
    texts = [text_of(rng, rng.randrange(0, 120)) for _ in range(40)]
    for _ in range(60):
        parts = [text_of(rng, rng.randrange(0, 40)), rng.choice(shared), text_of(rng, rng.randrange(0, 40)), rng.choice(shared)]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    loop = " ".join(["a b c"] * 60)
    return texts + [loop, "x " * 300, texts[50], texts[50], None, "", shared[4] + "\t" + shared[4]]


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_substring_dedup_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    texts = passages()
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def thue_morse(n):
    """Two strings of n letters whose polynomial hashes modulo 2**64 are the same for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart_by_their_bytes(spark):
    rest = " ".join(f"r{i}" for i in range(34))
    texts = [f"{w} {rest}" for w in thue_morse(1024)]
    assert [r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows_of(texts), DOCS)).collect()] == [0, 0]
    eight = [f"{w} " + " ".join(f"r{i}" for i in range(7)) for w in thue_morse(1024)]
    assert quality.statistics(" ".join(eight).encode())[0][4] == brute_base(" ".join(eight))[4] == 0
    # words in that order, two of each kind, where a rolling polynomial over words would be in doubt
    lines = [" ".join(x) for x in thue_morse(4096)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows_of(lines), DOCS)).collect()}
    assert got == dict(enumerate(brute_repeats(lines)))


def test_a_hot_passage_lengthens_and_thins(spark, monkeypatch):
    """One passage in all documents, each with words of its own around it, over many tasks."""
    monkeypatch.setattr(substring_dedup, "HEAVY", 20)
    monkeypatch.setattr(substring_dedup, "SALTS", 3)
    rng = random.Random(16)
    hot = text_of(rng, 50)
    texts = [f"{text_of(rng, i % 40)} {hot} {text_of(rng, i % 7)} end{i}" for i in range(400)] + [hot] * 200
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(40)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def test_rows_without_an_id_keep_their_own_marks(spark):
    rng = random.Random(17)
    texts = passages()[:60]
    df = spark.createDataFrame([(None, t, None, None, None) for t in texts] + [(7, t, None, None, None) for t in texts[:30]], DOCS)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect())
    both = texts + texts[:30]
    assert got == Counter((None if i < 60 else 7, *b) for i, b in enumerate(brute_repeats(both))) and rng


def test_substring_dedup_on_awkward_tables(spark, odd, none):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(odd).collect())
    assert got == Counter((r[0], *b) for r, b in zip(awkward(), brute_repeats([r[1] for r in awkward()]), strict=True))
    cut = substring_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and cut.filter("doc_id = 3").first().text == " \n\t "
    assert substring_dedup.remove_repeats(none).count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(tokenizer):
    rng = random.Random(6)
    space = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    some = [*space, *"abcXYZ019'.,!s", "'s", "'ll", "é", "ß", "日", "本", "́", "😀", "²", "Ⅷ", "<|endoftext|>", "<|endof", "\x00"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000, "\n" * 999, "日本" * 999, text_of(rng, 5000), ""]
    own = bpe.codec(bpe.default_path())
    for text, ids, want in zip(texts, own.encode(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, repr(text)
        assert own.decode(ids) == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_bpe_over_code_points(tokenizer):
    own = bpe.codec(bpe.default_path())
    texts = ["".join(f"a{chr(c)}1 {chr(c)}b{chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x20000, 64)]
    bad = [t for t, ids in zip(texts, own.encode(texts), strict=True) if ids.tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    # letters that were assigned after the library's tables were made may be split otherwise
    assert not bad, [hex(ord(t[1])) for t in bad]


def test_bpe_on_awkward_tables(spark, odd, none, tokenizer):
    out = bpe.encode(odd, decoded=True)
    for r in out.collect():
        assert list(r.ids) == tokenizer.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.n_tokens == len(r.ids)
    again = bpe.decode(bpe.encode(odd)).select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in again) and bpe.encode(none).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()[0].decoded is None


# token counts


def brute_counts(flat, separator):
    out, n = [], 0
    for x in flat:
        if x == separator:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_separator_scan_against_a_loop(spark, monkeypatch, size):
    monkeypatch.setattr(token_counts, "CHUNK", 4)
    rng = np.random.default_rng(size)
    files = {f: rng.integers(0, 6, n) for f, n in enumerate((0, 1, 50, 333, 1000))} | {5: np.full(90, 3), 6: np.zeros(300, int)}
    blocks = [(f, b, v[at : at + size].astype("<u2").tobytes()) for f, v in files.items() for b, at in enumerate(range(0, len(v), size))] + [(7, 0, None), (7, 1, b"")]
    got = token_counts.separator_scan(spark.createDataFrame(blocks, "file long, block long, data binary").repartition(3), 3).orderBy("file", "ordinal").collect()
    want = [(f, i, n, closed) for f, v in sorted(files.items()) for i, (n, closed) in enumerate(brute_counts(v.tolist(), 3))]
    assert [tuple(r) for r in got] == want


def counted(docs, folder, **kw):
    order = written(token_counts.write_flat(docs, folder, **kw), "order")
    return token_counts.token_counts(order, folder, **kw)


def test_flat_files_and_documents(spark, odd, none, tokenizer, tmp_path):
    tokenizer.encode_special_tokens = True
    try:
        want = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), True) for r in awkward())
        assert Counter(map(tuple, counted(odd, f"file://{tmp_path}/odd").collect())) == want
        # a separator past two bytes widens the ids
        assert Counter(map(tuple, counted(odd, f"file://{tmp_path}/wide", separator=70_000).collect())) == want
    finally:
        tokenizer.encode_special_tokens = False
    (tmp_path / "none").mkdir()
    assert counted(none, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        token_counts.id_bytes_of(separator=1 << 32)


@pytest.mark.parametrize("block", [2, 5, 1 << 20])
def test_files_are_read_in_ranges(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {f"{i}.bin": rng.integers(0, 9, n) for i, n in enumerate((0, 1, 7, 200))}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u4").tobytes())
    (tmp_path / "other.txt").write_bytes(b"not ids")
    got = token_counts.scan_files(spark, f"file://{tmp_path}", 9 - 1, 4, block).collect()
    want = sorted((f, i, n, closed) for f, ids in files.items() for i, (n, closed) in enumerate(brute_counts(ids.tolist(), 8)))
    assert sorted((r.file.split("/")[-1], r.ordinal, r.n_tokens, r.closed) for r in got) == want


def test_what_a_lost_attempt_left_is_not_opened(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, "one two three", "x", 1.5) for i in range(20)], "doc_id long, text string, file string, inner double")  # columns named as the operator's own
    order = written(token_counts.write_flat(docs, folder), "order")
    (tmp_path / "part-000000-lost.bin").write_bytes(b"odd")
    got = token_counts.token_counts(order, folder).collect()
    assert sorted(r.doc_id for r in got) == list(range(20)) and all(r.closed for r in got)
    with pytest.raises(Exception, match="no multiple of"):
        token_counts.scan_files(spark, folder, 0).collect()


def test_a_file_of_tiny_documents(spark, tmp_path):
    ids = np.zeros(1_000_000, "<u2")
    ids[500_000] = 5
    (tmp_path / "tiny.bin").write_bytes(ids.tobytes())
    got = token_counts.scan_files(spark, f"file://{tmp_path}", 0, 2, 1 << 14)
    ends = got.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.max("ordinal").alias("last"), F.sum("n_tokens").alias("t")).first()
    assert (ends.n, ends.d, ends.last, ends.t) == (999_999, 999_999, 999_998, 1) and got.filter("n_tokens = 1").first().ordinal == 500_000


# mixing


def drawn(spark, rows):
    """rows (u, rate) with the counts that inversion gives, one draw each."""
    df = spark.createDataFrame(rows, "u double, source string, rate double")
    rates = mixing.with_distributions(df.select("source", "rate").distinct()).select("source", "cum", "draws")
    return df.join(rates, "source").withColumn("k", mixing.poisson_count(F.col("u"), F.col("cum"))).collect()


def test_poisson_inversion(spark):
    got = drawn(spark, [(u / 997, str(rate), rate) for u in range(997) for rate in (0.0, 0.3, 1.0, 6.5)])

    def slow(u, rate):
        k, term = 0, np.exp(-rate)
        total = term
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        return k

    assert all(r.k == slow(r.u, r.rate) for r in got)
    means = {rate: np.mean([r.k for r in got if r.rate == rate]) for rate in (0.3, 1.0, 6.5)}
    assert all(abs(m - rate) < 0.03 for rate, m in means.items())


def test_mixing_meets_weights(spark):
    rng = random.Random(8)
    rows = [(i, text_of(rng, 40), "en", "big" if i % 3 else "small" if i % 2 else None, 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs, {"big": 1.0, "small": 2.0, None: 1.0})
    tokens = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    total = sum(tokens.values())
    assert abs(tokens["big"] / total - 0.25) < 0.02 and abs(tokens["small"] / total - 0.5) < 0.02
    same = lambda df: Counter(map(tuple, df.select("doc_id", "copy", "n_copies").collect()))
    assert same(out) == same(mixing.mix(docs.repartition(7), {"big": 1.0, "small": 2.0, None: 1.0}))
    assert set(mixing.mix(docs, {"small": 1.0}, budget=0.2).select("source").distinct().toPandas().source) == {"small"}
    many = mixing.mix(docs.limit(60), {"small": 1.0}, budget=500.0).groupBy("doc_id").count().collect()
    assert many and all(r["count"] > 500 for r in many)


def test_mixing_draws_every_rate(spark, tmp_path):
    """A source of few tokens has a rate far past 20; op1 and the pipeline's stage draw it all the same."""
    import corpus_pipeline
    from cartolith.llm import queries

    long = text_of(random.Random(9), 20_000)
    rows = [(i, f"{i} {long}", "en", "big", 0) for i in range(40)] + [(100 + i, "x", "en", "small", 0) for i in range(3)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op1_mixing(spark, f"file://{tmp_path}").collect()
    rate = next(r.rate for r in got if r.source == "small")
    small = Counter(r.doc_id for r in got if r.source == "small")
    assert rate > 20 and set(small) == {100, 101, 102} and all(abs(n - rate) < 6 * rate**0.5 for n in small.values())
    stage = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, DOCS), "")
    assert stage.filter("source = 'small'").count() == sum(small.values())


def test_poisson_draws_at_large_rates(spark):
    """One draw against summed terms in exact arithmetic of logs; sums of draws by their mean and variance."""
    got = drawn(spark, [(u / 997 + 0.0005, str(rate), rate) for u in range(997) for rate in (25.0, 90.0, 480.0)])
    below = {rate: np.cumsum(np.exp([-rate + k * np.log(rate) - math.lgamma(k + 1) for k in range(1500)])) for rate in (25.0, 90.0, 480.0)}
    assert all(r.k == np.searchsorted(below[r.rate], r.u, side="right") for r in got)
    rates = mixing.with_distributions(spark.createDataFrame([("s", 2600.0)], "source string, rate double"))
    many = spark.range(3000).crossJoin(rates).select(mixing.counts(F.col("draws"), F.col("cum"), F.lit("7"), F.col("id").cast("string")).alias("k")).toPandas().k
    assert abs(many.mean() - 2600) < 5 and 0.85 < many.var() / 2600 < 1.15


def test_one_stray_row_is_mixed_and_its_sql_agrees(spark, tmp_path):
    """A source of one row among 60,000 is drawn at its rate; a stray row doesn't stop the query."""
    from cartolith.llm import queries

    rows = [(i, "some words of a text", "en", "all", 0) for i in range(60_000)] + [(60_000, "stray", None, None, None)] * 2
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"file://{path}")
    got = queries.op1_mixing(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert Counter(map(tuple, got.select(*sorted(got.columns)).collect())) == Counter(con.sql(queries.OP1_SQL).select(", ".join(sorted(got.columns))).fetchall())
    assert got.filter("doc_id = 60000").first().rate > 20


def test_mixing_salts_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 7}" if i % 5 else None, 0) for i in range(300)], DOCS)
    want = Counter(map(tuple, mixing.mix(docs).select("doc_id", "copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 2)
    assert Counter(map(tuple, mixing.mix(docs).select("doc_id", "copy").collect())) == want


def test_mixing_on_awkward_tables(odd, none):
    out = mixing.mix(odd)
    rows = out.collect()
    assert all(0 <= r.copy < r.n_copies for r in rows) and {r.doc_id for r in rows} <= {r[0] for r in awkward()}
    assert mixing.mix(none).count() == 0


# top-k


def brute_top(rows, queries, k):
    usable = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, w in {(i, tuple(v)) for i, v in whole if i in queries}:
        best = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_against_all_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    dense = rng.normal(0, 0.3, (900, 16))
    dense[rng.random((900, 16)) < 0.8] = 0
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(dense)] + [(1000 + i, [0.25] * 16) for i in range(30)]
    rows += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(6)
    queries = {i for i, _ in rows if i is not None and i % 50 == 0}
    monkeypatch.setattr(topk, "SHARE", 100)
    for block in (32_768, 16, 2):
        got = topk.top_k(df, "vec_id % 50 = 0", 5, query_block=block).collect()
        assert sorted(map(tuple, got)) == brute_top(rows, queries, 5)
    monkeypatch.setattr(topk, "TASK_ROWS", 7)
    monkeypatch.setattr(topk, "TASK_QUERIES", 3)
    got = topk.top_k(df.repartition(2), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, queries, 5)
    # rows of one id, equal or not, are queries of their own and candidates of each other
    twins = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [4.0, 0.0]), (2, [0.0, 4.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    both = spark.createDataFrame(twins, "vec_id long, embedding array<double>")
    want = []
    for q, (i, v) in enumerate(twins):
        if i == 50:
            ranked = sorted((-sum(round(a * b * 65536) for a, b in zip(v, w, strict=True)), j) for c, (j, w) in enumerate(twins) if c != q)
            want += [(50, r + 1, j, -s) for r, (s, j) in enumerate(ranked[:4])]
    assert sorted(map(tuple, topk.top_k(both, "vec_id = 50", 4).collect())) == sorted(want) and len(want) == 12
    both.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registered.op6_exact_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(registered.OP6_SQL).fetchall()) and len(got) == 15
    # exact past a double's digits, and the nearest long past a long
    far = [(0, [2.0**40, 3.0]), (1, [2.0**7, 1.0]), (2, [2.0**7, 2.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])]
    got = topk.top_k(spark.createDataFrame(far, "vec_id long, embedding array<double>"), "vec_id = 0", 5).orderBy("rank").collect()
    exact = {i: sum(int(256 * a) * int(256 * b) for a, b in zip(far[0][1], v, strict=True)) for i, v in far}
    assert [(r.vec_id, r.score) for r in got] == sorted(((i, max(-(2**63), min(2**63 - 1, s))) for i, s in exact.items() if i), key=lambda x: (-x[1], x[0]))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk.top_k(few).count() == 6 and topk.top_k(few.limit(0)).count() == 0 and topk.top_k(few, "false").count() == 0


# quality


def brute_base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(again)


def test_quality_counts(spark, odd, none):
    texts = passages() + ["a # b\na # b\n\na # b \n * $% é日\r\n", "één été 日本\x85x\xa0y", *[r[1] for r in awkward()]]
    got = quality.judge(spark.createDataFrame(rows_of(texts), DOCS), quality.boost(np.empty((0, len(quality.FEATURES))), np.empty(0))).collect()
    for r in got:
        n, chars, symbols, dups, again = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, again)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n) and not (r.base_failed and r.kept)
    labels = spark.createDataFrame([(8, 1, 0), (9, 0, 0), (9, 1, 0), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    assert quality.judge(odd, model).count() == len(awkward()) and quality.keep_good(odd, model).columns == odd.columns
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(10)
    x = rng.random((1500, len(quality.FEATURES)))
    fall, free = quality.FEATURES.index("repeat_share"), quality.FEATURES.index("log_words")
    y = (x[:, free] - x[:, fall] + 0.3 * np.sin(12 * x[:, fall]) + rng.normal(0, 0.1, 1500) > 0).astype(float)
    model = quality.boost(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) > 0.5) == (y[1000:] > 0.5)).mean() > 0.85
    line = np.repeat(x[:50], 40, axis=0)
    line[:, fall] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.score(line).reshape(50, 40), axis=1) <= 1e-12).all()

    def walk(row):
        total = model.start
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    assert model.score(x[:20]) == pytest.approx([walk(r) for r in x[:20]])


# sharding


def check_shards(rows, got, shards=16):
    import zlib

    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want and all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_balances(spark, odd, none):
    rng = random.Random(11)
    texts = [text_of(rng, int(rng.paretovariate(1.3) * 20) % 3000) for _ in range(3000)]
    texts += ["copied " * 5] * 900 + [text_of(rng, 200)] * 300
    rows = rows_of(texts)
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).collect()
    check_shards([r[:2] for r in rows], got)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(sizes) < 1.03 * sum(sizes) / 16 and min(sizes) > 0.97 * sum(sizes) / 16
    of = {}
    for r in got:
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
    # equal texts stay together unless they are too large for that
    assert sum(len(v) > 1 for v in of.values()) <= 2
    assert {r.doc_id for r in got if r.split} <= {i for i, t in enumerate(texts) if len(of[t]) > 1}
    check_shards([r[:2] for r in awkward()], sharding.shard(odd).collect())
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("ident", [None, 7])
def test_a_hot_group_without_ids_keeps_the_law(spark, monkeypatch, ident):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 500)
    rows = [(ident, "the same text of a hot group", None, None, None)] * 4000 + [(i, f"{i} words", None, None, None) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(8)).collect()
    check_shards([r[:2] for r in rows], got)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(sizes) < 1.03 * sum(sizes) / 16 and min(sizes) > 0.97 * sum(sizes) / 16
    assert all(r.split == (r.size == 29) for r in got)


def test_packing_where_bytes_and_tokens_conflict():
    """Items that are heavy in bytes alone or in tokens alone: all three sums come out near equal."""
    rng = np.random.default_rng(24)
    items = np.stack([rng.pareto(1.5, 4000) * 100 + 5, rng.pareto(1.5, 4000) * 20 + 1, rng.integers(1, 5, 4000)], axis=1)
    items = np.concatenate([items, [[30_000.0, 10, 1]] * 10, [[10.0, 9_000, 1]] * 10])
    where = sharding.pack(items, 16)
    for j in range(3):
        load = np.bincount(where, items[:, j], 16)
        assert load.max() < 1.01 * load.mean() and load.min() > 0.99 * load.mean()


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_plain_loops(seed):
    rng = np.random.default_rng(seed)
    items = np.stack([rng.pareto(1.2, 300) * 100 + 5, rng.pareto(1.5, 300) * 20 + 1, rng.integers(1, 5, 300)], axis=1)
    items[rng.integers(0, 300, 60)] = items[0]  # ties
    weights, shards, slack = (8.0, 1.0, 1.0), 7, 0.01
    mean = [sum(x[j] for x in items) / shards for j in range(3)]
    unit = [[x[j] / mean[j] * math.sqrt(weights[j]) for j in range(3)] for x in items]
    left, want = [[math.sqrt(w) for w in weights] for _ in range(shards)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(unit[i]), i)):
        fits = [s for s in range(shards) if left[s][0] - unit[i][0] >= math.sqrt(weights[0]) - (1 + slack) * math.sqrt(weights[0])]
        match = lambda s, i=i: sum(a * b for a, b in zip(left[s], unit[i], strict=True)) if fits else left[s][0]  # noqa: B023, E731
        best = max(map(match, fits or range(shards)))
        want[i] = s = next(s for s in fits or range(shards) if match(s) >= best - 1e-12)
        left[s] = [a - b for a, b in zip(left[s], unit[i], strict=True)]
    got = sharding.pack(items, shards, weights, slack)
    assert got.tolist() == want


# language and toxicity


def test_language_learns(spark, odd, none):
    rng = random.Random(12)
    stems = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "eit", "lich"], "cc": ["zo", "wy", "prz", "cze"]}
    make = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    train = [(i, make(k, rng.randrange(3, 60)), k, None, None) for i, k in enumerate(rng.choice(list(stems)) for _ in range(400))]
    model = language.fit(spark.createDataFrame(train, DOCS))
    held = [(i, make(k, 12), k, None, None) for i, k in enumerate(rng.choice(list(stems)) for _ in range(200))]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(held, DOCS), model).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 198 and all(0 <= r.score <= 1 for r in got.values())
    others = language.identify(odd, model).collect()
    assert len(others) == len(awkward()) and {r.lang_pred for r in others if r.doc_id in (1, 2, 3)} == {"und"} and all(r.lang_pred in (*stems, "und") for r in others)
    blank = language.identify(spark.createDataFrame(rows_of(["1 2 ...", "٣", "é"]), DOCS), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in blank] == [True, True, False]
    assert language.identify(none, language.fit(none)).count() == 0 and language.identify(odd, language.fit(none)).first().lang_pred == "und"


@pytest.mark.parametrize("sample,together,languages,want", [(1000, 10**6, 500, 1000), (1001, 10**6, 500, 1001), (50, 10**6, 500, 50), (1001, 3000, 500, 750), (1001, 10**6, 2, 1001)])
def test_language_sample(spark, monkeypatch, sample, together, languages, want):
    """Exactly so many rows of each language, whatever the bound is; small ones are whole."""
    rows = [(i, f"text {i}", lang, None, None) for lang, n in (("a", 4000), ("b", 2500), ("c", 1500), ("d", 20)) for i in range(n)]
    rows += [(7, "text 7", "a", None, None)] * 2000  # copies of a row count once
    seen = []
    monkeypatch.setattr(language, "train", lambda counts, langs: seen.append(Counter(langs)))
    language.fit(spark.createDataFrame(rows, DOCS).repartition(5), sample, together, languages)
    assert seen == [{x: min(n, want) for x, n in list({"a": 4000, "b": 2500, "c": 1500, "d": 20}.items())[:languages]}]


def test_three_hundred_languages(spark, monkeypatch):
    rows = [(i, f"w{i % 300} x{i}", f"l{i % 300}", None, None) for i in range(3000)]
    seen = []
    monkeypatch.setattr(language, "train", lambda counts, langs: seen.append(Counter(langs)))
    language.fit(spark.createDataFrame(rows, DOCS), together=900)
    assert seen == [{f"l{i}": 3 for i in range(300)}]


def test_maximal_segments_against_a_recursion():
    rng = np.random.default_rng(13)

    def slow(x, base=0):
        """The best contiguous run, then the same left and right of it."""
        sums = np.concatenate([[0], np.cumsum(x)])
        best = max(((sums[b] - sums[a], -(b - a), -a, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        a, b = best[3], best[4]
        return [*slow(x[:a], base), (base + a, base + b, best[0]), *slow(x[b:], base + b)]

    for _ in range(60):
        x = np.where(rng.random(25) < 0.4, rng.random(25) * 2, -0.25 - rng.random(1) * 0.5)
        drift = float(x[x < 0][0]) if (x < 0).any() else -0.3
        at = np.flatnonzero(x > 0)
        got = toxicity.maximal_segments(at, x[at] - drift, drift)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow(x)] and [s for *_, s in got] == pytest.approx([s for *_, s in slow(x)])


def brute_features(text):
    """Bucket counts of a text, one word and one n-gram at a time."""
    flat = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text)
    out = Counter()
    mask = (1 << 64) - 1

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & mask
        return x ^ x >> 33

    for w in flat.encode().split(b" "):
        if w:
            out[xxhash.xxh64_intdigest(w, 42) % language.BUCKETS] += 1
            padded = b" " + w + b" "
            for n in (2, 3, 4):
                for i in range(len(padded) - n + 1):
                    code = 0
                    for x in padded[i : i + n]:
                        code = code * 257 + x
                    if padded[i] != 32 or padded[i + n - 1] != 32:
                        out[mix(code + (n << 48) & mask) % language.BUCKETS] += 1
    return out


def test_language_features_against_loops(monkeypatch):
    rng = random.Random(18)
    texts = ["", "a", "Ab  cd\te\n", "über Straße 日本 x", text_of(rng, 300), text_of(rng, 5)]
    for at_once in (1 << 18, 200):
        monkeypatch.setattr(language, "AT_ONCE", at_once)
        got = [Counter() for _ in texts]
        for owner, bucket in language.features([t.encode() for t in texts]):
            for i, b in zip(owner.tolist(), bucket.tolist(), strict=True):
                got[i][b] += 1
        assert got == [brute_features(t) for t in texts]


def test_language_training_against_loops():
    """Every step of SGD again, one text, feature and class at a time."""
    rng = random.Random(19)
    texts = [(rng.choice("ab") * 3 + f" {rng.choice('xyz')}{i % 3}") for i in range(20)]
    langs = ["l" + t[0] for t in texts]
    feats = [brute_features(t) for t in texts]
    counts = [(np.array(sorted(f)), np.array([f[b] for b in sorted(f)])) for f in feats]
    model = language.train(counts, langs, steps=10, batch=8)
    gen = np.random.default_rng(1)
    emb = gen.uniform(-1 / language.WIDTH, 1 / language.WIDTH, (language.BUCKETS, language.WIDTH)).tolist()
    names, width = sorted(set(langs)), language.WIDTH
    layer, bias = [[0.0] * len(names) for _ in range(width)], [0.0] * len(names)
    fit, step = np.array([i for i in range(20) if i % 5 != 4]), 0
    epochs = max(4, -(-10 * 8 // len(fit)))
    for _ in range(epochs):
        gen.shuffle(fit)
        for at in range(0, len(fit), 8):
            rows, now = fit[at : at + 8], 2.0 * (1 - step / (epochs * 2))
            d_emb, d_layer, d_bias = {}, [[0.0] * len(names) for _ in range(width)], [0.0] * len(names)
            for i in rows:
                total = sum(feats[i].values())
                mean = [sum(n * emb[b][w] for b, n in feats[i].items()) / total for w in range(width)]
                logit = [sum(mean[w] * layer[w][k] for w in range(width)) + bias[k] for k in range(len(names))]
                p = [math.exp(v) for v in logit]
                error = [v / sum(p) - (names[k] == langs[i]) for k, v in enumerate(p)]
                for k, e in enumerate(error):
                    d_bias[k] += e / len(rows)
                    for w in range(width):
                        d_layer[w][k] += mean[w] * e / len(rows)
                        for b, n in feats[i].items():
                            d_emb[b, w] = d_emb.get((b, w), 0.0) + n / total * e * layer[w][k]
            for (b, w), v in d_emb.items():
                emb[b][w] -= now * v
            for k in range(len(names)):
                bias[k] -= now * d_bias[k]
                for w in range(width):
                    layer[w][k] -= now * d_layer[w][k]
            step += 1
    for f, t in zip(feats, texts, strict=True):
        total = sum(f.values())
        want = [sum(n * emb[b][w] for b, n in f.items()) / total for w in range(width)]
        logit = [sum(want[w] * layer[w][k] for w in range(width)) + bias[k] for k in range(len(names))]
        assert model.logits([t.encode()])[0] == pytest.approx(logit, abs=1e-5)


def test_toxic_words_against_loops(spark):
    """Counts without each fold, log-odds and z, one word at a time."""
    rng = random.Random(20)
    texts = [(text_of(rng, 30) + (" Rude rudely, rudeness! vile" * (i % 3 == 0)), int(i % 3 == 0), i % 5) for i in range(400)] + [("copied copied vile rude", 1, 2)] * 3
    df = spark.createDataFrame([(t, y, f) for t, y, f in texts], "text string, toxic long, fold long").repartition(3)
    got = {r.token & (1 << 64) - 1: r for r in toxicity.word_counts(df).collect()}
    seen = {}
    for t, y, f in texts:
        before = 0
        for w in "".join(c if c.isalnum() else " " for c in t.lower()).split():
            h = toxicity.token_hash(w)
            for token in [h] + [toxicity.token_hash(w, n) for n in toxicity.STEMS if len(w) > n]:
                seen.setdefault((token, before, y), set()).add(f)
            before = h
    want = {}
    for (token, _, y), folds in seen.items():
        for i in range(toxicity.FOLDS + 1):
            if folds - {i}:
                want[token, y, i] = want.get((token, y, i), 0) + 1
    assert set(got) == {t for t, _, _ in want}
    for token, r in got.items():
        for i in range(toxicity.FOLDS + 1):
            assert (r[f"toxic_{i}"], r[f"clean_{i}"]) == (want.get((token, 1, i), 0), want.get((token, 0, i), 0))
    scores = toxicity.lists(toxicity.word_counts(df))
    for i in range(toxicity.FOLDS + 1):
        all_toxic, all_clean = (sum(n for (_, y, k), n in want.items() if k == i and y == label) for label in (1, 0))
        slow = {}
        for token in got:
            a, b = want.get((token, 1, i), 0), want.get((token, 0, i), 0)
            prior = 0.5 + (a + b) / (all_toxic + all_clean)
            delta = math.log((a + prior) / (all_toxic + 1 - a)) - math.log((b + prior) / (all_clean + 1 - b))
            if a >= toxicity.LEAST_USES and delta / math.sqrt(1 / (a + prior) + 1 / (b + prior)) >= toxicity.LEAST_Z and delta >= toxicity.LEAST_DELTA:
                slow[token] = delta
        assert scores[i] == pytest.approx(slow) and slow


def test_extreme_values_against_a_search():
    """lambda and K of simulated best scores, and against every point of a fine grid."""
    rng = np.random.default_rng(21)
    n = rng.integers(50, 2000, 4000).astype(float)
    best = np.maximum(0.0, np.log(0.02 * n / -np.log(rng.random(4000))) / 0.7)
    rate, k = toxicity.extreme_values(n, best)
    assert abs(rate - 0.7) < 0.05 and abs(np.log(k / 0.02)) < 0.25

    def loss(rate, k):
        own = [math.log(rate) + math.log(k * m) - rate * s - k * m * math.exp(-rate * s) if s > 0 else -k * m for m, s in zip(n, best, strict=True)]
        return -sum(own)

    least = loss(rate, k)
    assert all(least <= loss(rate * a, k * b) + 0.5 for a in (0.9, 0.97, 1, 1.03, 1.1) for b in (0.9, 0.97, 1, 1.03, 1.1))


def test_curve_against_a_search():
    rng = np.random.default_rng(22)
    x = rng.random(300) * 4
    y = (x + rng.normal(0, 1, 300) > 2.5).astype(float)
    w = np.where(y > 0, 150 / y.sum(), 150 / (1 - y).sum())
    a, b = toxicity.logistic(x, y, w)

    def loss(a, b):
        return sum(v * math.log1p(math.exp(-(a * s + b) if t else a * s + b)) for s, t, v in zip(x, y, w, strict=True)) + a * a / 4

    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def test_very_long_texts_are_scanned_in_linear_time():
    at = np.arange(0, 640_000, 40)
    began = time.perf_counter()
    assert len(toxicity.maximal_segments(at, np.full(len(at), 3.0), -0.25)) == len(at)
    assert time.perf_counter() - began < 1
    rng = random.Random(23)
    words = [f"word{i}" for i in range(300)]
    model = toxicity.Model({toxicity.token_hash("vile"): 4.0}, (5,), 1.0, 0.1, 1.0, -3.0)
    text = " ".join("vile" if i % 40 == 0 else rng.choice(words) for i in range(1_500_000)).encode()
    began = time.perf_counter()
    found, n = model.segments(text)
    assert len(text) > 10_000_000 and n == 1_500_000 and len(found) == 37_500 and time.perf_counter() - began < 10


def test_toxicity_learns(spark, odd, none):
    rng = random.Random(14)
    rude = [f"rude{i}" for i in range(12)]

    def make(toxic):
        words = text_of(rng, rng.randrange(20, 200)).split()
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(rude + WORDS[:3]) for _ in range(12)]
        return " ".join(words)

    rows = [(i, make(i % 4 == 0), None, None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, None, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [got[i].predicted == int(i % 4 == 0) for i in range(600, 900)]
    assert sum(right) >= 295 and all(0 <= r.score <= 1 for r in got.values())
    hit = max(got.values(), key=lambda r: r.best_segment)
    assert any(w in rude for w in rows[hit.doc_id][1].split()[hit.segments[0].first : hit.segments[0].after])
    assert toxicity.score(odd, model).count() == len(awkward()) and toxicity.score(odd, model).filter("doc_id in (1, 2, 3) AND predicted = 1").count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
