"""Line dedup, spelling variants and vector codes against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import line_dedup, queries, spelling, vector_codes
from cartolith.llm.common import joined_by_weight

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], DOCS)


# line dedup


def lines_by_loop(pairs, least_chars, least_docs):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(UPPER)
    having = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                having[key(line)].add(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in having.items() if len(v) >= least_docs}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_pairs():
    rng = random.Random(5)
    shared = [f"{'x' * rng.randrange(30, 45)} shared line {i} é " for i in range(12)]
    decorate = lambda x: rng.choice(["", " ", "\t\r", "\x0b"]) + rng.choice([x, x.upper() if x.isascii() else x.translate(str.maketrans("xs", "XS"))]) + rng.choice(["", "\f", "  "])
    pairs = []
    for i in range(60):
        lines = [decorate(rng.choice(shared)) if rng.random() < 0.5 else rng.choice(["", "short", f"a line of its own that is long enough to count {rng.random()}"]) for _ in range(rng.randrange(6))]
        pairs.append((rng.choice([None, i, i, i, 7]), "\n".join(lines)))
    pairs += [(3, None), (None, None), (70, ""), (71, "\n"), (72, "\n".join([shared[0]] * 5000)), (73, shared[0]), (73, shared[0]), (None, shared[1]), (None, shared[1])]
    return pairs + [(100 + i, "É" * 39 + "\n" + "É" * 40 + "\n" + "é" * 40) for i in range(5)]


@pytest.mark.parametrize("least", [(40, 5), (40, 1), (1, 2)])
def test_lines_against_a_loop(spark, least):
    pairs = line_pairs()
    got = line_dedup.drop_lines(docs_of(spark, pairs), *least).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Counter(lines_by_loop(pairs, *least))
    assert {(r.doc_id, r.text) for r in got} == set(pairs)


def test_lines_against_sql(spark, tmp_path):
    docs_of(spark, line_pairs()).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(tuple(r) for r in got) == Counter(con.sql(queries.OP13_SQL).fetchall())
    assert sum(r.n_dropped for r in got) > 50


def test_a_line_of_every_document(spark):
    line = "this very line stands in each of the documents of the table"
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\nrow "), "id").alias("text"))
    got = line_dedup.drop_lines(docs)
    assert [r.doc_id for r in got.filter("n_dropped = 0").collect()] == [3999] and got.filter("kept LIKE 'row%'").count() == 3999


def test_lines_of_awkward_tables(spark):
    empty = line_dedup.drop_lines(docs_of(spark, []))
    assert empty.count() == 0 and empty.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_dropped", "kept"]
    clash = spark.createDataFrame([(1, "a\nb", "x", 5, "y", 1.5)], "doc_id long, text string, kept string, n_lines int, k1 string, h1 double")
    assert line_dedup.drop_lines(clash).collect()[0].asDict() == {"doc_id": 1, "text": "a\nb", "k1": "y", "h1": 1.5, "n_lines": 2, "n_dropped": 0, "kept": "a\nb"}


def test_joined_by_weight(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 3000), (2, 5), (3, 1), (None, 4)) for i in range(n)], "k long, i long")
    right = spark.createDataFrame([(1, 3000, "a"), (2, 5, "b")] + [(k, 40_000, "c") for k in range(10, 2000)], "k long, n long, v string")
    out = joined_by_weight(left, right, ["k"], "n")
    assert Counter((r.k, r.v) for r in out.collect()) == {(1, "a"): 3000, (2, "b"): 5} and out.columns == ["k", "i", "v"]


# spelling variants


def one_edit(a, b):
    """By its definition: b is a with one code point put in, left out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_loop(counts):
    out = {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def test_vocabulary_against_a_loop(spark):
    rng = random.Random(8)
    letters = "abcXYZéÀÿ×÷ß"
    pairs = [(rng.choice([None, i]), " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(200)) + rng.choice(["", "don't x1y2ABCDE日本語abcde¿abcdeĀ"])) for i in range(40)]
    pairs += [(50, None), (51, ""), (52, "Éa" * 60_000), (53, "hello HELLO hellÓ hellÓ")]
    want = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            want[run] += 1
    got = spelling.vocabulary(docs_of(spark, pairs), damage=7, least_uses=1).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if len(w) >= 5} and len(got) == len({r.word for r in got})
    fewer = spelling.vocabulary(docs_of(spark, pairs), damage=7).collect()
    assert {r.word for r in fewer} == {w for w, n in want.items() if len(w) >= 5 and n >= 3}


def words_near_each_other(n, letters="abé", seed=2):
    rng, counts = random.Random(seed), {}
    while len(counts) < n:
        counts["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10)))] = rng.choice([1, 2, 3, 6, 6, 20, 100, 1000])
    return counts


@pytest.mark.parametrize("shard,crowd", [(20_000, 2_000), (50, 2_000), (50, 6), (50, 0)], ids=["one automaton", "shards", "some halves crowded", "all halves crowded"])
def test_variants_against_all_pairs(spark, shard, crowd):
    counts = words_near_each_other(700)
    counts |= {"x" * 5000: 4, "x" * 5001: 9, "x" * 4999 + "y": 4, "abbbcd": 5, "abbcd": 11, "zzzzz": 1}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), shard=shard, crowd=crowd).collect()
    assert len(got) == len(counts)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants_by_loop(counts)


def test_roots_of_long_chains(spark):
    chain = [f"w{i}" for i in range(63)]
    forms = spark.createDataFrame([*zip(chain, chain[1:], strict=False), ("lone", "end")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {w: "w62" for w in chain[:-1]} | {"lone": "end"}


def test_variants_of_nothing(spark):
    out = spelling.variants(spelling.vocabulary(docs_of(spark, [(1, None)]), damage=97))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_of_spelling_variants(spark, tmp_path):
    rng = random.Random(4)
    base = ["station", "stations", "gemeinde", "gemeinden", "résumé", "resume", "Wörter"]
    pairs = [(i, " ".join(rng.choice(base) for _ in range(400))) for i in range(100)]
    docs_of(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == variants_by_loop(counts) and sum(v[0] is not None for v in got.values()) > 5


# vector codes


def codes_by_loop(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, list of integers) in order; nearest entries by all distances."""
    d = len(rows[0][1]) // parts
    cut = [[w[p * d : p * d + d] for p in range(parts)] for _, w in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (gap(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = assign()
    return books, codes, [sum(gap(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i % 3) if i % 4 else None) for i, v in zip(rng.permutation(n), rng.normal(0, 0.1, (n, dim)), strict=True)]
    rows += [(5000, rows[0][1], 1), (5000, rows[1][1], 1), (None, rows[2][1], 2), (7, rows[3][1], None), (8, [0.5] * dim, 1)]
    return rows + [(9, None, 1), (10, [0.1, None] * (dim // 2), 1), (11, [float("nan")] * dim, 1), (12, [float("inf")] * dim, 1), (13, [float("-inf")] * dim, 1)]


def test_codes_against_all_distances(spark, tmp_path):
    table = vectors()
    kept = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in table if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books, codes, errors = codes_by_loop([r[:2] for r in kept])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    want = Counter((r[0], "".join(f"{c:02x}" for c in code), e, by_label[r[2]], digest) for r, code, e in zip(kept, codes, errors, strict=True))
    spark.createDataFrame(table, VECTORS).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(tuple(r) for r in got) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.sql(queries.ORACLES["op12_vector_codes"])
    assert Counter(found.select("vec_id, code, error, label_error, codebooks_sha256").fetchall()) == want


@pytest.mark.parametrize("width,low,high", [(4, -40, 40), (1, -3, 3), (2, -(2**26), 2**26)])
def test_bounds_hold_and_filter(width, low, high):
    rng = np.random.default_rng(3)
    entries, asked = rng.integers(low, high, (64, width)), rng.integers(low, high, (5000, width))
    book = vector_codes.Codebook.of(entries)
    exact = ((asked[:, None] - entries[None]) ** 2).sum(axis=2)
    lower, upper = book.bounds(asked)
    assert (lower <= exact).all() and (exact <= upper).all()
    refined = (lower <= upper.min(axis=1)[:, None]).mean()
    assert refined < 0.5
    code, error = book.nearest(asked)
    assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


def test_codes_of_awkward_tables(spark):
    def coded(rows, schema=VECTORS):
        ints = vector_codes.integer_vectors(spark.createDataFrame(rows, schema))
        return vector_codes.encode(ints, vector_codes.fit(ints)).collect()

    assert coded([]) == [] and coded([(1, None, 1)]) == []
    assert [(r.codes, r.error) for r in coded([(1, [], 1), (2, [], None)])] == [([], 0)] * 2
    one = coded([(1, [0.5] * 17, 1), (2, [0.25], 2)])  # unequal lengths are filled to 32
    assert sorted((r.vec_id, r.error) for r in one) == [(1, 0), (2, 0)]
    many = coded([(1, [0.5] * 16, 1)] * 200)  # equal entries: the first of them
    assert {tuple(r.codes) for r in many} == {(0,) * 16} and len(many) == 200
    huge = coded([(i, [s * 1e30] * 16, None) for i, s in enumerate((1, -1, 0))])
    assert [r.error for r in huge] == [0, 0, 0]
    clash = coded([(1, [0.5] * 16, 1, 2, "c", 3.0)], VECTORS + ", error int, codes string, w double")
    assert clash[0].asDict() == {"vec_id": 1, "label": 1, "codes": [0] * 16, "error": 0}
