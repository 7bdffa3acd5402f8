"""The queries opN_<name> of this subpackage and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import bpe, language, line_dedup, mixing, near_dedup, quality, sharding, spelling, substring_dedup, token_counts, topk, toxicity, vector_codes
from cartolith.llm.common import joined_by_weight, table, written

#: Production parameters of op1: seed, exponent of the target weights, tokens out against tokens in.
MIX = {"seed": 7, "smoothing": 0.7, "budget": 1.0}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy, n_copies, rate (8 decimals) of every copy in the mixture."""
    out = mixing.mix(table(spark, sf_dir, "documents"), **MIX)
    return out.select("doc_id", "source", "copy", "n_copies", F.round("rate", 8).alias("rate"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP1_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT source, sum(octet_length(encode(t)) // 4 + 1) AS tokens FROM d GROUP BY source),
r AS (SELECT source, pow(tokens::DOUBLE, 0.7) / (SELECT sum(pow(tokens::DOUBLE, 0.7)) FROM s) * (SELECT sum(tokens)::DOUBLE FROM s) / tokens AS rate FROM s),
e AS (SELECT source, rate, greatest(1, ceil(rate / 500))::BIGINT AS draws FROM r),
u AS (SELECT doc_id, source, rate, draws, md5(t) AS text_md5, unnest(range(1, draws + 1)) AS i, coalesce(doc_id::VARCHAR, '') || ':' || md5(t) AS id
      FROM (SELECT d.doc_id, d.source, d.t, row_number() OVER () AS row, rate, draws FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)),
h AS (SELECT *, ('0x' || substr(md5('7:' || id || CASE WHEN draws > 1 THEN ':' || i ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM u),
c AS (SELECT source, k, sum(exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cum
      FROM e, unnest(range(0, (rate / draws + 9 * sqrt(rate / draws) + 30)::BIGINT)) x(k)),
n AS (SELECT doc_id, source, rate, text_md5, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM h.source AND c.cum <= h.u) AS n, draws, i FROM h),
t AS (SELECT doc_id, source, rate, text_md5, n_copies FROM (
        SELECT doc_id, source, rate, text_md5, sum(n) OVER (PARTITION BY doc_id, text_md5, source, part) AS n_copies, i
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text_md5, source, i) AS part FROM n)) WHERE i = 1)
SELECT doc_id, source, unnest(range(0, n_copies::BIGINT))::INT AS copy, n_copies::INT AS n_copies, round(rate, 8) AS rate, text_md5 FROM t
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat token files that are written from documents first."""
    folder = token_counts.new_folder(spark)
    order = written(token_counts.write_flat(table(spark, sf_dir, "documents"), folder), "token-order")
    return token_counts.token_counts(order, folder)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


OP6_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _crc(name: str) -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(_crc("doc_id") % 3 != 1))
    return language.identify(docs, model).select("doc_id", (_crc("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(_crc("doc_id") % 5 != 0))
    return toxicity.score(docs, model).select("doc_id", (_crc("doc_id") % 5 == 0).alias("held_out"), "score", "predicted", "n_segments", "best_segment")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, the bare rules' verdict and the trees' verdict on every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(spelling.vocabulary(table(spark, sf_dir, "documents"), damage=97), "vocabulary")
    return spelling.variants(words)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every usable vector, with the error of its label and the digest of the codebooks."""
    rows = vector_codes.integer_vectors(table(spark, sf_dir, "embeddings"))
    books = vector_codes.fit(rows)
    numbers = ",".join(str(x) for b in books for x in b.entries.ravel().tolist())
    same = F.to_json(F.struct("label")).alias("same")  # nulls meet
    coded = written(vector_codes.encode(rows, books).select("*", same), "vector-codes")
    by_label = written(coded.groupBy("same").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows")), "label-errors")
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    out = joined_by_weight(coded, by_label, ["same"], "n_rows")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.sha2(F.lit(numbers), 256).alias("codebooks_sha256"))


def _op12_sql() -> str:
    def assigned(book: str) -> str:
        gap = "list_sum(list_transform(range(1, len(q) + 1), lambda j: (q[j] - e[j]) * (q[j] - e[j])))::BIGINT"
        return f"(SELECT r, part, q, min([d, entry]) AS best FROM (SELECT r, part, q, entry, coalesce({gap}, 0) AS d FROM p JOIN {book} USING (part)) GROUP BY ALL)"

    def moved(book: str) -> str:
        mean = f"SELECT part, entry, list(floor(s::DOUBLE / n)::BIGINT ORDER BY j) AS e FROM (SELECT part, best[2] AS entry, j, sum(q[j]) AS s, count(*) AS n FROM {assigned(book)}, range(1, (SELECT max(len(q)) FROM p) + 1) x(j) GROUP BY ALL) GROUP BY ALL"
        return f"(SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN ({mean}) m USING (part, entry))"

    return f"""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(greatest(floor(256 * x::DOUBLE), -67108864), 67108864)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS (SELECT ceil(max(len(w)) / 16)::BIGINT AS d FROM u),
v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS r, vec_id, label, list_resize(w, d * 16, 0) AS w, d FROM u, z),
p AS MATERIALIZED (SELECT r, part, w[part * d + 1 : part * d + d] AS q FROM v, range(16) x(part)),
b0 AS (SELECT part, r - 1 AS entry, q AS e FROM p WHERE r <= 64), b1 AS MATERIALIZED {moved("b0")}, b2 AS MATERIALIZED {moved("b1")},
c AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM {assigned("b2")} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
b AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5),
g AS (SELECT k.*, b.key IS NOT NULL AND k.doc_id IS DISTINCT FROM b.keeper AS gone FROM k LEFT JOIN b ON k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op6_exact_topk": OP6_SQL, "op12_vector_codes": _op12_sql(), "op13_line_dedup": OP13_SQL}
