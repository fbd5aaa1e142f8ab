"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

from . import ann, bpe, langid, minhash, mixing, quality, rules, substring, tokenfile, url_sql, urls
from .storage import read

URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = tokenfile.write(read(ship(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.crc32(tokenfile.read(spark, at))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(ship(spark), sf_dir, "documents"), minhash.Params(shingle=2))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(read(ship(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digest(coded)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(ship(spark), sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "text_score", "meta_score", "score", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(ship(spark), sf_dir, "documents")
    apart = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(5)) == 0
    out = langid.predict(docs, langid.train(docs, ~apart))
    return out.select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(ship(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.strip_repeats(read(ship(spark), sf_dir, "documents"), give="digest")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_token_files, op3_minhash_dedup, op4_url_filters, op5_bpe_round_trip, op6_quality_classifier, op7_language_id, op8_nearest_neighbours, op9_source_mixing, op10_substring_dedup)
    return {f.__name__: f for f in own}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
n AS (SELECT row_number() OVER () AS r, * FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM n WHERE len(w) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY r),
m AS (
  SELECT n.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains({rules.STOP_WORDS!r}, lower(x)))) AS n_stop_words
  FROM n LEFT JOIN p USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars BETWEEN 2.0::DOUBLE * n_words AND 12.0::DOUBLE * n_words AND n_symbols <= 0.1::DOUBLE * n_words
         AND n_stop_words >= 0.03::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * n_lines AS kept
FROM m"""

_OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(a, b) AS g FROM (
    SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n y ON x.a = y.doc_id JOIN n z ON x.b = z.doc_id WHERE 100 * c >= 80 * (y.n + z.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|0') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2 AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight FROM s),
b AS (
  SELECT *, sum(source_size) OVER () * 150 / 100 AS budget, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER o, 0) AS done, coalesce(sum(weight) OVER o, 0) AS spent
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (budget - done)::DOUBLE / (weights - spent)::DOUBLE AS level FROM b),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, spent) FROM v WHERE level <= cap::DOUBLE / weight)) AS target FROM v),
c AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, (upto + (copy - 1) * source_size)::DOUBLE / target AS finish FROM c, (SELECT unnest([1, 2]) AS copy) WHERE target > 0 AND size > 0),
a AS (SELECT r, size, sum(size) OVER (ORDER BY finish, key, doc_id, copy, size, r ROWS UNBOUNDED PRECEDING) AS total FROM f),
k AS (SELECT r, sum(size)::BIGINT AS taken FROM a WHERE total <= (SELECT sum(target) FROM t) + 1e-6 GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (r)"""

_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS low FROM g) WHERE doc_id > low),
x AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM m),
y AS (SELECT r, list(j) AS gone FROM x GROUP BY r),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d JOIN y USING (r)),
z AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.j) AS kept FROM u ANTI JOIN x ON u.r = x.r AND u.j = x.j GROUP BY u.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN y USING (r) LEFT JOIN z USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op3_minhash_dedup": _OP3, "op4_url_filters": url_sql.sql(URL_RULES), "op9_source_mixing": _OP9, "op10_substring_dedup": _OP10}
