"""The registered queries of the thirteen operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import ann, decontaminate, divergence, fingerprint, html, langid, linedup, mixing, packing, resample, sharding, simhash, toxicity
from catalens.llm.common import table, tokenizer


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents")).drop("_file", "_row")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.without_duplicates(table(spark, sf_dir, "documents"), equal=1)
    return found.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), "text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, within=4)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_fingerprint": op5_fingerprint,
    "op6_ann": op6_ann,
    "op7_line_dedup": op7_line_dedup,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_decontaminate": op12_decontaminate,
    "op13_resample": op13_resample,
}

# Repeats of lines that are not blank, and lines of 20 or more characters one edit apart: equal but for one character put in, left out or changed.
OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)
), firsts AS (
  SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM lines WHERE length(line) >= 20 OR regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY line
), near AS (
  SELECT DISTINCT b.line
  FROM firsts a JOIN firsts b ON a.first < b.first AND abs(a.n - b.n) <= 1 AND a.n >= 20 AND b.n >= 20
  WHERE levenshtein(a.line, b.line) <= 4 AND (
    (a.n = b.n AND len(list_filter(range(1, a.n + 1), lambda i: substring(a.line, i, 1) <> substring(b.line, i, 1))) = 1)
    OR (a.n + 1 = b.n AND len(list_filter(range(1, b.n + 1), lambda i: substring(b.line, 1, i - 1) || substring(b.line, i + 1) = a.line)) > 0)
    OR (b.n + 1 = a.n AND len(list_filter(range(1, a.n + 1), lambda i: substring(a.line, 1, i - 1) || substring(a.line, i + 1) = b.line)) > 0))
), judged AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND ((l.doc_id, l.pos) <> f.first OR n.line IS NOT NULL) AS dropped
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
), docs AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_dropped, 0) AS n_dropped, length(x.text) AS n_chars, x.text
FROM documents d LEFT JOIN docs x USING (doc_id)
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT coalesce(doc_id, -1) AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS r
  FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), each AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT lang, source, r, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS n FROM each GROUP BY ALL HAVING sum(docs) >= 3
), langs AS (
  SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS all_n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang
), own AS (
  SELECT g.lang, g.source, k.term, coalesce(e.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k USING (lang) LEFT JOIN each e USING (lang, source, term)
), sums AS (
  SELECT lang, source, sum(n) AS group_n FROM own GROUP BY ALL
), shares AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000::HUGEINT * (n + 1) // (group_n + v) AS BIGINT) AS p, 1 + CAST(1000000000::HUGEINT * (lang_n + 1) // (all_n + v) AS BIGINT) AS q
  FROM own JOIN sums USING (lang, source) JOIN langs USING (lang)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // t.p) AS value FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 200
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), occurs AS (
  SELECT DISTINCT d.r, d.s, d.n, v.item
  FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) k WHERE len(w) >= n)) d JOIN windows v ON v.win = d.win AND v.n = d.n
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM occurs) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occurs) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""

# CRC-32 by its polynomial: a table of 256 entries, then a fold over the bytes of each distinct feature.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i)) AS t
), words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', -row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT side, r, feature, count(*) AS n FROM (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words) GROUP BY ALL
), dictionary AS (
  SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM features), crc
), sums AS (
  SELECT side, bucket, sum(n) AS n FROM features JOIN dictionary USING (feature) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (WHERE side = 'd'), 0) + 10000 AS s_all, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) + 10000 AS t_all FROM sums
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * s_all::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b CROSS JOIN totals LEFT JOIN (FROM sums WHERE side = 'd') s USING (bucket) LEFT JOIN (FROM sums WHERE side = 'b') t USING (bucket)
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM features JOIN dictionary USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (r) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""

ORACLES: dict[str, str] = {
    "op7_line_dedup": OP7_SQL,
    "op11_divergence": OP11_SQL,
    "op12_decontaminate": OP12_SQL,
    "op13_resample": OP13_SQL,
}
