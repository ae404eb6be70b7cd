"""The driver queries of this subpackage, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam, filter_audit, fingerprint, hardneg, langid, linededup, ngram_join, packing, pii, quality, repetition, sharding,
    toxicity,
)
from .common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(
        documents(spark, sf_dir), words=3, num=90, den=100
    ).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicate_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256")
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.assess(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", *repetition.COUNTS, *repetition.VERDICTS
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_language": op2_language,
    "op3_decontaminate": op3_decontaminate,
    "op4_fingerprints": op4_fingerprints,
    "op5_ngram_join": op5_ngram_join,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {
    "op5_ngram_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN link l ON l.x = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op10_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, line, i,
         translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (SELECT k, max(doc_id) AS keep_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT d.*, h.k IS NOT NULL AND d.doc_id <> h.keep_doc AS gone FROM keyed d LEFT JOIN hot h ON d.k = h.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_quality_rules": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d),
w3 AS (SELECT doc_id, i, CASE WHEN i + 3 <= len(ws) THEN array_to_string(ws[i + 1:i + 3], ' ') END AS g3,
              CASE WHEN i + 8 <= len(ws) THEN array_to_string(ws[i + 1:i + 8], ' ') END AS g8,
              CASE WHEN i + 101 <= len(ws) THEN hash(array_to_string(ws[i + 1:i + 101], ' ')) END AS g101 FROM pos),
c AS (SELECT doc_id, i, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3,
             g8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g8) > 1 AS r8,
             g101 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g101) > 1 AS r101 FROM w3),
m AS (SELECT doc_id, max(CASE WHEN r3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS in3,
             max(CASE WHEN r8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS in8,
             r101 FROM c),
rep AS (SELECT doc_id, sum(in3) AS n3, sum(in8) AS n8, bool_or(r101) AS long_one FROM m GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(k - 1) AS n FROM (
  SELECT doc_id, line, count(*) AS k FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n3, 0) AS BIGINT) AS n_repeat_words,
             coalesce(rep.n8, 0) AS n8, coalesce(rep.long_one, false) AS long_one
      FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n8 <= 30 * n_words AND NOT long_one AS kept
FROM b""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same)
  WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_filter_audit": """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
low AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
         (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) ||
         (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END) ||
         (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) THEN 'C' ELSE '' END) ||
         (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END) ||
         (CASE WHEN d.doc_id > low.least THEN 'E' ELSE '' END) AS fails
  FROM d JOIN low ON low.t = d.t LEFT JOIN lab ON lab.doc_id = d.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM l a, l b, l c, l e, l g
  WHERE a.x NOT IN (b.x, c.x, e.x, g.x) AND b.x NOT IN (c.x, e.x, g.x) AND c.x NOT IN (e.x, g.x) AND e.x <> g.x),
st AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS x, substr(filter_order, 1, k - 1) AS before
  FROM o, range(1, 6) r(k)),
cell AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
u AS (
  SELECT c.*, st.*, contains(fails, x) AS now, fails <> translate(fails, before, '') AS gone FROM cell c, st),
g AS (
  SELECT part, filter_order, step, x,
         CAST(coalesce(sum(n) FILTER (NOT now AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (now AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (now AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (now AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (now AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM u GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g""",
}
