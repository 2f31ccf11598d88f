"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, divergence, katz, licenses, lines, ngram_join, quality, sharding, suffix_dedup, urls, whitening, winnow
from sluice.llm.common import table


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.report(table(spark, folder, "documents"))


def op2_katz(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(table(spark, folder, "documents"))


def op3_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.against_edits(table(spark, folder, "documents"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.judge(pages, urls.page_outcomes(pages, table(spark, folder, "labels")))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(table(spark, folder, "documents"), vocabulary_file())


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.report(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.cut(table(spark, folder, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_katz": op2_katz,
    "op3_winnowing": op3_winnowing,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_divergence": op13_divergence,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
PLAIN = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_ngram_join": f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{PLAIN}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM doc, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN comp USING (doc_id)""",
    "op4_decontaminate": f"""
WITH item AS (SELECT item_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM benchmark),
doc AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM documents),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
gram AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM doc, (SELECT DISTINCT m FROM win) AS s, unnest(range(1, len(w) - m + 2)) AS t(i)),
met AS (SELECT doc_id, i, m, item_id FROM gram JOIN win USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + m)) AS t(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op13_divergence": f"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '{TERM}') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 30),
grp AS (SELECT DISTINCT lang, source FROM doc),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
cnt AS (SELECT g.lang, g.source, k.term, count(t.term)::HUGEINT AS n
        FROM grp g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term FROM tok) t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cnt GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (t.total + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
      FROM cnt c JOIN tot t USING (lang, source) JOIN v USING (lang) JOIN kept k USING (lang, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pair UNION ALL FROM term))
WHERE part = 'pair' OR rank <= 50""",
}
