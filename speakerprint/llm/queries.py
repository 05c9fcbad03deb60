"""Named queries of this subpackage over the test tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.llm import backoff, bpe, leaks, licenses, near_dups, quality_lm, repair, repeats, rules, site_tree, substrings, surrogates, whitening
from speakerprint.plans.catalog import table
from speakerprint.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).drop("class_key")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_tree.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, count="n_entities")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("base", "runs")


def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.apply_policies(rules.ledger(table(spark, sf_dir, "documents")))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return led.select("doc_id", *measures, (~F.col("kept_base")).alias("base_failed"), F.col("kept_v2").alias("kept"), "bits")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.length("without_shared")).cast("bigint")
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("shared").cast("bigint").alias("n_spans"), F.sha2("without_shared", 256).alias("kept_sha256")
    )


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: Rules of op7 in DuckDB's dialect: the conditions of ``rules.RULES`` over the same measurements.
OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), g AS (
  SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i:i+4]) AS c FROM g
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM h WHERE c > 1) GROUP BY r
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words || [''], 'string_agg', ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM w LEFT JOIN covered ON w.r = covered.r
), b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * word_chars)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
    + 32 * (100 * n_capitals > 50 * word_chars)::BIGINT AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits FROM b
"""

#: Damage, faults and cheapest edits of op12: a dynamic program over (cost, edits), one row of a conversation at a time.
#: ``step`` has the edits of a row by state (0 nothing yet, 1 after s, 2 after u, 3 after a), ``more`` what may be inserted after it.
OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))) AS crc FROM conversations
), drawn AS (
  SELECT *, xor(crc, 4294967295) % 20 AS draw FROM bits
), damaged AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM placed
), rows_ AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS k, i, role, text, turn, CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated'
    ELSE '' END AS fault, i > 1 AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal FROM seen
), step(q, edit, initial, q1, cost, gives) AS (
  VALUES (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL),
    (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (3, 'R', NULL, 2, 3, 'user'),
    (2, 'R', NULL, 3, 3, 'assistant')
), more(q1, q2, edits, cost, lines) AS (
  VALUES (0, 0, '', 0, NULL), (1, 1, '', 0, NULL), (2, 2, '', 0, NULL), (3, 3, '', 0, NULL), (0, 2, 'I', 3, 'user:'), (1, 2, 'I', 3, 'user:'), (3, 2, 'I', 3, 'user:'),
    (2, 3, 'I', 3, 'assistant:'), (0, 3, 'II', 6, 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, 'user:' || chr(10) || 'assistant:')
), best AS (
  SELECT k, 0::BIGINT AS i, q2 AS q, cost::BIGINT AS cost, edits AS audit, lines AS out FROM (SELECT DISTINCT k FROM rows_), more WHERE q1 = 0
  UNION ALL
  SELECT k, i, q, cost, audit, out FROM (
    SELECT r.k, r.i, m.q2 AS q, b.cost + s.cost + m.cost + CASE WHEN r.fault = 'truncated' AND s.edit <> 'D' THEN 3 ELSE 0 END AS cost, b.audit || s.edit || m.edits AS audit,
      nullif(concat_ws(chr(10), b.out, CASE s.edit WHEN 'K' THEN r.role || ':' || r.text WHEN 'R' THEN s.gives || ':' || r.text END, m.lines), '') AS out,
      row_number() OVER (PARTITION BY r.k, m.q2 ORDER BY b.cost + s.cost + m.cost + CASE WHEN r.fault = 'truncated' AND s.edit <> 'D' THEN 3 ELSE 0 END, b.audit || s.edit || m.edits) AS nth
    FROM best b JOIN rows_ r ON r.k = b.k AND r.i = b.i + 1 JOIN step s ON s.q = b.q AND (s.initial IS NULL OR s.initial = r.role[1:1])
      AND (s.edit = 'D' OR r.fault IN ('', 'truncated')) JOIN more m ON m.q1 = s.q1) WHERE nth = 1
), counts AS (
  SELECT k, max(i) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (illegal) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM rows_ GROUP BY k
), ends AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.k ORDER BY cost, audit) AS nth FROM best b JOIN counts c ON c.k = b.k AND c.n = b.i WHERE q IN (0, 3)
)
SELECT v.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(e.out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counts c ON c.k = coalesce(v.conv_id::VARCHAR, '') LEFT JOIN ends e ON e.k = c.k AND e.nth = 1
"""

#: Words of op13 in windows of 35, as rows.
OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d
), g AS (
  SELECT r, p, n, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS s FROM w
), twice AS (
  SELECT s FROM g WHERE p <= n - 34 GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM g WHERE p <= n - 34 AND s IN (SELECT s FROM twice)
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM w ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_near_duplicates, op3_main_text, op4_surrogates, op5_licenses, op6_backoff_scores, op7_quality_rules, op8_bpe, op9_repeats,
        op10_leaks, op11_whitening, op12_repair, op13_substrings,
    )
}
_SQL = {"op7_quality_rules": OP7_SQL, "op12_repair": OP12_SQL, "op13_substrings": OP13_SQL}


def _shipped(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


def llm_queries() -> dict[str, Query]:
    return {name: _shipped(fn) for name, fn in _QUERIES.items()}


def llm_sql() -> dict[str, str]:
    return dict(_SQL)
