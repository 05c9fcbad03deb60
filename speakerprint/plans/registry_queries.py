"""Registry, injection and audits. Documents play the fingerprint summaries.

id = doc_id, task_type = source, fp_type and success_score by arithmetic (null without a label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.functions.mixing import mix_sql
from speakerprint.operators import registry as G
from speakerprint.plans.catalog import query, table, wide_table

_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'skill' WHEN 2 THEN 'combined' ELSE 'other' END"
_SCORE = f"quality * 0.5 + CAST({mix_sql('doc_id', '5')} % 51 AS DOUBLE) / 100"
_STAMP = f"{mix_sql('doc_id', '6')} % 1000"

REGISTRY_SQL = f"""SELECT d.doc_id AS id, {_TYPE.replace('doc_id', 'd.doc_id')} AS fp_type, d.source AS task_type, d.text AS summary,
    CAST(l.quality AS DOUBLE) * 0.5 + CAST({mix_sql('d.doc_id', '5')} % 51 AS DOUBLE) / 100 AS success_score,
    {mix_sql('d.doc_id', '6')} % 1000 AS created_at
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Registry binding: ``(id, fp_type, task_type, summary, success_score, created_at)``."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.expr(_TYPE).alias("fp_type"),
        F.col("source").alias("task_type"),
        F.col("text").alias("summary"),
        F.expr(_SCORE.replace("0.5", "0.5D")).alias("success_score"),
        F.expr(_STAMP).alias("created_at"),
    )


def words_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r]+'), lambda w: w <> ''))"


@query("summary_words", f"SELECT doc_id, {words_sql('text')} AS words FROM documents")
def summary_words(spark, sf):
    return G.summary_words(table(spark, sf, "documents"), "text").select("doc_id", "words")


@query(
    "summary_stats",
    f"""SELECT source, count(*) AS n, sum(w)::BIGINT AS words, min(w) AS min_words, max(w) AS max_words,
        count(*) FILTER (w BETWEEN 60 AND 200) AS in_range FROM (SELECT source, {words_sql('text')} AS w FROM documents) GROUP BY source""",
)
def summary_stats(spark, sf):
    return G.summary_stats(table(spark, sf, "documents"), ["source"], "text")


@query(
    "summary_validation",
    f"""WITH reg AS ({REGISTRY_SQL}), c AS (SELECT id, {words_sql('summary')} AS words, fp_type, success_score FROM reg),
    k AS (SELECT id, words, words BETWEEN 60 AND 200 AS ok_words, fp_type IN ('identity', 'skill', 'combined') AS ok_type,
          success_score IS NULL OR success_score BETWEEN 0 AND 1 AS ok_score FROM c)
    SELECT *, ok_words AND ok_type AND ok_score AS valid FROM k""",
)
def summary_validation(spark, sf):
    return G.row_checks(registry_rows(spark, sf)).select("id", "words", "ok_words", "ok_type", "ok_score", "valid")


@query(
    "registry_latest",
    f"""WITH reg AS ({REGISTRY_SQL}),
    new AS (SELECT id % 300 AS id, fp_type, task_type, summary, success_score, created_at * 1000000 + id AS created_at FROM reg),
    both_ AS (SELECT id, fp_type, task_type, success_score, created_at FROM reg UNION ALL
              SELECT id, fp_type, task_type, success_score, created_at FROM new)
    SELECT id, fp_type, task_type, success_score, created_at FROM
      (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM both_) WHERE rn = 1""",
)
def registry_latest(spark, sf):
    reg = registry_rows(spark, sf)
    new = reg.withColumn("created_at", F.col("created_at") * 1000000 + F.col("id")).withColumn("id", F.col("id") % 300)
    return G.upsert_registry(reg, new).select("id", "fp_type", "task_type", "success_score", "created_at")


@query(
    "best_per_task",
    f"""WITH reg AS ({REGISTRY_SQL}) SELECT task_type, id, success_score, created_at FROM (SELECT *, row_number() OVER
    (PARTITION BY task_type ORDER BY success_score DESC NULLS LAST, created_at DESC, id) AS rn FROM reg) WHERE rn = 1""",
)
def best_per_task(spark, sf):
    return G.load_best(registry_rows(spark, sf)).select("task_type", "id", "success_score", "created_at")


@query(
    "injected_prompts",
    f"""WITH reg AS ({REGISTRY_SQL}), p AS (SELECT conv_id, conv_id % 50 AS identity_id, 'src' || conv_id % 25 AS task_type, text AS prompt
        FROM conversations WHERE role = 'system'),
    skill AS (SELECT task_type, summary FROM (SELECT *, row_number() OVER
        (PARTITION BY task_type ORDER BY success_score DESC NULLS LAST, created_at DESC, id) AS rn FROM reg) WHERE rn = 1)
    SELECT p.conv_id, concat_ws(chr(10) || chr(10), i.summary, s.summary, p.prompt) AS system_prompt FROM p
    LEFT JOIN reg i ON i.id = p.identity_id AND i.fp_type = 'identity' LEFT JOIN skill s ON s.task_type = p.task_type""",
)
def injected_prompts(spark, sf):
    reg = registry_rows(spark, sf)
    prompts = table(spark, sf, "conversations").where("role = 'system'").select(
        "conv_id",
        (F.col("conv_id") % 50).alias("identity_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("task_type"),
        F.col("text").alias("prompt"),
    )
    identity = reg.where("fp_type = 'identity'").select(F.col("id").alias("identity_id"), "summary")
    return G.inject(prompts, identity, G.load_best(reg), "conv_id").select("conv_id", "system_prompt")


def _runs_sql(key: str, src: str) -> str:
    return f"""(SELECT {key}, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM
    (SELECT {key}, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM {src})))"""


def _leak_sql(key: str, src: str, other_key: str, other: str) -> str:
    return f"""WITH hit AS (SELECT {key}, count(*) AS leaked FROM {_runs_sql(key, src)} WHERE s IN (SELECT s FROM {_runs_sql(other_key, other)})
      GROUP BY {key}),
    total AS (SELECT {key}, greatest({words_sql('text')} - 7, 0) AS runs FROM {src})
    SELECT t.{key}, runs, coalesce(leaked, 0) AS leaked, coalesce(leaked, 0) > 0 AS leak,
           round(CASE WHEN runs > 0 THEN coalesce(leaked, 0) / runs ELSE 0 END, 6) AS containment
    FROM total t LEFT JOIN hit ON hit.{key} = t.{key}"""


@query("leak_audit", _leak_sql("doc_id", "documents", "item_id", "benchmark"))
def leak_audit(spark, sf):
    docs, items = wide_table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark")
    return G.leak_audit(docs, items, "doc_id", "text", "text").withColumn("containment", F.round("containment", 6))


@query("leaked_messages", _leak_sql("item_id", "benchmark", "doc_id", "documents"))
def leaked_messages(spark, sf):
    docs, items = wide_table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark")
    return G.leak_audit(items, docs, "item_id", "text", "text").withColumn("containment", F.round("containment", 6))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("'", "''")


def _hits_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{_quoted(pattern)}'))"


@query(
    "secret_audit",
    " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count(*) FILTER (n > 0) AS texts, coalesce(sum(n), 0)::BIGINT AS hits FROM (SELECT {_hits_sql(p)} AS n FROM documents)"
        for r, p in G.AUDIT_RULES.items()
    ),
)
def secret_audit(spark, sf):
    return G.secret_audit(wide_table(spark, sf, "documents", "doc_id", "text"))


def _redact_sql() -> str:
    out = "text"
    for r, p in G.AUDIT_RULES.items():
        out = f"regexp_replace({out}, '{_quoted(p)}', '{G.REPLACEMENTS[r]}', 'g')"
    return out


@query("redacted", f"SELECT doc_id, {_redact_sql()} AS text FROM documents")
def redacted(spark, sf):
    return G.redact(wide_table(spark, sf, "documents", "doc_id", "text"))


@query(
    "digest_duplicates",
    """SELECT substring(h, 1, 12) AS digest, count(*) AS copies, min(doc_id) AS first_key
       FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) > 1""",
)
def digest_duplicates(spark, sf):
    return G.digest_duplicates(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "size_report",
    """SELECT source, count(*) AS n, sum(b) / 1024 AS total_kb, min(b) / 1024 AS min_kb, round(sum(b) / count(*) / 1024, 6) AS avg_kb,
       max(b) / 1024 AS max_kb, count(*) FILTER (b > 204800) AS over_budget
       FROM (SELECT source, octet_length(encode(text)) AS b FROM documents) GROUP BY source""",
)
def size_report(spark, sf):
    return G.size_report(table(spark, sf, "documents"), "text", ["source"]).withColumn("avg_kb", F.round("avg_kb", 6))
