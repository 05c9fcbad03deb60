"""Archives made from the tables, opened again: contract checks, typed manifests, retrieval by their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.operators import match as J
from speakerprint.operators import registry as G
from speakerprint.plans.catalog import query, table
from speakerprint.plans.registry_queries import words_sql
from speakerprint.session import materialised
from speakerprint.sources.archives import open_archives, pack_archives

DIM = 64

# Documents as archives with planted faults: by the number of the document a member is missing or broken, the version is old, the
# type unknown, or the score out of range. Odd documents have the field names of earlier tools.
_FAULTS = {
    "no_summary": "doc_id % 19 = 3", "no_metadata": "doc_id % 23 = 5", "bad_json": "doc_id % 29 = 7", "not_zip": "doc_id % 31 = 9",
    "old": "doc_id % 7 = 1", "odd": "doc_id % 2 = 1",
}
_STAMP = "concat('2024-01-0', CAST(1 + doc_id % 9 AS STRING), 'T0', CAST(doc_id % 10 AS STRING), ':00:00Z')"


def document_archives(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content) of every document's archive."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", *[F.expr(e).alias(n) for n, e in _FAULTS.items()])
    types = F.expr("CASE doc_id % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'skill' WHEN 2 THEN 'combined' ELSE 'other' END")
    score = F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 13 AS DOUBLE) / 10 END")
    version, stamp = F.when(F.col("old"), "1.0").otherwise("2.0"), F.expr(_STAMP)
    common = [version.alias("csp_version"), types.alias("fp_type"), F.col("lang").alias("task_type"), score.alias("success_score")]
    kept = {"ignoreNullFields": "false"}
    manifest = F.when(F.col("odd"), F.to_json(F.struct(*common, stamp.alias("created"), F.lit("m1").alias("model")), kept))
    manifest = manifest.otherwise(F.to_json(F.struct(*common, stamp.alias("created_at"), F.lit("m2").alias("model_origin")), kept))
    manifest = F.when(F.col("bad_json"), F.concat(manifest, F.lit(","))).otherwise(manifest)
    size, messages, none = F.length("text"), F.col("doc_id") % 50, F.lit(None).cast("bigint")
    metadata = F.when(F.col("odd"), F.to_json(F.struct(stamp.alias("created"), size.alias("summary_words"), F.lit(10_000).alias("hdc_dim")), kept))
    fields = [stamp.alias("generated_at"), F.lit("m2").alias("model_origin"), messages.alias("source_message_count"), size.alias("summary_token_count"), none.alias("vector_dimensions")]
    metadata = metadata.otherwise(F.to_json(F.struct(*fields), kept))
    rows = docs.select(
        "doc_id", "not_zip", manifest.alias("manifest"), F.when(~F.col("no_summary"), F.col("text")).alias("summary"),
        F.when(~F.col("no_metadata"), metadata).alias("metadata"), F.lit(None).cast("array<float>").alias("vector"),
    )
    zipped = pack_archives(rows.where("NOT not_zip"), "doc_id")
    plain = rows.where("not_zip").select("doc_id", F.coalesce("summary", F.lit("")).cast("binary").alias("content"))
    return zipped.unionByName(plain).withColumnRenamed("doc_id", "path")


_ROWS = f"""d AS (SELECT doc_id, text, lang, {", ".join(f"{e} AS {n}" for n, e in _FAULTS.items())}, doc_id % 4 AS t,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 13 AS DOUBLE) / 10 END AS score FROM documents)"""
_CHECKS = """CASE WHEN not_zip THEN 'zip' END, CASE WHEN not_zip OR no_summary OR no_metadata THEN 'files' END,
    CASE WHEN not_zip OR bad_json OR {old_names} THEN 'manifest' END, CASE WHEN not_zip OR no_metadata OR {old_names} THEN 'metadata' END,
    CASE WHEN not_zip OR bad_json OR old THEN 'version' END, CASE WHEN not_zip OR bad_json OR t = 3 THEN 'fp_type' END,
    CASE WHEN NOT not_zip AND NOT bad_json AND score > 1 THEN 'score' END,
    CASE WHEN not_zip OR no_summary OR words NOT BETWEEN 60 AND 200 THEN 'summary' END"""


def _validated(spark, sf, mode: str) -> DataFrame:
    checked = G.validate(open_archives(document_archives(spark, sf), raw=False), mode)
    return checked.select(F.col("path").cast("bigint").alias("doc_id"), F.array_join("violations", ",").alias("violations"), "valid")


def _validation_sql(old_names: str) -> str:
    return f"""WITH {_ROWS}, w AS (SELECT *, {words_sql('text')} AS words FROM d),
    v AS (SELECT doc_id, concat_ws(',', {_CHECKS.format(old_names=old_names)}) AS violations FROM w)
    SELECT doc_id, violations, violations = '' AS valid FROM v"""


@query("archives_validated", _validation_sql("odd"))
def archives_validated(spark, sf):
    """Every contract check on archives, by the contract's names only. (An archive under the size limit always, as documents are.)"""
    return _validated(spark, sf, "strict")


@query("archives_validated_lenient", _validation_sql("false"))
def archives_validated_lenient(spark, sf):
    return _validated(spark, sf, "lenient")


@query(
    "manifests_normalised",
    f"""WITH {_ROWS}, s AS (SELECT *, CAST(concat('2024-01-0', 1 + doc_id % 9, ' 0', doc_id % 10, ':00:00') AS TIMESTAMP) AS stamp,
        NOT bad_json AND NOT not_zip AS m, NOT no_metadata AND NOT not_zip AS k FROM d)
    SELECT doc_id, CASE WHEN m THEN CASE WHEN old THEN '1.0' ELSE '2.0' END END AS version,
        CASE WHEN m THEN CASE t WHEN 0 THEN 'identity' WHEN 1 THEN 'skill' WHEN 2 THEN 'combined' ELSE 'other' END END AS fp_type,
        CASE WHEN m THEN lang END AS task_type, CASE WHEN m THEN score END AS success_score, CASE WHEN m THEN epoch(stamp)::BIGINT END AS created,
        CASE WHEN m THEN CASE WHEN odd THEN 'm1' ELSE 'm2' END END AS model, CASE WHEN k THEN epoch(stamp)::BIGINT END AS generated,
        CASE WHEN k AND NOT odd THEN 'm2' WHEN m AND odd THEN 'm1' END AS metadata_model,
        CASE WHEN k AND NOT odd THEN doc_id % 50 END AS messages, CASE WHEN k THEN length(text)::BIGINT END AS tokens, CASE WHEN k AND odd THEN 10000 END AS dimensions
    FROM s""",
)
def manifests_normalised(spark, sf):
    """Typed manifests and metadata, under the contract's names and under those of earlier tools."""
    typed = G.normalise_manifest(open_archives(document_archives(spark, sf), raw=False))
    return typed.select(
        F.col("path").cast("bigint").alias("doc_id"), F.col("manifest.csp_version").alias("version"), "manifest.fp_type", "manifest.task_type", "manifest.success_score",
        F.unix_timestamp("manifest.created_at").alias("created"), F.col("manifest.model_origin").alias("model"),
        F.unix_timestamp("metadata.generated_at").alias("generated"), F.col("metadata.model_origin").alias("metadata_model"),
        F.col("metadata.source_message_count").alias("messages"), F.col("metadata.summary_token_count").alias("tokens"), F.col("metadata.vector_dimensions").alias("dimensions"),
    )


@query(
    "archives_retrieved",
    f"""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding) AS x FROM embeddings WHERE vec_id % 37 <> 11),
    b AS (SELECT vec_id, string_agg(CASE WHEN x >= -1.0 / 33554432 THEN '1' ELSE '0' END, '' ORDER BY j)::BIT AS b FROM x GROUP BY vec_id),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate, ({DIM} - 2 * bit_count(xor(q.b, c.b))) / {DIM}.0 AS score FROM b q, b c WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) AS rank FROM s)
    SELECT r.query_id, r.candidate, r.score, r.rank, 'speaker ' || e.label AS summary FROM r JOIN embeddings e ON e.vec_id = r.candidate WHERE rank <= 5 AND score > 0.1""",
)
def archives_retrieved(spark, sf):
    """Messages' vectors as half-precision members of archives; retrieval reads nothing but the archives. Some have no vector and match nothing."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit("{}").alias("manifest"), F.concat(F.lit("speaker "), F.col("label")).alias("summary"),
        F.lit("{}").alias("metadata"), F.when(F.col("vec_id") % 37 != 11, F.col("embedding")).alias("vector"),
    )
    opened = open_archives(pack_archives(rows), "id", raw=False).where(F.col("vector_dim") == DIM)
    opened = materialised(opened.select(F.col("path").cast("bigint").alias("id"), "summary", "bits"), "archives")
    queries = opened.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "bits")
    candidates = opened.select(F.col("id").alias("candidate"), F.col("id").alias("ord"), "bits")
    hits = J.retrieve(queries, candidates, 5, 0.1, DIM, registry=opened)
    return hits.select("query_id", "candidate", "score", F.col("rank").cast("bigint").alias("rank"), "summary")
