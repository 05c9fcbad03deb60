"""Fingerprint registry: contract checks, upsert, selection, injection, audits, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speakerprint.functions.jsontext import keys_of, strict_object
from speakerprint.functions.text import explode_items, run_hashes, script_strip, word_count, words
from speakerprint.functions.vectors import as_col
from speakerprint.operators.scale import HOT_ROWS, bit_filter, may_hold, spread_join

# Fixed values of the fingerprint contract.
VERSION = "2.0"
FP_TYPES = ("identity", "skill", "combined")
MIN_WORDS, MAX_WORDS = 60, 200
MAX_BYTES = 200 * 1024
REQUIRED_FILES = ("manifest.json", "summary.txt", "metadata.json")
MANIFEST_FIELDS = ("csp_version", "fp_type", "task_type", "success_score", "created_at", "model_origin")
METADATA_FIELDS = ("generated_at", "model_origin", "source_message_count", "summary_token_count", "vector_dimensions")
#: Bits of a bitmap of runs at most (16 MiB).
FILTER_BITS = 1 << 27
#: Names written by earlier tools, accepted in lenient mode.
MANIFEST_ALIASES = {"created_at": "created", "model_origin": "model"}
METADATA_ALIASES = {"generated_at": "created", "summary_token_count": "summary_words", "vector_dimensions": "hdc_dim"}

# Audit rules (patterns valid in Java and RE2) and their replacements.
AUDIT_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "credential": r"(?i)(?:api[_-]?key|secret|password|passwd|access[_-]?token)[ \t]*[:=][ \t]*[^ \t\n\r]+",
    "token": r"[0-9a-fA-F]{32,}",
    "phone": r"\+?[0-9][0-9 ()-]{7,}[0-9]",
}
REPLACEMENTS = {"email": "[EMAIL]", "credential": "[CREDENTIAL]", "token": "[TOKEN]", "phone": "[PHONE]"}


def summary_words(df: DataFrame, text: str = "summary") -> DataFrame:
    return df.withColumn("words", word_count(text))


def summary_stats(df: DataFrame, by: list[str], text: str = "summary") -> DataFrame:
    counted = summary_words(df, text)
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("words").alias("words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
        F.count_if(F.col("words").between(MIN_WORDS, MAX_WORDS)).alias("in_range"),
    )


def row_checks(df: DataFrame) -> DataFrame:
    """Contract checks on registry rows: summary length, type name and score range."""
    score = F.col("success_score")
    return (
        summary_words(df)
        .withColumn("ok_words", F.coalesce(F.col("words").between(MIN_WORDS, MAX_WORDS), F.lit(False)))
        .withColumn("ok_type", F.coalesce(F.col("fp_type").isin(*FP_TYPES), F.lit(False)))
        .withColumn("ok_score", score.isNull() | score.between(0.0, 1.0))
        .withColumn("valid", F.col("ok_words") & F.col("ok_type") & F.col("ok_score"))
    )


def normalise_manifest(archives: DataFrame, mode: str = "lenient") -> DataFrame:
    """Add typed ``manifest`` and ``metadata`` structs from the archives' JSON texts.

    ``strict`` reads the contract's names only; ``lenient`` also takes the earlier tool names.
    """
    aliases = (MANIFEST_ALIASES, METADATA_ALIASES) if mode == "lenient" else ({}, {})
    parsed = archives.withColumn("__m", strict_object(script_strip("manifest_json"))).withColumn("__d", strict_object(script_strip("metadata_json")))

    def field(source: str, name: str, typ: str, alias: dict[str, str]) -> Column:
        value = F.try_variant_get(source, F.lit(f"$.{name}"), typ)
        if name in alias:
            value = F.coalesce(value, F.try_variant_get(source, F.lit(f"$.{alias[name]}"), typ))
        return value.alias(name)

    m_types = ("string", "string", "string", "double", "string", "string")
    d_types = ("string", "string", "bigint", "bigint", "int")
    manifest = [field("__m", n, t, aliases[0]) for n, t in zip(MANIFEST_FIELDS, m_types)]
    metadata = [field("__d", n, t, aliases[1]) for n, t in zip(METADATA_FIELDS, d_types)]
    if mode == "lenient":
        metadata[1] = F.coalesce(F.try_variant_get("__d", F.lit("$.model_origin"), "string"), F.try_variant_get("__m", F.lit("$.model"), "string")).alias("model_origin")
        metadata[2] = F.coalesce(
            F.try_variant_get("__d", F.lit("$.source_message_count"), "bigint"), F.try_variant_get("__m", F.lit("$.n_messages"), "bigint")
        ).alias("source_message_count")
    typed = parsed.withColumn("manifest", F.struct(*manifest)).withColumn("metadata", F.struct(*metadata))
    stamp = F.col("manifest").withField("created_at", F.try_to_timestamp(F.col("manifest.created_at")))
    generated = F.col("metadata").withField("generated_at", F.try_to_timestamp(F.col("metadata.generated_at")))
    return typed.withColumn("manifest", stamp).withColumn("metadata", generated).drop("__m", "__d")


def validate(archives: DataFrame, mode: str = "strict") -> DataFrame:
    """All contract checks per archive: one boolean each, ``violations`` and ``valid``.

    ``strict`` wants every field under its contract name; ``lenient`` accepts the earlier
    tools' names and asks for no metadata field they never wrote.
    """
    lenient = mode == "lenient"
    df = (
        archives.withColumn("__m", strict_object(script_strip("manifest_json")))
        .withColumn("__d", strict_object(script_strip("metadata_json")))
        .withColumn("__words", F.when(F.col("summary_utf8"), word_count("summary")))
        .withColumns({f"{c}_keys": keys_of(F.col(c)) for c in ("__m", "__d")})
    )

    def present(source: str, names: tuple[str, ...], aliases: dict[str, str]) -> Column:
        ok = F.lit(True)
        for n in names:
            one = F.array_contains(f"{source}_keys", n)
            if lenient and n in aliases:
                one = one | F.array_contains(f"{source}_keys", aliases[n])
            ok = ok & one
        return ok

    def text(name: str) -> Column:
        return F.try_variant_get("__m", F.lit(f"$.{name}"), "string")

    score = F.try_variant_get("__m", F.lit("$.success_score"), "double")
    has_score = text("success_score").isNotNull()
    metadata_names = tuple(METADATA_ALIASES) if lenient else METADATA_FIELDS
    checks = {
        "zip": F.col("is_zip"),
        "files": F.forall(F.array(*map(F.lit, REQUIRED_FILES)), lambda f: F.array_contains("files", f)),
        "manifest": present("__m", MANIFEST_FIELDS, MANIFEST_ALIASES),
        "metadata": present("__d", metadata_names, METADATA_ALIASES),
        "version": text("csp_version") == VERSION,
        "fp_type": text("fp_type").isin(*FP_TYPES),
        "score": ~has_score | F.coalesce(score.between(0.0, 1.0), F.lit(False)),
        "summary": F.col("__words").between(MIN_WORDS, MAX_WORDS),
        "size": F.col("size") <= MAX_BYTES,
    }
    out = df
    for name, check in checks.items():
        out = out.withColumn(f"ok_{name}", F.coalesce(check, F.lit(False)))
    failed = F.array_compact(F.array(*[F.when(~F.col(f"ok_{n}"), F.lit(n)) for n in checks]))
    return out.withColumn("violations", failed).withColumn("valid", F.size("violations") == 0).drop("__m", "__d", "__m_keys", "__d_keys", "__words")


def validation_report(validated: DataFrame) -> DataFrame:
    """Archives per violated check; archives without one count under ``none``."""
    named = F.when(F.size("violations") == 0, F.array(F.lit("none"))).otherwise(F.col("violations"))
    return validated.select(F.explode(named).alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("archives"))


def upsert_registry(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Union with one row per id: the latest created_at, a new row before an old one at equal time.

    Spark keeps one row per id in every task before the shuffle, so a hot id stays cheap.
    """
    both = registry.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    tie = F.xxhash64(*[F.col(c) for c, t in registry.dtypes if not t.startswith("map")])
    latest = Window.partitionBy("id").orderBy(F.desc_nulls_last("created_at"), F.desc("__new"), F.desc("__tie"))
    return (
        both.withColumn("__tie", tie).withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__new", "__tie", "__rn")
    )


def load_best(registry: DataFrame, task_type: str | None = None) -> DataFrame:
    """Best fingerprint per task type: success_score, then latest, then smallest id."""
    rows = registry if task_type is None else registry.where(F.col("task_type") == task_type)
    best = Window.partitionBy("task_type").orderBy(F.desc_nulls_last("success_score"), F.desc_nulls_last("created_at"), F.asc("id"))
    return rows.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")


def inject(
    prompts: DataFrame, identity: DataFrame, skill: DataFrame, prompt_id: str = "prompt_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``system_prompt``: identity summary, skill summary, original prompt, blank lines between.

    ``identity`` has one row per ``identity_id``, ``skill`` one per ``task_type``, each with
    ``summary``. Prompts without one keep the rest. Popular fingerprints are spread over tasks.
    """
    i = identity.select("identity_id", F.col("summary").alias("__i"))
    s = skill.select("task_type", F.col("summary").alias("__s"))
    joined = spread_join(prompts, i, ["identity_id"], [prompt_id], "left", hot_rows)
    joined = spread_join(joined, s, ["task_type"], [prompt_id], "left", hot_rows, hot_from=prompts)
    return joined.withColumn("system_prompt", F.concat_ws("\n\n", "__i", "__s", "prompt")).drop("__i", "__s")


def _run_rows(df: DataFrame, keep: list[str], text: str, k: int) -> DataFrame:
    hashes = df.select(*keep, F.transform(words(text), lambda w: F.xxhash64(w)).alias("__w"))
    return explode_items(hashes.select(*keep, run_hashes("__w", k).alias("__s")), keep, "__s", "s").select(*keep, "s.h1", "s.h2")


def _filter_bits(texts: DataFrame, text: str) -> int | None:
    """Size of a bitmap for the runs of a table, some eight bits each; None where it would be too large."""
    chars = texts.agg(F.coalesce(F.sum(F.octet_length(as_col(text))), F.lit(0)).alias("c")).first()["c"]
    bits = 1 << max(10, (2 * chars).bit_length())
    return bits if bits <= FILTER_BITS else None


def leak_audit(texts: DataFrame, against: DataFrame, key: str, text: str, against_text: str, k: int = 8) -> DataFrame:
    """``(key, runs, leaked, containment, leak)``: a text's k-word runs that occur in ``against``.

    ``texts`` has one row per key. Run with summaries against messages it finds summaries that
    quote messages; the other way round it finds the messages quoted. Only the distinct runs of
    ``against`` are joined, as a semi-join, so no (text, message) pair is built however often
    either repeats; a run common to very many texts is split by Spark's skew join. A text is
    hashed once: its number of runs follows from its words. Where one of the tables is small, a bitmap of its runs'
    hashes leaves only runs of the other that may match to be shuffled.
    """
    total = F.greatest(word_count(text) - (k - 1), F.lit(0)).cast("bigint")
    runs, known = _run_rows(texts, [key], text, k), _run_rows(against, [], against_text, k).distinct()
    sizes = _filter_bits(against, against_text), _filter_bits(texts, text)
    if sizes[0] and (not sizes[1] or sizes[0] <= sizes[1]):
        runs = runs.where(may_hold(bit_filter(known, "h1", sizes[0]), "h1", sizes[0]))
    elif sizes[1]:
        known = _run_rows(against, [], against_text, k).where(may_hold(bit_filter(runs, "h1", sizes[1]), "h1", sizes[1])).distinct()
    hits = runs.join(known, ["h1", "h2"], "left_semi")
    leaked = hits.groupBy(key).agg(F.count(F.lit(1)).alias("leaked"))
    rows = texts.select(key, total.alias("runs")).join(leaked, key, "left").withColumn("leaked", F.coalesce("leaked", F.lit(0)))
    share = F.when(F.col("runs") > 0, F.col("leaked") / F.col("runs")).otherwise(0.0)
    return rows.select(key, "runs", F.col("leaked").cast("bigint").alias("leaked"), share.alias("containment"), (F.col("leaked") > 0).alias("leak"))


def secret_counts(df: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """Add one match count per audit rule."""
    rules = AUDIT_RULES if rules is None else rules
    return df.select("*", *[F.regexp_count(as_col(text), F.lit(p)).cast("bigint").alias(f"n_{name}") for name, p in rules.items()])


def secret_audit(df: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """``(rule, texts, hits)``: texts with a match and all matches per rule, in one scan."""
    rules = AUDIT_RULES if rules is None else rules
    counted = secret_counts(df.select(text), text, rules)
    wide = counted.agg(
        *[F.count_if(F.col(f"n_{r}") > 0).alias(f"t_{r}") for r in rules], *[F.coalesce(F.sum(f"n_{r}"), F.lit(0)).alias(f"h_{r}") for r in rules]
    )
    entries = [F.struct(F.lit(r).alias("rule"), F.col(f"t_{r}").alias("texts"), F.col(f"h_{r}").alias("hits")) for r in rules]
    return wide.select(F.inline(F.array(*entries)))


def redact(df: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """Replace every audited match by its placeholder, rules in order."""
    rules = AUDIT_RULES if rules is None else rules
    out = as_col(text)
    for name, pattern in rules.items():
        out = F.regexp_replace(out, pattern, REPLACEMENTS.get(name, f"[{name.upper()}]"))
    return df.withColumn(text, out)


def content_digest(content: str | Column) -> Column:
    """First 12 hex digits of SHA-256."""
    return F.substring(F.sha2(as_col(content), 256), 1, 12)


def digest_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """``(digest, copies, first_key)`` of contents that occur more than once, grouped by full SHA-256."""
    full = df.select(key, F.sha2(as_col(content), 256).alias("__h"))
    groups = full.groupBy("__h").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
    return groups.where("copies > 1").select(F.substring("__h", 1, 12).alias("digest"), "copies", "first_key")


def size_report(df: DataFrame, content: str, by: list[str] | None = None) -> DataFrame:
    """Count, total, smallest, average and largest KB, and how many exceed the size budget."""
    size = F.octet_length(as_col(content))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(size) / 1024).alias("total_kb"),
        (F.min(size) / 1024).alias("min_kb"),
        (F.sum(size) / F.count(size) / 1024).alias("avg_kb"),
        (F.max(size) / 1024).alias("max_kb"),
        F.count_if(size > MAX_BYTES).alias("over_budget"),
    )
