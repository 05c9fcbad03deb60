"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text.

One model of character 4-grams per language, and one of all trusted text (language ``*``) for languages
without enough of it. All trusted documents are counted. Counts, discounts, back-off weights and probabilities are tables, sharded by the hash of the n-gram.

Scoring. Documents are dealt to blocks of text; the distinct n-grams of each block are joined with the
shards, the way n-grams that the model has not seen are joined with its lower orders, and each block then
meets the probabilities of its own n-grams. Per-document perplexity is compared with a quantile of the
perplexities of all trusted documents of the language, times a margin and an allowance for the standard
error of a mean over few characters.

A null or empty text has no perplexity and is not kept. A null or unknown language is judged by ``*``.
Repeated rows are judged one by one; other columns of the input do not reach the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import materialised
from speakerprint.llm.ngrams import BLOCK_BYTES, Grams, context, counted, low, scored
from speakerprint.operators.scale import SMALL_TABLE

#: Trusted documents that a language needs for a model and a threshold of its own.
LEAST_DOCS = 20
#: Quantile of trusted perplexities, and the margin above it that a document may reach.
QUANTILE = 0.98
MARGIN = 1.25
#: Deviation of a character's log probability, for the standard error of short documents' means.
DEVIATION = 2.0
ORDER, BITS = 4, 16
GRAMS = Grams(ORDER, BITS)
ALL = "*"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of trusted labelled documents."""
    return labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the models of (lang, text): probabilities and back-off weights.

    (model, n, key, p): probability of the last character of a seen n-gram of n characters.
    (model, n, ctx, w): weight that an n-gram of n characters with this context leaves to the shorter one.
    """
    own = counted(texts.select(F.col("lang").alias("model"), "text"), GRAMS, "model").where("model IS NOT NULL")
    per = own.groupBy("model", "key").agg(F.sum("n").alias("c"))
    every = per.groupBy("key").agg(F.sum("c").alias("c")).select(F.lit(ALL).alias("model"), "key", "c")
    top = materialised(per.unionByName(every), "kn-counts")
    counts = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        shorter = counts[n + 1].groupBy("model", low("key", n, BITS).alias("key")).agg(F.count(F.lit(1)).alias("c"))
        counts[n] = materialised(shorter, "kn-counts")
    lower, probabilities, weights = None, [], []
    for n in range(1, ORDER + 1):
        c = counts[n].withColumn("ctx", context("key", BITS))
        how = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        shares = [F.greatest(F.lit(0.01), F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.5 * i))).alias(f"d{i}") for i in (1, 2, 3)]
        discounts = c.groupBy("model").agg(*how).select("model", *shares)
        by_ctx = c.groupBy("model", "ctx").agg(
            F.sum("c").alias("total"), *[F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"k{i}") for i in (1, 2)],
            F.sum(F.when(F.col("c") >= 3, 1).otherwise(0)).alias("k3"), F.count(F.lit(1)).alias("kinds"),
        )
        # One row per model: discounts, and for the shortest n-grams the number of characters.
        ctx = by_ctx.join(F.broadcast(discounts), "model").withColumn("w", (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total"))
        weights.append(ctx.select("model", F.lit(n).alias("n"), "ctx", "w"))
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = c.join(ctx.select("model", "ctx", "total", "w", "d1", "d2", "d3", "kinds"), ["model", "ctx"]).withColumn("own", F.greatest(F.col("c") - d, F.lit(0)) / F.col("total"))
        if lower is None:
            p = seen.select("model", "key", (F.col("own") + F.col("w") / (F.col("kinds") + 1)).alias("p"))
        else:
            rest = lower.select("model", F.col("key").alias("suffix"), F.col("p").alias("q"))
            p = seen.withColumn("suffix", low("key", n - 1, BITS)).join(rest, ["model", "suffix"]).select("model", "key", (F.col("own") + F.col("w") * F.col("q")).alias("p"))
        lower = materialised(p, "kn-probabilities")
        probabilities.append(lower.select("model", F.lit(n).alias("n"), "key", "p"))
    all_p, all_w = probabilities[0], weights[0]
    for p, w in zip(probabilities[1:], weights[1:]):
        all_p, all_w = all_p.unionByName(p), all_w.unionByName(w)
    return all_p, materialised(all_w, "kn-weights")


def gram_scores(grams: DataFrame, probabilities: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, key, value): log probability of each distinct (model, key), seen by the model or not.

    From the longest order down: what an order has seen is final; the rest carries the weight of its
    context to the next.
    """
    open_rows = grams.select("model", "key").distinct().withColumn("carried", F.lit(0.0))
    out = None
    for n in range(ORDER, 0, -1):
        p = probabilities.where(F.col("n") == n).select("model", F.col("key").alias("short"), "p")
        w = weights.where(F.col("n") == n).select("model", "ctx", "w")
        met = open_rows.withColumn("short", low("key", n, BITS)).join(p, ["model", "short"], "left")
        met = met.withColumn("ctx", context("short", BITS)).join(w, ["model", "ctx"], "left")
        met = materialised(met.select("model", "key", "carried", "p", "w"), "kn-scores")
        done = met.where("p IS NOT NULL").select("model", "key", (F.col("carried") + F.log("p")).alias("value"))
        out = done if out is None else out.unionByName(done)
        open_rows = met.where("p IS NULL").select("model", "key", (F.col("carried") + F.log(F.coalesce("w", F.lit(1.0)))).alias("carried"))
    # A character that no trusted text has: the uniform share of the shortest order.
    size = probabilities.where("n = 1").groupBy("model").agg((-F.log(F.count(F.lit(1)) + 1.0)).alias("least"))
    unseen = open_rows.join(F.broadcast(size), "model", "left").select("model", "key", (F.col("carried") + F.coalesce("least", F.lit(-16.0))).alias("value"))
    return out.unionByName(unseen)


def perplexities(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) of every document. ``trusted`` has (lang, text)."""
    trusted = trusted.where("text IS NOT NULL")
    probabilities, weights = train(trusted)
    # One row per language with enough trusted text.
    models = trusted.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") >= LEAST_DOCS) & F.col("lang").isNotNull()).select("lang")
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    known = F.broadcast(materialised(models.withColumn("model", F.col("lang")), "kn-models"))
    rows = rows.join(known, "lang", "left").select("doc_id", "lang", F.coalesce("model", F.lit(ALL)).alias("model"), "text")
    # A block has one model, so that its n-grams have one value each.
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    deal = int(total // BLOCK_BYTES) + 1
    block = F.concat_ws("/", "model", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(deal)).cast("string"))
    blocks = rows.withColumn("block", block).select("doc_id", "lang", "text", "block").repartition(2 * deal, "block")
    grams = counted(blocks.select("block", "text"), GRAMS, "block").select("block", "key").distinct()
    grams = materialised(grams.withColumn("model", F.substring_index("block", "/", 1)), "kn-grams")
    values = grams.join(gram_scores(grams, probabilities, weights), ["model", "key"]).select("block", "key", "value")
    sums = scored(blocks, values, GRAMS)
    perplexity = F.when(F.col("n_grams") > 0, F.exp(-F.col("total") / F.col("n_grams")))
    return sums.select("doc_id", "lang", F.col("n_grams").alias("n_chars"), perplexity.alias("perplexity"))


def thresholds(scores: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, threshold): per language, and for ``*``, from the perplexities of all trusted documents."""
    good = scores.join(trusted, "doc_id", "left_semi").where("perplexity IS NOT NULL")
    q = (F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * margin).alias("threshold")
    own = good.where("lang IS NOT NULL").groupBy("lang").agg(q, F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_DOCS).select("lang", "threshold")
    return own.unionByName(good.agg(q).select(F.lit(ALL).alias("lang"), "threshold"))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept) of every document."""
    ids = trusted_ids(labels)
    few = ids.count() <= SMALL_TABLE
    picked = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    scores = materialised(perplexities(docs, picked.select("lang", "text"), id, text, lang), "kn-perplexities")
    limits = materialised(thresholds(scores, ids), "kn-thresholds")
    own = scores.join(F.broadcast(limits), "lang", "left")
    # One row: the threshold for languages without one of their own.
    rest = F.broadcast(limits.where(F.col("lang") == ALL).select(F.col("threshold").alias("every")))
    out = own.join(rest, F.lit(True), "left").withColumn("threshold", F.coalesce("threshold", "every"))
    allowed = F.col("threshold") * F.exp(F.lit(DEVIATION) / F.sqrt("n_chars"))
    kept = F.coalesce(F.col("perplexity") <= allowed, F.lit(False))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))
