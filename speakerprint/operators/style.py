"""Deterministic style profile per speaker: sentences, vocabulary, hedging, punctuation, phrases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speakerprint.functions.text import explode_items, runs, strip, word_count, words
from speakerprint.functions.vectors import as_col
from speakerprint.operators.scale import SMALL_TABLE, bit_filter, may_hold, spread_join
from speakerprint.session import materialised

# Characters cut from words, long-word length, default lexicon.
WORD_EDGES = r"[.,;:!?()\"]+"
LONG_WORD = 7
LEXICON = {
    "hedge": ("maybe", "perhaps", "might", "could", "possibly", "probably", "seems", "likely", "somewhat", "roughly"),
    "certain": ("always", "never", "definitely", "certainly", "clearly", "obviously", "must", "surely", "exactly"),
    "direct": ("do", "use", "stop", "start", "make", "give", "send", "fix", "please", "need"),
}
MARKS = {"question": "?", "exclamation": "!", "comma": ",", "semicolon": ";", "colon": ":", "period": "."}
# Most frequent phrases of a speaker, for each one asked, that tell which score is surely reached; bits of the bitmap of phrases at most.
FIRST_PHRASES = 64
PHRASE_BITS = 1 << 26
# Buckets that phrases are counted by at least, before any phrase is shuffled; buckets looked into at first for each of the most frequent phrases.
LEAST_BUCKETS = 1 << 22
FIRST_BUCKETS = 8
LIST_LINE = r"(?m)^[ \t]*(?:[-*]|[0-9]+\.)[ \t]"


def sentence_profile(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Sentences, words, average and longest sentence length (in words) per group."""
    per_text = df.select(*by, F.split(as_col(text), "[.!?]+").alias("__s")).select(
        *by, F.filter(F.transform("__s", lambda s: word_count(s)), lambda n: n > 0).alias("__n")
    )
    sums = per_text.select(
        *by,
        F.size("__n").cast("bigint").alias("__c"),
        F.aggregate("__n", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("__w"),
        F.array_max("__n").alias("__m"),
    )
    return sums.groupBy(*by).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("__c").alias("sentences"),
        F.sum("__w").alias("words"),
        (F.sum("__w") / F.sum("__c")).alias("avg_words"),
        F.max("__m").alias("max_words"),
    )


def tokens(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """One lower-case word per row, sentence marks cut; words of marks only vanish."""
    plain = F.regexp_replace(F.lower(as_col(text)), WORD_EDGES, " ")
    return explode_items(df.select(*by, words(plain).alias("__w")), by, "__w", "token")


def vocabulary_profile(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Tokens, types, type/token ratio, mean word length and long-word rate per group.

    Counted per (group, word) first, so neither a large group nor a common word is one task's work.
    """
    counted = tokens(df, by, text).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("__c"))
    size = F.length("token")
    total = F.sum("__c")
    return counted.groupBy(*by).agg(
        total.alias("tokens"),
        F.count(F.lit(1)).alias("types"),
        (F.count(F.lit(1)) / total).alias("type_token_ratio"),
        (F.sum(F.col("__c") * size) / total).alias("mean_word_length"),
        (F.sum(F.when(size >= LONG_WORD, F.col("__c")).otherwise(0)) / total).alias("long_word_rate"),
    )


def hedging_profile(
    df: DataFrame, by: Sequence[str], text: str = "text", lexicon: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Occurrences of each lexicon class per group and per 100 words."""
    lexicon = LEXICON if lexicon is None else lexicon
    total = F.count(F.lit(1))
    counts = {name: F.count_if(F.col("token").isin(list(entries))) for name, entries in lexicon.items()}
    return tokens(df, by, text).groupBy(*by).agg(
        total.alias("tokens"),
        *[c.alias(f"{name}_count") for name, c in counts.items()],
        *[(c * 100 / total).alias(f"{name}_per_100") for name, c in counts.items()],
    )


def punctuation_profile(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Punctuation counts, question texts, list lines and marks per 100 words per group."""
    t = F.coalesce(as_col(text), F.lit(""))
    def mark(m: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))).cast("bigint")
    per_text = df.select(
        *by,
        *[mark(m).alias(name) for name, m in MARKS.items()],
        F.endswith(strip(t), F.lit("?")).alias("__ask"),
        F.regexp_count(t, F.lit(LIST_LINE)).cast("bigint").alias("__list"),
        word_count(t).alias("__w"),
    )
    marks = F.lit(0)
    for name in MARKS:
        marks = marks + F.sum(name)
    return per_text.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in MARKS],
        F.count_if("__ask").alias("question_texts"),
        F.sum("__list").alias("list_lines"),
        F.when(F.sum("__w") > 0, marks * 100 / F.sum("__w")).otherwise(0.0).alias("marks_per_100"),
    )


def signature_phrases(df: DataFrame, by: str, text: str = "text", n: int = 2, k: int = 5) -> DataFrame:
    """Top-k n-grams per speaker by tf * ln(N / df); equal scores in phrase order.

    Every phrase of every text is counted, first by a bucket of its hash: a bucket's count is at least that of each
    phrase in it. Phrases of buckets that cannot hold one of the k best of any speaker are neither shuffled nor
    stored; the others are counted per (speaker, phrase), with all speakers that use them, so that tf and df are exact.
    Where buckets tell little, as for speakers with few words, all phrases are counted so, and ranked where their
    frequency lets them be among the best. A phrase that very many speakers use has one row per speaker in the join and is
    salted. The table of phrases grows with the data and is never broadcast.
    """
    normal = F.regexp_replace(F.lower(as_col(text)), WORD_EDGES, " ")
    split = df.select(by, words(normal).alias("__w")).select(by, runs("__w", n).alias("__g"))
    grams = explode_items(split, [by], "__g", "phrase")
    speakers = df.where(F.col(by).isNotNull()).select(by).distinct().agg(F.count(F.lit(1)).alias("n"))
    tf = _frequent(grams, by, k, speakers)
    if tf is None:
        tf = materialised(_counted(grams, by), "phrases")
        scored = _scored(*_reachable(tf, by, k, speakers), by, speakers)
    else:
        scored = _scored(tf, tf, by, speakers)
    return _best(scored, by, k).select(by, "rank", "phrase", "tf", "df", "score")


def _counted(grams: DataFrame, by: str) -> DataFrame:
    return grams.groupBy(by, "phrase").agg(F.count(F.lit(1)).alias("tf"))


def _best(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k best phrases of each speaker, with their rank."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _reached(scored: DataFrame, by: str, k: int) -> DataFrame:
    """(speaker, ``__reached``): the k-th best of the given scores, which the k-th best of all reaches; null for fewer."""
    return _best(scored, by, k).groupBy(by).agg(F.when(F.count("score") == k, F.min("score")).alias("__reached"))


def _may_reach(tf: str, speakers: DataFrame) -> Column:
    """Whether a frequency could reach the limit, were the speaker the phrase's only one."""
    return F.coalesce(F.col(tf) * F.log(speakers.scalar() / F.lit(1)) >= F.col("__reached"), F.lit(True))


def _frequent(grams: DataFrame, by: str, k: int, speakers: DataFrame) -> DataFrame | None:
    """Stored rows (speaker, phrase, tf) of all phrases of buckets that may hold one of the k best of a speaker.

    None where that would be most of all rows. Buckets are those of the phrase's hash alone, so that a phrase is there with
    all its speakers or with none. Speakers are told apart by the other bits of one number; should two share them,
    counts and limits of both hold for the two.
    """
    first = FIRST_BUCKETS * FIRST_PHRASES * k
    wanted = first * (speakers.first()["n"] + 1)
    if 4 * wanted > PHRASE_BITS:
        return None
    buckets = min(PHRASE_BITS, max(LEAST_BUCKETS, 1 << (8 * wanted).bit_length()))
    who = F.xxhash64(by).bitwiseAND(F.lit(-buckets))
    hashed = grams.select(by, "phrase", F.xxhash64("phrase").alias("__h"))
    bucket = F.col("__h").bitwiseAND(F.lit(buckets - 1))
    sums = hashed.select(who.bitwiseOR(bucket).alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("c"))
    sums = materialised(sums.select(F.col("__h").bitwiseAND(F.lit(-buckets)).alias("__who"), bucket.cast("int").alias("__bucket"), "c"), "phrase-buckets")
    most = sums.count() / 2

    def side(limits: DataFrame) -> DataFrame:
        return F.broadcast(limits) if limits.count() <= SMALL_TABLE else limits

    def held(of: DataFrame) -> Column:
        return bit_filter(of.select(F.col("__bucket").cast("bigint").alias("__h")), "__h", buckets)

    def counted(words: Column) -> DataFrame:
        return materialised(_counted(hashed.where(may_hold(words, "__h", buckets)), by), "phrases")

    often = Window.partitionBy("__who").orderBy(F.desc("c"))
    kinds = sums.groupBy("__who", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(often))
    # The counts that the first buckets of a speaker have; of equal buckets, which may be very many, only as many as are asked.
    counts = kinds.where(F.col("upto") - F.col("n") < first).groupBy("__who").agg(F.min("c").alias("__least"))
    chosen = sums.join(side(materialised(counts, "phrase-limits")), "__who").where(F.col("c") >= F.col("__least"))
    chosen = chosen.withColumn("__rank", F.row_number().over(often.orderBy(F.desc("c"), F.asc("__bucket")))).where(F.col("__rank") <= first)
    chosen = materialised(chosen.select("__bucket").distinct(), "phrase-choice")
    seen = sums.withColumn("__h", F.col("__bucket").cast("bigint")).withColumn("__seen", may_hold(held(chosen), "__h", buckets))
    if seen.where("__seen").count() > most:
        return None
    tf = counted(held(chosen))
    limits = _reached(_scored(tf, tf, by, speakers), by, k).groupBy(who.alias("__who")).agg(
        F.when(F.count("__reached") == F.count(F.lit(1)), F.min("__reached")).alias("__reached")
    )
    rest = seen.where(~F.col("__seen")).join(side(materialised(limits, "phrase-limits")), "__who").where(_may_reach("c", speakers))
    rest = materialised(rest.select("__bucket").distinct(), "phrase-choice")
    if rest.isEmpty():
        return tf
    if seen.where(F.col("__seen") | may_hold(held(rest), "__h", buckets)).count() > most:
        return None
    return tf.unionByName(counted(held(rest)))


def _scored(chosen: DataFrame, tf: DataFrame, by: str, speakers: DataFrame) -> DataFrame:
    """Stored rows (speaker, phrase, tf) with df and score; df counts the rows of ``tf``."""
    if chosen is not tf:
        bits = min(PHRASE_BITS, 1 << max(10, (16 * chosen.count()).bit_length()))
        hashed = F.xxhash64("phrase").alias("__h")
        tf = tf.select("phrase", hashed).where(may_hold(bit_filter(chosen.select(hashed), "__h", bits), "__h", bits))
    spread = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    scored = spread_join(chosen, spread, ["phrase"], [by]).withColumn("__n", speakers.scalar())
    return scored.withColumn("score", F.col("tf") * F.log(F.col("__n") / F.col("df")))


def _reachable(tf: DataFrame, by: str, k: int, speakers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``tf`` that may be among the k best of their speaker, ``tf``)."""

    def cut(limits: DataFrame, kept: Column) -> DataFrame:
        limits = materialised(limits.withColumnRenamed(by, "__by"), "phrase-limits")
        side = F.broadcast(limits) if limits.count() <= SMALL_TABLE else limits
        return materialised(tf.join(side, F.col(by).eqNullSafe(F.col("__by"))).where(kept).select(*tf.columns), "phrase-choice")

    down = Window.partitionBy(by).orderBy(F.desc("tf"))
    counts = tf.groupBy(by, "tf").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(down))
    # The largest frequency that enough phrases reach, or the smallest of all.
    least = F.coalesce(F.max(F.when(F.col("upto") >= FIRST_PHRASES * k, F.col("tf"))), F.min("tf"))
    first = cut(counts.groupBy(by).agg(least.alias("__least")), F.col("tf") >= F.col("__least"))
    if 2 * first.count() > tf.count():
        return tf, tf
    return cut(_reached(_scored(first, tf, by, speakers), by, k), _may_reach("tf", speakers)), tf


def style_profile(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """All profiles of a speaker in one row, signature phrases as an array."""
    phrases = signature_phrases(df, by, text).groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda p: p["phrase"]).alias("phrases")
    )
    out = sentence_profile(df, [by], text)
    for part in (
        vocabulary_profile(df, [by], text).drop("tokens"),
        hedging_profile(df, [by], text).drop("tokens"),
        punctuation_profile(df, [by], text),
        phrases,
    ):
        out = out.join(part, by, "left")
    return out


def render_summary(profile: DataFrame) -> DataFrame:
    """Add ``summary``: a fixed-form description of 60 to 200 words built from a style profile.

    Only words of the profile appear, no message; phrases are left out, as they could quote one.
    """
    def number(c: str, digits: int = 1) -> Column:
        return F.format_number(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), digits)
    def grade(c: str, low: float, high: float, names: tuple[str, str, str]) -> Column:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return F.when(v < low, names[0]).when(v < high, names[1]).otherwise(names[2])
    return profile.withColumn(
        "summary",
        F.format_string(
            "Writes %s sentences of %s words on average, the longest with %s words, over %s messages. "
            "The vocabulary is %s: %s distinct words per word used, words of %s letters on average, and a share of %s long words. "
            "Statements are %s: hedges occur %s times, certain words %s times and direct words %s times per hundred words. "
            "Punctuation is %s, with %s marks per hundred words, %s questions, %s exclamations and %s list lines in total. "
            "Keep sentence length, word choice, directness and punctuation habits close to these figures when writing in this style.",
            grade("avg_words", 8, 16, ("short", "medium", "long")),
            number("avg_words"),
            number("max_words", 0),
            number("messages", 0),
            grade("mean_word_length", 4, 6, ("plain", "mixed", "formal")),
            number("type_token_ratio", 2),
            number("mean_word_length"),
            number("long_word_rate", 2),
            grade("hedge_per_100", 0.5, 2, ("direct", "measured", "hedged")),
            number("hedge_per_100"),
            number("certain_per_100"),
            number("direct_per_100"),
            grade("marks_per_100", 8, 16, ("sparse", "regular", "dense")),
            number("marks_per_100"),
            number("question", 0),
            number("exclamation", 0),
            number("list_lines", 0),
        ),
    )
