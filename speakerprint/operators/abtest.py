"""Blind A/B evaluation: assignment, reply parsing, unblinding, statistics and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.functions.jsontext import strict_object
from speakerprint.functions.mixing import coin
from speakerprint.functions.text import strip, unfence

# Verdict thresholds (win rate in percent) and the default of a broken judgement.
VERDICTS = {"scored": (65.0, 50.0), "picked": (70.0, 50.0)}
DEFAULT_SCORE, DEFAULT_WINNER, DEFAULT_REASON = 5.0, "tie", "Parse error"


def assign_blind(trials: DataFrame, trial: str = "trial_id", seed: int = 42) -> DataFrame:
    """Add ``flip``: true shows the fingerprinted reply second (as Y), by a seeded coin."""
    return trials.withColumn("flip", coin(trial, str(seed)) == 1)


def parse_judgement(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``score_x, score_y, winner, reasoning, parse_failed`` from a judge's JSON reply.

    Code fences are removed. A reply that is no JSON object, or misses a key, counts 5 to 5, tie.
    """
    parsed = df.withColumn("__v", strict_object(unfence(reply)))
    def field(name: str, typ: str) -> Column:
        return F.try_variant_get("__v", F.lit(f"$.{name}"), typ)
    parsed = parsed.select(
        *df.columns,
        field("score_x", "double").alias("__x"),
        field("score_y", "double").alias("__y"),
        field("winner", "string").alias("__w"),
        field("reasoning", "string").alias("__r"),
    )
    failed = F.col("__x").isNull() | F.col("__y").isNull() | F.col("__w").isNull() | F.col("__r").isNull()
    def value(name: str, default) -> Column:
        return F.when(failed, F.lit(default)).otherwise(F.col(name))
    return parsed.select(
        *df.columns,
        value("__x", DEFAULT_SCORE).alias("score_x"),
        value("__y", DEFAULT_SCORE).alias("score_y"),
        value("__w", DEFAULT_WINNER).alias("winner"),
        value("__r", DEFAULT_REASON).alias("reasoning"),
        failed.alias("parse_failed"),
    )


def parse_pick(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``pick``: A when the reply starts with A, else B; ``is_error`` marks replies with neither."""
    r = strip(F.coalesce(F.col(reply), F.lit("")))
    return df.withColumn("pick", F.when(r.startswith("A"), "A").otherwise("B")).withColumn(
        "is_error", ~(r.startswith("A") | r.startswith("B"))
    )


def unblind(df: DataFrame) -> DataFrame:
    """Map X/Y back: adds ``score_with, score_without, fingerprint_won, tie``."""
    flip = F.col("flip")
    return (
        df.withColumn("score_with", F.when(flip, F.col("score_y")).otherwise(F.col("score_x")))
        .withColumn("score_without", F.when(flip, F.col("score_x")).otherwise(F.col("score_y")))
        .withColumn("fingerprint_won", F.col("winner") == F.when(flip, "Y").otherwise("X"))
        .withColumn("tie", F.col("winner") == "tie")
    )


def unblind_pick(df: DataFrame) -> DataFrame:
    """Map an A/B pick back: A is the fingerprinted reply unless ``flip``."""
    return df.withColumn("fingerprint_won", (F.col("pick") == "A") != F.col("flip"))


def _statistics() -> list[Column]:
    won, tie = F.col("fingerprint_won"), F.col("tie")
    return [
        F.count_if(won).alias("wins"),
        F.count_if(~won & ~tie).alias("losses"),
        F.count_if(tie).alias("ties"),
        F.count(F.lit(1)).alias("total"),
        F.avg("score_with").alias("__w"),
        F.avg("score_without").alias("__o"),
    ]


def _rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    decided = F.col("wins") + F.col("losses")
    w, o = F.col("__w"), F.col("__o")
    return df.select(
        *by,
        "wins",
        "losses",
        "ties",
        "total",
        F.round(w, 2).alias("avg_with"),
        F.round(o, 2).alias("avg_without"),
        F.round(F.when(decided > 0, F.col("wins") / decided * 100).otherwise(0.0), 1).alias("win_rate"),
        F.round(F.when(o > 0, (w - o) / o * 100).otherwise(0.0), 1).alias("lift_pct"),
        F.round(w - o, 2).alias("delta"),
    )


def ab_stats(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Wins, losses, ties, averages, win rate over decided trials, lift and delta per group.

    A winner label that is neither side nor tie counts as a loss. Outputs are rounded, inputs
    of the ratios are not.
    """
    return _rates(df.groupBy(*by).agg(*_statistics()), by)


def ab_rate_all(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Integer win percentage over all trials, ties included."""
    return df.groupBy(*by).agg(
        F.count_if("fingerprint_won").alias("wins"),
        F.count(F.lit(1)).alias("total"),
        F.floor(F.count_if("fingerprint_won") / F.count(F.lit(1)) * 100 + 0.5).cast("bigint").alias("win_rate"),
    )


def verdict(win_rate: str = "win_rate", variant: str = "scored") -> Column:
    high, low = VERDICTS[variant]
    r = F.col(win_rate)
    return F.when(r >= high, "validated").when(r >= low, "marginal").otherwise("not proven")


def compare_models(df: DataFrame, by: Sequence[str] = ("model",), variant: str = "scored") -> DataFrame:
    return ab_stats(df, by).withColumn("verdict", verdict("win_rate", variant))


def combine(df: DataFrame, model: str = "model") -> DataFrame:
    """Two overall figures: ``macro`` (mean of validated models) and ``pooled`` (all trials together)."""
    high = VERDICTS["scored"][0]
    good = ab_stats(df, [model]).where(F.col("win_rate") >= high)
    macro = good.agg(
        F.count(F.lit(1)).alias("models"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("trials"),
        F.avg("win_rate").alias("win_rate"),
        F.avg("avg_with").alias("avg_with"),
        F.avg("avg_without").alias("avg_without"),
    ).select(F.lit("macro").alias("method"), "*")
    per_model = df.groupBy(model).agg(
        F.count_if("fingerprint_won").alias("w"),
        F.count_if(~F.col("fingerprint_won") & ~F.col("tie")).alias("l"),
        F.count(F.lit(1)).alias("t"),
        F.sum("score_with").alias("sw"),
        F.sum("score_without").alias("so"),
    )
    decided = F.sum("w") + F.sum("l")
    pooled = per_model.agg(
        F.count(F.lit(1)).alias("models"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("trials"),
        F.when(decided > 0, F.sum("w") / decided * 100).otherwise(0.0).alias("win_rate"),
        (F.sum("sw") / F.sum("t")).alias("avg_with"),
        (F.sum("so") / F.sum("t")).alias("avg_without"),
    ).select(F.lit("pooled").alias("method"), "*")
    both = macro.unionByName(pooled)
    w, o = F.col("avg_with"), F.col("avg_without")
    return both.withColumn("improvement_pct", F.when(o > 0, (w - o) / o * 100).otherwise(0.0))
