"""Similarity statistics and the speaker-identification experiment."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.functions.mixing import pick, pick_sql
from speakerprint.functions.vectors import bit_cosine
from speakerprint.operators.basis import Basis, fit_shared_basis, project
from speakerprint.operators.hypervectors import HV_DIM, HV_SEED, hv_bundle, hv_encode_prefixes
from speakerprint.operators.scale import SMALL_TABLE, dense_index, exact_median, ranked, running_sums
from speakerprint.session import materialised

# Fixed values of the experiment.
TRIALS, CANDIDATES, REPORT_EVERY = 1_000, 10, 100
ABLATION_K = (1, 2, 4, 8, 16, 32)


def similarity_stats(df: DataFrame, by: Sequence[str] = (), value: str = "score") -> DataFrame:
    """n, mean, median, best, worst, population deviation and counts at 0.7 and 0.6 or above."""
    by = list(by)
    v = F.col(value)
    stats = df.groupBy(*by).agg(
        F.count(v).alias("n_messages"),
        F.avg(v).alias("average"),
        F.max(v).alias("best"),
        F.min(v).alias("worst"),
        F.stddev_pop(v).alias("std_dev"),
        F.count_if(v >= 0.7).alias("above_0_7"),
        F.count_if(v >= 0.6).alias("above_0_6"),
    )
    median = exact_median(df, by, value)
    if by:
        return stats.join(median, by, "left")
    return stats.withColumn("median", median.scalar())


def floyd_sample(trial: str, size: str, c: int, seed: int) -> Column:
    """``c`` distinct numbers below ``size``, uniform over all subsets (Floyd's algorithm)."""
    draw = pick_sql(trial, f"(j + {seed} * 1000)", "j + 1")
    return F.expr(
        f"aggregate(sequence(CAST({size} AS BIGINT) - {c}, CAST({size} AS BIGINT) - 1), CAST(array() AS ARRAY<BIGINT>),"
        f" (acc, j) -> concat(acc, array(if(array_contains(acc, {draw}), j, {draw}))))"
    )


def make_trials(speakers: DataFrame, by: str, n: int = TRIALS, c: int = CANDIDATES, seed: int = 42) -> DataFrame:
    """``c`` distinct candidate speakers per trial, one of them the truth: ``(trial, slot, by, is_truth)``.

    Speakers are numbered without a global sort and drawn by number, so the work is n * c rows
    and one join, whatever the number of speakers. Slot 0 is the truth.
    """
    numbered = dense_index(speakers, by, "__idx", "__size")
    size = numbered.agg(F.max("__size"))
    spark = speakers.sparkSession
    count = size.first()[0] or 0
    if count < c:
        raise ValueError(f"{c} candidates need at least {c} speakers, found {count}")
    trials = spark.range(n).withColumnRenamed("id", "trial").withColumn("__size", F.lit(count).cast("bigint"))
    drawn = trials.withColumn("__set", floyd_sample("trial", "__size", c, seed)).withColumn(
        "__truth", pick("trial", f"{seed} + 7", f"{c}").cast("int")
    )
    slots = drawn.select("trial", "__truth", F.posexplode("__set").alias("__j", "__idx"))
    slot = F.when(F.col("__j") == F.col("__truth"), 0).when(F.col("__j") < F.col("__truth"), F.col("__j") + 1).otherwise(F.col("__j"))
    return slots.join(numbered.select("__idx", by), "__idx").select(
        "trial", slot.cast("bigint").alias("slot"), by, (F.col("__j") == F.col("__truth")).alias("is_truth")
    )


def trial_queries(trials: DataFrame, heldout: DataFrame, by: str, order: str, seed: int = 42) -> DataFrame:
    """One held-out message of the true speaker per trial: ``(trial, truth, other heldout columns)``.

    The message is drawn by its position, so only drawn rows go on to be encoded. Few drawn ids, as is usual, are broadcast: then
    other held-out rows are left where they are read.
    """
    placed = ranked(heldout.select(by, order), [by], order, pos="__p", total=None)
    sizes = heldout.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    truth = trials.where("is_truth").select("trial", by).join(sizes, by)
    drawn = truth.withColumn("__p", pick("trial", f"{seed} + 11", "__n")).join(placed, [by, "__p"])
    drawn = materialised(drawn.select("trial", by, order), "drawn")
    small = drawn.count() <= SMALL_TABLE
    return heldout.join(F.broadcast(drawn) if small else drawn, [by, order]).withColumnRenamed(by, "truth")


def run_identification(
    trials: DataFrame, queries: DataFrame, seeds: DataFrame, by: str, dim: int = HV_DIM, group: Sequence[str] = ()
) -> DataFrame:
    """Answer every trial: ``(trial, truth, winner, score, correct)``; the first slot wins ties.

    ``queries`` is :func:`trial_queries` with packed ``bits``, ``seeds`` one row per speaker.
    ``group`` columns (say, a component count) run the same trials once per group. A trial
    meets only its own c candidates.
    """
    group = list(group)
    query = queries.select("trial", *group, "truth", F.col("bits").alias("__q"))
    sides = trials.join(seeds.select(by, *group, F.col("bits").alias("__c")), by)
    scored = query.join(sides, ["trial", *group]).select(
        "trial", *group, "truth", F.col(by).alias("__who"), F.col("slot"), bit_cosine("__q", "__c", dim).alias("score")
    )
    best = F.max_by(F.struct("__who", "score"), F.struct("score", (-F.col("slot")).alias("s"))).alias("__best")
    won = scored.groupBy("trial", *group, "truth").agg(best)
    return won.select(
        "trial", *group, "truth", F.col("__best.__who").alias("winner"), F.col("__best.score").alias("score"),
        (F.col("truth") == F.col("__best.__who")).alias("correct"),
    )


def accuracy(answers: DataFrame, c: int = CANDIDATES, group: Sequence[str] = ()) -> DataFrame:
    """``n_trials, n_correct, accuracy, baseline`` = 1/c and ``lift`` = accuracy * c."""
    rate = F.col("n_correct") / F.col("n_trials")
    return (
        answers.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("correct").alias("n_correct"))
        .withColumn("accuracy", rate)
        .withColumn("baseline", F.lit(1.0 / c))
        .withColumn("lift", rate * c)
    )


def running_accuracy(answers: DataFrame, every: int = REPORT_EVERY) -> DataFrame:
    """Accuracy after each full block of ``every`` trials: ``(trials, correct, running_accuracy)``."""
    blocks = (
        answers.withColumn("b", F.expr(f"trial div {every}"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("k"), F.count_if("correct").alias("c"))
    )
    summed = running_sums(blocks, [], "b", {"k": "trials", "c": "correct"})
    full = summed.where(F.col("k") == every)
    return full.select("trials", "correct", (F.col("correct") / F.col("trials")).alias("running_accuracy"))


def _log10_tail(k: int, n: int, p: float) -> float:
    """log10 P[X >= k] for X ~ Binomial(n, p), summed in log space until terms vanish."""
    if k <= 0:
        return 0.0
    if k > n or p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return 0.0

    def log_term(i: np.ndarray) -> np.ndarray:
        lg = np.vectorize(math.lgamma)
        return math.lgamma(n + 1) - lg(i + 1.0) - lg(n - i + 1.0) + i * math.log(p) + (n - i) * math.log1p(-p)

    upper = k > n * p
    start, stop, step = (k, n + 1, 4096) if upper else (k - 1, -1, -4096)
    peak, total, i = None, 0.0, start
    while (i < stop) if upper else (i > stop):
        idx = np.arange(i, min(i + step, stop)) if upper else np.arange(i, max(i + step, stop), -1)
        t = log_term(idx.astype(np.float64))
        peak = float(t.max()) if peak is None else peak
        part = float(np.exp(t - peak).sum())
        total += part
        if part < total * 1e-18:
            break
        i += step
    log_sum = peak + math.log(total)
    return (log_sum if upper else math.log1p(-min(1.0, math.exp(log_sum))) if log_sum < 0 else -math.inf) / math.log(10)


def binomial_test(df: DataFrame, k: str = "n_correct", n: str = "n_trials", p0: str = "baseline") -> DataFrame:
    """Add ``log10_p``: one-sided binomial p-value of k or more successes, as a decimal logarithm."""

    @F.pandas_udf("double")
    def tail(ks: pd.Series, ns: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([_log10_tail(int(a), int(b), float(c)) for a, b, c in zip(ks, ns, ps)])

    return df.withColumn("log10_p", tail(F.col(k), F.col(n), F.col(p0)))


def welch_t(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Welch's t and degrees of freedom between the true and false rows of ``group``."""
    g, v = F.col(group), F.col(value)
    parts = []
    for name, side in (("a", g), ("b", ~g)):
        x = F.when(side, v)
        parts += [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.var_samp(x).alias(f"var_{name}")]
    se = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(se[0] + se[1])
    freedom = (se[0] + se[1]) * (se[0] + se[1]) / (se[0] * se[0] / (F.col("n_a") - 1) + se[1] * se[1] / (F.col("n_b") - 1))
    return df.groupBy(*by).agg(*parts).withColumn("t", t).withColumn("df", freedom)


def k_ablation(
    train: DataFrame,
    heldout: DataFrame,
    by: str,
    order: str,
    vec: str = "embedding",
    ks: Sequence[int] = ABLATION_K,
    n: int = TRIALS,
    c: int = CANDIDATES,
    dim: int = HV_DIM,
    seed: int = HV_SEED,
    bind: str = "bag",
    basis: Basis | None = None,
) -> DataFrame:
    """Identification accuracy per number of principal components, on the same trials.

    One shared basis is fitted on the training rows, unless it is given. A row is projected once, and the signs for all
    ``ks`` come from running sums over its components (:func:`hv_encode_prefixes`). A k above the components there are uses all of them; its
    row is kept.
    """
    ks = sorted(set(ks))
    basis = fit_shared_basis(train, vec, max(ks)) if basis is None else basis

    def encoded(df: DataFrame) -> DataFrame:
        return hv_encode_prefixes(project(df, basis, vec), ks, "projected", dim=dim, seed=seed)

    seeds = hv_bundle(encoded(train.select(by, order, vec)), [by, "k"], order, dim, bind=bind, keep_acc=False)
    trials = make_trials(train.select(by), by, n, c)
    queries = encoded(trial_queries(trials, heldout.select(by, order, vec), by, order))
    answers = run_identification(trials, queries, seeds, by, dim, group=["k"])
    return accuracy(answers, c, group=["k"])
