"""Ground-truth task trials: scoring rules, paired outcomes, statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.functions.jsontext import bound, script_text, strict_object
from speakerprint.functions.text import strip, unfence
from speakerprint.functions.vectors import as_col

# Number tokens, and per gate the lowest lift %, helped count and shown trials.
NUMBER = r"(\d+\.?\d*)"
GATES = {"easy": (5.0, 0), "hard": (10.0, 3)}
GATE_TRIALS = 20


def score_exact(reply: str | Column, answer: str | Column) -> Column:
    """The trimmed reply starts with the answer, in any case ("negatively" passes for "negative")."""
    return F.startswith(F.lower(strip(reply)), F.lower(as_col(answer)))


def score_contains(reply: str | Column, answers: str | Column) -> Column:
    """Any accepted answer occurs in the reply, in any case."""
    r = F.lower(strip(reply))
    return F.exists(as_col(answers), lambda a: F.contains(r, F.lower(a)))


def score_numeric(reply: str | Column, answer: str | Column) -> Column:
    """A number token of the reply equals the answer as text: "66." and "66.0" are not "66"."""
    return F.array_contains(F.regexp_extract_all(strip(reply), F.lit(NUMBER), F.lit(1)), as_col(answer))


def score_json(reply: str | Column, expected: str | Column) -> Column:
    """The reply is one JSON object, fences aside, whose values equal every expected text in any case."""
    found = strict_object(unfence(reply, any_case=True)).try_cast("map<string,variant>")

    def same(texts: Column, e: Column) -> Column:
        text = F.when(F.map_contains_key(texts, e["key"]), F.lower(F.coalesce(script_text(F.element_at(texts, e["key"])), F.lit("null"))))
        return texts.isNotNull() & F.coalesce(F.coalesce(text, F.lit("undefined")) == F.lower(e["value"]), F.lit(False))

    return bound(found, lambda texts: F.forall(F.map_entries(as_col(expected)), lambda e: same(texts, e)))


def score_tasks(df: DataFrame, reply: str = "reply", out: str = "ok") -> DataFrame:
    """Score replies by the rule each case names: ``scoring`` in exact, contains, numeric, json.

    Cases carry ``answer`` (exact, numeric), ``answers`` (contains) and ``answer_obj`` (json).
    Anything that cannot be scored is false.
    """
    r = F.coalesce(F.col(reply), F.lit(""))
    rule = F.col("scoring")
    ok = (
        F.when(rule == "exact", score_exact(r, "answer"))
        .when(rule == "contains", score_contains(r, "answers"))
        .when(rule == "numeric", score_numeric(r, "answer"))
        .when(rule == "json", score_json(r, "answer_obj"))
    )
    return df.withColumn(out, F.coalesce(ok, F.lit(False)))


def paired_outcomes(df: DataFrame, with_: str = "ok_with", without: str = "ok_without") -> DataFrame:
    w, o = F.col(with_), F.col(without)
    return (
        df.withColumn("helped", w & ~o).withColumn("hurt", ~w & o).withColumn("both_ok", w & o).withColumn("both_bad", ~w & ~o)
    )


def task_stats(df: DataFrame, by: str = "task") -> DataFrame:
    """Successes with and without, n, delta and paired counts per task; a null task is the overall row."""
    paired = paired_outcomes(df)
    counts = [F.count_if(c).alias(c) for c in ("helped", "hurt", "both_ok", "both_bad")]
    return paired.rollup(by).agg(
        F.count_if("ok_with").alias("n_with"),
        F.count_if("ok_without").alias("n_without"),
        F.count(F.lit(1)).alias("n"),
        (F.count_if("ok_with") - F.count_if("ok_without")).alias("delta"),
        *counts,
    )


def task_gate(stats: DataFrame, variant: str = "hard") -> DataFrame:
    """Relative lift (one decimal, 0 without a success) and whether the gate is passed and shown."""
    lowest, helped = GATES[variant]
    w, o = F.col("n_with"), F.col("n_without")
    lift = F.round(F.when(o > 0, (w - o) / o * 100).otherwise(0.0), 1)
    passed = (F.col("lift_pct") > lowest) & (w > o) & (F.col("helped") >= helped)
    return stats.withColumn("lift_pct", lift).withColumn("passed", passed).withColumn("shown", F.col("n") >= GATE_TRIALS)
