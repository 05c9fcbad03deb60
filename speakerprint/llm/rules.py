"""Quality rules as a ledger: every rule is evaluated once, policies are masks over its bits.

``ledger`` gives each document its measurements and one failure bit per rule. A policy is a
named set of rules; applying another version, or asking what a rule alone removes, reads the
ledger and never the texts. All expressions are native.

Words are runs of characters other than space and U+0009-U+000D. A null or empty text has no
words. Repeated rows are judged one by one; columns of the input do not reach the ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import let

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

#: Rule name to its condition over the measurements; the bit is the position in this table.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "capitals"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals"),
}
CURRENT = "v2"


def mask(rules: Sequence[str]) -> int:
    """Bit mask of a set of rules."""
    return sum(1 << list(RULES).index(r) for r in set(rules))


def _removed(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _size(a: str) -> Column:
    return F.size(a).cast("bigint")


def measured(docs: DataFrame, text: str = "text", name: str = "__m") -> DataFrame:
    """``docs`` with one struct column of measurements.

    ``n_repeat_words`` counts the words in 5-word windows found twice or more in the text.
    Windows are 64-bit hashes. Only texts with a repeated window sort them, with their
    positions; flagged positions then cover words as a sum of capped gaps.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = let(docs, __words=F.array_remove(F.split(t, SPACE), ""), __lines=F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = let(df, __hashes=F.transform("__words", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("__hashes") - (WINDOW - 1), F.lit(0))
    shifted = [F.slice("__hashes", F.lit(i + 1), n) for i in range(WINDOW)]
    df = let(df, __windows=F.transform(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)]), lambda z: F.xxhash64(z)))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = let(df, __sorted=F.when(repeats, placed).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>")))
    last = F.greatest(F.size("__sorted") - 1, F.lit(0))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    around = F.arrays_zip(
        F.col("__sorted").alias("a"),
        F.concat(none, F.slice("__sorted", F.lit(1), last)).alias("b"),
        F.concat(F.slice("__sorted", F.lit(2), last), none).alias("c"),
    )
    flagged = F.filter(around, lambda z: F.coalesce(z.a.h == z.b.h, F.lit(False)) | F.coalesce(z.a.h == z.c.h, F.lit(False)))
    flagged = F.when(F.size("__sorted") > 0, F.sort_array(F.transform(flagged, lambda z: z.a.i))).otherwise(F.expr("array()").cast("array<int>"))
    df = let(df, __starts=flagged)
    more = F.greatest(F.size("__starts") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("__starts", F.lit(2), more), F.slice("__starts", F.lit(1), more), lambda x, y: F.least(F.lit(WINDOW), x - y))
    covered = F.when(F.size("__starts") > 0, F.lit(WINDOW) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
    out = F.struct(
        _size("__words").alias("n_words"),
        (F.length(t) - _removed(t, BLANKS)).cast("bigint").alias("word_chars"),
        _removed(t, SYMBOLS).cast("bigint").alias("n_symbols"),
        _size("__lines").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        _removed(t, CAPITALS).cast("bigint").alias("n_capitals"),
    )
    return df.withColumn(name, out).drop("__words", "__lines", "__hashes", "__windows", "__sorted", "__starts")


def failure_bits(measurements: str = "__m") -> Column:
    """One bit per failed rule."""
    fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES.values()):
        condition = " ".join(f"{measurements}.{w}" if w in fields else w for w in rule.split())
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measurements..., bits): one row per document."""
    df = measured(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")))
    df = df.select("doc_id", "__m", failure_bits("__m").alias("bits"))
    return df.select("doc_id", "__m.*", "bits")


def apply_policies(led: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """The ledger with a boolean ``kept_<version>`` per policy."""
    kept = {f"kept_{v}": F.col("bits").bitwiseAND(F.lit(mask(r))) == 0 for v, r in policies.items()}
    return led.withColumns(kept)


def ablations(led: DataFrame, rules: Sequence[str] = POLICIES[CURRENT]) -> DataFrame:
    """Per rule of a policy: (rule, failed, only): documents that fail it, and that no other rule rejects.

    Documents are first counted by their bits, of which there are at most 2^rules.
    """
    chosen = mask(rules)
    counted = led.groupBy(F.col("bits").bitwiseAND(F.lit(chosen)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("bigint").alias("bit")) for r in RULES if r in set(rules)])
    each = counted.select("bits", "n", F.inline(table))
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(F.lit(0))).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(F.lit(0))).alias("only"),
        (F.bit_or(F.when(failed, F.col("bits")).otherwise(F.lit(0).cast("bigint")))).alias("together"),
    )


def passing(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    df = measured(docs, text)
    ok = failure_bits("__m").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0
    return df.where(ok).select(*[F.col(f"`{c}`") for c in docs.columns])
