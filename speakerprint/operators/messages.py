"""Message selection, positions, chunks, prompt windows, samples and splits.

Messages are ``(conv_id, turn, role, text)``; ``turn`` is an integer, unique per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speakerprint.functions.mixing import mix
from speakerprint.operators.scale import BLOCK_ROWS, ranked

# Fixed values of the prompt windows: messages kept, characters kept, line template.
IDENTITY_MESSAGES, IDENTITY_CHARS = 6, 120
SKILL_MESSAGES, SKILL_CHARS = 10, 150
JUDGE_MESSAGES = 4
CHUNK_MESSAGES = 50
SAMPLE_LOW, SAMPLE_HIGH = 50, 100
TRAIN_FRACTION = 0.7


def select_messages(df: DataFrame, user_only: bool = True, bare: str | None = None) -> DataFrame:
    """Keep user messages; a missing role is dropped, bare strings are always kept.

    ``bare`` names a boolean column that marks messages read from bare strings.
    """
    if not user_only:
        return df
    keep = F.col("role") == "user"
    return df.where(keep | F.col(bare)) if bare else df.where(keep)


def nonempty(df: DataFrame) -> DataFrame:
    """Keep every role, drop only missing or empty text (white space counts as text)."""
    return df.where(F.col("text").isNotNull() & (F.col("text") != ""))


def with_position(df: DataFrame, key: str = "conv_id", order: str = "turn", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``pos`` (index after filtering), ``n`` and ``shift`` = n - 1 - pos."""
    out = ranked(df, [key], order, pos="pos", total="n", block_rows=block_rows)
    return out.withColumn("shift", F.col("n") - 1 - F.col("pos"))


def with_chunk(df: DataFrame, size: int = CHUNK_MESSAGES, pos: str = "pos") -> DataFrame:
    return df.withColumn("chunk", F.expr(f"{pos} div {size}"))


def prompt_lines(df: DataFrame, kind: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per line of a prompt window: ``(key, i, line)``.

    ``identity``, ``skill`` and ``judge`` take the head of each conversation, which Spark cuts
    to a few rows per task before the shuffle. ``train`` numbers every message and therefore
    stays in row form, however long a conversation is.
    """
    if kind == "train":
        numbered = ranked(df, [key], order, pos="__p", total=None).withColumn("i", F.col("__p") + 1)
        return numbered.select(key, "i", F.concat(F.col("i"), F.lit('. "'), F.col("text"), F.lit('"')).alias("line"))
    heads = {"identity": IDENTITY_MESSAGES, "skill": SKILL_MESSAGES, "judge": JUDGE_MESSAGES}
    first = Window.partitionBy(key).orderBy(order)
    head = df.withColumn("i", F.row_number().over(first)).where(F.col("i") <= heads[kind])
    text = F.coalesce(F.col("text"), F.lit(""))
    if kind == "identity":
        head = head.where(F.col("role") == "user")
        line = F.concat(F.col("i"), F.lit('. "'), F.substring(text, 1, IDENTITY_CHARS), F.lit('"'))
    elif kind == "skill":
        label = F.when(F.col("role") == "user", "User").otherwise("Assistant")
        line = F.concat(label, F.lit(": "), F.substring(text, 1, SKILL_CHARS))
    else:
        line = F.concat(F.lit("Example "), F.col("i"), F.lit(': "'), text, F.lit('"'))
    return head.select(key, F.col("i").cast("bigint").alias("i"), line.alias("line"))


def prompt_window(df: DataFrame, kind: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Newline-joined prompt window per conversation; only for the kinds with a fixed head."""
    if kind == "train":
        raise ValueError("a training window has no size bound; use prompt_lines(df, 'train')")
    lines = prompt_lines(df, kind, key, order).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"), F.count(F.lit(1)).alias("n_lines")
    )
    return lines.select(key, "n_lines", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("window"))


def sample_messages(
    df: DataFrame, low: int = SAMPLE_LOW, high: int = SAMPLE_HIGH, seed: int = 42, key: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """At most ``high`` messages per conversation, drawn by a seeded hash of (conversation, turn).

    ``sample_rank`` is the draw order; ``enough`` tells whether the conversation reaches ``low``.
    """
    draw = df.withColumn("__draw", mix(f"{key} * 31 + {seed}", order))
    pick = Window.partitionBy(key).orderBy("__draw", order)
    kept = draw.withColumn("sample_rank", F.row_number().over(pick)).where(F.col("sample_rank") <= high)
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    return kept.withColumn("enough", size >= low).drop("__draw")


def split(df: DataFrame, key: str, order: str, fraction: float = TRAIN_FRACTION, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``part``: the first floor(fraction * n) messages of a speaker train, the rest are held out."""
    out = ranked(df, [key], order, pos="pos", total="n", block_rows=block_rows)
    percent = round(fraction * 100)
    cut = F.expr(f"(n * {percent}) div 100")
    return out.withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("heldout"))
