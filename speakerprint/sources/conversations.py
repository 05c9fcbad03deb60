"""Conversation readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speakerprint.operators.scale import SMALL_TABLE
from speakerprint.session import materialised

MESSAGES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, line, value)``: lines of text files with their number in the file, from 0.

    Spark reads a file in blocks, each by one task from its start to its end. A row's place in its block and the counts of the
    blocks before it give its number, so that equal lines stay apart; the lines themselves are not shuffled. Settings of how files are split must not
    change between making this frame and using it.
    """
    at, block = F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("start")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block, at, "value")
    counts = materialised(raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")), "line-blocks")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")
    offsets = counts.select("file", "start", shift.alias("shift"))
    offsets = F.broadcast(offsets) if counts.count() <= SMALL_TABLE else offsets
    return raw.join(offsets, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def read_messages(spark: SparkSession, path: str | list[str], format: str = "json", lines: bool = False, key: str = "source") -> DataFrame:
    """Messages ``(source, turn, role, text, bare)`` of JSON conversations, or a message table.

    A document is an array of ``{role, content}`` objects, an array of strings, or an object
    with ``messages``; with ``lines`` every line is one document, named by its file and line number, so that
    equal lines are different conversations. ``key`` names the column of the document. Strings have no role and
    ``bare`` = true. The array index is ``turn``. Documents that do not parse or hold no message
    give one row with null turn and ``error`` set, so that they are reported and not lost.
    ``format="parquet"`` reads an existing ``(conv_id, turn, role, text)`` table.
    """
    if format == "parquet":
        return spark.read.schema(MESSAGES).parquet(*([path] if isinstance(path, str) else path))
    if lines:
        raw = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("source", F.concat_ws("#", "file", "line"))
    else:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    parsed = raw.select("source", F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    items = F.coalesce(F.col("v").try_cast("array<variant>"), F.try_variant_get("v", F.lit("$.messages"), "array<variant>"))
    listed = parsed.select("source", kind.alias("kind"), items.alias("items"))
    rows = listed.select("source", "kind", F.posexplode_outer("items").alias("turn", "m"))
    is_object = F.schema_of_variant("m").startswith("OBJECT")
    return rows.select(
        F.col("source").alias(key),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(is_object, F.try_variant_get("m", F.lit("$.role"), "string")).alias("role"),
        F.when(is_object, F.try_variant_get("m", F.lit("$.content"), "string")).otherwise(F.col("m").try_cast("string")).alias("text"),
        F.coalesce(~is_object, F.lit(False)).alias("bare"),
        F.when(F.col("kind").isNull(), "not JSON").when(F.col("turn").isNull(), "no messages").alias("error"),
    )
