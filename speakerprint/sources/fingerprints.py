"""Fingerprint tables: one row per speaker instead of one file per speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_fingerprints(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write fingerprint rows partitioned by ``fp_type`` and return their stored statistics.

    The returned frame reads back what was written: messages, vector KB and, where present,
    the variance of the first components.
    """
    if "fp_type" not in df.columns:
        df = df.withColumn("fp_type", F.lit("identity"))
    df.write.mode(mode).option("compression", "zstd").partitionBy("fp_type").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stats = [F.count(F.lit(1)).alias("fingerprints"), F.sum("n").alias("messages")]
    if "bits" in stored.columns:
        stats.append((F.sum(F.size("bits")) * 8 / 1024).alias("vector_kb"))
    if "variance_k4" in stored.columns:
        stats.append(F.avg("variance_k4").alias("variance_k4"))
    return stored.groupBy("fp_type").agg(*stats)


def read_fingerprints(spark: SparkSession, path: str, fp_type: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Read a fingerprint table; ``fp_type`` prunes partitions, ``columns`` prunes the scan."""
    df = spark.read.parquet(path)
    if fp_type is not None:
        df = df.where(F.col("fp_type") == fp_type)
    return df.select(*columns) if columns else df


def read_fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows from single-conversation JSON fingerprints (flat form with a list of +-1 values)."""
    schema = (
        "version string, n_messages bigint, embed_dim int, n_components int, pca_mean array<double>,"
        " pca_components array<array<double>>, pca_explained_variance_ratio array<double>, hdc_dim int, hdc_seed array<double>"
    )
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    fp = text.select("source", F.from_json("value", schema).alias("f")).select("source", "f.*")
    first_four = F.aggregate(F.slice("pca_explained_variance_ratio", 1, 4), F.lit(0.0), lambda s, x: s + x)
    word = F.transform(
        F.sequence(F.lit(0), F.expr("(size(hdc_seed) - 1) div 64")),
        lambda w: F.aggregate(
            F.sequence(F.lit(0), F.least(F.lit(63), F.size("hdc_seed") - 1 - w * 64)),
            F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(
                F.when(F.get("hdc_seed", w * 64 + b) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(
                    F.lit(0).cast("bigint")
                )
            ),
        ),
    )
    return fp.withColumn("bits", F.when(F.size("hdc_seed") > 0, word)).withColumn("variance_k4", first_four)


def write_registry(df: DataFrame, path: str, version: int) -> str:
    """Write a whole registry version next to the earlier ones; readers switch by path."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    return target
