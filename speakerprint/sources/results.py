"""Experiment output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.operators.abtest import compare_models

# Large text columns left out of the slim trial table.
LARGE = ("resp_with", "resp_without", "fingerprint")


def write_results(trials: DataFrame, path: str, experiment: str, mode: str = "overwrite") -> dict[str, str]:
    """Write ``summary`` (one row per model), ``trials`` (slim) and ``full_responses``; returns their paths."""
    root = path.rstrip("/")
    tables = {
        "summary": compare_models(trials, ["model"]),
        "trials": trials.drop(*LARGE),
        "full_responses": trials,
    }
    out = {}
    for name, df in tables.items():
        out[name] = f"{root}/{name}"
        stamped = df.withColumn("experiment", F.lit(experiment)).withColumn("written_at", F.current_timestamp())
        writer = stamped.write.mode(mode).option("compression", "zstd")
        (writer if name == "summary" else writer.partitionBy("model")).parquet(out[name])
    return out


def read_results(spark: SparkSession, path: str, table: str = "trials", model: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path.rstrip('/')}/{table}")
    return df if model is None else df.where(F.col("model") == model)
