"""Session helpers: local defaults for tests and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: JSON objects with equal keys are read as scripts do: the last one counts.
LAST_KEY = "spark.sql.variant.allowDuplicateKeys"


def get_session(app: str = "speakerprint", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(LAST_KEY, "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder below ``spark.checkpoint.dir`` (the folder all executors share).

    Only where the session names none (local tests) a temporary folder is chosen, once per
    Spark context, and removed when the program ends.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        sc = spark.sparkContext
        root = getattr(sc, "_speakerprint_scratch", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
            root = sc._speakerprint_scratch = tempfile.mkdtemp(prefix="speakerprint-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: costly rows are computed once and
    survive the loss of executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver was started, and the last of equal JSON keys count."""
    sc = spark.sparkContext
    spark.conf.set(LAST_KEY, "true")
    if getattr(sc, "_speakerprint_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="speakerprint-")
    target = os.path.join(folder, "speakerprint.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(path, f)
                    archive.write(full, os.path.join("speakerprint", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._speakerprint_shipped = True
