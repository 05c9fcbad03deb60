"""Fingerprints kept current from a message stream.

Each micro-batch writes unrotated partial sums under its own ``batch_id`` folder, so a
repeated batch overwrites itself. Sums are commutative: messages may arrive in any order.
Reading folds the partials of a speaker; compaction adds a snapshot that replaces many small ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.query import StreamingQuery

from speakerprint.operators.hypervectors import (
    BUNDLE_ROWS,
    HV_DIM,
    HV_SEED,
    Center,
    fold_partials,
    hv_encode,
    partial_sums,
)
from speakerprint.operators.scale import block_of


def stream_fingerprints(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    by: str = "conv_id",
    order: str = "turn",
    vec: str = "embedding",
    dim: int = HV_DIM,
    seed: int = HV_SEED,
    center: Center | None = None,
    event_time: str | None = None,
    watermark: str = "1 hour",
    block_rows: int = BUNDLE_ROWS,
) -> DataStreamWriter:
    """Writer that adds every new message to its speaker's stored partial sums.

    A message's position is its absolute ``order`` value. Repeats of (by, order) are dropped;
    with ``event_time`` the state is bounded by the watermark, without it it grows with the
    stream. Rows behind the watermark are left out; :func:`run_available` counts them. Start it with the trigger you want.
    """
    if event_time:
        unique = messages.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([by, order])
    else:
        unique = messages.dropDuplicates([by, order])

    def write(batch: DataFrame, batch_id: int) -> None:
        encoded = hv_encode(batch.where(F.col(vec).isNotNull()).select(by, order, vec), vec, dim=dim, seed=seed, center=center)
        data = encoded.withColumn("pos", F.col(order).cast("bigint")).withColumn("__block", block_of(order, block_rows))
        partials = partial_sums(data.select(by, "__block", "pos", "bits"), [by], dim)
        partials.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


@dataclass(frozen=True)
class StreamCounts:
    """What the batches of a run saw: rows read, rows that came after the watermark and were left out, and the most rows of state held."""

    rows: int
    late: int
    most_state: int

    def then(self, later: StreamCounts) -> StreamCounts:
        return StreamCounts(self.rows + later.rows, self.late + later.late, max(self.most_state, later.most_state))


def counts_of(query: StreamingQuery) -> StreamCounts:
    """Counts over the batches that a query still reports (``spark.sql.streaming.numRecentProgressUpdates``)."""
    rows = late = most = 0
    for progress in query.recentProgress:
        rows += progress.numInputRows
        for state in progress.stateOperators:
            late += state.numRowsDroppedByWatermark
            most = max(most, state.numRowsTotal)
    return StreamCounts(rows, late, most)


def run_available(writer: DataStreamWriter) -> StreamCounts:
    """Work through everything that is there, batch by batch, and stop; a later run goes on from there, its watermark included."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return counts_of(query)


def _current(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot and the batches after it; older folders are left out by their names.

    A snapshot of all batches up to u is stored as ``batch_id=-(u + 1)``.
    """
    partials = spark.read.parquet(path)
    upto = partials.agg(F.max(-F.col("batch_id") - 1)).first()[0]
    if upto is None or upto < 0:
        return partials
    return partials.where((F.col("batch_id") == -(upto + 1)) | (F.col("batch_id") > upto))


def read_stream_fingerprints(spark: SparkSession, path: str, by: str = "conv_id", dim: int = HV_DIM) -> DataFrame:
    """Current seeds ``(by, n, acc, bits)`` from the newest snapshot and the partials stored since."""
    return fold_partials(_current(spark, path).drop("batch_id"), [by], dim)


def compact_partials(spark: SparkSession, path: str, by: str = "conv_id", dim: int = HV_DIM, upto: int | None = None) -> int | None:
    """Fold the partials of all batches up to ``upto`` into a snapshot beside them, and return ``upto``.

    Without ``upto`` all but the newest batch are folded, since a running stream may still be
    writing that one; later batches go on adding to the same folder. A stream may run meanwhile,
    readers should wait until the snapshot is written. Folders of batches up to ``upto`` are not read
    any more afterwards and can be deleted. None means that there was nothing to fold.
    """
    partials = _current(spark, path)
    if upto is None:
        upto = (partials.agg(F.max("batch_id")).first()[0] or 0) - 1
    chosen = partials.where(F.col("batch_id") <= upto)
    if upto < 0 or chosen.where(F.col("batch_id") >= 0).isEmpty():
        return None
    folded = fold_partials(chosen.drop("batch_id"), [by], dim, finish=False)
    folded.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={-(upto + 1)}")
    return upto
