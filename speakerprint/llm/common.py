"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speakerprint.session import materialised, ship

__all__ = ["as_bytes", "content_key", "let", "map_batches", "materialised", "pieces", "ship", "text_blocks"]


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer doesn't merge projections across it, so that an array used many times, or
    inside a lambda, is computed once per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def content_key(text: Column) -> Column:
    """16 bytes that stand for a text: equal texts share a key, whatever their ids are."""
    return F.unhex(F.md5(as_bytes(text)))


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what Python holds at a time is small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one slice; None gives no rows."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def text_blocks(docs: DataFrame, key: list[str], block_bytes: int, name: str = "block") -> DataFrame:
    """Deal documents into blocks of about ``block_bytes`` of text.

    ``docs`` has a column ``text``; the number of blocks follows the bytes of all texts. Blocks
    are hashes of ``key`` and stay the same when a task is repeated.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = int(total // block_bytes) + 1
    return docs.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")).repartition(blocks, name)
