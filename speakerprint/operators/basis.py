"""Principal components: one shared basis, or one per speaker; projection and statistics.

The shared basis comes from Spark ML (distributed Gram matrix, d x d on the driver). Speaker
bases are built from moments per block of messages, folded in a tree, so that no task holds
more than d x d numbers and d rows of a speaker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speakerprint.functions import packed
from speakerprint.functions.vectors import as_col
from speakerprint.operators.scale import blocked, ranked, spread_join

#: Moments folded per task and level.
FOLD = 64
BASIS_BLOCK = 8_192


@dataclass(frozen=True)
class Basis:
    """mean[d], components[k, d] and explained-variance ratio[k]."""

    n: int
    mean: np.ndarray
    components: np.ndarray
    evr: np.ndarray

    def truncated(self, k: int) -> Basis:
        return Basis(self.n, self.mean, self.components[:k], self.evr[:k])


def fixed_signs(components: np.ndarray) -> np.ndarray:
    """Make the largest absolute loading of each component positive, so that bases reproduce."""
    if not components.size:
        return components
    top = np.abs(components).argmax(axis=1)
    sign = np.sign(components[np.arange(len(components)), top])
    return components * np.where(sign == 0, 1, sign)[:, None]


def fit_shared_basis(df: DataFrame, vec: str = "embedding", k: int | None = None) -> Basis:
    """Full (or k-truncated) PCA over all rows, at most min(n, d) components."""
    vectors = df.where(F.col(vec).isNotNull()).select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    row = vectors.select(Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s")).select("s.mean", "s.count").first()
    if row is None or not row["count"]:
        raise ValueError("no vectors to fit a basis on")
    mean = row["mean"].toArray()
    most = min(int(row["count"]), len(mean))
    k = most if k is None else min(k, most)
    if row["count"] < 2:
        return Basis(int(row["count"]), mean, np.zeros((0, len(mean))), np.zeros(0))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    components = fixed_signs(model.pc.toArray().T)
    return Basis(int(row["count"]), mean, components, model.explainedVariance.toArray())


def project(df: DataFrame, basis: Basis, vec: str = "embedding", out: str = "projected", keep_vec: bool = False) -> DataFrame:
    """(x - mean) . components^T with a shared basis; the basis (at most d x d) rides in the task closure."""
    mean, components = basis.mean, basis.components
    keep = [c for c in df.columns if keep_vec or c != vec]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (packed.list_matrix(batch.column(vec), np.float64) - mean) @ components.T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [packed.matrix_list(y, pa.float64())], names=[*keep, out]
                )

    return df.where(F.col(vec).isNotNull()).mapInArrow(apply, schema)


def _solve(n: int, mean: np.ndarray, cov: np.ndarray | None, rows: np.ndarray | None, k: int | None):
    """(components, evr or None) from centred rows when they are few, else from the covariance."""
    most = min(n, len(mean))
    k = most if k is None else min(k, most)
    if n < 2:
        return np.zeros((0, len(mean))), None
    if rows is not None:
        _, s, vt = np.linalg.svd(rows - mean, full_matrices=False)
        value, components = s**2, vt
    else:
        value, vectors = np.linalg.eigh(cov)
        value, components = np.clip(value[::-1], 0, None), vectors[:, ::-1].T
    total = value.sum()
    return fixed_signs(components[:k]), (value[:k] / total if total > 0 else None)


def fit_speaker_bases(
    df: DataFrame, by: str, order: str, vec: str = "embedding", k: int | None = None, block_rows: int = BASIS_BLOCK
) -> DataFrame:
    """One PCA per speaker: ``(by, n, d, k, mean, components, evr, degenerate)``.

    A speaker with one message has no variance: no component, null ratios, degenerate = true.
    """
    placed = ranked(df.where(F.col(vec).isNotNull()).select(by, order, vec), [by], order, total=None, block_rows=block_rows, keep_block=True)
    by_type = df.schema[by].dataType.simpleString()
    basis_schema = (
        f"`{by}` {by_type}, n bigint, d int, k int, mean array<double>, components array<array<double>>,"
        " evr array<double>, degenerate boolean"
    )

    def basis_row(key: pa.Scalar, n: int, mean: np.ndarray, cov, rows) -> pa.RecordBatch:
        components, evr = _solve(n, mean, cov, rows, k)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key.as_py()], type=key.type),
                pa.array([n], pa.int64()),
                pa.array([len(mean)], pa.int32()),
                pa.array([len(components)], pa.int32()),
                pa.array([mean.tolist()], pa.list_(pa.float64())),
                pa.array([components.tolist()], pa.list_(pa.list_(pa.float64()))),
                pa.array([None if evr is None else evr.tolist()], pa.list_(pa.float64())),
                pa.array([n < 2]),
            ],
            names=[by, "n", "d", "k", "mean", "components", "evr", "degenerate"],
        )

    def moments(batches: Iterator[pa.RecordBatch]):
        """(n, sum, outer or None, rows or None): rows are kept while there are at most d of them."""
        n, total, outer, held = 0, None, None, []
        for batch in batches:
            x = packed.list_matrix(batch.column(vec), np.float64)
            n += len(x)
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
            held.append(x)
            if sum(map(len, held)) > x.shape[1]:
                x = np.concatenate(held)
                outer = x.T @ x if outer is None else outer + x.T @ x
                held = []
        if outer is None:
            return n, total, None, np.concatenate(held)
        for x in held:
            outer += x.T @ x
        return n, total, outer, None

    def short(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer, rows = moments(batches)
        mean = total / n
        yield basis_row(key[0], n, mean, None if outer is None else outer / n - np.outer(mean, mean), rows)

    done = (
        placed.where(F.col("__blocks") == 1).select(by, "__block", vec).groupBy(by, "__block").applyInArrow(short, basis_schema)
    )

    part_schema = f"`{by}` {by_type}, `__block` bigint, n bigint, s array<double>, m array<double>"

    def part_row(key: tuple[pa.Scalar, ...], n: int, s: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x.as_py()], type=x.type) for x in key]
            + [pa.array([n], pa.int64()), packed.matrix_list(s[None, :], pa.float64()), packed.matrix_list(m.reshape(1, -1), pa.float64())],
            names=[by, "__block", "n", "s", "m"],
        )

    def partial(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer, rows = moments(batches)
        yield part_row(key, n, total, rows.T @ rows if outer is None else outer)

    def add(batches: Iterator[pa.RecordBatch]):
        n, s, m = 0, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n += one.column("n")[0].as_py()
                x, y = packed.list_matrix(one.column("s"), np.float64)[0], packed.list_matrix(one.column("m"), np.float64)[0]
                s, m = (x, y.copy()) if s is None else (s + x, m + y)
        return n, s, m

    def level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield part_row(key, *add(batches))

    def final(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = add(batches)
        mean = s / n
        yield basis_row(key[0], n, mean, m.reshape(len(s), -1) / n - np.outer(mean, mean), None)

    parts = placed.where(F.col("__blocks") > 1).select(by, "__block", vec).groupBy(by, "__block").applyInArrow(partial, part_schema)
    for _ in range(2):
        parts = parts.withColumn("__block", F.expr(f"(__block - pmod(__block, {FOLD})) div {FOLD}"))
        parts = parts.groupBy(by, "__block").applyInArrow(level, part_schema)
    return done.unionByName(parts.groupBy(by).applyInArrow(final, basis_schema))


def project_by_speaker(
    df: DataFrame, bases: DataFrame, by: str, order: str, vec: str = "embedding", out: str = "projected", block_rows: int = BASIS_BLOCK
) -> DataFrame:
    """Project each speaker's messages with the speaker's own basis, block by block.

    The basis is copied once per block of messages, never per message.
    """
    data = blocked(df.where(F.col(vec).isNotNull()), [by], order, block_rows)
    blocks = data.select(by, "__block").distinct()
    sides = spread_join(blocks, bases.select(by, "mean", "components"), [by], ["__block"]).select(
        F.col(by).alias("__key"), F.col("__block").alias("__part"), "mean", "components"
    )
    keep = [c for c in df.columns if c != vec]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        if left.num_rows and right.num_rows:
            mean = np.array(right.column("mean")[0].as_py())
            components = np.array(right.column("components")[0].as_py()).reshape(-1, len(mean))
            y = packed.matrix_list((packed.list_matrix(left.column(vec).chunk(0), np.float64) - mean) @ components.T, pa.float64())
        else:
            y = pa.array([None] * left.num_rows, pa.list_(pa.float64()))
        return pa.table([left.column(c) for c in keep] + [y], names=[*keep, out])

    return data.groupBy(by, "__block").cogroup(sides.groupBy("__key", "__part")).applyInArrow(apply, schema)


def variance_k(evr: str | Column = "evr", k: int = 4) -> Column:
    """Sum of the first k explained-variance ratios; null for a degenerate basis."""
    return F.aggregate(F.slice(as_col(evr), 1, k), F.lit(0.0), lambda s, x: s + x)


def speaker_stats(df: DataFrame, by: str, vec: str = "embedding", scale: int = packed.SCALE) -> DataFrame:
    """Centroid and population variance per speaker and dimension: ``(by, dim, n, mean, var)``.

    Sums are taken over quantised integers, so the result does not depend on partitioning;
    Spark combines them map-side per (speaker, dimension).
    """
    q = F.round(F.col("x").cast("double") * F.lit(float(scale))).cast("bigint")
    square = F.col("q").cast("decimal(19,0)") * F.col("q").cast("decimal(19,0)")
    sums = (
        df.select(by, F.posexplode(vec).alias("dim", "x"))
        .withColumn("q", q)
        .groupBy(by, "dim")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("decimal(20,0)")).alias("s"), F.sum(square.cast("decimal(28,0)")).alias("ss"))
    )
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    # n * ss - s^2 = n * (ss - s * whole) - s * rest, with s = n * whole + rest: no factor of n^2 arises.
    whole = F.floor(F.col("s") / F.col("n")).cast("decimal(19,0)")
    rest = (F.col("s") - whole * F.col("n").cast("decimal(18,0)")).cast("decimal(19,0)")
    centred = (F.col("ss") - (F.col("s") * whole).cast("decimal(38,0)")).cast("decimal(38,0)").cast("double")
    spread = centred * n - rest.cast("double") * s
    return sums.select(
        by,
        F.col("dim").cast("bigint").alias("dim"),
        "n",
        (s / n / F.lit(float(scale))).alias("mean"),
        (spread / (n * n) / F.lit(float(scale) ** 2)).alias("var"),
    )
