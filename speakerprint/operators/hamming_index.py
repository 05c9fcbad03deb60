"""Exact nearest fingerprints that skip whole cells of candidates by the triangle inequality.

Hamming distance is a metric: a candidate c is at least |d(q, p) - d(c, p)| from a query q, for any pivot p. Candidates
are dealt to the pivot they are closest to, and in rings of distance around it, so that a cell has a narrow range of
distances to its own pivot. The ranges of all pivots and cells are one small table. A query visits only cells that
these ranges allow to hold a result; skipped cells hold none, so that the result is that of comparing everything.

With a threshold its distance is the radius. Without one, the k-th best of the query's most promising cell is an upper
bound of the k-th best of all, and a second pass visits what lies within it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speakerprint.functions import packed
from speakerprint.operators import match
from speakerprint.operators.hypervectors import HV_DIM
from speakerprint.operators.scale import blocked
from speakerprint.session import materialised

#: Pivots, and the candidates (by the smallest hashes of their order) that they are chosen from.
PIVOTS = 32
SAMPLE = 1_024
#: Rows of a ring. The table of ranges, which rides along with tasks, has at most CELLS + PIVOTS rows: rings of larger
#: tables have more rows, and are scored in several tasks.
CELL_ROWS = 2_048
CELLS = 65_536
#: Rows (query, cell) that a task hands on together, each with the bits of its query.
VISIT_ROWS = 2_048


@dataclass(frozen=True)
class HammingIndex:
    """``cells`` (cell, candidate, ord, cbits); per cell its id, rows, and least and greatest distance to each pivot."""

    dim: int
    pivots: np.ndarray
    cells: DataFrame
    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray


def spread_out(bits: np.ndarray, count: int) -> np.ndarray:
    """Numbers of rows that are far from each other: always the one farthest from those chosen."""
    if not len(bits):
        return np.zeros(0, dtype=np.int64)
    chosen = [0]
    near = packed.hamming(bits[:1], bits)[0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, packed.hamming(bits[chosen[-1:]], bits)[0])
    return np.array(chosen)


def build_index(candidates: DataFrame, dim: int = HV_DIM, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> HammingIndex:
    """Index of candidates ``(candidate, ord, bits)``; rows without bits match nothing and are left out."""
    cand = match._candidate_columns(candidates)
    sample = cand.select(F.xxhash64("ord").alias("h"), "ord", "cbits").orderBy("h", "ord").limit(SAMPLE).toArrow().combine_chunks()
    some = packed.list_matrix(sample.column("cbits").chunk(0), np.int64) if sample.num_rows else np.zeros((0, packed.words(dim)), dtype=np.int64)
    centres = some[spread_out(some, pivots)]
    schema = T.StructType([*cand.schema.fields, T.StructField("dist", T.ArrayType(T.IntegerType())), T.StructField("pivot", T.IntegerType()), T.StructField("d", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dist = packed.hamming(packed.list_matrix(batch.column("cbits"), np.int64), centres)
                own = dist.argmin(axis=1)
                columns = [packed.matrix_list(dist, pa.int32()), pa.array(own.astype(np.int32)), pa.array(dist.min(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "dist", "pivot", "d"])

    placed = materialised(cand.mapInArrow(place, schema), "index-placed")
    cell_rows = max(cell_rows, -(-placed.count() // CELLS))
    rings = blocked(placed, ["pivot"], ["d", "ord"], cell_rows)
    rings = materialised(rings.withColumn("cell", F.shiftleft(F.col("pivot").cast("bigint"), 32) + F.col("__block")).drop("__block"), "index-cells")
    bounds = [f(F.col("dist")[i]).alias(f"{name}{i}") for i in range(len(centres)) for f, name in ((F.min, "l"), (F.max, "h"))]
    found = sorted(rings.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *bounds).collect(), key=lambda r: r["cell"])
    side = [np.array([[r[f"{name}{i}"] for i in range(len(centres))] for r in found], dtype=np.int32).reshape(len(found), len(centres)) for name in "lh"]
    ids, rows = (np.array([r[c] for r in found], dtype=np.int64) for c in ("cell", "n"))
    return HammingIndex(dim, centres, rings.select("cell", "candidate", "ord", "cbits"), ids, rows, *side)


def _least(index: HammingIndex, bits: np.ndarray) -> np.ndarray:
    """(queries, cells): no candidate of a cell is closer to a query than this."""
    dist = packed.hamming(bits, index.pivots)
    out = np.zeros((len(bits), len(index.ids)), dtype=np.int32)
    for p in range(len(index.pivots)):
        d = dist[:, p, None]
        np.maximum(out, np.maximum(d - index.high[None, :, p], index.low[None, :, p] - d), out=out)
    return out


def _visits(queries: DataFrame, index: HammingIndex, radius: int | str | None) -> DataFrame:
    """``queries`` times the cells they have to visit: those within a radius (a number or a column), or with None the most promising one."""
    names = queries.columns
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.LongType())])
    plain = HammingIndex(index.dim, index.pivots, None, index.ids, index.rows, index.low, index.high)
    shared = queries.sparkSession.sparkContext.broadcast(plain)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        step = max(1, min(1_024, (1 << 22) // max(1, len(idx.ids))))
        for whole in batches:
            for lo in range(0, whole.num_rows if len(idx.ids) else 0, step):
                batch = whole.slice(lo, step)
                least = _least(idx, packed.list_matrix(batch.column("bits"), np.int64))
                if radius is None:
                    rows, cols = np.arange(len(least)), least.argmin(axis=1)
                else:
                    most = batch.column(radius).to_numpy()[:, None] if isinstance(radius, str) else radius
                    rows, cols = np.nonzero(least <= most)
                for at in range(0, len(rows), VISIT_ROWS):
                    taken = batch.take(pa.array(rows[at : at + VISIT_ROWS]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(idx.ids[cols[at : at + VISIT_ROWS]])], names=[*names, "cell"])

    return queries.mapInArrow(visit, schema)


def _with_radius(numbered: DataFrame, index: HammingIndex, k: int) -> DataFrame:
    """Queries with ``__radius``: the k-th best distance within the most promising cell, or all of the space."""
    home = match._by_blocks(_visits(numbered.select("__row", "query_id", "bits"), index, None), index.cells, ["cell"], k, None, index.dim, keep_row=True)
    found = home.groupBy("__row").agg(F.count(F.lit(1)).alias("n"), F.max("ham").alias("ham"))
    radius = F.when(F.col("n") >= k, F.col("ham")).otherwise(F.lit(index.dim)).cast("int")
    return numbered.join(found.select("__row", radius.alias("__radius")), "__row", "left").fillna(index.dim, ["__radius"])


def search(queries: DataFrame, index: HammingIndex, k: int = 1, theta: float | None = None) -> DataFrame:
    """The same rows as ``match.top_candidates``: ``(query columns but bits, candidate, ord, score, rank)``."""
    numbered = match._numbered(queries)
    if theta is None:
        visits = _visits(materialised(_with_radius(numbered, index, k), "index-radius"), index, "__radius").drop("__radius")
    else:
        visits = _visits(numbered, index, match._most(theta, index.dim))
    return match._by_blocks(materialised(visits, "index-visits"), index.cells, ["cell"], k, theta, index.dim)


def pruning(queries: DataFrame, index: HammingIndex, k: int = 1, theta: float | None = None) -> DataFrame:
    """What a search skips: ``(query_id, cells, visited, candidates, compared)`` of every query row with bits."""
    numbered = match._numbered(queries.select("query_id", "bits"))
    if theta is None:
        visits = _visits(_with_radius(numbered, index, k), index, "__radius")
    else:
        visits = _visits(numbered, index, match._most(theta, index.dim))
    sizes = index.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    seen = visits.select("__row", "cell").join(sizes, "cell").groupBy("__row").agg(F.count(F.lit(1)).alias("visited"), F.sum("rows").alias("compared"))
    out = numbered.select("__row", "query_id").join(seen, "__row", "left").fillna(0, ["visited", "compared"])
    return out.select("query_id", F.lit(len(index.ids)).cast("bigint").alias("cells"), "visited", F.lit(int(index.rows.sum())).cast("bigint").alias("candidates"), "compared")
