"""Similarity, identification and retrieval over packed hypervectors.

Scoring needs every query against every candidate, but no pair row is ever built: tasks hold
a block of candidates as one matrix and give out only the best of it per query. Candidates
up to a checked row limit are broadcast and the queries stream past them without a shuffle;
beyond the limit queries and candidates meet block by block, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speakerprint.functions import packed
from speakerprint.functions.mixing import pick
from speakerprint.functions.vectors import cosine
from speakerprint.operators.hypervectors import HV_DIM
from speakerprint.operators.scale import SMALL_TABLE, ranked, spread_join
from speakerprint.session import materialised

# Retrieval threshold and similarity bands.
THETA = 0.75
BAND_HIGH, BAND_GOOD, BAND_POOR = 0.7, 0.5, 0.4

#: Candidates broadcast at most (times 1.25 KB each at 10,000 dimensions).
BROADCAST_CANDIDATES = 32_768
#: Rows per block when candidates are too many to broadcast.
QUERY_BLOCK = 8_192
CANDIDATE_BLOCK = 8_192
#: The same for banded retrieval, whose cells score few of their pairs.
BANDED_QUERIES, BANDED_CANDIDATES = 16_384, 32_768
#: Pairs whose distances a task holds at a time, and pairs whose bits it gathers at a time.
SCORED_PAIRS = 1 << 21
PAIR_STEP = 1 << 13


def _best(ham: np.ndarray, k: int | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest distances <= most per row; earlier column wins ties."""
    c = ham.shape[1]
    if c == 0 or ham.shape[0] == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key = ham.astype(np.int64) * c + np.arange(c)
    k = c if k is None else min(k, c)
    if k == 1:
        cols = key.argmin(axis=1)[:, None]
    else:
        cols = np.argpartition(key, k - 1, axis=1)[:, :k] if k < c else np.broadcast_to(np.arange(c), ham.shape)
        cols = np.take_along_axis(cols, np.take_along_axis(key, cols, axis=1).argsort(axis=1), axis=1)
    rows = np.repeat(np.arange(len(ham)), cols.shape[1])
    cols = cols.reshape(-1)
    ok = ham[rows, cols] <= most
    return rows[ok], cols[ok]


def _dense(qm: np.ndarray, cm: np.ndarray, k: int | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, distance) of the k best candidates per query, some queries at a time."""
    step = max(1, SCORED_PAIRS // len(cm))
    for lo in range(0, len(qm), step):
        ham = packed.hamming(qm[lo : lo + step], cm)
        rows, cols = _best(ham, k, most)
        yield rows + lo, cols, ham[rows, cols]


def _sharing(
    qm: np.ndarray, cm: np.ndarray, ords: pa.ChunkedArray, bands: int, dim: int, k: int | None, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_dense` of the pairs that share a band of 16 bits; of equal ``ord`` (neighbours, as candidates come sorted) the best counts."""
    step = max(1, dim // 16 // bands)
    qv, cv = (np.ascontiguousarray(m).view("<u2")[:, : step * bands : step] for m in (qm, cm))
    order = [cv[:, b].argsort(kind="stable") for b in range(bands)]
    values = [cv[:, b][o] for b, o in enumerate(order)]
    same = np.cumsum(np.diff(ords.dictionary_encode(null_encoding="encode").combine_chunks().indices.to_numpy(), prepend=0) != 0)
    width = max(1, SCORED_PAIRS // len(cm))
    for lo in range(0, len(qm), width):
        asked = qv[lo : lo + width]
        share = np.zeros((len(asked), len(cm)), dtype=bool)
        for b in range(bands):
            first, last = (np.searchsorted(values[b], asked[:, b], side=side) for side in ("left", "right"))
            for i in np.flatnonzero(last > first):
                share[i, order[b][first[i] : last[i]]] = True
        rows, cols = np.nonzero(share)
        ham = np.empty(len(rows), dtype=np.int64)
        for at in range(0, len(rows), PAIR_STEP):
            part = slice(at, at + PAIR_STEP)
            ham[part] = np.bitwise_count(qm[lo + rows[part]].view(np.uint64) ^ cm[cols[part]].view(np.uint64)).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(ham <= most)
        rows, cols, ham = rows[near], cols[near], ham[near]
        # The best row of an ord, then the k best of a query.
        best = np.lexsort((cols, ham, same[cols], rows))
        head = np.ones(len(best), dtype=bool)
        head[1:] = (np.diff(rows[best]) != 0) | (np.diff(same[cols[best]]) != 0)
        best = best[head]
        best = best[np.lexsort((cols[best], ham[best], rows[best]))]
        if k is not None:
            best = best[np.arange(len(best)) - np.searchsorted(rows[best], rows[best], side="left") < k]
        yield rows[best] + lo, cols[best], ham[best]


def _most(theta: float | None, dim: int) -> int:
    """Largest Hamming distance whose cosine is strictly above theta."""
    if theta is None:
        return dim
    h = int(np.floor((1 - theta) * dim / 2)) + 1
    while h >= 0 and not (dim - 2 * h) / dim > theta:
        h -= 1
    return h


def _with_scores(hits: DataFrame, dim: int) -> DataFrame:
    return hits.withColumn("score", (F.lit(dim) - 2 * F.col("ham")) / F.lit(float(dim)))


def _candidate_columns(candidates: DataFrame, bucket: Sequence[str] = ()) -> DataFrame:
    """Candidates as they are scored; one without bits matches nothing."""
    given = candidates.where(F.col("bits").isNotNull())
    return given.select(*bucket, "candidate", F.col("ord").cast("bigint").alias("ord"), F.col("bits").alias("cbits"))


def _numbered(queries: DataFrame) -> DataFrame:
    """Queries with bits, stored with a number of their row: rows that share a ``query_id`` are ranked apart."""
    return materialised(queries.where(F.col("bits").isNotNull()).withColumn("__row", F.monotonically_increasing_id()), "queries")


def top_candidates(
    queries: DataFrame,
    candidates: DataFrame,
    k: int | None = 1,
    theta: float | None = None,
    dim: int = HV_DIM,
    broadcast_limit: int = BROADCAST_CANDIDATES,
) -> DataFrame:
    """Best candidates per query: ``(query columns but bits, candidate, ord, score, rank)``.

    ``queries`` carry ``query_id`` and ``bits``; ``candidates`` carry ``candidate``, ``ord``
    and ``bits``. Order is score descending, then ``ord`` (the first candidate wins ties).
    ``theta`` keeps scores strictly above it; ``k=None`` ranks all candidates.
    """
    cand = _candidate_columns(candidates)
    local = cand.limit(broadcast_limit + 1).toArrow()
    if local.num_rows > broadcast_limit:
        return _by_blocks(queries, cand, [], k, theta, dim)
    local = local.sort_by("ord").combine_chunks()
    ids = local.column("candidate").combine_chunks() if local.num_rows else pa.array([], local.schema.field("candidate").type)
    shared = queries.sparkSession.sparkContext.broadcast(
        (
            ids if isinstance(ids, pa.Array) else ids.chunk(0),
            local.column("ord").to_numpy(),
            packed.list_matrix(local.column("cbits").combine_chunks(), np.int64) if local.num_rows else np.zeros((0, packed.words(dim)), dtype=np.int64),
        )
    )
    keep = [c for c in queries.columns if c != "bits"]
    schema = T.StructType(
        [queries.schema[c] for c in keep]
        + [candidates.schema["candidate"], T.StructField("ord", T.LongType()), T.StructField("ham", T.LongType()), T.StructField("rank", T.IntegerType())]
    )
    most = _most(theta, dim)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, ords, matrix = shared.value
        step = max(1, min(1_024, (1 << 24) // max(1, len(ords))))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                ham = packed.hamming(packed.list_matrix(batch.column("bits"), np.int64), matrix)
                rows, cols = _best(ham, k, most)
                first = np.searchsorted(rows, rows, side="left")
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(c) for c in keep]
                    + [
                        cids.take(pa.array(cols)),
                        pa.array(ords[cols], pa.int64()),
                        pa.array(ham[rows, cols], pa.int64()),
                        pa.array(np.arange(len(rows)) - first + 1, pa.int32()),
                    ],
                    names=[*keep, "candidate", "ord", "ham", "rank"],
                )

    hits = queries.where(F.col("bits").isNotNull()).mapInArrow(score, schema)
    return _with_scores(hits, dim).select(*keep, "candidate", "ord", "score", "rank")


def _by_blocks(
    queries: DataFrame,
    cand: DataFrame,
    bucket: Sequence[str],
    k: int | None,
    theta: float | None,
    dim: int,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    keep_row: bool = False,
    bands: int | None = None,
) -> DataFrame:
    """Block-by-block scoring inside each bucket (no bucket columns: one bucket for all).

    A bucket with many queries and candidates, even one holding a third of both, is cut into
    cells of at most about query_block x candidate_block rows; a cell emits its k best per query.
    A query is a ``__row`` where the frame has that column, as it does without buckets, else a ``query_id``.
    ``keep_row`` gives the rows with their ``__row`` and distance ``ham`` instead of scores. With ``bands`` a cell compares only
    pairs that share a band, and an ``ord`` counts once per query.
    """
    bucket = list(bucket)
    queries = queries.where(F.col("bits").isNotNull()) if bucket else _numbered(queries)
    row = "__row" if "__row" in queries.columns else "query_id"
    keep = [c for c in queries.columns if c not in ("bits", *bucket)]
    if bucket:
        def cells(df: DataFrame, rows: int, name: str) -> DataFrame:
            return df.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))

        grid = cells(queries, query_block, "__nq").join(cells(cand, candidate_block, "__nc"), bucket)
        q = spread_join(queries, grid, bucket, [row])
        c = spread_join(cand, grid, bucket, ["ord"])
    else:
        cand = materialised(cand, "candidates")
        width = {"__nq": F.lit(max(1, -(-queries.count() // query_block))), "__nc": F.lit(max(1, -(-cand.count() // candidate_block)))}
        q, c = queries.withColumns(width), cand.withColumns(width)
    q = q.withColumn("__q", F.pmod(F.xxhash64(row), F.col("__nq")).cast("int")).withColumn(
        "__c", F.explode(F.sequence(F.lit(0), F.col("__nc") - 1))
    )
    c = c.withColumn("__c", F.pmod(F.xxhash64("ord"), F.col("__nc")).cast("int")).withColumn(
        "__q", F.explode(F.sequence(F.lit(0), F.col("__nq") - 1))
    )
    q, c = q.drop("__nq", "__nc"), c.drop("__nq", "__nc")
    cell = [*bucket, "__q", "__c"]
    most = _most(theta, dim)
    schema = T.StructType(
        [queries.schema[x] for x in keep]
        + [cand.schema["candidate"], T.StructField("ord", T.LongType()), T.StructField("ham", T.LongType())]
    )
    names = [f.name for f in schema.fields]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by("ord").combine_chunks()
        out = []
        if left.num_rows and right.num_rows:
            qm = packed.list_matrix(left.column("bits").chunk(0), np.int64)
            cm = packed.list_matrix(right.column("cbits").chunk(0), np.int64)
            given, found = left.select(keep), right.select(["candidate", "ord"])
            for rows, cols, ham in _sharing(qm, cm, found.column("ord"), bands, dim, k, most) if bands else _dense(qm, cm, k, most):
                taken, best = given.take(pa.array(rows)), found.take(pa.array(cols))
                columns = [taken.column(x) for x in keep] + [best.column("candidate"), best.column("ord"), pa.array(ham, pa.int64())]
                out.append(pa.table(columns, names=names))
        if out:
            return pa.concat_tables(out)
        types = [left.schema.field(x).type for x in keep] + [right.schema.field("candidate").type, pa.int64(), pa.int64()]
        return pa.table([pa.array([], t) for t in types], names=names)

    hits = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInArrow(score, schema)
    if bucket or bands:
        hits = hits.dropDuplicates([row, "ord"])
    order = Window.partitionBy(row).orderBy("ham", "ord")
    ranked_hits = hits.withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked_hits = ranked_hits.where(F.col("rank") <= k)
    if keep_row:
        return ranked_hits
    return _with_scores(ranked_hits, dim).select(*[x for x in keep if x != "__row"], "candidate", "ord", "score", "rank")


def _pruned(queries: DataFrame, candidates: DataFrame, k: int, theta: float | None, dim: int, **kw) -> DataFrame:
    from speakerprint.operators.hamming_index import build_index, search

    return search(queries, build_index(candidates, dim, **kw), k, theta)


def identify(queries: DataFrame, candidates: DataFrame, dim: int = HV_DIM, method: str = "exact", **kw) -> DataFrame:
    """The closest fingerprint per query; the first candidate wins ties.

    ``pruned`` gives the same rows by a metric index (:mod:`speakerprint.operators.hamming_index`).
    """
    hits = _pruned(queries, candidates, 1, None, dim, **kw) if method == "pruned" else top_candidates(queries, candidates, 1, None, dim, **kw)
    return hits.drop("rank")


def rank_candidates(queries: DataFrame, candidates: DataFrame, dim: int = HV_DIM, k: int | None = None, **kw) -> DataFrame:
    """All scores per query, best first (or the k best)."""
    return top_candidates(queries, candidates, k, None, dim, **kw)


def band_keys(df: DataFrame, bands: int, width: int = 16, bits: str = "bits", dim: int | None = None) -> DataFrame:
    """Explode packed bits into ``(band, band_value)`` keys of ``width`` bits (a divisor of 64), spread over ``dim`` bits if given."""
    per_word = 64 // width
    step = max(1, dim // width // bands) if dim else 1
    word = F.element_at(F.col(bits), (F.expr(f"(band * {step}) div {per_word}") + 1).cast("int"))
    shift = F.col("band") * step % per_word * width
    exploded = df.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    value = F.expr("shiftrightunsigned(__w, CAST(__s AS INT))").bitwiseAND(F.lit((1 << width) - 1))
    return exploded.withColumn("__w", word).withColumn("__s", shift).withColumn("band_value", value).drop("__w", "__s")


def retrieve(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    theta: float = THETA,
    dim: int = HV_DIM,
    method: str = "exact",
    bands: int = 64,
    registry: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Top-k candidates with cosine strictly above theta, optionally with the summary of each.

    ``exact`` compares everything. ``pruned`` gives the same rows, skipping cells of candidates by the triangle
    inequality (:mod:`speakerprint.operators.hamming_index`). ``banded`` compares only pairs that share one of ``bands``
    16-bit bands of the hypervector and re-scores them exactly; it may miss a pair with
    probability (1 - p^16)^bands, p being the share of equal bits (0.03 % at cosine 0.75).
    """
    if method == "exact":
        hits = top_candidates(queries, candidates, k, theta, dim, **kw)
    elif method == "pruned":
        hits = _pruned(queries, candidates, k, theta, dim, **kw)
    else:
        hits = _by_blocks(queries, _candidate_columns(candidates), [], k, theta, dim, BANDED_QUERIES, BANDED_CANDIDATES, bands=min(bands, dim // 16))
    if registry is not None:
        summaries = registry.select(F.col("id").alias("candidate"), "summary")
        hits = spread_join(hits, summaries, ["candidate"], ["query_id"], how="left")
    return hits


def similarity_band(score: str = "score"):
    """Name of a similarity: high, good, fair or poor."""
    s = F.col(score)
    return F.when(s >= BAND_HIGH, "high").when(s >= BAND_GOOD, "good").when(s < BAND_POOR, "poor").otherwise("fair")


def message_similarity(original: DataFrame, generated: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Cosine and band of each original message and the generated one with the same key."""
    g = generated.select(key, F.col(vec).alias("__g"))
    joined = original.select(key, F.col(vec).alias("__o")).join(g, key)
    return joined.select(key, cosine("__o", "__g").alias("score")).withColumn("band", similarity_band())


def speaker_pairs(df: DataFrame, by: str, order: str, vec: str, trials: int = 1_000, seed: int = 42) -> DataFrame:
    """Same- and cross-speaker pairs of ``trials`` seeded draws: ``(trial, draw, a, b, same_speaker, score)``.

    Every trial draws an anchor message, a partner from the anchor's speaker (draw ``same``)
    and a partner from all messages (draw ``any``); the speakers decide the label. Pairs are
    drawn by position among ids only, ranked once; the vectors of the drawn messages are joined last.
    """
    placed = ranked(ranked(df.select(by, order), [], order, pos="__g", total="__all"), [by], order, pos="__p", total="__n")
    placed = materialised(placed, "positions")
    size = placed.agg(F.max("__all").alias("__all"))
    draws = df.sparkSession.range(trials).withColumnRenamed("id", "trial").withColumn("__size", size.scalar())
    who = F.col(by).alias("__by")
    anchors = draws.withColumn("__g", pick("trial", f"{seed}", "__size")).join(
        placed.select("__g", who, F.col(order).alias("a"), "__p", "__n"), "__g"
    )
    same = (
        anchors.where(F.col("__n") > 1)
        .withColumn("__q", (F.col("__p") + 1 + pick("trial", f"{seed + 1}", "__n - 1")) % F.col("__n"))
        .join(placed.select(who, F.col("__p").alias("__q"), F.col(order).alias("b")), ["__by", "__q"])
        .select("trial", F.lit("same").alias("draw"), "a", "b", F.lit(True).alias("same_speaker"), "__by", F.col("__by").alias("__by2"))
    )
    other = (
        anchors.where(F.col("__size") > 1)
        .withColumn("__h", (F.col("__g") + 1 + pick("trial", f"{seed + 2}", "__size - 1")) % F.col("__size"))
        .join(placed.select(F.col("__g").alias("__h"), F.col(by).alias("__by2"), F.col(order).alias("b")), "__h")
        .select("trial", F.lit("any").alias("draw"), "a", "b", (F.col("__by") == F.col("__by2")).alias("same_speaker"), "__by", "__by2")
    )
    vectors_a = df.select(F.col(by).alias("__by"), F.col(order).alias("a"), F.col(vec).alias("__va"))
    vectors_b = df.select(F.col(by).alias("__by2"), F.col(order).alias("b"), F.col(vec).alias("__vb"))
    pairs = materialised(same.unionByName(other), "pairs")
    few = 2 * trials <= SMALL_TABLE

    def found(vectors: DataFrame, on: list[str]) -> DataFrame:
        """Vectors of the drawn messages alone, picked out where they are read when the draws are few."""
        asked = pairs.select(*on).distinct()
        return vectors.join(F.broadcast(asked) if few else asked, on)

    pairs = pairs.join(found(vectors_a, ["__by", "a"]), ["__by", "a"]).join(found(vectors_b, ["__by2", "b"]), ["__by2", "b"])
    return pairs.select("trial", "draw", "a", "b", "same_speaker", cosine("__va", "__vb").alias("score"))
