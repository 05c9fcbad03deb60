"""Sign projection, positional binding and bundling of message vectors into seeds.

A seed is the thresholded sum of rolled +-1 vectors, newest message unshifted. Because
``roll(h_i, n-1-i) = roll(roll(h_i, -i), n-1)``, the sum itself is commutative: every task
adds ``roll(h_i, -i)`` for its own rows and one rotation at the end gives the seed. Integer
sums are kept apart from the thresholded bits since thresholded parts cannot be merged.

Rows are projected where they are read, so only packed bits (157 words at 10,000 dimensions,
smaller than the vector itself) are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speakerprint.functions import packed
from speakerprint.operators.runs import fold_runs
from speakerprint.operators.scale import blocked, ranked, spread_join
from speakerprint.session import materialised

# Hypervector dimensions and projection seed.
HV_DIM = 10_000
HV_SEED = 42
#: Messages summed by one task into one partial.
BUNDLE_ROWS = 1 << 20
#: Speakers a task holds at once while adding up vectors.
HELD_SPEAKERS = 4_096
#: Rows unpacked or projected at once inside a task.
STEP = 1_024
#: Rows that are projected at a time: 80 KB each at 10,000 dimensions, and as much twice over while they are made.
ENCODE_ROWS = 256
#: Neighbouring chunk seeds that a task folds into one.
COMPOSE_FAN = 4_096
#: Consensus rule: members per task type and lowest score.
MERGE_TOP, MERGE_MIN_SCORE = 5, 0.8


@dataclass(frozen=True)
class Center:
    """Exact mean of quantised vectors: row count and per-dimension integer sums."""

    n: int
    sums: tuple[int, ...]
    scale: int = packed.SCALE

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) / self.scale


def shared_center(df: DataFrame, vec: str = "embedding", scale: int = packed.SCALE) -> Center:
    """Exact mean over all rows: one partial row per partition, d sums on the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            q = packed.quantise(packed.list_matrix(batch.column(0), np.float64), scale)
            if len(q):
                n += len(q)
                sums = q.sum(axis=0) if sums is None else sums + q.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": packed.matrix_list(sums[None, :], pa.int64())})

    parts = df.select(vec).where(F.col(vec).isNotNull()).mapInArrow(partial, "n bigint, s array<bigint>")
    rows = (
        parts.select("n", F.posexplode("s").alias("j", "x"))
        .groupBy("j")
        .agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        .collect()
    )
    if not rows:
        raise ValueError("no vectors to centre")
    rows.sort(key=lambda r: r["j"])
    return Center(int(rows[0]["n"]), tuple(int(r["x"]) for r in rows), scale)


def speaker_centers(df: DataFrame, by: str, vec: str = "embedding", scale: int = packed.SCALE) -> DataFrame:
    """``(by, center_n, center_sums)``: exact integer sums per speaker.

    Every task first adds up its own rows per speaker, at most HELD_SPEAKERS at a time, so a
    speaker with very many messages sends few rows.
    """
    head = _head(df, [by])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        key_type = None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), type=key_type),
                    pa.array([n for n, _ in held.values()], pa.int64()),
                    packed.matrix_list(np.stack([s for _, s in held.values()]), pa.int64()),
                ],
                names=[by, "center_n", "center_sums"],
            )
            held.clear()
            return out

        for batch in batches:
            key_type = batch.schema.field(by).type
            q = packed.quantise(packed.list_matrix(batch.column(vec), np.float64), scale)
            codes = batch.column(by).dictionary_encode()
            index = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            starts = np.flatnonzero(np.diff(index[order], prepend=-1)) if len(order) else order
            sums = np.add.reduceat(q[order], starts, axis=0) if len(order) else q
            sizes = np.diff(np.append(starts, len(order)))
            for key, n, total in zip(codes.dictionary.to_pylist(), sizes.tolist(), sums):
                had = held.get(key)
                held[key] = (n, total) if had is None else (had[0] + n, had[1] + total)
            if len(held) >= HELD_SPEAKERS:
                yield flush()
        if held:
            yield flush()

    partial = df.where(F.col(vec).isNotNull()).select(by, vec).mapInArrow(combine, f"{head}, center_n bigint, center_sums array<bigint>")

    def prepare(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("center_n").to_numpy(zero_copy_only=False), packed.list_matrix(batch.column("center_sums"), np.int64)

    def add(acc: list, rows: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> None:
        acc[0] += int(rows[0][start:stop].sum())
        acc[1] = acc[1] + rows[1][start:stop].sum(axis=0)

    def emit(_: list[tuple], done: list[list]) -> list[pa.Array]:
        return [pa.array([n for n, _ in done], pa.int64()), packed.matrix_list(np.stack([s for _, s in done]), pa.int64())]

    columns = ["center_n", "center_sums"]
    return fold_runs(partial, [by], columns, prepare, lambda: [0, 0], add, emit, columns, "center_n bigint, center_sums array<bigint>", STEP)


def with_speaker_center(df: DataFrame, by: str, order: str, vec: str = "embedding", scale: int = packed.SCALE) -> DataFrame:
    return spread_join(df, speaker_centers(df, by, vec, scale), [by], [order])


def _thresholds(n: int, sums: Sequence[int], sign: np.ndarray) -> np.ndarray:
    """Smallest integer a with n * a >= sums . R, per dimension, in exact arithmetic."""
    s = np.array([int(x) for x in sums], dtype=object)
    low = np.array([int(x) & ((1 << 26) - 1) for x in s], dtype=np.float64)
    high = np.array([int(x) >> 26 for x in s], dtype=np.float64)
    b = (high @ sign).astype(np.int64).astype(object) * (1 << 26) + (low @ sign).astype(np.int64).astype(object)
    return np.array([-((-x) // n) for x in b], dtype=np.int64)


def _row_thresholds(n: np.ndarray, sums: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """:func:`_thresholds` for several means at once, in int64 where the products fit."""
    if int(np.abs(sums).max()) * sums.shape[1] < 1 << 62:
        return -((-packed.project_exact(sums, sign)) // n[:, None])
    return np.stack([_thresholds(int(a), b.tolist(), sign) for a, b in zip(n, sums)])


def hv_encode(
    df: DataFrame,
    vec: str = "embedding",
    out: str = "bits",
    dim: int = HV_DIM,
    seed: int = HV_SEED,
    center: Center | str | None = None,
    projection: str = "sign",
    scale: int = packed.SCALE,
    keep_vec: bool = False,
) -> DataFrame:
    """Replace the vector by packed signs of its projection; 0 counts as +1. No shuffle.

    ``center`` is a shared :class:`Center`, ``"columns"`` (the frame carries ``center_n`` and
    ``center_sums``, see :func:`with_speaker_center`) or None. Rows without a vector keep a
    null result.
    """
    per_row = center == "columns"
    gone = ({"center_sums"} if per_row else set()) | (set() if keep_vec else {vec})
    keep = [c for c in df.columns if c not in gone]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.LongType()))])
    shared = None if per_row else center

    def signs(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        r = packed.sign_matrix(x.shape[1], dim, seed, projection)
        if projection == "gaussian":
            if shared is not None:
                x = x - shared.mean()
            elif per_row:
                n = batch.column("center_n").to_numpy(zero_copy_only=False)
                x = x - packed.list_matrix(batch.column("center_sums"), np.float64) / n[:, None] / scale
            return (x @ r) >= 0
        product = packed.project_exact(packed.quantise(x, scale), r)
        if shared is not None:
            return product >= cut(x.shape[1])
        if per_row:
            n = batch.column("center_n").to_numpy(zero_copy_only=False)
            sums = packed.list_matrix(batch.column("center_sums"), np.int64)
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(row.tobytes(), len(known)) for row in sums])
            first = np.unique(which, return_index=True)[1]
            product -= _row_thresholds(n[first], sums[first], r)[which]
        return product >= 0

    memo: dict[int, np.ndarray] = {}

    def cut(d: int) -> np.ndarray:
        if d not in memo:
            memo[d] = _thresholds(shared.n, shared.sums, packed.sign_matrix(d, dim, seed, projection))
        return memo[d]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(lo, ENCODE_ROWS)
                column = batch.column(vec)
                present = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                out_bits = np.zeros((batch.num_rows, packed.words(dim)), dtype=np.int64)
                if len(present):
                    rows = batch if len(present) == batch.num_rows else batch.take(pa.array(present))
                    x = packed.list_matrix(rows.column(vec), np.float64)
                    out_bits[present] = packed.pack(signs(x, rows))
                result = packed.matrix_list(out_bits, pa.int64())
                if len(present) < batch.num_rows:
                    result = pa.array([r if ok else None for r, ok in zip(result.to_pylist(), column.is_valid().to_pylist())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [result], names=keep + [out])

    return df.mapInArrow(encode, schema)


def hv_encode_prefixes(
    df: DataFrame, ks: Sequence[int], vec: str = "projected", out: str = "bits", dim: int = HV_DIM, seed: int = HV_SEED, scale: int = packed.SCALE
) -> DataFrame:
    """One row per k of ``ks``: packed signs of the first k components of a vector, ``(other columns, k, bits)``.

    The product with the sign matrix is built up component range by component range, so that all k together cost one
    product; the sums are exact integers. A k above the length takes the whole vector.
    """
    ks = sorted(set(ks))
    keep = [c for c in df.columns if c != vec]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("k", T.IntegerType()), T.StructField(out, T.ArrayType(T.LongType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(lo, ENCODE_ROWS)
                q = packed.quantise(packed.list_matrix(batch.column(vec), np.float64), scale)
                sign = packed.sign_matrix(q.shape[1], dim, seed, "sign")
                total, done = np.zeros((len(q), dim), dtype=np.int64), 0
                for k in ks:
                    if done < min(k, q.shape[1]):
                        total += packed.project_exact(q[:, done:k], sign[done:k])
                        done = min(k, q.shape[1])
                    columns = [*[batch.column(c) for c in keep], pa.array(np.full(len(q), k, dtype=np.int32)), packed.matrix_list(packed.pack(total >= 0), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "k", out])

    return df.where(F.col(vec).isNotNull()).mapInArrow(encode, schema)


def hv_query(df: DataFrame, center: Center | None, vec: str = "embedding", dim: int = HV_DIM, seed: int = HV_SEED, **kw) -> DataFrame:
    """Encode single messages unshifted, in the basis shared with the seeds."""
    return hv_encode(df, vec=vec, dim=dim, seed=seed, center=center, **kw)


class _Sum:
    """Running sum of +-1 rows (kept as a count of ones), rows and last position."""

    __slots__ = ("ones", "n", "last")

    def __init__(self, dim: int):
        self.ones, self.n, self.last = np.zeros(dim, dtype=np.int64), 0, 0


def _narrow(acc: np.ndarray) -> tuple[int, bytes]:
    """Sum in the fewest bytes that hold it: most speakers need one byte per dimension."""
    peak = int(np.abs(acc).max())
    width = next(w for w in (1, 2, 4, 8) if peak < 1 << (8 * w - 1))
    return width, acc.astype(f"<i{width}").tobytes()


def _head(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


#: Partial sums: a block of a speaker's messages, not rotated, in ``width`` bytes per dimension.
PARTIAL_NAMES = ("width", "acc", "n", "last")
PARTIAL_SCHEMA = "width int, acc binary, n bigint, last bigint"


def _partial_columns(sums: Sequence[np.ndarray], ns: Sequence[int], lasts: Sequence[int]) -> list[pa.Array]:
    short = [_narrow(a) for a in sums]
    return [
        pa.array([w for w, _ in short], pa.int32()),
        pa.array([raw for _, raw in short], pa.binary()),
        pa.array(ns, pa.int64()),
        pa.array(lasts, pa.int64()),
    ]


def partial_sums(data: DataFrame, by: Sequence[str], dim: int, positional: bool = True) -> DataFrame:
    """Unrotated partial sums ``(by, __block, width, acc, n, last)`` of rows ``(by, __block, pos, bits)``."""

    def prepare(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bits = packed.unpack(packed.list_matrix(batch.column("bits"), np.int64), dim)
        return bits, batch.column("pos").to_numpy(zero_copy_only=False)

    def add(acc: _Sum, rows: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> None:
        bits, pos = rows[0][start:stop], rows[1][start:stop]
        acc.n += stop - start
        acc.last = max(acc.last, int(pos.max()))
        if positional:
            for row, shift in zip(bits, ((-pos) % dim).tolist()):
                acc.ones[shift:] += row[: dim - shift]
                acc.ones[:shift] += row[dim - shift :]
        else:
            acc.ones += bits.sum(axis=0, dtype=np.int64)

    def emit(_: list[tuple], done: list[_Sum]) -> list[pa.Array]:
        return _partial_columns([2 * s.ones - s.n for s in done], [s.n for s in done], [s.last for s in done])

    keys = [*by, "__block"]
    return fold_runs(data, keys, ["pos", "bits"], prepare, lambda: _Sum(dim), add, emit, PARTIAL_NAMES, PARTIAL_SCHEMA, STEP)


def fold_partials(
    partials: DataFrame, by: Sequence[str], dim: int, positional: bool = True, finish: bool = True, keep_acc: bool = True
) -> DataFrame:
    """Fold unrotated partial sums into seeds ``(by, n, acc, bits)``, streaming per speaker.

    A speaker has one partial per block of rows, so even a speaker with 10^10 messages folds
    some 10^4 short rows here. With ``finish=False`` the result is one partial per speaker
    (block 0), to which later partials can still be added.
    """

    def prepare(batch: pa.RecordBatch) -> list:
        raw = [np.frombuffer(x.as_buffer(), dtype=f"<i{w}") for w, x in zip(batch.column("width").to_pylist(), batch.column("acc"))]
        return [raw, batch.column("n").to_numpy(zero_copy_only=False), batch.column("last").to_numpy(zero_copy_only=False)]

    def add(acc: _Sum, rows: list, start: int, stop: int) -> None:
        for part in rows[0][start:stop]:
            acc.ones += part
        acc.n += int(rows[1][start:stop].sum())
        acc.last = max(acc.last, int(rows[2][start:stop].max()))

    def emit(_: list[tuple], done: list[_Sum]) -> list[pa.Array]:
        if not finish:
            columns = _partial_columns([s.ones for s in done], [s.n for s in done], [s.last for s in done])
            return [pa.array([0] * len(done), pa.int64()), *columns]
        seeds = np.stack([np.roll(s.ones, s.last % dim) if positional else s.ones for s in done])
        acc = [packed.matrix_list(seeds, pa.int64())] if keep_acc else []
        return [pa.array([s.n for s in done], pa.int64()), *acc, packed.matrix_list(packed.pack(seeds >= 0), pa.int64())]

    if finish:
        names = ["n", "acc", "bits"] if keep_acc else ["n", "bits"]
        schema = "n bigint, acc array<bigint>, bits array<bigint>" if keep_acc else "n bigint, bits array<bigint>"
    else:
        names, schema = ["__block", *PARTIAL_NAMES], f"`__block` bigint, {PARTIAL_SCHEMA}"
    return fold_runs(partials, list(by), PARTIAL_NAMES, prepare, lambda: _Sum(dim), add, emit, names, schema, STEP)


def hv_bundle(
    df: DataFrame,
    by: str | Sequence[str],
    order: str,
    dim: int = HV_DIM,
    bind: str = "positional",
    position: str = "index",
    block_rows: int = BUNDLE_ROWS,
    keep_acc: bool = True,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """Bundle packed messages into one seed per speaker: ``(by, n, acc, bits)``.

    ``bind="positional"`` rolls each message by its distance from the last one, ``"bag"``
    does not. ``position="index"`` counts the rows present; ``"turn"`` takes the order column
    itself, which a stream or a frame that already has positions can know, and saves the
    ranking. The bits are shuffled once, by (speaker, block of positions); a partial sum per
    block is shuffled to its speaker. ``counts_from`` is a frame with the same keys and order
    values but a cheaper lineage (the rows before encoding), read to find block offsets.
    """
    by = [by] if isinstance(by, str) else list(by)
    positional = bind == "positional"
    rows = df.select(*by, order, "bits")
    if positional and position == "index":
        placed = ranked(rows, by, order, pos="pos", total=None, block_rows=block_rows, keep_block=True, counts_from=counts_from)
    else:
        rows = rows.where(F.col(order).isNotNull())
        placed = blocked(rows, by, order, block_rows, counts_from).withColumn("pos", F.col(order).cast("bigint"))
    data = placed.select(*by, "__block", "pos", "bits")
    return fold_partials(partial_sums(data, by, dim, positional), by, dim, positional, keep_acc=keep_acc)


def fingerprints(
    df: DataFrame,
    by: str,
    order: str,
    vec: str = "embedding",
    dim: int = HV_DIM,
    seed: int = HV_SEED,
    center: Center | str | None = "shared",
    bind: str = "positional",
    position: str = "index",
    block_rows: int = BUNDLE_ROWS,
    keep_acc: bool = True,
    **encode,
) -> DataFrame:
    """Seeds of every speaker straight from message vectors: ``(by, n, degenerate, acc, bits)``.

    ``acc`` (the sum before thresholding) is what later messages can be added to; leave it out
    with ``keep_acc=False`` where only comparison is wanted.

    ``center``: ``"shared"`` (exact mean of all rows, the default), ``"speaker"`` (each
    speaker's own mean), a :class:`Center`, or None. A speaker with one message centred on
    itself carries no style and is marked degenerate.
    """
    own = center == "speaker"
    source = df.where(F.col(vec).isNotNull())
    if own:
        data, used = with_speaker_center(source, by, order, vec), "columns"
    else:
        data, used = source, shared_center(source, vec) if center == "shared" else center
    keep = [by, order, vec] + (["center_n", "center_sums"] if own else [])
    encoded = hv_encode(data.select(*keep), vec, dim=dim, seed=seed, center=used, **encode)
    seeds = hv_bundle(encoded, by, order, dim, bind, position, block_rows, keep_acc, source)
    rest = ["acc", "bits"] if keep_acc else ["bits"]
    return seeds.select(by, "n", (F.lit(own) & (F.col("n") < 2)).alias("degenerate"), *rest)


def hv_compose(parts: DataFrame, by: str, chunk: str = "chunk", dim: int = HV_DIM, fan: int = COMPOSE_FAN) -> DataFrame:
    """Compose chunk seeds ``(by, chunk, n, acc)`` into whole seeds without their messages.

    ``acc`` is the integer seed of a chunk. Composition (S1, n1) + (S2, n2) = (roll(S1, n2) + S2, n1 + n2) is
    associative: neighbours are folded in levels, up to ``fan`` of them by a task, in as few bytes per dimension as their sums
    need. A speaker of any number of chunks takes the logarithm of it in levels.
    """
    keys = parts.schema[by].dataType.simpleString()
    names = [by, "__order", "n", "width", "acc"]
    head = f"`{by}` {keys}, __order bigint, n bigint, width int, acc binary"

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [_narrow(a) for a in packed.list_matrix(batch.column("acc"), np.int64)]
            columns = [batch.column(by), batch.column("__order"), batch.column("n"), pa.array([w for w, _ in short], pa.int32()), pa.array([raw for _, raw in short], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, acc, kind = None, 0, None, None

        def done() -> pa.RecordBatch:
            width, raw = _narrow(acc)
            columns = [pa.array([current[0]], kind), pa.array([current[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([width], pa.int32()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            kind = batch.schema.field(by).type
            columns = [batch.column(c).to_pylist() for c in (by, "__block", "n", "width", "acc")]
            for who, block, size, width, raw in zip(*columns):
                part = np.frombuffer(raw, dtype=f"<i{width}").astype(np.int64)
                if (who, block) != current:
                    if current is not None:
                        yield done()
                    current, n, acc = (who, block), size, part
                else:
                    acc, n = np.roll(acc, size % dim) + part, n + size
        if current is not None:
            yield done()

    given = parts.select(by, F.col(chunk).cast("bigint").alias("__order"), F.col("n").cast("bigint").alias("n"), "acc").where(F.col("acc").isNotNull() & F.col("__order").isNotNull())
    level = materialised(given.mapInArrow(narrow, head), "compose")
    while True:
        dealt = blocked(level, [by], "__order", fan)
        folded = dealt.repartition(by, "__block").sortWithinPartitions(by, "__block", "__order").mapInArrow(fold, head)
        level = materialised(folded, "compose")
        if level.groupBy(by).agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            break
    last = level.select(by, F.lit(0).cast("bigint").alias("__block"), "width", "acc", "n", F.lit(0).cast("bigint").alias("last"))
    return fold_partials(last, [by], dim)


def consensus_members(registry: DataFrame, top: int = MERGE_TOP, min_score: float = MERGE_MIN_SCORE) -> DataFrame:
    """The best ``top`` fingerprints per task type with score >= ``min_score``, ranked.

    Equal scores: latest first, then id. Spark cuts to ``top`` rows per task before the shuffle.
    """
    best = Window.partitionBy("task_type").orderBy(F.desc("success_score"), F.desc("created_at"), F.asc("id"))
    good = registry.where(F.col("success_score") >= min_score)
    return good.withColumn("member", F.row_number().over(best)).where(F.col("member") <= top)


def hv_merge(registry: DataFrame, dim: int = HV_DIM, top: int = MERGE_TOP, min_score: float = MERGE_MIN_SCORE) -> DataFrame:
    """Consensus fingerprint per task type: score-weighted sum of its members' +-1 vectors.

    Scores are quantised to millionths so that the threshold is exact; the best member's
    summary stands for the consensus. Members are ranked without their vectors and summaries,
    which are joined to the few chosen rows by id.
    """
    chosen = consensus_members(registry.select("id", "task_type", "success_score", "created_at"), top, min_score)
    members = chosen.join(registry.select("id", "summary", "bits"), "id").drop("id", "created_at")

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("member").combine_chunks()
        bits = packed.unpack(packed.list_matrix(table.column("bits").combine_chunks(), np.int64), dim).astype(np.int64)
        weight = packed.quantise(table.column("success_score").to_numpy())
        total = ((2 * bits - 1) * weight[:, None]).sum(axis=0)
        return pa.table(
            {
                "task_type": pa.array([key[0].as_py()], pa.string()),
                "members": pa.array([table.num_rows], pa.int64()),
                "success_score": pa.array([float(np.mean(table.column("success_score").to_numpy()))]),
                "summary": pa.array([table.column("summary")[0].as_py()], pa.string()),
                "bits": packed.matrix_list(packed.pack((total >= 0)[None, :]), pa.int64()),
            }
        )

    return members.groupBy("task_type").applyInArrow(
        merge, "task_type string, members bigint, success_score double, summary string, bits array<bigint>"
    )
