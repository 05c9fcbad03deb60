"""Ranking, joining and medians that stay parallel when one key holds most rows.

Keys of up to ``block_rows`` rows are ranked by a window. The rows of larger keys are range-partitioned
by (key, order), written once, and numbered where they lie; each (key, partition) has one count, and the
offsets made of those turn places into positions. A block is a range of positions, so that a key of n rows
has ceil(n / block_rows) blocks whatever its order values are: crowded, sparse, negative or not numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speakerprint.session import materialised

BLOCK_ROWS = 65_536
HOT_ROWS = 1_000_000
#: Salts for rows of ``spread_join`` with a null key, which match nothing wherever they go.
NULL_SALTS = 1 << 30
#: Rows of keys or of partition offsets that are broadcast at most; more are joined by a shuffle.
SMALL_TABLE = 1_000_000


def block_of(order: str, block_rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer order value (floor division, also below zero)."""
    return F.expr(f"(CAST({order} AS BIGINT) - pmod(CAST({order} AS BIGINT), {block_rows})) div {block_rows}")


def _key(keys: Sequence[str]) -> Column:
    """Keys in one struct, with a field also where there are none; null fields are equal to each other."""
    return F.struct(*keys, F.lit(0).alias("__one"))


def _side(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, broadcast where its counted rows are few."""
    return F.broadcast(df) if rows <= SMALL_TABLE else df


def _light_and_heavy(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int, counts_from: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without the rows of keys of more than ``block_rows`` rows, and those rows with their places.

    The second frame is None where no key is that large, else it has ``__pos``, ``__total``,
    ``__block`` and ``__blocks`` besides. It is written to the shared folder before it is numbered:
    a range partitioning samples its input, and numbers must not change when a task runs again.
    """
    source = df if counts_from is None else counts_from
    sizes = source.groupBy(_key(keys).alias("__key")).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > block_rows)
    seen = sizes.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("__c"), F.lit(0)).alias("rows")).first()
    if not seen["keys"]:
        return df, None
    large = _side(sizes.select("__key"), seen["keys"])
    named = df.withColumn("__key", _key(keys))
    light = named.join(large, "__key", "left_anti").drop("__key")
    parts = -(-seen["rows"] // block_rows)
    along = ["__key", *order]
    dealt = named.join(large, "__key", "left_semi").repartitionByRange(parts, *along).sortWithinPartitions(*along)
    heavy = materialised(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    counts = heavy.groupBy("__key", part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy("__key")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__key", "__part", (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__c").over(whole).alias("__total")
    )
    joined = heavy.withColumn("__part", part).join(_side(offsets, parts + seen["keys"]), ["__key", "__part"])
    joined = joined.withColumn("__pos", F.col("__at") + F.col("__shift"))
    joined = joined.withColumn("__block", F.expr(f"__pos div {block_rows}")).withColumn("__blocks", F.expr(f"(__total + {block_rows - 1}) div {block_rows}"))
    return light, joined.drop("__key", "__part", "__at", "__shift")


def blocked(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], block_rows: int = BLOCK_ROWS, counts_from: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__block``: the position of a row inside its key, in order, div ``block_rows``.

    ``order`` is one or several columns that are unique inside a key together. ``counts_from`` has the
    same keys, row for row, and a cheaper lineage.
    """
    light, heavy = _light_and_heavy(df, keys, [order] if isinstance(order, str) else order, block_rows, counts_from)
    light = light.withColumn("__block", F.lit(0).cast("bigint"))
    return light if heavy is None else light.unionByName(heavy.drop("__pos", "__total", "__blocks"))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    pos: str = "pos",
    total: str | None = "n",
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """0-based position of every row inside its key, and the key's row count.

    ``order`` is one or several columns of any orderable types that are unique inside a key together.
    Rows with a null key are a key of their own and a null order comes first, as in a window. Rows of
    keys of up to ``block_rows`` rows are shuffled once, by key, and ranked by a window; a pass over
    the keys alone finds the larger ones. With ``keep_block`` the columns ``__block`` and ``__blocks`` (blocks of the key)
    stay; there, rows with a null order belong to no bundle and are left out. ``counts_from`` is another
    frame with the same keys, row for row, used for the counts when ``df`` is costly to compute twice.
    """
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    if keep_block:
        missing = reduce(or_, [F.col(c).isNull() for c in order])
        df, counts_from = (d if d is None else d.where(~missing) for d in (df, counts_from))
    light, heavy = _light_and_heavy(df, keys, order, block_rows, counts_from)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    light = light.withColumn("__pos", (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint"))
    light = light.withColumn("__total", F.count(F.lit(1)).over(whole)) if total else light
    if keep_block:
        light = light.withColumn("__block", F.lit(0).cast("bigint")).withColumn("__blocks", F.lit(1).cast("bigint"))
    out = light if heavy is None else light.unionByName(heavy.select(*light.columns))
    given = {pos: F.col("__pos"), **({total: F.col("__total")} if total else {})}
    return out.withColumns(given).drop("__pos", "__total")


def dense_index(df: DataFrame, key: str, name: str = "idx", total: str | None = "n") -> DataFrame:
    """Number the distinct values of ``key`` 0, 1, 2, ... in their order, without a global sort."""
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    return ranked(distinct, [], key, pos=name, total=total)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], sums: dict[str, str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running sums of columns along an order; those of large keys in two block-wise levels."""
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    light, heavy = _light_and_heavy(df, keys, order, block_rows)
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    light = light.select("*", *[F.sum(c).over(along).alias(name) for c, name in sums.items()])
    if heavy is None:
        return light
    heavy = heavy.withColumn("__place", F.struct(*keys, "__block"))
    totals = heavy.groupBy("__place").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(*[F.col("__place")[k] for k in keys] or [F.lit(0)]).orderBy(F.col("__place")["__block"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__place", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    inner = Window.partitionBy("__place").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = heavy.join(offsets, "__place")
    upto = [(F.sum(c).over(inner) + F.col(f"__o_{c}")).alias(name) for c, name in sums.items()]
    return light.unionByName(joined.select(*df.columns, *upto))


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Join whose hot keys are cut into several tasks.

    Keys of ``big`` with more than ``hot_rows`` rows are found by a counting pass. Their rows
    are salted by a hash of ``spread_by`` (deterministic, so that a retried task repeats it)
    and only the matching rows of ``small`` are replicated. The broadcast table of hot keys
    has at most |big| / hot_rows rows. Rows of ``big`` with a null key match nothing and are
    dealt out by the same hash. ``how`` is inner, left, left_semi or left_anti.
    ``hot_from`` is a frame with the same key values and a cheaper lineage for the counting pass.
    """
    on = list(on)
    fanout = F.ceil(F.col("__c") / F.lit(hot_rows)).cast("int")
    hot = (
        (big if hot_from is None else hot_from)
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__c"))
        .where(F.col("__c") > hot_rows)
        .select(*on, fanout.alias("__fanout"))
    )
    width = F.coalesce(F.col("__fanout"), F.lit(1))
    lost = reduce(or_, [F.col(c).isNull() for c in on])
    salt = F.pmod(F.xxhash64(*spread_by), F.when(lost, F.lit(NULL_SALTS)).otherwise(width)).cast("int")
    left = big.join(F.broadcast(hot), on, "left").withColumn("__salt", salt)
    right = small.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), width - 1)))
    joined = left.drop("__fanout").join(right.drop("__fanout"), [*on, "__salt"], how)
    return joined.drop("__salt")


def bit_filter(values: DataFrame, hashed: str, bits: int) -> Column:
    """Bitmap of a column of 64-bit hashes, as one array of words that a scan can look rows up in before they are shuffled.

    ``bits`` is a power of two; use :func:`may_hold` to ask. The array is made by Spark (bits set are ored per word) and reaches
    tasks as a scalar subquery.
    """
    low = F.col(hashed).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int"))
    words = values.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(one).alias("b"))
    every = values.sparkSession.range(max(1, bits // 64)).withColumnRenamed("id", "w").join(words, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x.b)).scalar()


def may_hold(words: Column, hashed: str, bits: int) -> Column:
    """False for hashes that are surely not among those of :func:`bit_filter`."""
    low = F.col(hashed).bitwiseAND(F.lit(bits - 1))
    return F.getbit(F.get(words, F.shiftright(low, 6).cast("int")), low.bitwiseAND(F.lit(63)).cast("int")) == 1


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact median per group, of any range of values and however they crowd.

    Equal values become one row with a count before they are shuffled; running counts along the distinct values, in
    blocks of ``block_rows`` where a group has more, tell which hold the middle ranks.
    """
    by = list(by)
    values = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counts = values.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = running_sums(counts, by, "__v", {"__c": "__end"}, block_rows)
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    if by:
        named = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__n")
        placed = upto.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]))
    else:
        placed = upto.withColumn("__n", sizes.scalar())

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("__end") > F.expr(rank), F.col("__v")))

    picked = placed.groupBy(*by).agg(at("(__n - 1) div 2").alias("__a"), at("__n div 2").alias("__b"))
    return picked.select(*by, ((F.col("__a") + F.col("__b")) / 2).alias(name))


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan by ``key`` when it has fewer partitions than the cluster has cores.

    For costly per-row text work on a few large row groups. A scan with enough partitions, as
    any large table has, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
