"""Block-wise ranking, joins and medians against plain computation, with tiny blocks."""

import statistics

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from speakerprint.operators import scale as S


def skewed(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    order = rng.permutation(n * 3)[:n]
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "o": order, "v": rng.normal(size=n).round(2)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_ranked_matches_plain_rank_for_any_block(spark):
    pdf, df = skewed(spark)
    want = pdf.assign(pos=pdf.groupby("k")["o"].rank().astype(int) - 1, n=pdf.groupby("k")["o"].transform("size"))
    expected = sorted(map(tuple, want[["k", "o", "pos", "n"]].values.tolist()))
    for rows in (1, 7, 100, 10**6):
        got = sorted(tuple(r) for r in S.ranked(df, ["k"], "o", block_rows=rows).select("k", "o", "pos", "n").collect())
        assert got == expected


def test_ranked_without_keys_and_negative_order(spark):
    df = spark.range(50).select((F.col("id") - 25).alias("o"))
    got = sorted(tuple(r) for r in S.ranked(df, [], "o", block_rows=8).select("o", "pos", "n").collect())
    assert got == [(i - 25, i, 50) for i in range(50)]


def test_dense_index_numbers_strings_once(spark):
    df = spark.createDataFrame([(f"s{i % 30}",) for i in range(200)], ["name"])
    rows = S.dense_index(df, "name").collect()
    assert sorted(r["idx"] for r in rows) == list(range(30))
    assert {r["name"] for r in rows} == {f"s{i}" for i in range(30)}


def test_running_sums(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    got = {r["id"]: r["s"] for r in S.running_sums(df, [], "id", {"x": "s"}, block_rows=9).collect()}
    total = 0
    for i in range(100):
        total += i % 7
        assert got[i] == total


def test_spread_join_equals_join_with_hot_keys(spark):
    pdf, df = skewed(spark)
    small = spark.createDataFrame([(i, f"n{i}") for i in range(0, 40, 2)], ["k", "name"])
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, df.join(small, ["k"], how).collect()))
        got = sorted(map(str, S.spread_join(df, small, ["k"], ["o"], how, hot_rows=10).collect()))
        assert got == want


def test_spread_join_salts_only_hot_keys(spark):
    pdf, df = skewed(spark)
    small = spark.createDataFrame([(i,) for i in range(40)], ["k"])
    joined = S.spread_join(df, small, ["k"], ["o"], hot_rows=50)
    assert joined.count() == len(pdf)
    assert joined.columns == ["k", "o", "v"]


def test_exact_median(spark):
    pdf, df = skewed(spark, 601)
    for rows in (7, 1 << 16):
        got = {r["k"]: r["median"] for r in S.exact_median(df, ["k"], "v", block_rows=rows).collect()}
        want = {k: statistics.median(g["v"]) for k, g in pdf.groupby("k")}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    whole = S.exact_median(df, [], "v").first()["median"]
    assert abs(whole - statistics.median(pdf["v"])) < 1e-12


def test_exact_median_of_any_range_and_crowd(spark):
    """A million equal values, and values of all magnitudes: equal values are one row before they are shuffled."""
    equal = spark.range(1_000_000).select(F.lit(None).cast("int").alias("k"), F.lit(0.25).alias("v"))
    wide = [(1, v) for v in (-1e300, -5.0, -1e-300, 0.0, 1e-300, 3e-300, 7.5, 1e18, 1e300, 1e301)] + [(2, None)]
    df = equal.unionByName(spark.createDataFrame(wide, "k int, v double"))
    assert {r["k"]: r["median"] for r in S.exact_median(df, ["k"], "v", block_rows=3).collect()} == {None: 0.25, 1: 2e-300}


def test_null_keys_and_orders_are_ranked_and_summed_as_in_a_window(spark):
    rows = [(None, 1, 5), (None, 900, 7), ("a", None, 2), ("a", 3, 4), ("a", -70, 1), (None, None, 9)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    w = Window.partitionBy("k").orderBy("o")
    placed = S.ranked(df, ["k"], "o", block_rows=10)
    assert placed.columns == ["k", "o", "v", "pos", "n"]
    want = df.select("k", "o", "v", (F.row_number().over(w) - 1).alias("pos"), F.count("v").over(Window.partitionBy("k")).alias("n"))
    assert set(map(tuple, placed.collect())) == set(map(tuple, want.collect()))
    summed = S.running_sums(df, ["k"], "o", {"v": "upto"}, block_rows=10)
    assert set(map(tuple, summed.collect())) == set(map(tuple, df.withColumn("upto", F.sum("v").over(w)).collect()))


def test_null_join_keys_are_dealt_out(spark):
    big = spark.range(400).select(F.when(F.col("id") < 8, F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(1, "x"), (None, "y")], "k bigint, name string")
    out = S.spread_join(big, small, ["k"], ["id"], how="left", hot_rows=10)
    assert out.count() == 400
    assert [tuple(r) for r in out.where("name IS NOT NULL").select("k", "id", "name").collect()] == [(1, 1, "x")]


def test_blocks_follow_rows_not_values(spark):
    """Clustered, sparse, negative and extreme values: every key has ceil(n / block) blocks, and no block has more rows than that."""
    rows = [(k, (i - 200) * 10**12 + k) for k in range(20) for i in range(20)]
    rows += [(99, i * 10**9) for i in range(1_000)] + [(99, 2**63 - 1), (99, -(2**63))]
    rows += [(98, c * 10**15 + i) for c in (-1, 1) for i in range(1_000)] + [(None, -i) for i in range(150)]
    df = spark.createDataFrame(rows, "k bigint, o bigint")
    out = S.ranked(df, ["k"], "o", block_rows=100, keep_block=True)
    blocks = {r["k"]: r["n"] for r in out.groupBy("k").agg(F.count_distinct("__block").alias("n")).collect()}
    assert blocks == {**dict.fromkeys(range(20), 1), 99: 11, 98: 20, None: 2}
    assert out.groupBy("k", "__block").count().agg(F.max("count")).first()[0] == 100
    assert out.where("__blocks <> CASE WHEN k IS NULL THEN 2 WHEN k = 99 THEN 11 WHEN k = 98 THEN 20 ELSE 1 END").count() == 0
    by_key = {k: sorted(x for j, x in rows if j == k) for k in blocks}
    want = {(k, o, by_key[k].index(o)) for k, o in rows}
    assert {tuple(r) for r in out.select("k", "o", "pos").collect()} == want
    whole = S.blocked(df, [], ["k", "o"], block_rows=100)
    assert sorted(r["count"] for r in whole.groupBy("__block").count().collect()) == [52] + [100] * 35


def test_large_keys_are_numbered_in_bounded_tasks(spark, monkeypatch):
    """Without adaptive execution, no partition of a range-partitioned key gets far more than its share."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    written, write = [], S.materialised
    monkeypatch.setattr(S, "materialised", lambda df, name: written.append(write(df, name)) or written[-1])
    try:
        df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), (F.pow("id", 2) % 7919 * 10**6 + F.col("id")).cast("bigint").alias("o"))
        _, heavy = S._light_and_heavy(df, ["k"], ["o"], 1_000)
        sizes = [r["count"] for r in written[0].groupBy(F.shiftright("__at", 33)).count().collect()]
        assert sum(sizes) == 26_666 and max(sizes) <= 2_000
        assert heavy.groupBy("__block").count().agg(F.max("count"), F.count("*")).first()[0:2] == (1_000, 27)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_orders_of_several_columns_and_texts(spark):
    rows = [(i % 3, f"w{i * 7919 % 500:04d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a string, b int")
    for block in (20, 1_000):
        got = {(r["k"], r["a"], r["b"]): (r["pos"], r["n"]) for r in S.ranked(df, ["k"], ["a", "b"], block_rows=block).collect()}
        for k in range(3):
            own = sorted((a, b) for j, a, b in rows if j == k)
            assert [got[(k, a, b)] for a, b in own] == [(i, len(own)) for i in range(len(own))]
        sums = {(r["k"], r["a"], r["b"]): r["s"] for r in S.running_sums(df, ["k"], ["a", "b"], {"b": "s"}, block_rows=block).collect()}
        assert all(sums[(0, a, b)] == sum(y for j, x, y in rows if j == 0 and (x, y) <= (a, b)) for j, a, b in rows if j == 0)
