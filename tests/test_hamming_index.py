"""The metric index against comparing everything: same rows, fewer comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speakerprint.functions import packed
from speakerprint.operators import hamming_index as I
from speakerprint.operators import match as J

DIM = 1_000


def planted(spark, clusters=12, each=30, seed=1):
    """Copies of a few leaders with 2 to 15 % of their bits turned, ties and repeated rows among them."""
    rng = np.random.default_rng(seed)
    leaders = rng.integers(0, 2, (clusters, DIM))
    bits = np.repeat(leaders, each, axis=0) ^ (rng.random((clusters * each, DIM)) < rng.uniform(0.02, 0.15, (clusters * each, 1)))
    bits[5] = bits[4]
    rows = [(i, 3 * i % 1000, packed.pack(b[None, :])[0].tolist()) for i, b in enumerate(bits)] + [(9_999, 9_999, None)]
    cand = spark.createDataFrame(rows, "candidate bigint, ord bigint, bits array<bigint>")
    q = [(i % 11, packed.pack(b[None, :])[0].tolist()) for i, b in enumerate(leaders)] + [(77, None)]
    return spark.createDataFrame(q, "query_id bigint, bits array<bigint>"), cand


def rows(df):
    return sorted(map(str, df.select("query_id", "candidate", "ord", "score", "rank").collect()))


@pytest.fixture(scope="module")
def data(spark):
    q, c = planted(spark)
    return q.cache(), c.cache()


@pytest.mark.parametrize("k,theta", [(1, None), (7, None), (500, None), (5, 0.75), (100, 0.5)])
def test_equal_to_comparing_everything(data, k, theta):
    q, c = data
    index = I.build_index(c, DIM, cell_rows=10)
    assert rows(I.search(q, index, k, theta)) == rows(J.top_candidates(q, c, k, theta, DIM))


def test_most_is_skipped(data):
    q, c = data
    index = I.build_index(c, DIM, cell_rows=10)
    for k, theta in ((10, 0.75), (1, None)):
        seen = I.pruning(q, index, k, theta).collect()
        assert len(seen) == 12 and all(r["candidates"] == 360 and r["cells"] == len(index.ids) for r in seen)
        assert sum(r["compared"] for r in seen) < 0.2 * 12 * 360


def test_methods_of_retrieve_and_identify(data):
    q, c = data
    assert rows(J.retrieve(q, c, 4, 0.75, DIM, method="pruned", cell_rows=16)) == rows(J.retrieve(q, c, 4, 0.75, DIM))
    got = J.identify(q, c, DIM, method="pruned").select("query_id", "candidate", "score")
    assert sorted(map(str, got.collect())) == sorted(map(str, J.identify(q, c, DIM).select("query_id", "candidate", "score").collect()))


def test_nothing_to_search(spark, data):
    q, c = data
    empty = I.build_index(c.where("candidate < 0"), DIM)
    assert I.search(q, empty, 3).collect() == [] and I.search(q, empty, 3, 0.5).collect() == []
    assert I.search(q.where("query_id < 0"), I.build_index(c, DIM), 3).collect() == []
    assert {r["compared"] for r in I.pruning(q, empty, 3, 0.5).collect()} == {0}


def test_equal_candidates_share_one_pivot(spark):
    word = packed.pack(np.ones((1, DIM), dtype=int))[0].tolist()
    c = spark.range(40).select(F.col("id").alias("candidate"), F.col("id").alias("ord"), F.array(*map(F.lit, word)).alias("bits"))
    index = I.build_index(c, DIM, cell_rows=8)
    assert len(index.pivots) == 1 and len(index.ids) == 5
    q = c.limit(1).select(F.lit(1).cast("bigint").alias("query_id"), "bits")
    assert [r["candidate"] for r in I.search(q, index, 3).orderBy("rank").collect()] == [0, 1, 2]
