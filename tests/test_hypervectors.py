"""Seeds against a plain numpy reading of the definition, and the algebra of their parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speakerprint.functions import packed
from speakerprint.functions.mixing import mix, mix_array
from speakerprint.operators import hypervectors as H

DIM = 320


def vectors(speakers=5, n=23, d=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, t, rng.normal(size=d).astype(np.float32).tolist()) for s in range(speakers) for t in range(n)]
    return rows + [(99, 4, rng.normal(size=d).astype(np.float32).tolist())]


@pytest.fixture(scope="module")
def rows():
    return vectors()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "label int, vec_id bigint, embedding array<float>").repartition(4)


def plain_seeds(rows, center, dim=DIM, roll=True):
    q = {(s, t): packed.quantise(np.array(v, dtype=np.float64)) for s, t, v in rows}
    allsum, alln = sum(q.values()), len(q)
    r = packed.sign_matrix(len(rows[0][2]), dim, H.HV_SEED, "sign").astype(np.int64)
    out = {}
    for s in sorted({s for s, _, _ in rows}):
        turns = sorted(t for x, t, _ in rows if x == s)
        own = [q[s, t] for t in turns]
        acc = np.zeros(dim, dtype=np.int64)
        for i, x in enumerate(own):
            if center == "shared":
                x = alln * x - allsum
            elif center == "speaker":
                x = len(own) * x - sum(own)
            h = np.where(x @ r >= 0, 1, -1)
            acc += np.roll(h, len(turns) - 1 - i) if roll else h
        out[s] = acc
    return out


def collected(seeds, by="label"):
    return {r[by]: np.array(r["acc"]) for r in seeds.collect()}


def same(a, b):
    return a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_mixer_is_the_same_in_numpy_and_sql(spark):
    got = spark.range(500).select(mix("id * 1000003", "id + 7").alias("z")).collect()
    i = np.arange(500, dtype=np.int64)
    assert [r["z"] for r in got] == mix_array(i * 1000003, i + 7).tolist()


def test_sign_matrix_is_balanced_and_row_stable():
    r = packed.sign_matrix(64, 4096, 42, "sign")
    assert abs(r.mean()) < 0.01
    assert (packed.sign_matrix(16, 4096, 42, "sign") == r[:16]).all()
    corr = (r @ r.T) / 4096 - np.eye(64)
    assert np.abs(corr).max() < 0.1


def test_pack_round_trip_and_hamming():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (9, 150)).astype(np.uint8)
    p = packed.pack(bits)
    assert p.shape == (9, 3)
    assert (packed.unpack(p, 150) == bits).all()
    want = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    assert (packed.hamming(p, p) == want).all()


def test_exact_product_beyond_float_range():
    rng = np.random.default_rng(0)
    q = rng.integers(-(1 << 50), 1 << 50, (3, 40))
    sign = packed.sign_matrix(40, 20, 1, "sign")
    want = [[sum(int(a) * int(b) for a, b in zip(row, col)) for col in sign.T] for row in q]
    assert packed.project_exact(q, sign).tolist() == want


@pytest.mark.parametrize("center", [None, "shared", "speaker"])
@pytest.mark.parametrize("block", [5, 1 << 20])
def test_seeds_match_definition(df, rows, center, block):
    seeds = H.fingerprints(df, "label", "vec_id", dim=DIM, center=center, block_rows=block)
    got = {r["label"]: r for r in seeds.collect()}
    want = plain_seeds(rows, center)
    assert same({k: np.array(r["acc"]) for k, r in got.items()}, want)
    for k, r in got.items():
        bits = packed.unpack(np.array([r["bits"]], dtype=np.int64), DIM)[0]
        assert (bits == (want[k] >= 0)).all()
        assert r["degenerate"] == (center == "speaker" and k == 99)
    if center == "speaker":
        assert (want[99] == 1).all()


def test_bag_ignores_order(df, rows):
    seeds = H.fingerprints(df, "label", "vec_id", dim=DIM, bind="bag", block_rows=4)
    assert same(collected(seeds), plain_seeds(rows, "shared", roll=False))


def test_roll_by_dim_is_identity(spark, df):
    far = df.withColumn("vec_id", F.col("vec_id") + F.lit(DIM))
    coded = [H.hv_encode(x.where("label < 99"), dim=DIM) for x in (df, far)]
    a, b = (collected(H.hv_bundle(c, "label", "vec_id", DIM, position="turn")) for c in coded)
    assert same(a, b)


@pytest.mark.parametrize("size", [1, 4, 23])
def test_composition_of_chunks_equals_whole(df, rows, size):
    coded = H.hv_encode(df.where("label < 99"), dim=DIM)
    chunked = coded.withColumn("chunk", F.expr(f"vec_id div {size}")).withColumn("inner", F.col("vec_id") % size)
    chunks = H.hv_bundle(chunked, ["label", "chunk"], "inner", DIM)
    whole = {k: v for k, v in plain_seeds(rows, None).items() if k < 99}
    assert same(collected(H.hv_compose(chunks, "label", "chunk", DIM)), whole)


def test_missing_vectors_stay_null_in_encode(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, None)], "id int, embedding array<float>")
    got = {r["id"]: r["bits"] for r in H.hv_encode(df, dim=64).collect()}
    assert got[1] is not None and got[2] is None


def test_gaussian_projection_agrees_with_numpy(spark, df, rows):
    coded = H.hv_encode(df, dim=DIM, projection="gaussian").collect()
    r = np.random.RandomState(H.HV_SEED).randn(16, DIM).astype(np.float32)
    vec = {(s, t): np.array(v) for s, t, v in rows}
    for row in coded[:10]:
        want = vec[row["label"], row["vec_id"]] @ r.astype(np.float64) >= 0
        assert (packed.unpack(np.array([row["bits"]], dtype=np.int64), DIM)[0] == want).all()


def test_merge_weighs_by_score(spark):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (8, DIM)).astype(np.uint8)
    score = [0.9, 0.95, 0.85, 0.8, 0.99, 0.81, 0.5, None]
    table = [(i, "t", f"s{i}", score[i], i, packed.pack(bits[i : i + 1])[0].tolist()) for i in range(8)]
    reg = spark.createDataFrame(table, "id int, task_type string, summary string, success_score double, created_at int, bits array<bigint>")
    row = H.hv_merge(reg, DIM).first()
    best = [4, 1, 0, 2, 5]
    total = sum((2 * bits[i].astype(int) - 1) * round(score[i] * 1_000_000) for i in best)
    assert row["members"] == 5 and row["summary"] == "s4"
    assert (packed.unpack(np.array([row["bits"]], dtype=np.int64), DIM)[0] == (total >= 0)).all()
