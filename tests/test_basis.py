"""Principal components, projections, statistics and embeddings."""

import numpy as np
import pytest

from speakerprint.operators import basis as B
from speakerprint.operators.embed import embed


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    return {0: rng.normal(size=(90, 8)) * np.arange(1, 9), 1: rng.normal(size=(5, 8)), 2: rng.normal(size=(1, 8))}


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(s, s * 1000 + i, v.tolist()) for s, m in data.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "label int, vec_id bigint, embedding array<double>").repartition(3)


def plain(x):
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    return B.fixed_signs(vt[: min(x.shape)]), (s**2 / (s**2).sum())[: min(x.shape)]


def test_shared_basis_matches_svd(df, data):
    x = np.concatenate(list(data.values()))
    basis = B.fit_shared_basis(df)
    components, ratio = plain(x)
    assert np.allclose(basis.mean, x.mean(axis=0))
    assert np.allclose(basis.components, components, atol=1e-8)
    assert np.allclose(basis.evr, ratio)
    got = {r["vec_id"]: r["projected"] for r in B.project(df, basis.truncated(3)).collect()}
    assert np.allclose(got[1], (data[0][1] - x.mean(axis=0)) @ components[:3].T)


@pytest.mark.parametrize("block", [2, 7, 1 << 13])
def test_speaker_bases_match_svd_for_any_block(df, data, block):
    got = {r["label"]: r for r in B.fit_speaker_bases(df, "label", "vec_id", block_rows=block).collect()}
    for s in (0, 1):
        components, ratio = plain(data[s])
        k = 8 if s == 0 else 4
        assert (got[s]["n"], got[s]["d"], got[s]["degenerate"]) == (len(data[s]), 8, False)
        assert np.allclose(got[s]["evr"][:k], ratio[:k], atol=1e-8)
        assert np.allclose(np.array(got[s]["components"])[:k], components[:k], atol=1e-5)
    assert got[2]["degenerate"] and got[2]["evr"] is None and got[2]["k"] == 0


def test_variance_of_degenerate_basis_is_null(df):
    bases = B.fit_speaker_bases(df, "label", "vec_id").select("label", B.variance_k("evr", 4).alias("v"))
    got = {r["label"]: r["v"] for r in bases.collect()}
    assert got[2] is None and 0 < got[0] < 1 and got[1] == pytest.approx(1.0)


def test_projection_by_speaker(df, data):
    bases = B.fit_speaker_bases(df, "label", "vec_id", k=2)
    rows = B.project_by_speaker(df, bases, "label", "vec_id", block_rows=10).collect()
    got = {r["vec_id"]: r["projected"] for r in rows}
    assert len(got) == 96
    want = (data[0] - data[0].mean(axis=0)) @ plain(data[0])[0][:2].T
    assert np.allclose(got[3], want[3], atol=1e-6)
    assert got[2000] == []


def test_speaker_stats(df, data):
    got = {(r["label"], r["dim"]): r for r in B.speaker_stats(df, "label").collect()}
    assert len(got) == 24
    assert got[0, 5]["mean"] == pytest.approx(data[0][:, 5].mean(), abs=1e-6)
    assert got[0, 5]["var"] == pytest.approx(data[0][:, 5].var(), abs=1e-4)
    assert got[2, 0]["var"] == 0.0


def test_embed_methods(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, "hello there"), (3, "other words"), (4, None), (5, "")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed(df, "hash", dim=32).collect()}
    assert all(len(v) == 32 for v in got.values()) and got[1] == got[2] != got[3]
    own = embed(df, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {r["id"]: r["embedding"] for r in own.collect()}[1] == [11.0, 1.0]
    moved = embed(own.withColumnRenamed("embedding", "v"), "column", column="v")
    assert moved.schema["embedding"].dataType.simpleString() == "array<float>"
