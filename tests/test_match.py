"""Identification and retrieval against brute force; planted speakers must be found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speakerprint.functions import packed
from speakerprint.operators import experiment as X
from speakerprint.operators import hypervectors as H
from speakerprint.operators import match as J

DIM = 256


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2, (60, DIM))
    near = np.where(rng.random((40, DIM)) < 0.08, 1 - base[:40], base[:40])
    copies = np.repeat(base[:1], 30, axis=0)
    cand = np.concatenate([base, copies]).astype(np.uint8)
    query = np.concatenate([near, base[:5]]).astype(np.uint8)
    c = spark.createDataFrame(
        [(f"c{i:03d}", i, w.tolist()) for i, w in enumerate(packed.pack(cand))], "candidate string, ord bigint, bits array<bigint>"
    )
    q = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(packed.pack(query))], "query_id bigint, bits array<bigint>")
    ham = (query[:, None, :] != cand[None, :, :]).sum(axis=2)
    return q, c, ham


def brute(ham, k, theta):
    out = set()
    for i, row in enumerate(ham):
        score = (DIM - 2 * row) / DIM
        best = sorted(range(len(row)), key=lambda j: (-score[j], j))[: k or len(row)]
        out |= {(i, j, float(score[j]), r + 1) for r, j in enumerate(best) if theta is None or score[j] > theta}
    return out


def hits(df):
    return {(r["query_id"], r["ord"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k,theta", [(1, None), (3, 0.75), (None, None), (40, 0.5)])
def test_broadcast_and_blocks_equal_brute_force(coded, k, theta):
    q, c, ham = coded
    want = brute(ham, k, theta)
    assert hits(J.top_candidates(q, c, k, theta, DIM)) == want
    blocks = J._by_blocks(q, J._candidate_columns(c), [], k, theta, DIM, query_block=7, candidate_block=11)
    assert hits(blocks) == want


def test_first_candidate_wins_ties(coded):
    q, c, _ = coded
    row = J.identify(q.where("query_id = 40"), c, DIM).first()
    assert (row["candidate"], row["score"]) == ("c000", 1.0)


def test_candidate_limit_switches_to_blocks(coded):
    q, c, ham = coded
    assert hits(J.top_candidates(q, c, 2, None, DIM, broadcast_limit=10)) == brute(ham, 2, None)


def test_banded_recall_and_no_false_hit(coded):
    q, c, ham = coded
    want = brute(ham, 100, 0.75)
    got = hits(J.retrieve(q, c, 100, 0.75, DIM, method="banded"))
    assert {(a, b, s) for a, b, s, _ in got} <= {(a, b, s) for a, b, s, _ in want}
    assert len(got) >= 0.9 * len(want)


def test_hot_bands_are_cut_into_cells(coded):
    q, c, _ = coded
    qb, cb = J.band_keys(q, 16), J.band_keys(J._candidate_columns(c), 16, bits="cbits")
    keys = ["band", "band_value"]
    whole = hits(J._by_blocks(qb, cb, keys, 100, 0.75, DIM))
    assert len(whole) > 60
    assert hits(J._by_blocks(qb, cb, keys, 100, 0.75, DIM, query_block=2, candidate_block=3)) == whole


def test_retrieve_adds_summary(spark, coded):
    q, c, _ = coded
    reg = spark.createDataFrame([("c001", "one"), ("c002", "two")], "id string, summary string")
    got = {r["candidate"]: r["summary"] for r in J.retrieve(q.where("query_id in (1, 2, 3)"), c, 1, 0.5, DIM, registry=reg).collect()}
    assert got == {"c001": "one", "c002": "two", "c003": None}


def test_theta_is_strict():
    assert (256 - 2 * J._most(0.75, 256)) / 256 > 0.75
    assert (256 - 2 * (J._most(0.75, 256) + 1)) / 256 <= 0.75
    assert J._most(None, 256) == 256


def test_band_names(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.5,), (0.49,), (0.4,), (0.39,)], "score double")
    assert [r[0] for r in df.select(J.similarity_band()).collect()] == ["high", "good", "good", "fair", "fair", "poor"]


def test_cosine_of_zero_vector_is_zero(spark):
    a = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0])], "id int, embedding array<double>")
    got = {r["id"]: r["score"] for r in J.message_similarity(a, a, "id").collect()}
    assert got[1] == 0.0 and abs(got[2] - 1.0) < 1e-12


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    means = rng.normal(size=(12, 64))
    rows = [(s, s * 40 + t, (means[s] + 0.8 * rng.normal(size=64)).astype(np.float32).tolist()) for s in range(12) for t in range(40)]
    return spark.createDataFrame(rows, "label int, vec_id bigint, embedding array<float>")


def test_planted_speakers_are_identified(planted):
    from speakerprint.operators.messages import split

    parts = split(planted, "label", "vec_id")
    train, heldout = parts.where("part = 'train'"), parts.where("part = 'heldout'")
    center = H.shared_center(train)
    seeds = H.hv_bundle(H.hv_encode(train.select("label", "pos", "embedding"), dim=1024, center=center), "label", "pos", 1024, bind="bag", position="turn")
    trials = X.make_trials(planted.select("label"), "label", 300, 10)
    drawn = X.trial_queries(trials, heldout.select("label", "vec_id", "embedding"), "label", "vec_id")
    answers = X.run_identification(trials, H.hv_query(drawn, center, dim=1024), seeds, "label", 1024)
    row = X.binomial_test(X.accuracy(answers)).first()
    assert row["n_trials"] == 300 and row["accuracy"] > 0.9 and row["lift"] > 9
    assert row["log10_p"] < -100


def test_ablation_improves_with_components(planted):
    from speakerprint.operators.messages import split

    parts = split(planted, "label", "vec_id")
    got = X.k_ablation(parts.where("part = 'train'"), parts.where("part = 'heldout'"), "label", "vec_id", ks=(1, 8), n=200, dim=512)
    acc = {r["k"]: r["accuracy"] for r in got.collect()}
    assert acc[8] > acc[1] and acc[8] > 0.8


def test_trials_need_enough_speakers(planted):
    with pytest.raises(ValueError):
        X.make_trials(planted.select("label"), "label", 10, 13)


def test_trials_are_distinct_and_uniform(planted):
    t = X.make_trials(planted.select("label"), "label", 2_000, 5)
    assert t.groupBy("trial").agg(F.countDistinct("label").alias("d"), F.count_if("is_truth").alias("t")).where("d <> 5 or t <> 1").count() == 0
    truth = [r["count"] for r in t.where("is_truth").groupBy("label").count().collect()]
    assert len(truth) == 12 and min(truth) > 110 and max(truth) < 230


def test_binomial_tail_values():
    assert abs(X._log10_tail(520, 1000, 0.1) - -242.8) < 0.1
    assert abs(10 ** X._log10_tail(2, 3, 0.5) - 0.5) < 1e-12
    assert X._log10_tail(0, 10, 0.5) == 0.0
    assert abs(10 ** X._log10_tail(1, 10, 0.5) - (1 - 2**-10)) < 1e-12
