"""Scoring rules, reply parsing, statistics and verdicts on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from speakerprint.operators import abtest as A
from speakerprint.operators import experiment as X
from speakerprint.operators import tasks as K

CASES = [
    ("exact", " Negatively put\n", "negative", None, None, True),
    ("exact", "\tNEUTRAL", "neutral", None, None, True),
    ("exact", "it is neutral", "neutral", None, None, False),
    ("contains", "I think it is BLUE.", None, ["red", "blue"], None, True),
    ("contains", "green", None, ["red", "blue"], None, False),
    ("numeric", "= 66", "66", None, None, True),
    ("numeric", "66.", "66", None, None, False),
    ("numeric", "66.0", "66", None, None, False),
    ("numeric", "1,158", "1158", None, None, False),
    ("numeric", "from 80 to 2.4 hours", "2.4", None, None, True),
    ("numeric", None, "1", None, None, False),
    ("json", '```JSON\n{"age": 38, "city": "Oslo"}\n```', None, None, {"age": "38", "city": "oslo"}, True),
    ("json", '{"age": 38.0, "more": [1]}', None, None, {"age": "38"}, True),
    ("json", '{"age": "38"}', None, None, {"age": "38"}, True),
    ("json", '{"age": "38.0"}', None, None, {"age": "38"}, False),
    ("json", '{"city": "Oslo"}', None, None, {"age": "38"}, False),
    ("json", '{"age": null}', None, None, {"age": "null"}, True),
    ("json", '{"ok": true}', None, None, {"ok": "True"}, True),
    ("json", '{"age": 38', None, None, {"age": "38"}, False),
    ("json", '{"age": 38} thanks', None, None, {"age": "38"}, False),
    ("json", "[1, 2]", None, None, {"age": "38"}, False),
    ("unknown", "x", "x", None, None, False),
]


def test_scoring_rules(spark):
    schema = "scoring string, reply string, answer string, answers array<string>, answer_obj map<string,string>, want boolean"
    df = spark.createDataFrame(CASES, schema)
    wrong = K.score_tasks(df).where("ok <> want").collect()
    assert wrong == []


REPLIES = [
    (0, '{"score_x": 8, "score_y": 2, "winner": "X", "reasoning": "r"}'),
    (1, '```json\n{"score_x": 1, "score_y": 9, "winner": "Y", "reasoning": "r"}\n```'),
    (2, "no json"),
    (3, '{"score_x": 3, "score_y": 4, "reasoning": "r"}'),
    (4, '{"score_x": 3, "score_y": 4, "winner": "Z", "reasoning": "r"}'),
    (5, None),
]


def test_judgement_parsing_and_unblinding(spark):
    df = spark.createDataFrame(REPLIES, "id int, reply string").withColumn("flip", F.col("id") == 1)
    got = {r["id"]: r for r in A.unblind(A.parse_judgement(df)).collect()}
    assert [got[i]["parse_failed"] for i in range(6)] == [False, False, True, True, False, True]
    assert (got[2]["score_x"], got[2]["winner"], got[2]["tie"]) == (5.0, "tie", True)
    assert (got[0]["score_with"], got[0]["score_without"], got[0]["fingerprint_won"]) == (8.0, 2.0, True)
    assert (got[1]["score_with"], got[1]["score_without"], got[1]["fingerprint_won"]) == (9.0, 1.0, True)
    assert (got[4]["fingerprint_won"], got[4]["tie"]) == (False, False)
    stats = A.ab_stats(A.unblind(A.parse_judgement(df)).withColumn("model", F.lit("m"))).first()
    assert (stats["wins"], stats["losses"], stats["ties"], stats["total"], stats["win_rate"]) == (2, 1, 3, 6, 66.7)


def test_stats_without_decided_trials(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0, False, True)], "model string, score_with double, score_without double, fingerprint_won boolean, tie boolean")
    row = A.compare_models(df).first()
    assert (row["win_rate"], row["lift_pct"], row["verdict"]) == (0.0, 0.0, "not proven")
    both = {r["method"]: r for r in A.combine(df).collect()}
    assert both["macro"]["models"] == 0 and both["macro"]["trials"] == 0 and both["pooled"]["win_rate"] == 0.0


def test_macro_and_pooled_differ(spark):
    rows = [("a", 9.0, 1.0, True, False)] * 3 + [("b", 6.0, 3.0, True, False)] * 2 + [("b", 2.0, 4.0, False, False)] + [("c", 1.0, 2.0, False, False)] * 4
    df = spark.createDataFrame(rows, "model string, score_with double, score_without double, fingerprint_won boolean, tie boolean")
    got = {r["method"]: r for r in A.combine(df).collect()}
    assert (got["macro"]["models"], got["macro"]["trials"]) == (2, 6)
    assert got["macro"]["win_rate"] == pytest.approx((100.0 + 66.7) / 2)
    assert (got["pooled"]["models"], got["pooled"]["trials"], got["pooled"]["win_rate"]) == (3, 10, 50.0)


def test_pick_parsing(spark):
    df = spark.createDataFrame([(0, " A, since"), (1, "B it"), (2, "error"), (3, None)], "id int, reply string")
    got = {r["id"]: (r["pick"], r["is_error"]) for r in A.parse_pick(df).collect()}
    assert got == {0: ("A", False), 1: ("B", False), 2: ("B", True), 3: ("B", True)}


def test_blind_assignment_is_fair_and_repeats(spark):
    df = spark.range(4_000).withColumnRenamed("id", "trial_id")
    flips = A.assign_blind(df).where("flip").count()
    assert 1_850 < flips < 2_150
    again = A.assign_blind(df.repartition(7)).where("flip").count()
    assert again == flips


def test_gates(spark):
    rows = [("t", i < 24, i < 15) for i in range(25)]
    df = spark.createDataFrame(rows, "task string, ok_with boolean, ok_without boolean")
    total = K.task_stats(df).where("task is null")
    hard = K.task_gate(total, "hard").first()
    assert (hard["n_with"], hard["n_without"], hard["helped"], hard["lift_pct"], hard["passed"], hard["shown"]) == (24, 15, 9, 60.0, True, True)
    none = K.task_gate(K.task_stats(df.withColumn("ok_without", F.lit(False))).where("task is null"), "easy").first()
    assert (none["lift_pct"], none["passed"]) == (0.0, False)


def test_similarity_stats_of_listed_scores(spark):
    scores = [0.51, 0.724, 0.514, 0.555, 0.757, 0.459, 0.649, 0.371, 0.533, 0.366]
    row = X.similarity_stats(spark.createDataFrame([(s,) for s in scores], "score double")).first()
    assert row["n_messages"] == 10 and row["above_0_7"] == 2 and row["above_0_6"] == 3
    assert row["median"] == pytest.approx((0.514 + 0.533) / 2) and row["best"] == 0.757


def test_running_accuracy_reports_full_blocks(spark):
    df = spark.range(250).select(F.col("id").alias("trial"), (F.col("id") < 50).alias("correct"))
    got = sorted((r["trials"], r["running_accuracy"]) for r in X.running_accuracy(df).collect())
    assert got == [(100, 0.5), (200, 0.25)]
