"""What a row costs: expressions that were computed once for each use, and tasks that held too much."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speakerprint.functions import packed
from speakerprint.functions.jsontext import script_number
from speakerprint.operators import hamming_index, hypervectors, match
from speakerprint.operators.tasks import score_json
from speakerprint.sources import archives


def planned(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_number_is_formatted_once_per_try(spark):
    """The digits of a number were searched anew wherever its text used them."""
    df = spark.createDataFrame([(x,) for x in (0.1, 2.0**-44, 1e21, 9007199254740992.0, -1.5, 1e15, 1e300, 0.0, 123456.789)], "x double")
    told = df.select("x", script_number(F.col("x")).alias("t"))
    assert planned(told).count("%.") <= 5
    assert [float(r["t"]) for r in told.collect()] == [r["x"] for r in told.collect()]
    assert [r["t"] for r in told.collect()][-4:] == ["1000000000000000", "1e+300", "0", "123456.789"]


@pytest.mark.parametrize(
    "reply, want", [('{"k": 5, "j": null}', True), ('{"k": 5}', False), ('{"k": 6, "j": null}', False), ("{", False), (None, False), ('{"k": 5, "j": "NULL"}', True)]
)
def test_a_reply_is_parsed_once(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    scored = df.select(score_json("reply", F.create_map(F.lit("k"), F.lit("5"), F.lit("j"), F.lit("null"))).alias("ok"))
    assert planned(scored).count("try_parse_json") == 1
    assert scored.first()["ok"] is want


def test_many_archives_are_handed_on_together():
    """Every archive was a table of its own."""
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(2_500)], "content": [b"x" * 20] * 2_500})
    out = list(archives._opened(iter([batch]), True))
    assert [b.num_rows for b in out] == [1_024, 1_024, 452] and [p for b in out for p in b.column("path").to_pylist()] == batch.column("path").to_pylist()
    assert not any(b.column("is_zip")[0].as_py() for b in out) and list(archives._opened(iter([]), True)) == []


def test_banded_cells_find_what_bands_share():
    """Rows went to a cell of each of their 64 bands with all of their bits."""
    rng = np.random.default_rng(3)
    cm = rng.integers(-(1 << 62), 1 << 62, (300, 16))
    qm = cm[::10].copy()
    qm[:, 0] ^= rng.integers(0, 1 << 40, len(qm))
    ords = pa.chunked_array([pa.array([*range(298), None, None], pa.int64())])
    got = {(int(r), int(c), int(h)) for rows, cols, ham in match._sharing(qm, cm, ords, 64, 1_024, 2, 400) for r, c, h in zip(rows, cols, ham)}
    want = set()
    chunks = [m.view("<u2") for m in (qm, cm)]
    for r in range(len(qm)):
        shared = [c for c in range(300) if (chunks[0][r] == chunks[1][c]).any()]
        near = sorted((int(np.bitwise_count((qm[r] ^ cm[c]).view(np.uint64)).sum()), c) for c in shared)
        want |= {(r, c, h) for h, c in [x for x in near if x[0] <= 400][:2]}
    assert got == want and len(want) >= 30


def test_banded_shuffles_no_row_per_band(spark):
    rows = spark.range(200).selectExpr("id", "transform(sequence(1, 16), i -> xxhash64(id, i)) AS bits")
    q, c = rows.where("id % 50 = 0").selectExpr("id AS query_id", "bits"), rows.selectExpr("id AS candidate", "id AS ord", "bits")
    hits = match.retrieve(q, c, 3, 0.75, 1_024, method="banded")
    assert "band" not in planned(hits)
    assert {(r["query_id"], r["candidate"], r["rank"]) for r in hits.collect()} == {(i, i, 1) for i in (0, 50, 100, 150)}


def test_a_query_is_not_copied_for_all_of_its_cells_at_once(spark):
    """A batch of queries times its cells was one table with the bits of every pair."""
    rows = spark.range(600).selectExpr("id", "transform(sequence(1, 16), i -> xxhash64(id, i)) AS bits")
    index = hamming_index.build_index(rows.selectExpr("id AS candidate", "id AS ord", "bits"), 1_024, cell_rows=8)
    visits = hamming_index._visits(rows.selectExpr("id AS query_id", "bits").coalesce(1), index, 1_024)
    assert hamming_index.VISIT_ROWS == 2_048 and visits.count() == 600 * len(index.ids)


def test_a_task_projects_few_rows_at_a_time(spark, monkeypatch):
    """1,024 rows by 10,000 dimensions were held in several forms."""
    df = spark.createDataFrame([(1, [0.5] * 32)], "id bigint, projected array<double>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: fn)
    encode = hypervectors.hv_encode_prefixes(df, (1, 32))
    x = np.random.default_rng(1).normal(size=(2_048, 32))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_048), pa.int64()), packed.matrix_list(x, pa.float64())], names=["id", "projected"])
    packed.sign_matrix(32, 10_000, hypervectors.HV_SEED, "sign")
    tracemalloc.start()
    rows = sum(b.num_rows for b in encode(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 2 * 2_048 and peak < 120
