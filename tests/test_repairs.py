"""Regressions: white space around JSON, ragged vectors, long sums."""

import io
import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from speakerprint.functions.jsontext import strict_object
from speakerprint.functions.packed import list_matrix
from speakerprint.functions.text import script_strip
from speakerprint.operators import match
from speakerprint.operators.basis import speaker_stats
from speakerprint.operators.registry import validate
from speakerprint.operators.style import signature_phrases
from speakerprint.sources.archives import ingest_archives


def test_json_with_white_space_around(spark):
    texts = ['{"a": 1}\n', '\t{"a": 1}\r\n', '﻿{"a": 1}', '\xa0{"a": 1}', '{"a": 1}x']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(strict_object(script_strip("t")).isNotNull()).collect()]
    assert got == [True, True, True, True, False]


def test_ragged_vectors_are_refused():
    with pytest.raises(ValueError):
        list_matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]), np.float64)
    assert list_matrix(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1), np.float64).tolist() == [[3.0, 4.0]]


def test_speaker_stats_of_large_values(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(10_000, 5, 4_000)
    df = spark.createDataFrame([("a", [float(v)]) for v in x], "who string, embedding array<double>")
    big = df.unionAll(df).unionAll(df)
    r = speaker_stats(big, "who").first()
    assert r["n"] == 12_000 and r["mean"] == pytest.approx(x.mean(), rel=1e-9) and r["var"] == pytest.approx(x.var(), rel=1e-6)


def test_equal_query_ids_and_candidates_without_bits(spark):
    queries = spark.createDataFrame([(1, [5]), (1, [5]), (1, [-1]), (2, None)], "query_id bigint, bits array<bigint>")
    cands = spark.createDataFrame([("a", 0, [5]), ("b", 1, [-1]), ("c", 2, None)], "candidate string, ord bigint, bits array<bigint>")
    found = [sorted(map(tuple, match.top_candidates(queries, cands, 1, None, 64, broadcast_limit=n).collect())) for n in (10, 1)]
    assert found[0] == found[1] == [(1, "a", 0, 1.0, 1), (1, "a", 0, 1.0, 1), (1, "b", 1, 1.0, 1)]


def test_archive_above_64_mib_breaks_the_size_rule_only(spark, tmp_path):
    manifest = {"csp_version": "1.0", "fp_type": "identity"}
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("manifest.json", json.dumps(manifest) + "\n")
        z.writestr("summary.txt", "word " * 80)
        z.writestr("metadata.json", json.dumps({"success_score": 0.5}))
        z.writestr("vector.bin", bytes(65 << 20))
    (tmp_path / "a.fp").write_bytes(whole.getvalue())
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w") as z, zipfile.ZipFile(whole) as old:
        for name in old.namelist()[:3]:
            z.writestr(name, old.read(name))
        z.writestr("vector.bin", bytes(8))
    (tmp_path / "b.fp").write_bytes(small.getvalue())
    rows = {r["path"][-4:]: r for r in ingest_archives(spark, str(tmp_path)).collect()}
    big = rows["a.fp"]
    assert big["is_zip"] and big["error"] is None and big["summary"] == rows["b.fp"]["summary"] and len(big["vector"]) == 65 << 20
    broken = {r["path"][-4:]: set(r["violations"]) for r in validate(ingest_archives(spark, str(tmp_path))).select("path", "violations").collect()}
    assert broken["a.fp"] - broken["b.fp"] == {"size"}


def test_signature_phrases_keep_phrases_of_every_speaker(spark):
    df = spark.createDataFrame([(i, f"all alike own{i} word{i}") for i in range(6)], "who bigint, text string")
    rows = signature_phrases(df, "who", k=9).collect()
    assert {(r["phrase"], r["df"], round(r["score"], 9)) for r in rows if r["df"] == 6} == {("all alike", 6, 0.0)}
    assert len(rows) == 18


def test_signature_phrases_rank_what_can_be_among_the_best(spark, monkeypatch):
    """Phrases that no count of speakers could lift into the best are not joined, and the best stay what all phrases give."""
    import random

    from speakerprint.operators import style

    rng = random.Random(2)
    rows = []
    for who in [*range(8), None]:
        often = [f"a{who} b{rng.randrange(9)}" for _ in range(12)]
        for _ in range(60):
            rows.append((who, " ".join(rng.choice([*often, "all alike", *(f"x{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(30))))
    rows += [(100, "few words"), (101, None), (102, "one one one")]
    df = spark.createDataFrame(rows, "who bigint, text string")
    monkeypatch.setattr(style, "FIRST_PHRASES", 1 << 40, raising=False)
    want = signature_phrases(df, "who").collect()
    monkeypatch.setattr(style, "FIRST_PHRASES", 2, raising=False)
    joined, join = [], style.spread_join
    monkeypatch.setattr(style, "spread_join", lambda big, *rest: joined.append(big.count()) or join(big, *rest))
    got = signature_phrases(df, "who").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r["who"] for r in got} == {*range(8), None, 100, 102}
    assert max(joined) < 2000 < signature_phrases(df, "who", k=10**6).count()


def test_signature_phrases_store_only_phrases_that_may_be_among_the_best(spark, monkeypatch):
    """All phrases are counted by buckets; only those of buckets that may hold one of the best are shuffled as text and stored."""
    import math
    from collections import Counter

    from speakerprint.operators import style

    rows = []
    for who in [*range(8), None]:
        rows += [(who, f"all{i} alike") for i in range(6) for _ in range(30)]
        rows += [(who, f"pair{(who or 0) // 2} word{j}") for j in range(8) for _ in range(20 + j)]
        rows += [(who, f"alone{who} word{j}") for j in range(2) for _ in range(19)]
        rows += [(who, f"once{who} word{j}") for j in range(300)]
    rows += [(100, "few words"), (101, None), (102, "one one one")]
    tf = Counter((who, " ".join(p)) for who, text in rows for w in [(text or "").lower().split()] for p in zip(w, w[1:], strict=False))
    df, n, k = Counter(p for _, p in tf), len({who for who, _ in rows} - {None}), 4
    want = set()
    for who in {w for w, _ in tf}:
        found = sorted((-c * math.log(n / df[p]), p, c) for (w, p), c in tf.items() if w == who)[:k]
        want |= {(who, rank, p, c, df[p], round(-s, 6)) for rank, (s, p, c) in enumerate(found, 1)}
    table = spark.createDataFrame(rows, "who bigint, text string").repartition(5)
    stored, keep = [], style.materialised

    def seen(rows, name):
        out = keep(rows, name)
        stored.extend([out.count()] if name == "phrases" else [])
        return out

    monkeypatch.setattr(style, "materialised", seen)
    monkeypatch.setattr(style, "FIRST_PHRASES", 3)
    # Buckets enough at first; too few at first, so that others are looked into; phrases that share a bucket.
    for first, buckets, tables in ((8, 1 << 20, 1), (1, 1 << 20, 2), (1, 1 << 10, 2)):
        monkeypatch.setattr(style, "FIRST_BUCKETS", first, raising=False)
        monkeypatch.setattr(style, "LEAST_BUCKETS", buckets, raising=False)
        monkeypatch.setattr(style, "PHRASE_BITS", buckets)
        stored.clear()
        got = signature_phrases(table, "who", k=k).collect()
        assert {(*r[:5], round(r["score"], 6)) for r in got} == want and len(got) == len(want)
        assert len(stored) == tables and sum(stored) < len(tf) / 2
