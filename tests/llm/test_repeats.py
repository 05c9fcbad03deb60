import hashlib
import random

import pytest
from brute import repeats as brute

from speakerprint.llm import queries, repeats
from speakerprint.plans.catalog import table


def digest(rows):
    return sorted(tuple(r) for r in rows)


def removed(df):
    return digest(
        (r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["without_shared"]), len(r["shared"]), hashlib.sha256(r["without_shared"]).hexdigest())
        for r in repeats.remove_repeats(df).collect()
    )


def test_given_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = queries.op9_repeats(spark, sf_dir).collect()
    assert digest(got) == digest(brute(rows))


def fixture():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, other = text(400), text(230)
    rows = [(i, text(150) + shared + text(rng.randint(0, 300))) for i in range(30)]
    rows += [(50 + i, text(40) + other[i : 205 + i] + text(60)) for i in range(12)]
    rows += [(70, "a" * 900), (71, "xy" * 300), (72, text(99)), (73, shared), (74, shared[:199]), (75, None), (76, ""), (77, shared)]
    rows += [(80, text(700)), (81, rows[0][1]), (82, text(300) + shared[100:320] + shared[100:320])]
    return rows


def test_passages(docs_of):
    rows = fixture()
    assert removed(docs_of(rows)) == digest(brute(rows))


def test_many_runs_and_chunks(docs_of, monkeypatch):
    """The forms for anchors with many runs and for texts in several chunks give the same."""
    monkeypatch.setattr(repeats, "MANY", 2)
    monkeypatch.setattr(repeats, "CHUNK", 256)
    rows = fixture()
    assert removed(docs_of(rows)) == digest(brute(rows))


def keeping_first(rows, n=200):
    """doc_id -> bytes without those in strings that start earlier; texts in the order of their keys."""
    seen, out = set(), {}
    for _, i, b in sorted((hashlib.md5((t or "").encode()).digest(), i, (t or "").encode()) for i, t in rows):
        copy = any(b == other for other, _ in out.values()) and len(b) >= n
        gone = bytearray(b"\1" * len(b) if copy else len(b))
        for j in range(len(b) - n + 1):
            if b[j : j + n] in seen:
                gone[j : j + n] = b"\1" * n
            seen.add(b[j : j + n])
        out[i] = (b, bytes(x for x, g in zip(b, gone) if not g))
    return {i: kept for i, (_, kept) in out.items()}


@pytest.mark.parametrize("many", [2, 1024])
def test_first_copy_stays(docs_of, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rows = fixture()
    out = repeats.remove_repeats(docs_of(rows)).collect()
    assert {r["doc_id"]: r["without_earlier"] for r in out} == keeping_first(rows)


def test_edges(docs_of):
    assert removed(docs_of([])) == []
    rows = [(None, "q" * 10 + "r" * 250), (3, "q" * 10 + "r" * 250), (4, "s" * 30)]
    got = repeats.remove_repeats(docs_of(rows).selectExpr("*", "1 AS key", "2 AS packed")).collect()
    assert sorted((r["doc_id"] or 0, len(r["without_shared"])) for r in got) == [(0, 0), (3, 0), (4, 30)]
