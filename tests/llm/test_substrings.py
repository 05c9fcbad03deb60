"""Repeated passages of words against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from speakerprint.llm import queries, substrings
from speakerprint.plans.catalog import table


def plain(rows, n=35):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[j : j + n]) for _, w in texts for j in range(len(w) - n + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if counts[tuple(w[j : j + n])] > 1:
                gone[j : j + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    out = substrings.remove_substrings(df).collect()
    rows = [(r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out]
    for r in out:
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(rows, key=str)


def test_given_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op13_substrings(spark, sf_dir).collect()), key=str) == plain(rows)


def fixture():
    rng = random.Random(11)
    text = lambda n, kinds=400: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    shared, other = text(90).split(), text(60).split()
    rows = [(i, f"{text(20)} {' '.join(shared)}  {text(rng.randint(0, 60))}") for i in range(25)]
    rows += [(30 + i, f"{text(9)}\n{' '.join(other[i : 36 + i])}\t{text(12)}") for i in range(12)]
    rows += [(50, "a " * 120), (51, "x y " * 70), (52, "z " * 35), (53, "z " * 34), (54, "Z " * 35), (55, None), (56, ""), (57, " \n "), (None, text(50))]
    rows += [(60, text(200)), (60, rows[-1][1]), (61, rows[0][1]), (62, rows[0][1]), (63, " ".join(shared[20:56]) + " é " + " ".join(shared[20:56])), (64, text(500, 2))]
    rows += [(70 + i, f"{' '.join(shared[:40])} {i} {' '.join(shared[41:])}") for i in range(8)]
    return rows


def test_passages(docs_of):
    rows = fixture()
    assert got(docs_of(rows).repartition(5)) == plain(rows)


def test_small_shards_hot_anchors_and_chunks(docs_of, monkeypatch):
    """Many shards, windows of anchors with many runs, and texts in several chunks give the same."""
    rows = fixture()
    for many, shard, chunk in ((2, 50, 64), (10**6, 1, 1 << 18)):
        monkeypatch.setattr(substrings, "MANY", many)
        monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        assert got(docs_of(rows)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b")]])
def test_edges(docs_of, rows):
    assert got(docs_of(rows)) == plain(rows)


def test_other_columns_do_not_matter(docs_of):
    rows = fixture()[:40]
    df = docs_of(rows).selectExpr("*", *[f"'x' AS {n}" for n in ("id", "key", "packed", "spans", "anchor")])
    assert got(df) == plain(rows)


def test_automaton_counts_places():
    rng = random.Random(3)
    texts = [([rng.randrange(3) for _ in range(rng.randint(1, 30))], rng.randint(1, 3)) for _ in range(20)]
    automaton = substrings.Automaton()
    for t, n in texts:
        automaton.add(t, n)
    automaton.close()

    def places(s):
        return sum(n for t, n in texts for j in range(len(t)) if t[j : j + len(s)] == s)

    for query in [t for t, _ in texts] + [[rng.randrange(4) for _ in range(40)] for _ in range(5)]:
        for end, (length, c) in enumerate(automaton.statistics(query, 5), 1):
            most = max(m for m in range(6) if m <= end and (not m or places(query[end - m : end])))
            assert length == most and (not length or c == places(query[end - length : end]))
