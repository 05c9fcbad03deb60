import random

import pytest
from brute import near_classes

from speakerprint.llm import near_dups
from speakerprint.plans.catalog import table


def classes(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(df).collect()}


def test_given_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert classes(docs) == near_classes([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.fixture(scope="module")
def copies():
    """A large group of near copies around one text, chains at the threshold, and unrelated texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for _ in range(160):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append(" ".join(t))
    chain = [rng.choice(words) for _ in range(120)]
    for step in range(12):
        chain = chain[8:] + [rng.choice(words) for _ in range(8)]
        rows.append(" ".join(chain))
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_large_group_and_chain(docs_of, copies):
    assert classes(docs_of(copies)) == near_classes(copies)


def test_large_nodes_branch(docs_of, copies, monkeypatch):
    """With tiny nodes every group goes through pivots, branching and cells of several blocks."""
    monkeypatch.setattr(near_dups, "SMALL", 4)
    monkeypatch.setattr(near_dups, "WHOLE", 8)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 1_000)
    assert classes(docs_of(copies)) == near_classes(copies)


@pytest.fixture(scope="module")
def versions():
    """Two versions of a text, similar at 0.765, each with copies that are nearer to it than to the other version."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(6000)]
    rows = []
    for _ in range(6):
        text = [rng.choice(words) for _ in range(1500)]
        other = list(text)
        for at in range(20, 1480, 36):
            other[at] = rng.choice(words)
        for version in (text, other):
            for _ in range(6):
                copy = list(version)
                copy[rng.randrange(1500)] = rng.choice(words)
                rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_versions_with_copies(docs_of, versions):
    """Links between the versions are found, although each copy has nearer partners of its own version."""
    want = near_classes(versions)
    assert len({c for _, c in want.values()}) == 6
    assert classes(docs_of(versions)) == want


def test_pivot_links_are_confirmed(docs_of):
    """A set whose tokens agree with the pivot beyond its true similarity keeps its link to another set."""
    roots = [(i * 11 + 3) % near_dups.MINHASHES for i in range(near_dups.TREES * near_dups.BRANCHES)]
    for seed in range(20_000):
        rng = random.Random(seed)
        text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        part = text[:300]  # 296 of 396 shingles: 0.747
        whole, few = (near_dups.minwise(near_dups.shingles(" ".join(t).encode(), {})) for t in (text, part))
        if (whole == few).sum() >= 106 and (whole == few)[roots].all():
            break
    rows = [" ".join(part), " ".join(text[:350]), " ".join(text)]
    for i in range(75):
        rows.append(" ".join([*text[:360], *(f"c{i}" if at == 365 + i % 30 else w for at, w in enumerate(text[360:], 360))]))
    rows = list(enumerate(rows))
    want = near_classes(rows)
    assert {c for _, c in want.values()} == {0}
    assert classes(docs_of(rows)) == want


def test_bitmaps_rule_out_no_link():
    """Whatever two sets share, a pair that is similar enough passes the bitmaps, and the exact count agrees with plain sets."""
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 700):
        pool = rng.integers(0, 2**63, 3 * size, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 2 * size + 1))) for _ in range(20)]
        for _ in range(20):
            kept = sets[rng.integers(len(sets))]
            sets.append(np.unique(np.concatenate([kept[rng.random(len(kept)) < 0.9], pool[:1]])))
        sizes, bits = np.array([len(s) for s in sets]), near_dups._bitmaps(sets)
        for x in range(len(sets)):
            may = near_dups._may_link(sizes, bits, x, np.arange(len(sets)))
            for y in range(len(sets)):
                a, b = set(sets[x].tolist()), set(sets[y].tolist())
                linked = 100 * len(a & b) >= 75 * len(a | b)
                assert near_dups.similar(sets[x], sets[y]) == linked and (may[y] or not linked)


def test_common_passage(docs_of, monkeypatch):
    """Pairs of copies among texts that mostly are one passage: large nodes that tokens don't separate."""
    monkeypatch.setattr(near_dups, "SMALL", 4)
    monkeypatch.setattr(near_dups, "LEVELS", 1)
    monkeypatch.setattr(near_dups, "BLOCK", 16, raising=False)
    monkeypatch.setattr(near_dups, "TREES", 1)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(240)]
    rows = []
    for n in range(40):
        own = [f"o{n}-{i}" for i in range(100)]
        rows += [" ".join(passage + own), " ".join([*passage, *own[:-2], f"e{n}", "e"])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = near_classes(rows)
    assert len({c for _, c in want.values()}) == 40
    assert classes(docs_of(rows)) == want


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A  b\tc"), (6, "a b c d"), (7, "a b c d e"), (9, "a b c d e"), (8, "x" * 200_000)]
    got = classes(docs_of(rows))
    assert got == near_classes(rows)
    assert got[5] == (1, 4) and got[9] == (1, 7) and got[1] == (0, 1)
    assert classes(docs_of([])) == {}
    none = near_dups.near_duplicates(docs_of([(None, "a b c"), (4, "a b c")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in none} == {(None, 4), (4, 4)}
    twice = near_dups.near_duplicates(docs_of([(1, "a b"), (1, "a b"), (2, "c d")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in twice) == [(1, 1), (1, 1), (2, 2)]
    extra = docs_of([(1, "a b"), (2, "a b")]).selectExpr("*", "1 AS name", "2 AS tokens", "3 AS component_id")
    assert classes(extra) == {1: (1, 1), 2: (1, 1)}


def _shuffled(df):
    """Records that the exchanges of a collected frame wrote."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_only_needed_texts_are_shuffled(spark, monkeypatch):
    """Full sets are made from the texts of the names that need them; other texts stay where they are read."""
    texts = spark.createDataFrame([(i, f"own words of text {i}".encode()) for i in range(3000)], "key bigint, text binary")
    texts = near_dups.materialised(texts, "texts")
    signed = near_dups.signatures(texts.selectExpr("key AS doc_id", "CAST(text AS string) AS text"))
    sets = near_dups.materialised(signed.selectExpr("name", "doc_id AS key", "tokens"), "sets")
    names = near_dups.materialised(sets.where("key IN (5, 2000)").select("name"), "names")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        full = near_dups._full_sets(names, sets, texts.unionAll(texts))
        assert sorted(r["name"] for r in full.collect()) == sorted(r["name"] for r in names.collect())
        assert _shuffled(full) < 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cells_need_sets_of_partners_only(docs_of, monkeypatch):
    """Texts that share a passage meet in cells, but only those that agree enough have their full sets made."""
    monkeypatch.setattr(near_dups, "SMALL", 4)
    asked, full_sets = [], near_dups._full_sets
    monkeypatch.setattr(near_dups, "_full_sets", lambda names, *rest: asked.append(names.count()) or full_sets(names, *rest))
    rng = random.Random(4)
    rows = []
    for n in range(80):
        own = [f"o{n}-{i}" for i in range(190)]
        rows.append(" ".join([f"p{i}" for i in range(150)] + own))
        if n < 6:
            rows.append(rows[-1] + " end")
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = near_classes(rows)
    assert len({c for _, c in want.values()}) == 80
    assert classes(docs_of(rows)) == want
    assert max(asked) <= 20
