"""Conversation repair against a plain dynamic program over (cost, edits)."""

import hashlib
import random
import zlib

import pytest

from speakerprint.llm import queries, repair
from speakerprint.plans.catalog import table

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        text, role = " " if text is None else text, " " if role is None else role
        draw = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if draw == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of a conversation's rows after damage."""
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        ended = text.strip(WHITE)
        faults.append("blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def better(ways, state, way):
        if state is not None and (state not in ways or way[:2] < ways[state][:2]):
            ways[state] = way

    def inserts(ways):
        for _ in range(4):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    better(ways, NEXT.get((state, role[0])), (cost + 3, audit + "I", (*lines, f"{role}:")))
        return ways

    best = inserts(best)
    for (_, role, text), fault in zip(rows, faults):
        ways, more = {}, 3 if fault == "truncated" else 0
        for state, (cost, audit, lines) in best.items():
            better(ways, state, (cost + 4, audit + "D", lines))
            if fault in ("", "truncated"):
                better(ways, NEXT.get((state, role[:1])), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    better(ways, NEXT.get((state, new[0])), (cost + 3 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = inserts(ways)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha


def wanted(rows):
    return sorted(((c, *plain(r)) for c, r in damage(rows).items()), key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def got(spark, rows):
    out = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_repair(spark, sf_dir).collect()), key=str) == wanted(rows)


def conversations(seed=3, n=150, most=24):
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "well", "  ", "", None, "Why? ", "a\nb.\n", "naïve…", "x" * 3000, ".", " ", "fin。"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, most)):
            rows.append((c if c else None, None if rng.random() < 0.03 else t + rng.randint(0, 1), rng.choice(roles[: rng.choice([2, 4, 9])]), rng.choice(texts)))
    return rows


def test_odd_conversations(spark):
    rows = conversations()
    assert got(spark, rows) == wanted(rows)


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 8)
    rows = conversations(5, 40, 90)
    assert got(spark, rows) == wanted(rows)


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "dropped")] * 2, [(7, None, None, None)], [(None, None, "assistant", "Hi.")]])
def test_edges(spark, rows):
    rows = [(next(i for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0), *r[1:]) if r[3] == "dropped" else r for r in rows]
    assert got(spark, rows) == wanted(rows)


def test_other_columns_do_not_matter(spark):
    rows = conversations(8, 12, 9)
    names = ["conv", "draw", "copy", "pos", "block", "fault", "rows", "c0"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {n}" for n in names])
    assert sorted((tuple(r) for r in repair.repair(df).collect()), key=str) == wanted(rows)


def test_prices_are_dual_optimal():
    """No arc undercuts the fall of price, and the path found has tight arcs only."""
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 12)
        roles = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(n)]
        faults = [rng.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        arcs, prices = repair.arcs_of(roles, faults, repair.ENDS), repair.first_prices(faults, repair.ENDS)
        assert all(prices[i] <= c + prices[j] for i, out in enumerate(arcs) for c, j, _ in out)
        cost = repair.auction(arcs, prices, repair.START)
        assert all(prices[i] <= c + prices[j] for i, out in enumerate(arcs) for c, j, _ in out)
        assert cost == prices[0] - prices[-1]
