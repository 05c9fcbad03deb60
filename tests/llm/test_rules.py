import re

import pytest
from compare import connect, difference

from speakerprint.llm import queries, rules


def measure(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), len(re.findall("[A-Z]", text)))


TEXTS = [
    None, "", " \n\t", "a b c d", "one two three four five one two three four five", "x " * 30, "same line\n" * 7 + "other", "A! B! C# |||| D\x1cE",
    "é漢字 \x0b🎉 tail\x0c", "a b c d e f g h i j k", "\n\n", "w" * 5000, "p q r s t u p q r s t v w p q r s t", " ".join(str(i % 700) for i in range(9000)),
]


def test_measures(docs_of):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "a b")]
    got = rules.ledger(docs_of(rows)).collect()
    want = [(i, *measure(t)) for i, t in rows if t is None or len(t) < 9000] + [(i, *measure(t)) for i, t in rows if t is not None and len(t) >= 9000]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted((tuple(r)[:8] for r in got), key=order) == sorted(want, key=order)


def test_table_against_sql(spark, sf_dir):
    assert difference(queries.op7_quality_rules(spark, sf_dir), connect(sf_dir), queries.OP7_SQL) is None


def test_policies_and_ablations(docs_of):
    led = rules.ledger(docs_of(list(enumerate(TEXTS))))
    rows = rules.apply_policies(led).collect()
    for r in rows:
        assert r["kept_base"] == (r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"])
        assert r["kept_v2"] == (r["bits"] == 0)
    got = {r["rule"]: (r["failed"], r["only"]) for r in rules.ablations(led).collect()}
    for i, rule in enumerate(rules.RULES):
        assert got[rule] == (sum(r["bits"] >> i & 1 for r in rows), sum(r["bits"] == 1 << i for r in rows))


def test_passing_keeps_columns(docs_of):
    docs = docs_of([(1, "ten plain words stand here so that nothing fails at all"), (2, "short"), (3, None)]).selectExpr("*", "7 AS bits", "8 AS n_words")
    out = rules.passing(docs)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1]
    assert rules.passing(docs_of([])).count() == 0


def test_native(docs_of):
    plan = rules.ledger(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(docs_of, rows):
    assert rules.ledger(docs_of(rows)).count() == len(rows)
