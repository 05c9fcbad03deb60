"""Quality model, backoff scores and surrogates against plain versions."""

import math
import re
from collections import Counter, defaultdict

import pytest

from speakerprint.llm import backoff, quality_lm, queries, surrogates
from speakerprint.plans.catalog import table

TEXTS = ["abracadabra abra", "the cat sat on the mat, the cat", "zz", "a", "Ünïcödé 漢字 🎉 2024-01-02", "the the the the the the the"]


def plain_kneser_ney(texts):
    """log p(last char | context) of any 4-gram, by the textbook."""
    norm = [re.sub("[0-9]", "0", t) for t in texts]
    counts = {4: Counter()}
    for t in norm:
        s = "\2\2\2" + t
        counts[4].update(s[i : i + 4] for i in range(len(t)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, kinds = {}, {}, {}
    for n, c in counts.items():
        of = Counter(min(v, 5) for v in c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else None
        discount[n] = {i: max(0.01, i - (i + 1) * y * of[i + 1] / of[i]) if y is not None and of[i] else 0.5 * i for i in (1, 2, 3)}
        total[n], kinds[n] = Counter(), defaultdict(Counter)
        for g, v in c.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]][min(v, 3)] += 1

    def p(gram):
        n = len(gram)
        ctx = gram[:-1]
        if not total[n][ctx]:
            return p(gram[1:])
        w = sum(discount[n][i] * k for i, k in kinds[n][ctx].items()) / total[n][ctx]
        lower = p(gram[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        c = counts[n][gram]
        return (max(c - discount[n][min(c, 3)], 0) / total[n][ctx] if c else 0) + w * lower

    def perplexity(text):
        t = "\2\2\2" + re.sub("[0-9]", "0", text)
        return math.exp(-sum(math.log(p(t[i : i + 4])) for i in range(len(text))) / len(text))

    return perplexity


def test_perplexity(spark, docs_of):
    train = spark.createDataFrame([("en", t) for t in TEXTS[:3]], "lang string, text string")
    plain = plain_kneser_ney([t for t in TEXTS[:3]])
    rows = list(enumerate(TEXTS)) + [(50, None), (51, ""), (0, TEXTS[0]), (None, "q")]
    got = quality_lm.perplexities(docs_of(rows).selectExpr("*", "1 AS model", "2 AS block"), train).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["perplexity"] for r in got}
    assert by[50] is None and by[51] is None
    for i in (0, 1, 2, 3, 5):
        assert by[i] == pytest.approx(plain(TEXTS[i]), rel=1e-6), TEXTS[i]
    assert by[4] > by[1]


def test_probabilities_sum_to_one(spark):
    train = spark.createDataFrame([("en", t) for t in TEXTS[:3]], "lang string, text string")
    p, w = quality_lm.train(train)
    for n in range(2, 5):
        lower = {r["key"]: r["p"] for r in p.where(f"model = '*' AND n = {n - 1}").collect()}
        mass, seen_lower = defaultdict(float), defaultdict(float)
        for r in p.where(f"model = '*' AND n = {n}").collect():
            mass[r["key"] >> 16] += r["p"]
            seen_lower[r["key"] >> 16] += lower[r["key"] & (1 << 16 * (n - 1)) - 1]
        weights = {r["ctx"]: r["w"] for r in w.where(f"model = '*' AND n = {n}").collect()}
        for ctx, m in mass.items():
            above = sum(v for k, v in lower.items() if k >> 16 == ctx & (1 << 16 * (n - 2)) - 1)
            assert m + weights[ctx] * (above - seen_lower[ctx]) <= 1 + 1e-9


def test_classifier_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r for r in table(spark, sf_dir, "labels").collect()}
    assert len(rows) == table(spark, sf_dir, "documents").count()
    good = [rows[i]["kept"] for i, r in labels.items() if r["quality"] == 1]
    bad = [rows[i]["kept"] for i, r in labels.items() if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.6


def test_classifier_edges(spark, docs_of):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = quality_lm.classify(docs_of([(0, "some words"), (1, "more words"), (2, None), (None, "words")], lang=None), labels).collect()
    assert len(got) == 4 and {r["doc_id"]: r["kept"] for r in got}[2] is False
    assert quality_lm.classify(docs_of([]), labels).count() == 0
    assert len(quality_lm.classify(docs_of([(1, "a b")]), labels.where("false")).collect()) == 1


def plain_backoff(texts):
    fold = lambda c: ord("0") if c in "0123456789" else ord(c) if ord(c) < 4096 else (ord(c) * 0x9E3779B97F4A7C15 % 2**64) >> 52
    runs = [tuple([2] * 4 + [fold(c) for c in t or ""]) for t in texts]
    counts, ctx = defaultdict(Counter), defaultdict(Counter)
    for s in runs:
        for i in range(len(s) - 4):
            for n in range(1, 6):
                g = s[i + 5 - n : i + 5]
                counts[n][g] += 1
                ctx[n][g[:-1]] += 1

    def score(g):
        n = len(g)
        if n == 1:
            return math.log10(counts[1][g] / sum(counts[1].values()))
        if counts[n][g] >= backoff.MIN_COUNT:
            return math.log10(counts[n][g] / ctx[n][g[:-1]])
        return math.log10(backoff.BACKOFF) + score(g[1:])

    return [(len(s) - 4, sum(score(s[i : i + 5]) for i in range(len(s) - 4))) for s in runs]


def test_backoff(docs_of, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 40)
    rows = list(enumerate(TEXTS * 3)) + [(50, None), (51, ""), (51, "")]
    got = sorted(tuple(r) for r in backoff.backoff_scores(docs_of(rows).selectExpr("*", "1 AS block", "2 AS key")).collect())
    for (doc, n, total, mean), (i, (m, want)) in zip(got, zip([i for i, _ in rows], plain_backoff([t for _, t in rows]))):
        assert (doc, n) == (i, m) and total == pytest.approx(want, abs=1e-6)
        assert (mean is None) == (m == 0)
    assert backoff.backoff_scores(docs_of([])).count() == 0


PII = [
    (1, "write to anna.k@mail5.example.com or ANNA.K@MAIL5.EXAMPLE.COM, not bob@mail5.example.com."),
    (2, "call +1 (743) 555-3824 or +1-743-555-3824 from 10.24.3.200. Card 4111 1111 1111 1111, token = \"0be64439e3e49cf46b2d7c90f3602a3d0b907ff1\""),
    (3, "Mrs. Anna Smith met Mr Smith and Herr Otto MÜLLER; госпожа Анна Петрова; card 4111111111111111"),
    (4, "no data here 12 34 2020-01-02 v1.2.3"), (5, None), (6, ""), (7, "Mrs Anna Jones"), (8, "x anna.k@mail5.example.com"), (4, "again 192.168.0.1"), (None, "ssn 123-45-6789"),
]


def test_surrogates(docs_of):
    out = surrogates.with_surrogates(docs_of(PII).selectExpr("*", "1 AS surface", "2 AS n_entities2"), count="found")
    assert out.columns[-3:] == ["surface", "n_entities2", "found"]
    rows = out.collect()
    assert len(rows) == len(PII)
    new = {(r["doc_id"], r["found"]): r["text"] for r in rows}
    assert new[4, 0] == PII[3][1] and new[5, 0] is None and new[6, 0] == ""
    a, b, c = re.findall(r"[\w.]+@[\w.]*\w", new[1, 3])
    assert b == a.upper() and c.split("@")[1] == a.split("@")[1] and c != a and a.endswith(".com") and new[8, 1] == "x " + a
    phones = re.findall(r"\+1[^a-z]*\d", new[2, 5])
    digits = [re.sub(r"\D", "", p) for p in phones]
    assert digits[0] == digits[1] != "17435553824" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4})", new[2, 5])[1].replace(" ", "")
    luhn = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(card))
    assert luhn % 10 == 0 and card[0] == "4" and card in new[3, 5]
    name = next(t for (i, _), t in new.items() if i == 3)
    m = re.match(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Herr (\w+) (\w+); госпожа (\w+) (\w+); card (\d+)", name)
    assert m and m[2] == m[3] and m[5].isupper() and re.fullmatch("[А-Яа-я]+", m[6]) and m[8] == card
    assert new[7, 1].split()[1] == m[1] and m[1].endswith(surrogates.ENDINGS["latin", "female"])
    for _, t in PII:
        for found in re.findall(r"[\w.]+@[\w.]+\w|\d{3}-\d{2}-\d{4}|\b\d{16}\b|[0-9a-f]{40}|192\.168\.0\.1|Smith|Петрова", t or ""):
            assert not any(found in (x or "") for x in new.values()), found


def test_surrogates_are_distinct(spark):
    rows = [("email", f"a{i}@b.co") for i in range(300)] + [("ip", f"1.1.1.{i}") for i in range(1, 9)] + [("surname latin", f"name{i}") for i in range(900)]
    got = surrogates.surrogate_table(spark.createDataFrame(rows, "kind string, canon string")).collect()
    assert len(got) == len(rows) == len({(r["kind"], r["surrogate"]) for r in got})
    assert not {(r["kind"], r["surrogate"]) for r in got} & {tuple(r) for r in rows}


def test_surrogates_native(docs_of):
    plan = surrogates.with_surrogates(docs_of(PII))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert surrogates.with_surrogates(docs_of([])).count() == 0


def test_full_formats_widen(spark, docs_of):
    """Mailboxes of one host, short addresses, short phone numbers and very many surnames: more than their formats hold."""
    from speakerprint.llm import surrogates

    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"write to {c}@example.org") for i, c in enumerate(letters)]
    rows += [(100 + i, f"host {1 + i % 9}.{1 + i // 9 % 9}.{1 + i // 81 % 9}.{1 + i // 729}") for i in range(5_000)]
    rows += [(10_000 + i, f"call +7 {10 + i // 90} {10 + i % 90}") for i in range(6_000)]
    rows += [(20_000 + i, f"Herr {letters[i % 26].upper()}{letters[i // 26 % 26]}{letters[i // 676 % 26]}{letters[i // 17576]}q") for i in range(20_000)]
    out = {r["doc_id"]: r["text"] for r in surrogates.with_surrogates(docs_of(rows)).collect()}
    for low, high in ((0, 100), (100, 10_000), (10_000, 20_000), (20_000, 50_000)):
        before = {t for i, t in rows if low <= i < high}
        after = [t for i, t in out.items() if low <= i < high]
        assert len(set(after)) == len(after) == len(before) and not before & set(after)
