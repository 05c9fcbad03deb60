"""Extraction, licenses, encoding and decontamination against plain versions."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import edit_distance

from speakerprint.llm import bpe, leaks, licenses, queries, site_tree
from speakerprint.plans.catalog import table


@pytest.fixture(scope="module")
def reference():
    enc = bpe.encoder(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def strings(n, seed=1):
    rng = random.Random(seed)
    alphabet = "ab c'sdé\n\t  12.,!漢字🎉\xa0 \x1cllremTv\x85"
    for _ in range(n):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        yield s * 3 + "aaaaa" * rng.randint(0, 20) if rng.random() < 0.3 else s


def test_bpe_tree_of_texts(reference, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 5)
    enc = bpe.Encoder(public_tokenizers.path(bpe.RANKS))
    for s in strings(3000):
        assert np.frombuffer(enc.encode(s), dtype="<u4").tolist() == reference.encode_ordinary(s), repr(s)


def test_bpe_long_matches(reference):
    enc = bpe.Encoder(public_tokenizers.path(bpe.RANKS))
    rng = random.Random(2)
    texts = ["thtionhan" * 3000 + "é漢" * 500 + "x" * 5000, *("".join(rng.choice("thetionéingsaß") for _ in range(rng.randint(20, 300))) for _ in range(300))]
    for s in texts:
        assert enc.encode_match(s.encode()) == reference.encode_ordinary(s)


def test_bpe_query(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op8_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_edges(docs_of):
    rows = [(1, None), (2, ""), (None, "a b"), (2, ""), (3, "word " * 60_000)]
    out = bpe.decode(bpe.encode(docs_of(rows).selectExpr("*", "1 AS tokens", "2 AS n_tokens"))).collect()
    assert sorted(bytes(r["bytes"]).decode() for r in out) == sorted(t or "" for _, t in rows)
    assert bpe.encode(docs_of([])).count() == 0


def test_bpe_workers_forget(docs_of):
    """Spark keeps workers: what is remembered of texts must not stay in them."""
    path = public_tokenizers.path(bpe.RANKS)
    rows = docs_of([(1, "some words, unforgettable ones"), (2, None), (None, "\u00e9\U0001f600 \u4e2d\u6587")])
    batch = rows.coalesce(1).toArrow().select(["doc_id", "text"]).slice(0, 1).to_batches()[0]
    held = []
    for _ in bpe._task(path, bpe._encoded)(iter([batch])):
        held.append(len(bpe.encoder(path).known))
    enc = bpe.encoder(path)
    assert held[0] > 0 and not (enc.known or enc.pairs or enc.leaves)


def test_bpe_round_trip(spark, sf_dir, docs_of):
    """One Python node gives what two gave, and the query takes it."""
    rows = docs_of([(1, "some words"), (1, "some words"), (2, None), (3, ""), (None, "\u00e9\U0001f600 \u4e2d\u6587")])
    two = bpe.decode(bpe.encode(rows))
    one = bpe.round_trip(rows)
    assert one.schema == two.schema and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    for frame in (queries.op8_bpe(spark, sf_dir), corpus_pipeline.tokens(spark, rows, sf_dir)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


PAGES = "page_id bigint, url string, html string"


def test_main_text_query(spark, sf_dir):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    for r in queries.op3_main_text(spark, sf_dir).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_main_text_of_a_site(spark):
    """Without article elements: the notice that every page repeats goes, what differs stays."""
    page = "<body><div class=x><p>Welcome to our site, members save more.</div><div class=y><p>Story {0} tells &amp;   of<br>{0}<p>{0} ends</div><ul><li><a href=/>one<li><a href=/>two</ul>"
    rows = [(i, f"http://Host.example/{i}", page.format(i)) for i in range(12)]
    rows += [(20, None, None), (21, "http://host.example/q", ""), (22, "other", page.format("x")), (3, "http://Host.example/3", page.format(3))]
    got = site_tree.extract(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS text")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[3] == "Story 3 tells & of 3\n\n3 ends" and by[20] == by[21] == ""
    assert by[22].startswith("Welcome") and "Story x" in by[22]
    assert site_tree.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<b>x<p>c &amp; d&nbsp;e<ul><li>one<li>two</ul><script>if(a<b){'</p>'}</script>tail<br>t2", "ax\n\nc & d e\n\none\n\ntwo\n\ntail t2"),
        ("<table><tr><td>q<td>r</table> 3 < 4 <form>no</form><div class='user comments'>no</div>", "q\n\nr\n\n3 < 4"),
        ("<header>no</header><article><header><h1>T</h1></header>x<aside>no</aside><footer>no</footer></article><p>no", "T\n\nx"),
        ("<nav><p>no</nav><main><p>yes<section id=sidebar>no</section></main><!-- no", "yes"),
        ("<p title='a>b'>in</p", "in"),
        ("plain text", "plain text"),
        ("<style>p{}", ""),
    ],
)
def test_markup(page, text):
    assert site_tree.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><div class='content has-sidebar'><article>a<p>b</article></div>", "a\n\nb"),
        ("<body><form action=x><div id=wrap><article>a</article></div><input><button>no</button></form>", "a"),
        ("<body><form><h1>t</h1><p>" + "long text " * 9 + "<nav><a>no</a></nav></form><p>short", "t\n\n" + ("long text " * 9).strip() + "\n\nshort"),
        ("<article class='post no-comments format-aside'>a</article>", "a"),
        ("<article>" + "long text " * 20 + "</article><article>teaser</article><article>" + "second " * 20 + "</article>", ("long text " * 20).strip() + "\n\n" + ("second " * 20).strip()),
        ("<section class=comments><article>me too, and at much greater length than the post</article></section><article>post</article>", "post"),
        ("<div class=post-comments><article class=comment>no</article></div><div class=sidebar-left><p>no</div><p>yes", "yes"),
        ("<main><p>intro of some length<article>teaser</article><p>more of the text</main>", "intro of some length\n\nteaser\n\nmore of the text"),
        ("<article><div class=entry-header><h1>T</h1></div>let <math><mi>x</mi></math> be <object data=y>shown</object><noscript>too</noscript></article>", "T\n\nlet x be showntoo"),
        ("<div class=site-header>no</div><div class=MainMenu>no</div><p>yes", "yes"),
        ("<div role=main>yes</div><p>no", "yes"),
    ],
)
def test_wrappers_and_articles(page, text):
    assert site_tree.main_text(page) == text


@pytest.mark.parametrize("body", ["<article>The same story on every page.</article>", "<div><h1>Same</h1><p>The same story.</div>"])
def test_mirrored_and_link_heavy_hosts(spark, body):
    """Equal pages count once, and long menus above short articles weigh nothing."""
    menu = "<nav>" + "".join(f"<li><a href=/{i}>a long entry of the menu {i}</a>" for i in range(40)) + "</nav>"
    rows = [(i, "http://m.example/", f"<body>{menu}{body}</body>") for i in range(20)] + [(20 + i, "http://l.example/", f"<body>{menu}<div class=z><p>Story {i}.</div>") for i in range(12)]
    by = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {by[i] for i in range(20)} == {site_tree.main_text(body)} and "" not in by.values()
    assert [by[20 + i] for i in range(12)] == [f"Story {i}." for i in range(12)]


def test_deep_pages_take_linear_time():
    import time

    start = time.perf_counter()
    assert site_tree.main_text("<span>x" * 20_000) == "x" * 20_000
    assert len(list(site_tree.node_rows("<span>x" * 20_000))) == 20_000
    assert site_tree.main_text("<span><p>x" * 5_000).count("x") == 5_000 and site_tree.main_text("</b>" * 50_000 + "x") == "x"
    assert time.perf_counter() - start < 4


def plain_site(rows, low=site_tree.LOW):
    """Extraction with a style tree in plain dictionaries, for pages without articles; page_id -> text."""
    import math
    from collections import Counter, defaultdict

    hosts = defaultdict(set)
    for _, url, page in rows:
        hosts[url].add(page)
    out = {}
    for url, pages in hosts.items():
        content, style, size = defaultdict(Counter), defaultdict(Counter), defaultdict(lambda: [0, 0])
        for page in pages:
            for node, _, c, s, chars, links in site_tree.node_rows(page):
                content[node][c] += 1
                style[node][s] += 1
                size[node][0] += chars
                size[node][1] += links
        def entropy(counts):
            n = sum(counts.values())
            return 1 - sum(c * math.log(c) for c in counts.values()) / n / math.log(n) if n > 1 else 1.0
        weak = {
            node for node in content
            if sum(content[node].values()) >= site_tree.MIN_PAGES
            and max(entropy(content[node]), entropy(style[node])) * (1 - size[node][1] / max(size[node][0], 1)) < low
        }
        for i, u, page in rows:
            if u == url:
                out[i] = site_tree.main_text(page, weak)
    return out


def test_style_tree_equals_plain_counts(spark):
    page = "<body><div class=x><p>Welcome.</div><div class=y><p>Story {0}<p>{1}</div><ul class=z><li><a href=/>one</a><li>{2}</ul><p>Imprint {3}"
    rows = [(i, f"h{i % 3}", page.format(i, i % 4, i % 2, "same")) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == plain_site(rows) and any("Welcome" not in t for t in got.values())


def test_licenses(docs_of):
    rows = [
        (1, "Released under the MIT License."), (2, "All rights reserved. ALL RIGHTS   reserved"), (3, "Licensed under CC BY-NC 4.0."), (4, None), (5, ""),
        (6, "licensed under the terms of the Apache License, Version 2.0"), (7, "licensed under the big Apache License, Version 2.0"),
        (8, "GNU General Public License"), (9, "mit license"), (10, "Copyright 2020 Some One. All rights reserved."), (None, "cc by"), (1, "x"),
        (12, "licensed under the gnu general public license version 3"), (13, "rights all reserved"),
    ]
    got = licenses.scan_licenses(docs_of(rows).selectExpr("*", "1 AS labels", "2 AS base")).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    labels = {k: r["labels"] for k, r in by.items()}
    assert labels[1, 5] == "mit" and labels[6, 11] == "apache-2.0" and labels[7, 9] == "" and labels[9, 2] == ""
    assert labels[3, 7] == "cc-by,cc-by-nc" and labels[10, 7] == "reserved" and labels[12, 9] == "gpl" and labels[None, 2] == "cc-by"
    r = by[2, 6]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (2, 0, 3, "reserved", 1.0)
    assert by[4, 0]["first_word"] is None and by[5, 0]["score"] == 0.0 and by[8, 4]["base_labels"] == "gpl"
    assert licenses.scan_licenses(docs_of([])).count() == 0


def test_license_base_against_plain(spark, sf_dir):
    for r, d in zip(
        queries.op5_licenses(spark, sf_dir).orderBy("doc_id").collect(), table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    ):
        w = licenses.words_of(d["text"].encode())
        places = [i for i in range(len(w)) for p in licenses.PHRASES if w[i : i + len(p.split())] == p.encode().split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))


def test_automaton_regions():
    a = licenses.Automaton("{who:0-2} may [[freely]] copy {what:1-3} here")
    yes = ["may copy it here", "all users may freely copy all of it here"]
    no = ["may copy here", "may not copy it here", "may copy all of it and more here", "you may copy it"]
    assert all(a.longest(licenses.words_of(s.encode()), 0) == len(s.split()) for s in yes)
    assert all(a.longest(licenses.words_of(s.encode()), 0) == -1 for s in no)


def test_myers():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 70))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert leaks.myers(a, b)[0] == edit_distance(a, b)


ITEMS = "item_id bigint, text string"


def damaged(words, k, rng):
    out = list(words)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else ["zz" + str(rng.randrange(99))]
    return out


def test_leaks(spark, docs_of):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((1, 3, 5, 12, 30, 64, 65, 90))]
    docs = []
    for n in range(150):
        body = [rng.choice(vocabulary) for _ in range(80)]
        words = items[rng.randrange(3, len(items))][1].split()
        at = rng.randrange(80)
        docs.append((n, " ".join(body[:at] + damaged(words, rng.randint(0, len(words) // 4), rng) + body[at:])))
    items += [(50, items[4][1].upper()), (51, None), (52, "")]
    docs += [(900, None), (901, ""), (None, items[5][1])]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in leaks.find_leaks(docs_of(docs), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = leaks.WORD.findall((item or "").lower().encode()), leaks.WORD.findall((text or "").lower().encode())
            if a and (n := edit_distance(a, b)) <= leaks.budget(len(a)):
                want[d, i] = n
    assert got == want and len(got) > 100


def test_leaks_in_blocks_and_kept_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 64)
    items = spark.createDataFrame([(i, f"item {i} has some words of its own to be found {i} times") for i in range(5)], ITEMS)
    docs = docs_of([(i, f"before item {i} has some words of its own to be found {i} times after") for i in range(3)] + [(7, "clean text"), (8, None), (None, "x")])
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect() if r["distance"] == 0} == {(0, 0), (1, 1), (2, 2)}
    kept = leaks.without_leaks(docs.selectExpr("*", "1 AS item_id"), items)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "8", "None"] and kept.columns[-1] == "item_id"
    none = spark.createDataFrame([], ITEMS)
    assert leaks.find_leaks(docs, none).count() == 0 and leaks.without_leaks(docs, none).count() == 6


def test_leaks_query(spark, sf_dir):
    items = {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").collect()}
    verbatim = {(d["doc_id"], i) for d in table(spark, sf_dir, "documents").collect() for i, t in items.items() if t in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_leaks(spark, sf_dir).collect()}
    assert verbatim <= got and len(got) <= 2 * len(verbatim) + 2
