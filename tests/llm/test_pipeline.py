"""Every stage takes effect on what the one before it kept."""

import hashlib

import corpus_pipeline
from brute import near_classes

from speakerprint.llm import rules
from speakerprint.plans.catalog import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in rules.ledger(docs).where("bits = 0").collect()}
    one = stages["near_duplicates"](spark, good, sf_dir)
    classes = near_classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {c for _, c in classes.values()}
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    clean = stages["decontamination"](spark, one, sf_dir)
    left, before = clean.collect(), one.count()
    assert clean.columns == docs.columns and not any(i in r["text"] for r in left for i in items) and len(left) > 0.9 * before
    private = stages["private_data"](spark, clean, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    assert private.columns == docs.columns and len(texts) == len(left)
    coded = stages["tokens"](spark, private, sf_dir).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in coded} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
