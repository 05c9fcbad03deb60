import pytest
from pyspark.sql import functions as F

from speakerprint.llm import quality_lm


@pytest.mark.parametrize("broadcast", [True, False])
def test_models_count_all_trusted_documents(spark, monkeypatch, broadcast):
    """The models were trained on the 20,000 labelled documents of least hash."""
    docs = spark.range(20_050).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 20_030, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    seen = []

    def counting(docs, trusted, *_):
        seen.append(trusted.count())
        return docs.selectExpr("doc_id", "lang", "1L AS n_chars", "1.0D AS perplexity")

    monkeypatch.setattr(quality_lm, "perplexities", counting)
    if not broadcast:
        monkeypatch.setattr(quality_lm, "SMALL_TABLE", 10)
    assert quality_lm.classify(docs, labels).where("kept").count() == 20_050
    assert seen == [20_030]
