"""Stupid-backoff scores from count tables of the whole corpus.

N-grams are runs of up to five characters, so that texts of any language have them; characters beyond
U+0FFF share 4,096 classes. Documents are dealt to blocks; the n-grams of each block are counted, summed
over the corpus in tables partitioned by the hash of the n-gram, scored there, and joined back to the
n-grams of the blocks; scores are summed per document.

An n-gram scores count / count of its context where it occurs ``MIN_COUNT`` times or more, else
``BACKOFF`` times the score of the n-gram without its first character, down to the relative frequency of
the last character. Scores are logarithms to base 10.

A null or empty text has no n-grams, the sum 0 and no mean. Repeated rows are scored, and counted, one by
one; other columns of the input do not reach the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speakerprint.llm.common import materialised, text_blocks
from speakerprint.llm.ngrams import BLOCK_BYTES, Grams, context, counted, low, scored

ORDER, BITS = 5, 12
GRAMS = Grams(ORDER, BITS)
BACKOFF = 0.4
MIN_COUNT = 5


def count_tables(grams: DataFrame) -> dict[int, DataFrame]:
    """(key, c) by order, from the n-grams of blocks (block, key, n)."""
    tables = {ORDER: materialised(grams.groupBy("key").agg(F.sum("n").alias("c")), "backoff-counts")}
    for n in range(ORDER - 1, 0, -1):
        shorter = tables[n + 1].groupBy(low("key", n, BITS).alias("key")).agg(F.sum("c").alias("c"))
        tables[n] = materialised(shorter, "backoff-counts")
    return tables


def score_table(tables: dict[int, DataFrame]) -> DataFrame:
    """(key, value): log10 score of every n-gram of the longest order."""
    total = tables[1].agg(F.sum("c").alias("total"))
    # One row.
    lower = tables[1].crossJoin(F.broadcast(total)).select("key", F.log10(F.col("c") / F.col("total")).alias("value"))
    for n in range(2, ORDER + 1):
        c = tables[n].withColumn("ctx", context("key", BITS)).withColumn("suffix", low("key", n - 1, BITS))
        contexts = c.groupBy("ctx").agg(F.sum("c").alias("of"))
        rest = lower.select(F.col("key").alias("suffix"), F.col("value").alias("shorter"))
        both = c.join(contexts, "ctx").join(rest, "suffix")
        value = F.when(F.col("c") >= MIN_COUNT, F.log10(F.col("c") / F.col("of"))).otherwise(F.lit(math.log10(BACKOFF)) + F.col("shorter"))
        lower = materialised(both.select("key", value.alias("value")), "backoff-scores")
    return lower


def backoff_scores(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_score, mean_score) of every document."""
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.col(text).alias("text"))
    blocks = text_blocks(rows, ["doc_id", "text"], BLOCK_BYTES)
    grams = materialised(counted(blocks, GRAMS, "block").groupBy("block", "key").agg(F.sum("n").alias("n")), "backoff-grams")
    table = score_table(count_tables(grams))
    values = grams.join(table, "key").select("block", "key", "value")
    sums = scored(blocks, values, GRAMS)
    mean = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams"))
    return sums.select("doc_id", "n_grams", F.col("total").alias("log_score"), mean.alias("mean_score"))
