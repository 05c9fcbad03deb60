"""Fingerprints from a stream with event times: rows out of order, repeated rows and rows that come too late."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.functions.mixing import coin_sql
from speakerprint.plans.catalog import query, table
from speakerprint.session import shared_dir
from speakerprint.streaming.fingerprints import StreamCounts, read_stream_fingerprints, run_available, stream_fingerprints

DIM = 64
# Events arrive in five batches of six days. One in ten comes a batch later than its time, one in twenty comes twice, and of the first batch
# one in fifty comes four batches later, when the watermark of eight days has passed it.
DAYS, DELAY, BATCHES = 6, "8 days", 5
_BATCH = f"least(CAST(floor({{seconds}}) AS BIGINT) {{div}} {DAYS * 86_400}, {BATCHES - 1})"
_LATE = "event_id % 50 = 7 AND b = 0"


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, event_id, ts, embedding, batch): events with the batch that each arrives in."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.expr("CAST(get_json_object(props, '$.k') AS INT)").alias("k"))
    rows = rows.withColumn("b", F.expr(_BATCH.format(seconds="timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))", div="div")))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("embedding", F.array(F.col("value"), F.col("k").cast("double")))
    batch = F.when(F.expr(_LATE), F.col("b") + 4).when(F.expr("event_id % 10 = 3"), F.col("b") + 1).otherwise(F.col("b"))
    again = rows.where("event_id % 20 = 5").withColumn("batch", F.col("b") + 1)
    return rows.withColumn("batch", batch).unionByName(again).drop("b", "value", "k")


@query(
    "stream_event_time",
    f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, {_BATCH.format(seconds='epoch(ts) - 1704067200', div='//')} AS b FROM events),
    r AS (SELECT m, CASE WHEN {coin_sql('0', '(m + 42000000)', '//')} = 0 THEN 1 ELSE -1 END AS r0,
                 CASE WHEN {coin_sql('1', '(m + 42000000)', '//')} = 0 THEN 1 ELSE -1 END AS r1 FROM (SELECT range AS m FROM range({DIM}))),
    a AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE NOT ({_LATE})),
    h AS (SELECT user_id, n, (m + last - event_id) % {DIM} AS m,
                 CASE WHEN CAST(round(value * 1000000) AS BIGINT) * r0 + k * 1000000 * r1 >= 0 THEN 1 ELSE -1 END AS h FROM a, r)
    SELECT user_id, n, m, sum(h)::BIGINT AS acc, (SELECT count(*) FROM e WHERE {_LATE}) AS late, true AS state_bounded FROM h GROUP BY user_id, n, m""",
)
def stream_event_time(spark, sf):
    """Seeds per user of what came in time, each event once; how many rows came too late; and whether the state stayed below a watermark's span."""
    folder = shared_dir(spark, "stream-events")
    feed = arriving(spark, sf).select("user_id", "event_id", "ts", "embedding", "batch")
    schema = feed.drop("batch").schema
    runs = []
    for b in range(BATCHES + 1):
        feed.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/events")
        writer = stream_fingerprints(
            stream, f"{folder}/partials", f"{folder}/checkpoint", "user_id", "event_id", dim=DIM, event_time="ts", watermark=DELAY,
        )
        runs.append(run_available(writer))
    seen = reduce(StreamCounts.then, runs)
    total = table(spark, sf, "events").count()
    seeds = read_stream_fingerprints(spark, f"{folder}/partials", "user_id", DIM)
    rows = seeds.select("user_id", "n", F.posexplode("acc").alias("m", "acc"))
    return rows.select("user_id", "n", F.col("m").cast("bigint").alias("m"), "acc", F.lit(seen.late).cast("bigint").alias("late"), F.lit(seen.most_state < total).alias("state_bounded"))
