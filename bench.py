"""Time the headline queries on one local Spark session and print one JSON line.

Every query is executed in full to the ``noop`` sink, once, after a warm-up that starts the
Python workers and runs one small query. ``BENCH_QUERIES`` picks queries by name (comma separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from speakerprint.plans.catalog import all_queries, table  # noqa: E402
from speakerprint.session import get_session, ship  # noqa: E402

HEADLINE = (
    "message_positions",
    "prompt_identity",
    "prompt_train_lines",
    "holdout_split",
    "conversation_fingerprints",
    "speaker_fingerprints",
    "speaker_seed_positional",
    "speaker_centroids",
    "speaker_bases",
    "identify_top1",
    "retrieve_topk",
    "id_accuracy",
    "pair_similarity",
    "similarity_stats",
    "consensus_seed",
    "ab_comparison",
    "ab_combined",
    "score_json",
    "task_stats",
    "summary_validation",
    "registry_latest",
    "injected_prompts",
    "leak_audit",
    "secret_audit",
    "redacted",
    "digest_duplicates",
    "sentence_profile",
    "vocabulary_profile",
    "signature_phrases",
    "stream_seeds",
)
#: Table whose rows a query works through, for rows per second.
INPUT = {
    "message_positions": "conversations", "prompt_identity": "conversations", "prompt_train_lines": "conversations",
    "conversation_fingerprints": "conversations", "ab_comparison": "events", "ab_combined": "events", "score_json": "events", "task_stats": "labels",
    "sentence_profile": "conversations", "injected_prompts": "conversations",
    **{q: "documents" for q in ("summary_validation", "registry_latest", "leak_audit", "secret_audit", "redacted",
                                "digest_duplicates", "vocabulary_profile", "signature_phrases")},
}


def warm_up(spark, workers: int) -> None:
    """Start one Python worker per core and let it import the package."""

    def touch(batches):
        import time

        import speakerprint.operators.hypervectors  # noqa: F401

        for batch in batches:
            time.sleep(0.5)
            yield batch

    ship(spark)
    spark.range(0, workers, 1, workers).mapInArrow(touch, "id bigint").write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_session("speakerprint-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    warm_up(spark, int(cpus) if cpus.isdigit() else 8)
    queries["message_hypervectors"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    counts = {t: table(spark, sf_dir, t).count() for t in {"embeddings", *INPUT.values()}}
    times, rates = {}, {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(counts[INPUT.get(name, "embeddings")] / times[name])
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                "rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
