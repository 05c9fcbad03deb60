"""Archives, contract checks, registry upkeep, audits, sources, sinks and the stream."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from speakerprint.functions import packed
from speakerprint.operators import hypervectors as H
from speakerprint.operators import messages as M
from speakerprint.operators import registry as G
from speakerprint.operators import style as S
from speakerprint.sources.archives import ingest_archives
from speakerprint.sources.conversations import read_messages
from speakerprint.sources.fingerprints import read_fingerprint_files, read_fingerprints, write_fingerprints, write_registry
from speakerprint.sources.results import read_results, write_results
from speakerprint.streaming.fingerprints import compact_partials, read_stream_fingerprints, stream_fingerprints

MANIFEST = {"csp_version": "2.0", "fp_type": "identity", "task_type": None, "success_score": 0.9, "created_at": "2026-03-01T00:00:00Z", "model_origin": "m"}
METADATA = {"generated_at": "2026-03-01T00:00:00Z", "model_origin": "m", "source_message_count": 9, "summary_token_count": 90, "vector_dimensions": 64}


def archive(manifest=MANIFEST, metadata=METADATA, words=80, extra=None, summary=None, skip=()):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        parts = {
            "manifest.json": manifest if isinstance(manifest, str) else json.dumps(manifest),
            "metadata.json": json.dumps(metadata),
            "summary.txt": summary if summary is not None else " ".join(["word"] * words),
            **(extra or {}),
        }
        for name, content in parts.items():
            if name not in skip:
                z.writestr(name, content)
    return buffer.getvalue()


OLD_MANIFEST = {"csp_version": "2.0", "fp_type": "skill", "task_type": "t", "success_score": 0.5, "created": "2026-02-01T00:00:00+00:00", "model": "m", "n_messages": 7}
OLD_METADATA = {"hdc_dim": 10000, "summary_words": 80, "created": "2026-02-01T00:00:00+00:00", "variance_k4": 0.3}


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    sized = archive()
    files = {
        "good": sized,
        "nosummary": archive(skip=("summary.txt",)),
        "notzip": b"plain text",
        "oldversion": archive({**MANIFEST, "csp_version": "1.0"}),
        "w59": archive(words=59), "w60": archive(words=60), "w200": archive(words=200), "w201": archive(words=201),
        "alias": archive(OLD_MANIFEST, OLD_METADATA, extra={"task_vector.bin": b"\x00\x3c" * 64}),
        "badtype": archive({**MANIFEST, "fp_type": "other"}),
        "badscore": archive({**MANIFEST, "success_score": 1.5}),
        "textscore": archive({**MANIFEST, "success_score": "high"}),
        "badjson": archive('{"csp_version": '),
        "notutf8": archive(summary=b"\xff\xfe " * 80),
    }
    stuffing = G.MAX_BYTES - len(archive(extra={"vector.bin": b""}))
    files["full"] = archive(extra={"vector.bin": bytes(stuffing)})
    files["over"] = archive(extra={"vector.bin": bytes(stuffing + 1)})
    assert len(files["full"]) == G.MAX_BYTES
    for name, content in files.items():
        (folder / f"{name}.fp").write_bytes(content)
    (folder / "other.txt").write_text("ignored")
    df = ingest_archives(spark, str(folder)).withColumn("name", F.regexp_extract("path", r"([^/]+)\.fp$", 1))
    return df.cache()


def test_archive_contract(archives):
    got = {r["name"]: list(r["violations"]) for r in G.validate(archives).collect()}
    assert got["good"] == got["w60"] == got["w200"] == got["full"] == []
    assert got["nosummary"] == ["files", "summary"]
    assert "zip" in got["notzip"]
    assert got["oldversion"] == ["version"]
    assert got["w59"] == got["w201"] == got["notutf8"] == ["summary"]
    assert got["badtype"] == ["fp_type"]
    assert got["badscore"] == got["textscore"] == ["score"]
    assert {"manifest", "version", "fp_type"} <= set(got["badjson"])
    assert got["over"] == ["size"]
    assert {"manifest", "metadata"} <= set(got["alias"])
    assert len(got) == 16


def test_lenient_mode_accepts_old_names(archives):
    lenient = {r["name"]: r["valid"] for r in G.validate(archives, "lenient").collect()}
    assert lenient["alias"] and not lenient["badtype"]
    row = G.normalise_manifest(archives).where("name = 'alias'").first()
    assert row["manifest"]["model_origin"] == "m" and row["manifest"]["created_at"] is not None
    assert (row["metadata"]["source_message_count"], row["metadata"]["vector_dimensions"], row["metadata"]["summary_token_count"]) == (7, 10000, 80)
    assert row["vector_name"] == "task_vector.bin"
    strict = G.normalise_manifest(archives, "strict").where("name = 'alias'").first()
    assert strict["manifest"]["model_origin"] is None


def test_validation_report_and_errors(archives):
    report = {r["check"]: r["archives"] for r in G.validation_report(G.validate(archives)).collect()}
    assert report["none"] == 4 and report["size"] == 1
    assert archives.where("error is not null").select("name").first()["name"] == "notzip"


def test_upsert_keeps_latest_and_prefers_new(spark):
    cols = "id string, summary string, created_at int"
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 5), ("c", "old", 2)], cols)
    new = spark.createDataFrame([("a", "new", 2), ("b", "new", 5), ("c", "new", 1), ("d", "new", 1), ("d", "newer", 2)], cols)
    got = {r["id"]: r["summary"] for r in G.upsert_registry(old, new).collect()}
    assert got == {"a": "new", "b": "new", "c": "old", "d": "newer"}


def test_inject_order_and_missing(spark):
    prompts = spark.createDataFrame([(1, "i1", "s1", "p"), (2, "i9", "s1", "p"), (3, "i1", None, "p"), (4, "i9", "s9", "p")], "prompt_id int, identity_id string, task_type string, prompt string")
    identity = spark.createDataFrame([("i1", "IDENTITY")], "identity_id string, summary string")
    skill = spark.createDataFrame([("s1", "SKILL")], "task_type string, summary string")
    got = {r["prompt_id"]: r["system_prompt"] for r in G.inject(prompts, identity, skill, hot_rows=1).collect()}
    assert got == {1: "IDENTITY\n\nSKILL\n\np", 2: "SKILL\n\np", 3: "IDENTITY\n\np", 4: "p"}


def test_leak_audit_on_short_and_repeated_texts(spark):
    quote = "one two three four five six seven eight"
    texts = spark.createDataFrame([(1, f"before {quote} after"), (2, "too short"), (3, f"{quote} {quote}"), (4, "a b c d e f g h i")], "id int, text string")
    messages = spark.createDataFrame([(quote,)] * 50, "text string")
    got = {r["id"]: (r["runs"], r["leaked"], r["leak"]) for r in G.leak_audit(texts, messages, "id", "text", "text").collect()}
    assert got == {1: (3, 1, True), 2: (0, 0, False), 3: (9, 2, True), 4: (2, 0, False)}


def test_redaction_leaves_nothing_to_audit(spark):
    text = "mail a.b@c.org or +47 123 45 678, api_key = abc123 token deadbeefdeadbeefdeadbeefdeadbeef99"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert {r["rule"]: r["hits"] for r in G.secret_audit(df).collect()} == {"email": 1, "credential": 1, "token": 1, "phone": 1}
    clean = G.redact(df)
    assert clean.first()["text"] == "mail [EMAIL] or [PHONE], [CREDENTIAL] token [TOKEN]"
    assert sum(r["hits"] for r in G.secret_audit(clean).collect()) == 0


def test_digest_groups(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, text string")
    row = G.digest_duplicates(df, "id", "text").collect()
    assert len(row) == 1 and row[0]["copies"] == 2 and row[0]["first_key"] == 1 and len(row[0]["digest"]) == 12


def test_read_messages_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"role": "user", "content": "hi"}, {"content": "no role"}, {"role": "assistant", "content": ""}]))
    (tmp_path / "b.json").write_text(json.dumps(["bare", "strings"]))
    (tmp_path / "c.json").write_text(json.dumps({"messages": [{"role": "user", "content": "in object"}]}))
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "e.json").write_text('{"other": 1}')
    df = read_messages(spark, str(tmp_path / "*.json")).withColumn("f", F.regexp_extract("source", r"(\w)\.json$", 1))
    got = sorted((r["f"], r["turn"], r["role"], r["text"], r["bare"], r["error"]) for r in df.where("error is null").collect())
    assert got == [
        ("a", 0, "user", "hi", False, None), ("a", 1, None, "no role", False, None), ("a", 2, "assistant", "", False, None),
        ("b", 0, None, "bare", True, None), ("b", 1, None, "strings", True, None), ("c", 0, "user", "in object", False, None),
    ]
    assert {r["f"]: r["error"] for r in df.where("error is not null").collect()} == {"d": "not JSON", "e": "no messages"}
    kept = M.select_messages(df.where("error is null"), bare="bare")
    assert sorted(r["text"] for r in kept.collect()) == ["bare", "hi", "in object", "strings"]
    assert M.nonempty(df).count() == 5


def test_chunks_and_positions_of_long_conversation(spark):
    df = spark.range(240).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    got = M.with_chunk(M.with_position(M.select_messages(df), block_rows=16))
    assert sorted((r["chunk"], r["count"]) for r in got.groupBy("chunk").count().collect()) == [(0, 50), (1, 50), (2, 20)]
    row = got.where("turn = 238").first()
    assert (row["pos"], row["n"], row["shift"]) == (119, 120, 0)
    with pytest.raises(ValueError):
        M.prompt_window(df, "train")


def test_fingerprint_table_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(s, t, rng.normal(size=8).tolist()) for s in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "label int, vec_id bigint, embedding array<double>")
    seeds = H.fingerprints(df, "label", "vec_id", dim=128).withColumn("variance_k4", F.lit(0.5))
    stats = write_fingerprints(seeds, str(tmp_path / "fp")).first()
    assert (stats["fp_type"], stats["fingerprints"], stats["messages"]) == ("identity", 3, 12)
    back = read_fingerprints(spark, str(tmp_path / "fp"), "identity", ["label", "bits"])
    assert back.columns == ["label", "bits"] and back.count() == 3
    target = write_registry(back, str(tmp_path / "reg"), 1)
    assert spark.read.parquet(target).count() == 3
    with pytest.raises(Exception):
        write_registry(back, str(tmp_path / "reg"), 1)


def test_flat_fingerprint_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    seed = rng.choice([-1.0, 1.0], 150)
    doc = {"version": "0.2", "n_messages": 3, "embed_dim": 2, "n_components": 2, "pca_mean": [0, 0], "pca_components": [[1, 0], [0, 1]],
           "pca_explained_variance_ratio": [0.75, 0.25], "hdc_dim": 150, "hdc_seed": seed.tolist()}
    (tmp_path / "one.fp").write_text(json.dumps(doc))
    row = read_fingerprint_files(spark, str(tmp_path / "*.fp")).first()
    assert row["bits"] == packed.pack((seed > 0)[None, :])[0].tolist()
    assert row["n_messages"] == 3 and row["variance_k4"] == 1.0


def test_result_tables(spark, tmp_path):
    rows = [("m1", 9.0, 1.0, True, False, "r", "a", "b", "f"), ("m2", 1.0, 2.0, False, False, "r", "a", "b", "f")]
    schema = "model string, score_with double, score_without double, fingerprint_won boolean, tie boolean, reasoning string, resp_with string, resp_without string, fingerprint string"
    write_results(spark.createDataFrame(rows, schema), str(tmp_path / "out"), "e1")
    slim = read_results(spark, str(tmp_path / "out"), "trials", "m1")
    assert slim.count() == 1 and not {"resp_with", "resp_without", "fingerprint"} & set(slim.columns)
    assert read_results(spark, str(tmp_path / "out"), "summary").count() == 2
    assert "resp_with" in read_results(spark, str(tmp_path / "out"), "full_responses").columns


def test_stream_equals_batch_with_shuffled_duplicates(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(c, t, rng.normal(size=8).tolist()) for c in range(4) for t in range(15)]
    schema = "conv_id bigint, turn bigint, embedding array<double>"
    mixed = rows + rows[::3]
    rng.shuffle(mixed)
    mixed = [(int(a), int(b), [float(x) for x in v]) for a, b, v in mixed]
    for i in range(3):
        spark.createDataFrame(mixed[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = stream_fingerprints(stream, str(tmp_path / "parts"), str(tmp_path / "check"), dim=128, block_rows=4)
    writer.trigger(availableNow=True).start().awaitTermination()
    batch = H.hv_bundle(H.hv_encode(spark.createDataFrame(rows, schema), dim=128), "conv_id", "turn", 128)
    want = {r["conv_id"]: (r["n"], r["acc"], r["bits"]) for r in batch.collect()}
    def current(path):
        return {r["conv_id"]: (r["n"], r["acc"], r["bits"]) for r in read_stream_fingerprints(spark, path, dim=128).collect()}
    assert current(str(tmp_path / "parts")) == want
    parts = str(tmp_path / "parts")
    assert compact_partials(spark, parts, dim=128) == 1
    assert current(parts) == want
    assert compact_partials(spark, parts, dim=128) is None

    more = [(c, 15, rng.normal(size=8).tolist()) for c in range(4)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_fingerprints(stream, parts, str(tmp_path / "check"), dim=128, block_rows=4).trigger(availableNow=True).start().awaitTermination()
    batch = H.hv_bundle(H.hv_encode(spark.createDataFrame(rows + more, schema), dim=128), "conv_id", "turn", 128)
    want = {r["conv_id"]: (r["n"], r["acc"], r["bits"]) for r in batch.collect()}
    assert current(parts) == want
    assert compact_partials(spark, parts, dim=128) == 2 and compact_partials(spark, parts, dim=128, upto=3) == 3
    assert current(parts) == want


def test_rendered_summary_meets_contract(spark):
    df = spark.createDataFrame([(1, "Hello there! Maybe we could stop?\n- a list"), (2, "Yes.")], "conv_id int, text string")
    rows = S.render_summary(S.style_profile(df, "conv_id")).withColumn("fp_type", F.lit("identity")).withColumn("success_score", F.lit(0.5))
    assert G.row_checks(rows).where("valid").count() == 2
