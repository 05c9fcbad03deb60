"""Vectors of archives as sign bits, archives made from rows, and lines with their numbers."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from speakerprint.functions import packed
from speakerprint.functions.jsontext import script_number, script_text, strict_object
from speakerprint.operators.abtest import parse_judgement
from speakerprint.sources.archives import ingest_archives, open_archives, pack_archives, vector_bits
from speakerprint.sources.conversations import numbered_lines, read_messages


def npy(values):
    buffer = io.BytesIO()
    np.save(buffer, values)
    return buffer.getvalue()


def test_vector_forms():
    values = np.random.default_rng(1).normal(size=130).astype("<f2")
    values[:3] = [0.0, -0.0, -1e-8]
    want = packed.pack((values >= 0)[None, :])[0].tolist()
    for raw in (values.tobytes(), npy(values), npy(values.astype(">f2"))):
        errors = []
        assert vector_bits(raw, errors) == (130, want) and not errors
    assert vector_bits(None, []) == (None, None) and vector_bits(b"", []) == (0, [])


@pytest.mark.parametrize("raw", [b"\x00", npy(np.zeros(4, np.float32)), npy(np.zeros((2, 2), np.float16)), npy(np.zeros(9, np.float16))[:-2], b"\x93NUMPY\x01\x00\xff", np.array([np.nan], "<f2").tobytes()])
def test_unreadable_vectors_are_named(raw):
    errors = []
    assert vector_bits(raw, errors)[1] is None and len(errors) == 1


def test_archives_of_rows_and_files(spark, tmp_path):
    rows = [(1, '{"a": 1}', "some words", "{}", [0.5, -2.0, 0.0]), (2, None, "x", "{}", None), (3, "{}", None, "{}", [])]
    df = spark.createDataFrame(rows, "id bigint, manifest string, summary string, metadata string, vector array<double>")
    made = pack_archives(df)
    assert made.collect() == pack_archives(df.repartition(3)).orderBy("id").collect()
    opened = {r["path"]: r for r in open_archives(made.unionByName(spark.createDataFrame([(4, b"no zip"), (5, None)], "id bigint, content binary")), "id", raw=False).collect()}
    assert sorted(opened) == ["1", "2", "3", "4"]
    assert (opened["1"]["manifest_json"], opened["1"]["summary"], opened["1"]["vector_dim"], opened["1"]["bits"], opened["1"]["vector"]) == ('{"a": 1}', "some words", 3, [5], None)
    assert opened["2"]["files"] == ["summary.txt", "metadata.json"] and opened["2"]["bits"] is None and opened["2"]["vector_dim"] is None
    assert {r["vector_error"] for r in opened.values()} == {None}
    assert opened["3"]["bits"] == [] and not opened["4"]["is_zip"] and opened["4"]["error"]
    for r in made.collect():
        (tmp_path / f"{r['id']}.fp").write_bytes(r["content"])
    again = {r["path"][-4:-3]: r for r in ingest_archives(spark, str(tmp_path)).collect()}
    assert again["1"]["bits"] == [5] and again["1"]["vector"] == np.array([0.5, -2, 0], "<f2").tobytes() and len(again) == 3
    with zipfile.ZipFile(io.BytesIO(made.where("id = 1").first()["content"])) as z:
        assert z.read("vector.bin") == again["1"]["vector"]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    texts = {"a.jsonl": [f"line {i % 7}" for i in range(4_000)], "b.jsonl": ["same"] * 50 + [""], "c.jsonl": [""]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        rows = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(name, i): v for name, lines in texts.items() for i, v in enumerate("\n".join(lines).splitlines())}
    assert rows == want


def test_equal_lines_are_different_conversations(spark, tmp_path):
    line = json.dumps([{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}])
    (tmp_path / "x.jsonl").write_text("\n".join([line, line, "", "{broken", line]))
    read = read_messages(spark, str(tmp_path), lines=True, key="conv_id")
    assert read.columns[0] == "conv_id"
    good = read.where("error IS NULL")
    assert good.count() == 6 and good.select("conv_id").distinct().count() == 3
    assert [r["conv_id"].rsplit("#", 1)[1] for r in read.where("error IS NOT NULL").collect()] == ["3"]


# Numbers and what a script's string conversion makes of them.
NUMBERS = {
    "1.5e10": "15000000000", "38.0": "38", "0.10": "0.1", "1e21": "1e+21", "123456789012345680000": "123456789012345680000", "1e-6": "0.000001", "1.5e-7": "1.5e-7", "-2.50": "-2.5",
    "0.1e1": "1", "1e23": "1e+23", "5e-324": "5e-324", "-0.0": "0", "100": "100", "9007199254740993": "9007199254740992", "1.7976931348623157e308": "1.7976931348623157e+308",
    "0.30000000000000004": "0.30000000000000004", "12.34": "12.34",
}


def test_numbers_as_scripts_write_them(spark):
    df = spark.createDataFrame([(k, float(k), v) for k, v in NUMBERS.items()], "given string, x double, want string")
    assert [r for r in df.select("given", "want", script_number(F.col("x")).alias("got")).collect() if r["got"] != r["want"]] == []
    held = df.select("want", script_text(F.try_variant_get(strict_object(F.concat(F.lit('{"k": '), "given", F.lit("}"))), F.lit("$.k"), "variant")).alias("got"))
    assert [r for r in held.collect() if r["got"] != r["want"]] == []


def test_last_of_equal_keys_counts(spark):
    reply = '{"score_x": 1, "score_y": 2, "winner": "X", "reasoning": "a", "score_x": 7, "winner": "Y"}'
    r = parse_judgement(spark.createDataFrame([(reply,)], "reply string")).first()
    assert (r["score_x"], r["score_y"], r["winner"], r["parse_failed"]) == (7.0, 2.0, "Y", False)
