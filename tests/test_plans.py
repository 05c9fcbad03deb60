"""Plan shapes that matter at scale."""

import pytest

import __spark_entry__ as entry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["user_messages", "message_positions", "prompt_identity", "sampled_messages", "holdout_split", "best_per_task", "registry_latest",
     "leak_audit", "leaked_messages", "secret_audit", "signature_phrases", "vocabulary_profile", "injected_prompts", "ab_combined",
     "message_similarity_bands", "similarity_stats", "speaker_centroids", "task_gate_hard", "id_trials", "id_answers", "pair_similarity"],
)
def test_no_cross_product(name, spark, sf_dir):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_role_filter_reaches_the_scan(spark, sf_dir):
    text = plan(entry.queries()["user_messages"](spark, sf_dir))
    assert "EqualTo(role,user)" in text


@pytest.mark.parametrize("name", ["prompt_identity", "sampled_messages", "best_per_task", "registry_latest", "consensus_selection", "signature_phrases"])
def test_top_k_is_cut_before_the_shuffle(name, spark, sf_dir):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(entry.queries()["digest_duplicates"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_positions_shuffle_rows_once(spark, sf_dir):
    text = plan(entry.queries()["message_positions"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning(conv_id") <= 4


@pytest.mark.parametrize("name", ["leak_audit", "leaked_messages"])
def test_runs_are_filtered_before_their_shuffle(name, spark, sf_dir):
    """Only runs that the bitmap of the small table may hold are shuffled."""
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "getbit" in text


def test_bitmap_holds_its_values_and_few_others(spark):
    from pyspark.sql import functions as F

    from speakerprint.operators.scale import bit_filter, may_hold

    values = spark.range(1_000).select(F.xxhash64("id").alias("h"))
    words = bit_filter(values, "h", 1 << 14)
    asked = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).withColumn("kept", may_hold(words, "h", 1 << 14))
    assert asked.where("id < 1000 AND kept").count() == 1_000
    assert asked.where("id >= 1000 AND kept").count() < 0.08 * 19_000


class _Conf:
    def __init__(self, root):
        self.root = root

    def get(self, key, default=None):
        return self.root if key == "spark.checkpoint.dir" and self.root else default


class _Session:
    def __init__(self, root, master):
        self.conf = _Conf(root)
        self.sparkContext = type("Context", (), {"master": master})()


def test_shared_folder_comes_from_the_session():
    from speakerprint.session import shared_dir

    assert shared_dir(_Session("hdfs:///scratch/", "yarn"), "x").startswith("hdfs:///scratch/x-")
    local = _Session(None, "local[2]")
    first, second = shared_dir(local, "x"), shared_dir(local, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    with pytest.raises(RuntimeError):
        shared_dir(_Session(None, "yarn"), "x")
