"""Message selection, positions, chunks, prompt windows, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from speakerprint.functions.mixing import mix_sql
from speakerprint.operators import messages as M
from speakerprint.plans.catalog import query, table
from speakerprint.session import shared_dir
from speakerprint.sources.conversations import read_messages


@query("user_messages", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def user_messages(spark, sf):
    return M.select_messages(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


@query(
    "nonempty_counts",
    "SELECT role, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM conversations WHERE text <> '' GROUP BY role",
)
def nonempty_counts(spark, sf):
    rows = M.nonempty(table(spark, sf, "conversations"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))


_POSITIONS = """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
       count(*) OVER (PARTITION BY conv_id) AS n
FROM conversations WHERE role = 'user'"""


@query("message_positions", f"SELECT conv_id, turn, pos, n, n - 1 - pos AS shift FROM ({_POSITIONS})")
def message_positions(spark, sf):
    users = M.select_messages(table(spark, sf, "conversations")).select("conv_id", "turn")
    return M.with_position(users).select("conv_id", "turn", "pos", "n", "shift")


@query(
    "message_chunks",
    f"SELECT conv_id, pos // 2 AS chunk, count(*) AS messages, min(turn) AS first_turn FROM ({_POSITIONS}) GROUP BY ALL",
)
def message_chunks(spark, sf):
    users = M.select_messages(table(spark, sf, "conversations")).select("conv_id", "turn")
    chunked = M.with_chunk(M.with_position(users), size=2)
    return chunked.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("messages"), F.min("turn").alias("first_turn"))


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations"


def _window_sql(lines: str) -> str:
    return f"SELECT conv_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS \"window\" FROM ({lines}) GROUP BY conv_id"


@query(
    "prompt_identity",
    _window_sql(
        f"""SELECT conv_id, i, i || '. "' || substring(text, 1, 120) || '"' AS line
        FROM ({_NUMBERED}) WHERE i <= 6 AND role = 'user'"""
    ),
)
def prompt_identity(spark, sf):
    return M.prompt_window(table(spark, sf, "conversations"), "identity")


@query(
    "prompt_skill",
    _window_sql(
        f"""SELECT conv_id, i, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substring(text, 1, 150) AS line
        FROM ({_NUMBERED}) WHERE i <= 10"""
    ),
)
def prompt_skill(spark, sf):
    return M.prompt_window(table(spark, sf, "conversations"), "skill")


@query("prompt_judge", _window_sql(f"""SELECT conv_id, i, 'Example ' || i || ': "' || text || '"' AS line FROM ({_NUMBERED}) WHERE i <= 4"""))
def prompt_judge(spark, sf):
    return M.prompt_window(table(spark, sf, "conversations"), "judge")


@query("prompt_train_lines", f"""SELECT conv_id, i, i || '. "' || text || '"' AS line FROM ({_NUMBERED})""")
def prompt_train_lines(spark, sf):
    return M.prompt_lines(table(spark, sf, "conversations"), "train")


@query(
    "sampled_messages",
    f"""WITH d AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS size, row_number() OVER
        (PARTITION BY conv_id ORDER BY {mix_sql('conv_id * 31 + 42', 'turn')}, turn) AS sample_rank FROM conversations)
    SELECT conv_id, turn, sample_rank, size >= 2 AS enough FROM d WHERE sample_rank <= 3""",
)
def sampled_messages(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    sampled = M.sample_messages(rows, low=2, high=3)
    return sampled.select("conv_id", "turn", F.col("sample_rank").cast("bigint").alias("sample_rank"), "enough")


@query(
    "holdout_split",
    """SELECT vec_id, label, pos, CASE WHEN pos < (n * 70) // 100 THEN 'train' ELSE 'heldout' END AS part FROM (
    SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
           count(*) OVER (PARTITION BY label) AS n FROM embeddings)""",
)
def holdout_split(spark, sf):
    return M.split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id").select("vec_id", "label", "pos", "part")


@query(
    "conversations_read",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT i AS turn, role, text, n, sum(CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 1 END)::BIGINT AS documents FROM c GROUP BY i, role, text, n""",
)
def conversations_read(spark, sf):
    """Conversations as lines of JSON, every third one written three times: each line is a conversation of its own."""
    folder = shared_dir(spark, "lines")
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    text = F.to_json(F.transform("m", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))))
    copies = F.explode(F.when(F.col("conv_id") % 3 == 0, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1))))
    listed.select(text.alias("value"), copies.alias("copy")).select("value").write.text(folder)
    read = read_messages(spark, folder, lines=True, key="conv_id")
    sizes = read.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return read.join(sizes, "conv_id").groupBy("turn", "role", "text", "n").agg(F.count_distinct("conv_id").alias("documents"))
