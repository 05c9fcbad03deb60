"""A/B and task trials. Judge replies are derived from the events table, task outcomes from labels.

An event is a trial: model = event_type, persona = user_id % 5. Its ``k`` gives both scores;
some reply texts are fenced, broken, incomplete or carry a label that is no side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from speakerprint.functions.mixing import coin_sql
from speakerprint.operators import abtest as A
from speakerprint.operators import tasks as K
from speakerprint.plans.catalog import query, table, wide_table
from speakerprint.session import shared_dir
from speakerprint.sources.results import read_results, write_results

_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
_KQ = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_WITH = "least(10, {k} % 10 + 1 + length(event_type) % 3 * 2)"
_WITHOUT = "(CAST(floor({k} / 10) AS BIGINT) + event_id) % 10 + 1"


def _replies(spark, sf):
    trials = A.assign_blind(wide_table(spark, sf, "events", "event_id", "user_id", "event_type", "props"), "event_id")
    scored = (
        trials.withColumn("k", F.expr(_K)).withColumn("w", F.expr(_WITH.format(k="k"))).withColumn("o", F.expr(_WITHOUT.format(k="k")))
    )
    x, y = F.when(F.col("flip"), F.col("o")).otherwise(F.col("w")), F.when(F.col("flip"), F.col("w")).otherwise(F.col("o"))
    winner = F.when(F.col("event_id") % 50 == 3, "Z").when(x > y, "X").when(x < y, "Y").otherwise("tie")
    body = F.concat(
        F.lit('{"score_x": '), x.cast("string"), F.lit(', "score_y": '), y.cast("string"),
        F.when(F.col("event_id") % 50 == 2, F.lit("")).otherwise(F.concat(F.lit(', "winner": "'), winner, F.lit('"'))),
        F.lit(', "reasoning": "k='), F.col("k").cast("string"), F.lit('"}'),
    )
    reply = (
        F.when(F.col("event_id") % 50 == 0, F.lit('{"score_x": '))
        .when(F.col("event_id") % 50 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .otherwise(body)
    )
    return scored.select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("persona"), "flip", "k", reply.alias("reply"))


_REPLIES = f"""
s AS (SELECT event_id, event_type AS model, user_id % 5 AS persona, {_KQ} AS k, {coin_sql('event_id', '42', '//')} = 1 AS flip,
      {_WITH.format(k=_KQ)} AS w, {_WITHOUT.format(k=_KQ)} AS o FROM events),
xy AS (SELECT *, CASE WHEN flip THEN o ELSE w END AS x, CASE WHEN flip THEN w ELSE o END AS y FROM s),
body AS (SELECT *, '{{"score_x": ' || x || ', "score_y": ' || y || CASE WHEN event_id % 50 = 2 THEN '' ELSE ', "winner": "' ||
         CASE WHEN event_id % 50 = 3 THEN 'Z' WHEN x > y THEN 'X' WHEN x < y THEN 'Y' ELSE 'tie' END || '"' END
         || ', "reasoning": "k=' || k || '"}}' AS body FROM xy),
replies AS (SELECT event_id, model, persona, flip, k, CASE WHEN event_id % 50 = 0 THEN '{{"score_x": '
            WHEN event_id % 50 = 1 THEN '```json' || chr(10) || body || chr(10) || '```' || chr(10) ELSE body END AS reply FROM body),
clean AS (SELECT *, trim(replace(replace(reply, '```json', ''), '```', ''), ' ' || chr(9) || chr(10) || chr(13)) AS c FROM replies),
js AS (SELECT *, CASE WHEN json_valid(c) THEN c ELSE '{{}}' END AS j FROM clean),
f AS (SELECT *, TRY_CAST(json_extract_string(j, '$.score_x') AS DOUBLE) AS fx, TRY_CAST(json_extract_string(j, '$.score_y') AS DOUBLE) AS fy,
      json_extract_string(j, '$.winner') AS fw, json_extract_string(j, '$.reasoning') AS fr FROM js),
g AS (SELECT *, fx IS NULL OR fy IS NULL OR fw IS NULL OR fr IS NULL AS parse_failed FROM f),
judged AS (SELECT event_id, model, persona, flip, parse_failed, CASE WHEN parse_failed THEN 5.0 ELSE fx END::DOUBLE AS score_x,
           CASE WHEN parse_failed THEN 5.0 ELSE fy END::DOUBLE AS score_y, CASE WHEN parse_failed THEN 'tie' ELSE fw END AS winner,
           CASE WHEN parse_failed THEN 'Parse error' ELSE fr END AS reasoning FROM g),
un AS (SELECT *, CASE WHEN flip THEN score_y ELSE score_x END AS score_with, CASE WHEN flip THEN score_x ELSE score_y END AS score_without,
       winner = CASE WHEN flip THEN 'Y' ELSE 'X' END AS fingerprint_won, winner = 'tie' AS tie FROM judged)"""

_STATS = """wins, losses, ties, total, round(aw, 2) AS avg_with, round(ao, 2) AS avg_without,
    round(CASE WHEN wins + losses > 0 THEN wins / (wins + losses) * 100 ELSE 0 END, 1) AS win_rate,
    round(CASE WHEN ao > 0 THEN (aw - ao) / ao * 100 ELSE 0 END, 1) AS lift_pct, round(aw - ao, 2) AS delta"""


def _counted(by: str) -> str:
    return f"""(SELECT {by}, count(*) FILTER (fingerprint_won) AS wins, count(*) FILTER (NOT fingerprint_won AND NOT tie) AS losses,
    count(*) FILTER (tie) AS ties, count(*) AS total, avg(score_with) AS aw, avg(score_without) AS ao FROM un GROUP BY {by})"""


def _trials(spark, sf):
    return A.unblind(A.parse_judgement(_replies(spark, sf)))


@query("blind_assignment", f"SELECT event_id, {coin_sql('event_id', '42', '//')} = 1 AS flip FROM events")
def blind_assignment(spark, sf):
    return A.assign_blind(table(spark, sf, "events").select("event_id"), "event_id")


@query("judge_parsed", f"WITH {_REPLIES} SELECT event_id, score_x, score_y, winner, reasoning, parse_failed FROM judged")
def judge_parsed(spark, sf):
    return A.parse_judgement(_replies(spark, sf)).select("event_id", "score_x", "score_y", "winner", "reasoning", "parse_failed")


_PICK = """CASE {k} % 5 WHEN 0 THEN 'A because ' WHEN 1 THEN '  A, ' WHEN 2 THEN 'B ' WHEN 3 THEN 'error ' ELSE 'a ' END || event_type"""


def _picks(spark, sf):
    trials = A.assign_blind(table(spark, sf, "events").select("event_id", "event_type", "props"), "event_id")
    return A.parse_pick(trials.withColumn("reply", F.expr(_PICK.format(k=_K))))


_PICKED = f"""p AS (SELECT event_id, event_type AS model, {coin_sql('event_id', '42', '//')} = 1 AS flip, {_PICK.format(k=_KQ)} AS reply FROM events),
picked AS (SELECT *, CASE WHEN starts_with(trim(reply), 'A') THEN 'A' ELSE 'B' END AS pick,
           NOT (starts_with(trim(reply), 'A') OR starts_with(trim(reply), 'B')) AS is_error FROM p)"""


@query(
    "pick_parsed",
    f"WITH {_PICKED} SELECT event_id, pick, is_error, (pick = 'A') <> flip AS fingerprint_won FROM picked",
)
def pick_parsed(spark, sf):
    return A.unblind_pick(_picks(spark, sf)).select("event_id", "pick", "is_error", "fingerprint_won")


@query("unblinded", f"WITH {_REPLIES} SELECT event_id, model, score_with, score_without, fingerprint_won, tie FROM un")
def unblinded(spark, sf):
    return _trials(spark, sf).select("event_id", "model", "score_with", "score_without", "fingerprint_won", "tie")


@query("ab_stats_by_model", f"WITH {_REPLIES} SELECT model, {_STATS} FROM {_counted('model')}")
def ab_stats_by_model(spark, sf):
    return A.ab_stats(_trials(spark, sf))


@query("ab_stats_by_persona", f"WITH {_REPLIES} SELECT model, persona, {_STATS} FROM {_counted('model, persona')}")
def ab_stats_by_persona(spark, sf):
    return A.ab_stats(_trials(spark, sf), ["model", "persona"])


@query(
    "ab_rate_all",
    f"""WITH {_PICKED} SELECT model, count(*) FILTER ((pick = 'A') <> flip) AS wins, count(*) AS total,
    CAST(floor(count(*) FILTER ((pick = 'A') <> flip) / count(*) * 100 + 0.5) AS BIGINT) AS win_rate FROM picked GROUP BY model""",
)
def ab_rate_all(spark, sf):
    return A.ab_rate_all(A.unblind_pick(_picks(spark, sf)).withColumnRenamed("event_type", "model"))


def _verdict_sql(high: int, rate: str = "win_rate") -> str:
    return f"CASE WHEN {rate} >= {high} THEN 'validated' WHEN {rate} >= 50 THEN 'marginal' ELSE 'not proven' END"


@query(
    "ab_verdicts",
    f"""WITH {_REPLIES} SELECT model, win_rate, {_verdict_sql(65)} AS scored, {_verdict_sql(70)} AS picked
    FROM (SELECT model, {_STATS} FROM {_counted('model')})""",
)
def ab_verdicts(spark, sf):
    stats = A.ab_stats(_trials(spark, sf))
    return stats.select("model", "win_rate", A.verdict().alias("scored"), A.verdict(variant="picked").alias("picked"))


@query("ab_comparison", f"WITH {_REPLIES} SELECT *, {_verdict_sql(65)} AS verdict FROM (SELECT model, {_STATS} FROM {_counted('model')})")
def ab_comparison(spark, sf):
    return A.compare_models(_trials(spark, sf))


@query("stored_results", f"WITH {_REPLIES} SELECT *, {_verdict_sql(65)} AS verdict FROM (SELECT model, {_STATS} FROM {_counted('model')})")
def stored_results(spark, sf):
    """The comparison as written to and read from the experiment's result tables."""
    path = shared_dir(spark, "results")
    trials = _trials(spark, sf).withColumn("resp_with", F.col("reply"))
    write_results(trials, path, "derived")
    return read_results(spark, path, "summary").drop("experiment", "written_at")


@query(
    "ab_combined",
    f"""WITH {_REPLIES}, st AS (SELECT model, {_STATS} FROM {_counted('model')}),
    macro AS (SELECT 'macro' AS method, count(*) AS models, coalesce(sum(total), 0)::BIGINT AS trials, avg(win_rate) AS win_rate,
              avg(avg_with) AS avg_with, avg(avg_without) AS avg_without FROM st WHERE win_rate >= 65),
    pooled AS (SELECT 'pooled' AS method, (SELECT count(*) FROM st) AS models, count(*) AS trials,
               count(*) FILTER (fingerprint_won) / (count(*) FILTER (NOT tie)) * 100 AS win_rate,
               avg(score_with) AS avg_with, avg(score_without) AS avg_without FROM un),
    both_ AS (SELECT * FROM macro UNION ALL SELECT * FROM pooled)
    SELECT method, models, trials, round(win_rate, 4) AS win_rate, round(avg_with, 4) AS avg_with, round(avg_without, 4) AS avg_without,
           round((avg_with - avg_without) / avg_without * 100, 4) AS improvement_pct FROM both_""",
)
def ab_combined(spark, sf):
    rates = ("win_rate", "avg_with", "avg_without", "improvement_pct")
    c = A.combine(_trials(spark, sf))
    return c.select("method", "models", "trials", *[F.round(r, 4).alias(r) for r in rates])


@query(
    "score_exact",
    r"""SELECT conv_id, turn, starts_with(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))),
        lower(CASE WHEN turn % 2 = 0 THEN upper(substring(text, 1, 4)) ELSE 'la' END)) AS ok FROM conversations""",
)
def score_exact(spark, sf):
    rows = table(spark, sf, "conversations")
    answer = F.when(F.col("turn") % 2 == 0, F.upper(F.substring("text", 1, 4))).otherwise("la")
    return rows.select("conv_id", "turn", K.score_exact("text", answer).alias("ok"))


@query(
    "score_contains",
    """SELECT conv_id, turn, contains(lower(text), 'that') OR contains(lower(text), 'ção') OR contains(lower(text), lower(role || '.')) AS ok
       FROM conversations""",
)
def score_contains(spark, sf):
    rows = table(spark, sf, "conversations")
    answers = F.array(F.lit("THAT"), F.lit("Ção"), F.concat("role", F.lit(".")))
    return rows.select("conv_id", "turn", K.score_contains("text", answers).alias("ok"))


@query(
    "score_numeric",
    r"""SELECT doc_id, list_contains(regexp_extract_all(text, '(\d+\.?\d*)', 1), CAST(doc_id % 10 AS VARCHAR)) AS ok_digit,
        list_contains(regexp_extract_all('= ' || n_chars || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.' ELSE '.0' END, '(\d+\.?\d*)', 1),
                      CAST(n_chars AS VARCHAR)) AS ok_chars FROM documents""",
)
def score_numeric(spark, sf):
    docs = table(spark, sf, "documents")
    ending = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, ".").otherwise(".0")
    reply = F.concat(F.lit("= "), F.col("n_chars").cast("string"), ending)
    return docs.select(
        "doc_id",
        K.score_numeric("text", (F.col("doc_id") % 10).cast("string")).alias("ok_digit"),
        K.score_numeric(reply, F.col("n_chars").cast("string")).alias("ok_chars"),
    )


_JSON_REPLY = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```JSON' || chr(10) || props || chr(10) || '```'
    WHEN 2 THEN '{"K": 1}' WHEN 3 THEN '{"k": ' WHEN 4 THEN '{"k": ' || K || '.0, "more": [1]}' ELSE '{"k": "' || K || '"}' END"""
_FENCE = "regexp_replace(reply, '```(json)?', '', 'gi')"


@query(
    "score_json",
    f"""WITH t AS (SELECT event_id, {_KQ} AS k, {_JSON_REPLY.replace('|| K ||', f'|| {_KQ} ||')} AS reply FROM events),
    c AS (SELECT event_id, k, trim({_FENCE}, ' ' || chr(10)) AS c FROM t),
    v AS (SELECT event_id, k, CASE WHEN json_valid(c) THEN json_extract_string(c, '$.k') END AS found FROM c)
    SELECT event_id, coalesce(regexp_replace(found, '[.]0+$', '') = CAST(k AS VARCHAR), false) AS ok FROM v""",
)
def score_json(spark, sf):
    rows = wide_table(spark, sf, "events", "event_id", "props").withColumn("kk", F.expr(_K))
    replied = rows.withColumn("reply", F.expr(_JSON_REPLY.replace("|| K ||", "|| kk ||").replace("chr(10)", "char(10)")))
    return replied.select("event_id", K.score_json("reply", F.create_map(F.lit("k"), F.col("kk").cast("string"))).alias("ok"))


# Number texts and repeated keys of replies, each with the text that a script makes of the value.
_NUMBER_REPLY = """CASE event_id % 8 WHEN 0 THEN concat('{"k": ', kk, 'e2}') WHEN 1 THEN concat('{"k": "x", "k": ', kk, '}')
    WHEN 2 THEN concat('{"k": ', kk, ', "k": 1000}') WHEN 3 THEN concat('{"k": ', kk, '.50}') WHEN 4 THEN concat('{"k": 1', kk, 'e20}')
    WHEN 5 THEN concat('{"k": 1', kk, 'e-9}') WHEN 6 THEN concat('{"k": -0.0', 1 + kk % 9, '0}') ELSE '{"k": 1.5e10}' END"""
_NUMBER_TEXT = """CASE event_id % 8 WHEN 0 THEN CAST(kk * 100 AS STRING) WHEN 3 THEN concat(kk, '.5')
    WHEN 4 THEN concat(regexp_replace(concat('1.', kk), '[.]?0*$', ''), CASE WHEN kk < 10 THEN 'e+21' ELSE 'e+22' END)
    WHEN 5 THEN concat(regexp_replace(concat('1.', kk), '[.]?0*$', ''), CASE WHEN kk < 10 THEN 'e-8' ELSE 'e-7' END)
    WHEN 6 THEN concat('-0.0', 1 + kk % 9) WHEN 7 THEN '15000000000' ELSE CAST(kk AS STRING) END"""


@query("score_json_numbers", "SELECT event_id, event_id % 8 <> 2 AS ok FROM events")
def score_json_numbers(spark, sf):
    """Exponents, trailing zeros, large and small numbers, and the last of equal keys."""
    rows = wide_table(spark, sf, "events", "event_id", "props").withColumn("kk", F.expr(_K))
    replied = rows.withColumn("reply", F.expr(_NUMBER_REPLY))
    return replied.select("event_id", K.score_json("reply", F.create_map(F.lit("k"), F.expr(_NUMBER_TEXT))).alias("ok"))


_OUTCOMES = "SELECT d.doc_id, d.lang AS task, l.quality = 1 AS ok_with, l.toxic = 1 AS ok_without FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _outcomes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("task"))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok_with"), (F.col("toxic") == 1).alias("ok_without"))
    return labels.join(docs, "doc_id")


@query(
    "paired_outcomes",
    f"""SELECT doc_id, ok_with AND NOT ok_without AS helped, NOT ok_with AND ok_without AS hurt, ok_with AND ok_without AS both_ok,
        NOT ok_with AND NOT ok_without AS both_bad FROM ({_OUTCOMES})""",
)
def paired_outcomes(spark, sf):
    return K.paired_outcomes(_outcomes(spark, sf)).select("doc_id", "helped", "hurt", "both_ok", "both_bad")


_TASK_STATS = f"""SELECT task, count(*) FILTER (ok_with) AS n_with, count(*) FILTER (ok_without) AS n_without, count(*) AS n,
    count(*) FILTER (ok_with) - count(*) FILTER (ok_without) AS delta, count(*) FILTER (ok_with AND NOT ok_without) AS helped,
    count(*) FILTER (NOT ok_with AND ok_without) AS hurt, count(*) FILTER (ok_with AND ok_without) AS both_ok,
    count(*) FILTER (NOT ok_with AND NOT ok_without) AS both_bad FROM ({_OUTCOMES}) GROUP BY ROLLUP (task)"""


@query("task_stats", _TASK_STATS)
def task_stats(spark, sf):
    return K.task_stats(_outcomes(spark, sf))


def _gate_sql(low: int, helped: int) -> str:
    return f"""SELECT task, n_with, n_without, n, lift_pct, lift_pct > {low} AND n_with > n_without AND helped >= {helped} AS passed, n >= 20 AS shown
    FROM (SELECT *, round(CASE WHEN n_without > 0 THEN (n_with - n_without) / n_without * 100 ELSE 0 END, 1) AS lift_pct FROM ({_TASK_STATS}))"""


@query("task_gate_hard", _gate_sql(10, 3))
def task_gate_hard(spark, sf):
    return K.task_gate(K.task_stats(_outcomes(spark, sf)), "hard").select("task", "n_with", "n_without", "n", "lift_pct", "passed", "shown")


@query("task_gate_easy", _gate_sql(5, 0))
def task_gate_easy(spark, sf):
    return K.task_gate(K.task_stats(_outcomes(spark, sf)), "easy").select("task", "n_with", "n_without", "n", "lift_pct", "passed", "shown")
