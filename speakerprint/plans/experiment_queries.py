"""Similarity statistics and the identification experiment over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from speakerprint.functions.mixing import pick_sql
from speakerprint.operators import experiment as X
from speakerprint.operators import hypervectors as H
from speakerprint.operators import match as J
from speakerprint.operators.basis import Basis
from speakerprint.plans.catalog import query, table
from speakerprint.plans.fingerprint_queries import FULL_SQL, parts, train_center, train_seeds

_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_PAIRS = f"""
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS g, count(*) OVER () AS total,
      row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
t AS (SELECT range AS trial, (SELECT count(*) FROM embeddings) AS total FROM range(1000)),
a AS (SELECT t.trial, e.* FROM t JOIN e ON e.g = {pick_sql('t.trial', '42', 't.total')}),
pairs AS (
  SELECT a.trial, 'same' AS draw, a.vec_id AS a, b.vec_id AS b, true AS same_speaker,
         {_COS.format(a='a.v', b='b.v')} AS score
  FROM a JOIN e b ON b.label = a.label AND b.p = (a.p + 1 + {pick_sql('a.trial', '43', '(a.n - 1)')}) % a.n WHERE a.n > 1
  UNION ALL
  SELECT a.trial, 'any', a.vec_id, b.vec_id, a.label = b.label, {_COS.format(a='a.v', b='b.v')}
  FROM a JOIN e b ON b.g = (a.g + 1 + {pick_sql('a.trial', '44', '(a.total - 1)')}) % a.total WHERE a.total > 1)"""


@query("pair_similarity", f"WITH {_PAIRS} SELECT trial, draw, a, b, same_speaker, round(score, 6) AS score FROM pairs")
def pair_similarity(spark, sf):
    pairs = J.speaker_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return pairs.withColumn("score", F.round("score", 6))


@query(
    "welch_same_cross",
    f"""WITH {_PAIRS}, s AS (SELECT count(*) FILTER (same_speaker) AS na, count(*) FILTER (NOT same_speaker) AS nb,
      avg(score) FILTER (same_speaker) AS ma, avg(score) FILTER (NOT same_speaker) AS mb,
      var_samp(score) FILTER (same_speaker) AS va, var_samp(score) FILTER (NOT same_speaker) AS vb FROM pairs)
    SELECT na AS n_a, nb AS n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b,
      round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t,
      round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 3) AS df FROM s""",
)
def welch_same_cross(spark, sf):
    w = X.welch_t(J.speaker_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding"), "same_speaker", "score")
    return w.select("n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("t", 4).alias("t"), F.round("df", 3).alias("df"))


_NEXT = f"""SELECT o.vec_id, {_COS.format(a='o.embedding::DOUBLE[]', b='g.embedding::DOUBLE[]')} AS score
FROM embeddings o JOIN embeddings g ON g.vec_id = o.vec_id + 1"""


def _next_scores(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return J.message_similarity(rows, rows.withColumn("vec_id", F.col("vec_id") - 1), "vec_id")


@query(
    "message_similarity_bands",
    f"""SELECT vec_id, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'good'
        WHEN score < 0.4 THEN 'poor' ELSE 'fair' END AS band FROM ({_NEXT})""",
)
def message_similarity_bands(spark, sf):
    return _next_scores(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "similarity_stats",
    f"""SELECT count(*) AS n_messages, round(avg(score), 6) AS average, round(median(score), 6) AS median, round(max(score), 6) AS best,
        round(min(score), 6) AS worst, round(stddev_pop(score), 6) AS std_dev, count(*) FILTER (score >= 0.7) AS above_0_7,
        count(*) FILTER (score >= 0.6) AS above_0_6 FROM ({_NEXT})""",
)
def similarity_stats(spark, sf):
    s = X.similarity_stats(_next_scores(spark, sf))
    exact = ("n_messages", "above_0_7", "above_0_6")
    return s.select(*[c if c in exact else F.round(c, 6).alias(c) for c in s.columns])


@query(
    "similarity_stats_by_speaker",
    f"""SELECT label, count(*) AS n_messages, round(avg(score), 6) AS average, round(median(score), 6) AS median, round(max(score), 6) AS best,
        round(min(score), 6) AS worst, round(stddev_pop(score), 6) AS std_dev
        FROM ({_NEXT}) s JOIN embeddings e ON e.vec_id = s.vec_id GROUP BY label""",
)
def similarity_stats_by_speaker(spark, sf):
    scores = _next_scores(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    s = X.similarity_stats(scores, ["label"]).drop("above_0_7", "above_0_6")
    exact = ("n_messages", "label")
    return s.select(*[c if c in exact else F.round(c, 6).alias(c) for c in s.columns])


_C = 10
_DRAW = pick_sql("trial", "(j + 42000)", "(j + 1)")
_TRIALS = f"""
speakers AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM embeddings)),
floyd AS (
  SELECT range AS trial, (SELECT count(*) FROM speakers) - {_C} AS j, CAST([] AS BIGINT[]) AS acc FROM range(1000)
  UNION ALL
  SELECT trial, j + 1, list_append(acc, CASE WHEN list_contains(acc, {_DRAW}) THEN j ELSE {_DRAW} END)
  FROM floyd WHERE j < (SELECT count(*) FROM speakers)),
chosen AS (SELECT trial, acc, {pick_sql('trial', '42 + 7', str(_C))} AS truth FROM floyd WHERE len(acc) = {_C}),
slots AS (SELECT trial, truth, unnest(acc) AS idx, generate_subscripts(acc, 1) - 1 AS k FROM chosen),
trials AS (SELECT trial, CASE WHEN k = truth THEN 0 WHEN k < truth THEN k + 1 ELSE k END AS slot, label, k = truth AS is_truth
           FROM slots JOIN speakers USING (idx))"""


@query("id_trials", f"WITH RECURSIVE {_TRIALS} SELECT trial, slot, label, is_truth FROM trials")
def id_trials(spark, sf):
    return X.make_trials(table(spark, sf, "embeddings").select("label"), "label", 1_000, _C)


# Seeds and held-out messages at the full width, as bit strings.
_WIDE = f"""{FULL_SQL},
placed AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
x AS (SELECT vec_id, label, pos, pos < (n * 70) // 100 AS train, generate_subscripts(embedding, 1) - 1 AS j,
             CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000000) AS BIGINT) AS x FROM placed)"""
_ANSWERS = f"""{_WIDE}, {_TRIALS},
tc AS (SELECT j, sum(x)::BIGINT AS s, count(*) AS n FROM x WHERE train GROUP BY j),
v AS (SELECT vec_id, label, pos, train, list((tc.n * x.x - tc.s)::DOUBLE ORDER BY x.j) AS v FROM x JOIN tc ON x.j = tc.j GROUP BY ALL),
tn AS (SELECT label, count(*) AS n FROM v WHERE train GROUP BY label),
seed AS (SELECT v.label, (r.m + tn.n - 1 - v.pos) % {H.HV_DIM} AS m, sum(CASE WHEN list_dot_product(v.v, r.r) >= 0 THEN 1 ELSE -1 END) AS acc
         FROM v JOIN tn ON v.label = tn.label, r WHERE v.train GROUP BY ALL),
sb AS (SELECT label, string_agg(CASE WHEN acc >= 0 THEN '1' ELSE '0' END, '' ORDER BY m)::BIT AS b FROM seed GROUP BY label),
qb AS (SELECT vec_id, string_agg(CASE WHEN list_dot_product(v, r) >= 0 THEN '1' ELSE '0' END, '' ORDER BY m)::BIT AS b FROM v, r WHERE NOT train GROUP BY vec_id),
score AS (SELECT qb.vec_id AS query_id, sb.label AS candidate, ({H.HV_DIM} - 2 * bit_count(xor(qb.b, sb.b))) / {H.HV_DIM}.0 AS score FROM qb, sb),
held AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n
         FROM v WHERE NOT train),
drawn AS (SELECT t.trial, t.label AS truth, held.vec_id FROM trials t JOIN held ON held.label = t.label
          AND held.p = {pick_sql('t.trial', '42 + 11', 'held.n')} WHERE t.is_truth),
judged AS (SELECT d.trial, d.truth, t.label AS winner, s.score, row_number() OVER (PARTITION BY d.trial ORDER BY s.score DESC, t.slot) AS rk
           FROM drawn d JOIN trials t ON t.trial = d.trial JOIN score s ON s.query_id = d.vec_id AND s.candidate = t.label),
answers AS (SELECT trial, truth, winner, score, truth = winner AS correct FROM judged WHERE rk = 1)"""


def _answers(spark, sf):
    train, heldout = parts(spark, sf)
    center = train_center(train)
    trials = X.make_trials(table(spark, sf, "embeddings").select("label"), "label", 1_000, _C)
    drawn = X.trial_queries(trials, heldout.select("label", "vec_id", "embedding"), "label", "vec_id")
    queries = H.hv_query(drawn, center)
    return X.run_identification(trials, queries, train_seeds(train, center, H.HV_DIM), "label")


@query("id_answers", f"WITH RECURSIVE {_ANSWERS} SELECT trial, truth, winner, score, correct FROM answers")
def id_answers(spark, sf):
    return _answers(spark, sf)


@query(
    "id_accuracy",
    f"""WITH RECURSIVE {_ANSWERS} SELECT count(*) AS n_trials, count(*) FILTER (correct) AS n_correct,
        round(count(*) FILTER (correct) / count(*), 6) AS accuracy, 0.1::DOUBLE AS baseline,
        round(count(*) FILTER (correct) / count(*) * {_C}, 6) AS lift FROM answers""",
)
def id_accuracy(spark, sf):
    a = X.accuracy(_answers(spark, sf), _C)
    return a.withColumn("accuracy", F.round("accuracy", 6)).withColumn("lift", F.round("lift", 6))


@query(
    "id_running_accuracy",
    f"""WITH RECURSIVE {_ANSWERS}, b AS (SELECT trial // 100 AS b, count(*) AS k, count(*) FILTER (correct) AS c FROM answers GROUP BY 1)
    SELECT (sum(k) OVER w)::BIGINT AS trials, (sum(c) OVER w)::BIGINT AS correct, round((sum(c) OVER w) / (sum(k) OVER w), 6) AS running_accuracy
    FROM b WINDOW w AS (ORDER BY b)""",
)
def id_running_accuracy(spark, sf):
    return X.running_accuracy(_answers(spark, sf)).withColumn("running_accuracy", F.round("running_accuracy", 6))


@query(
    "id_binomial",
    f"""WITH RECURSIVE {_ANSWERS}, s AS (SELECT count(*) AS n, count(*) FILTER (correct) AS k FROM answers),
    i AS (SELECT n, k, unnest(range(k, n + 1)) AS i FROM s)
    SELECT n AS n_trials, k AS n_correct, round(log10(sum(exp(
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1) + (n - i) * ln(0.9)))), 6) AS log10_p
    FROM i GROUP BY n, k""",
)
def id_binomial(spark, sf):
    tested = X.binomial_test(X.accuracy(_answers(spark, sf), _C))
    return tested.select("n_trials", "n_correct", F.round("log10_p", 6).alias("log10_p"))


@query(
    "id_ablation",
    f"""WITH RECURSIVE {_WIDE}, {_TRIALS},
    ks AS (SELECT unnest([{', '.join(map(str, X.ABLATION_K))}]) AS k),
    v AS (SELECT vec_id, label, train, list(x::DOUBLE ORDER BY j) AS v FROM x GROUP BY ALL),
    h AS (SELECT vec_id, label, train, k, m, CASE WHEN list_dot_product(v[1:k], r[1:k]) >= 0 THEN 1 ELSE -1 END AS h FROM v, r, ks),
    sb AS (SELECT label, k, string_agg(CASE WHEN acc >= 0 THEN '1' ELSE '0' END, '' ORDER BY m)::BIT AS b
           FROM (SELECT label, k, m, sum(h) AS acc FROM h WHERE train GROUP BY ALL) GROUP BY label, k),
    qb AS (SELECT vec_id, k, string_agg(CASE WHEN h > 0 THEN '1' ELSE '0' END, '' ORDER BY m)::BIT AS b FROM h WHERE NOT train GROUP BY vec_id, k),
    held AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM v WHERE NOT train),
    drawn AS (SELECT t.trial, t.label AS truth, held.vec_id FROM trials t JOIN held ON held.label = t.label
              AND held.p = {pick_sql('t.trial', '42 + 11', 'held.n')} WHERE t.is_truth),
    judged AS (SELECT d.trial, d.truth, qb.k, t.label AS winner,
               row_number() OVER (PARTITION BY d.trial, qb.k ORDER BY bit_count(xor(qb.b, sb.b)), t.slot) AS rk
               FROM drawn d JOIN trials t ON t.trial = d.trial JOIN qb ON qb.vec_id = d.vec_id JOIN sb ON sb.label = t.label AND sb.k = qb.k)
    SELECT k, count(*) AS n_trials, count(*) FILTER (truth = winner) AS n_correct, round(count(*) FILTER (truth = winner) / count(*), 6) AS accuracy,
           0.1::DOUBLE AS baseline, round(count(*) FILTER (truth = winner) / count(*) * {_C}, 6) AS lift FROM judged WHERE rk = 1 GROUP BY k""",
)
def id_ablation(spark, sf):
    """Six numbers of components at 10,000 dimensions and 10 candidates, in a given basis: the first 32 axes."""
    train, heldout = parts(spark, sf)
    axes = Basis(0, np.zeros(64), np.eye(64)[: max(X.ABLATION_K)], np.ones(max(X.ABLATION_K)) / 64)
    a = X.k_ablation(train, heldout, "label", "vec_id", c=_C, basis=axes)
    return a.withColumn("accuracy", F.round("accuracy", 6)).withColumn("lift", F.round("lift", 6))


@query("id_ablation_fitted")
def id_ablation_fitted(spark, sf):
    """The same in the principal components of the training messages."""
    train, heldout = parts(spark, sf)
    return X.k_ablation(train, heldout, "label", "vec_id", c=_C)
