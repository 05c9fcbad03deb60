"""Style profiles of conversation roles and document sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from speakerprint.operators import style as S
from speakerprint.plans.catalog import query, table, wide_table
from speakerprint.plans.registry_queries import words_sql

# Frequent function words of the table's languages, in place of the default lexicon.
_LEXICON = {"hedge": ("that", "which", "que"), "certain": ("is", "est", "ist"), "direct": ("the", "le", "der")}

_TOKENS = """(SELECT {by}, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[.,;:!?()"]+', ' ', 'g'), '[ \\t\\n\\r]+'),
    lambda w: w <> '')) AS token FROM {src})"""


@query(
    "sentence_profile",
    f"""WITH s AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {words_sql('s')}),
        lambda n: n > 0) AS n FROM conversations)
    SELECT conv_id, count(*) AS messages, sum(len(n))::BIGINT AS sentences, sum(coalesce(list_sum(n), 0))::BIGINT AS words,
    round(sum(coalesce(list_sum(n), 0)) / sum(len(n)), 6) AS avg_words, max(list_max(n)) AS max_words FROM s GROUP BY conv_id""",
)
def sentence_profile(spark, sf):
    p = S.sentence_profile(table(spark, sf, "conversations"), ["conv_id"])
    return p.withColumn("avg_words", F.round("avg_words", 6))


@query(
    "vocabulary_profile",
    f"""WITH t AS (SELECT source, token, count(*) AS c FROM {_TOKENS.format(by='source', src='documents')} GROUP BY ALL)
    SELECT source, sum(c)::BIGINT AS tokens, count(*) AS types, round(count(*) / sum(c), 6) AS type_token_ratio,
    round(sum(c * length(token)) / sum(c), 6) AS mean_word_length,
    round(sum(CASE WHEN length(token) >= 7 THEN c ELSE 0 END) / sum(c), 6) AS long_word_rate FROM t GROUP BY source""",
)
def vocabulary_profile(spark, sf):
    p = S.vocabulary_profile(wide_table(spark, sf, "documents", "doc_id", "source", "text"), ["source"])
    rates = ("type_token_ratio", "mean_word_length", "long_word_rate")
    return p.select(*[F.round(c, 6).alias(c) if c in rates else c for c in p.columns])


def _listed(entries) -> str:
    return ", ".join(f"'{e}'" for e in entries)


@query(
    "hedging_profile",
    f"""WITH t AS {_TOKENS.format(by='role', src='conversations')} SELECT role, count(*) AS tokens, """
    + ", ".join(f"count(*) FILTER (token IN ({_listed(e)})) AS {n}_count" for n, e in _LEXICON.items())
    + ", "
    + ", ".join(f"round(count(*) FILTER (token IN ({_listed(e)})) * 100 / count(*), 6) AS {n}_per_100" for n, e in _LEXICON.items())
    + " FROM t GROUP BY role",
)
def hedging_profile(spark, sf):
    p = S.hedging_profile(table(spark, sf, "conversations"), ["role"], lexicon=_LEXICON)
    return p.select(*[F.round(c, 6).alias(c) if c.endswith("_per_100") else c for c in p.columns])


def _mark_sql(m: str) -> str:
    return f"length(text) - length(replace(text, '{m}', ''))"


@query(
    "punctuation_profile",
    f"""WITH t AS (SELECT conv_id, {', '.join(f'{_mark_sql(m)} AS {n}' for n, m in S.MARKS.items())},
        ends_with(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '?') AS ask,
        len(regexp_extract_all(text, '(?m)^[ \t]*(?:[-*]|[0-9]+\\.)[ \t]')) AS list, {words_sql('text')} AS w FROM conversations)
    SELECT conv_id, {', '.join(f'sum({n})::BIGINT AS {n}' for n in S.MARKS)}, count(*) FILTER (ask) AS question_texts,
    sum(list)::BIGINT AS list_lines, round(CASE WHEN sum(w) > 0 THEN ({' + '.join(f'sum({n})' for n in S.MARKS)}) * 100 / sum(w) ELSE 0 END, 6)
    AS marks_per_100 FROM t GROUP BY conv_id""",
)
def punctuation_profile(spark, sf):
    p = S.punctuation_profile(table(spark, sf, "conversations"), ["conv_id"])
    return p.withColumn("marks_per_100", F.round("marks_per_100", 6))


@query(
    "signature_phrases",
    """WITH w AS (SELECT source, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[.,;:!?()"]+', ' ', 'g'), '[ \\t\\n\\r]+'),
        lambda w: w <> '') AS w FROM documents),
    g AS (SELECT source, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT source, w, unnest(range(1, len(w))) AS i FROM w)),
    tf AS (SELECT source, phrase, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY phrase),
    s AS (SELECT source, tf.phrase, tf, df, tf * ln((SELECT count(DISTINCT source) FROM documents) / df) AS score FROM tf JOIN df ON tf.phrase = df.phrase),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, phrase) AS rank FROM s)
    SELECT source, rank, phrase, tf, df, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def signature_phrases(spark, sf):
    p = S.signature_phrases(wide_table(spark, sf, "documents", "doc_id", "source", "text"), "source")
    return p.withColumn("rank", F.col("rank").cast("bigint")).withColumn("score", F.round("score", 6))


def _grade_sql(c: str, low: float, high: float, names: tuple[str, str, str]) -> str:
    return f"CASE WHEN {c} < {low} THEN '{names[0]}' WHEN {c} < {high} THEN '{names[1]}' ELSE '{names[2]}' END"


def _lexicon_sql(kind: str) -> str:
    return f"count(*) FILTER (token IN ({_listed(S.LEXICON[kind])})) * 100 / count(*)"


_SUMMARY = (
    "Writes %s sentences of %s words on average, the longest with %s words, over %s messages. "
    "The vocabulary is %s: %s distinct words per word used, words of %s letters on average, and a share of %s long words. "
    "Statements are %s: hedges occur %s times, certain words %s times and direct words %s times per hundred words. "
    "Punctuation is %s, with %s marks per hundred words, %s questions, %s exclamations and %s list lines in total. "
    "Keep sentence length, word choice, directness and punctuation habits close to these figures when writing in this style."
)


@query(
    "rendered_summaries",
    f"""WITH s AS (SELECT role, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {words_sql('s')}), lambda n: n > 0) AS n FROM conversations),
    a AS (SELECT role, count(*) AS messages, sum(coalesce(list_sum(n), 0)) / sum(len(n)) AS avg_words, max(list_max(n)) AS max_words FROM s GROUP BY role),
    t AS {_TOKENS.format(by='role', src='conversations')},
    v AS (SELECT role, count(DISTINCT token) / count(*) AS ratio, sum(length(token)) / count(*) AS letters, count(*) FILTER (length(token) >= 7) / count(*) AS long,
          {_lexicon_sql('hedge')} AS hedge, {_lexicon_sql('certain')} AS certain, {_lexicon_sql('direct')} AS direct FROM t GROUP BY role),
    m AS (SELECT role, {', '.join(f'{_mark_sql(m)} AS {n}' for n, m in S.MARKS.items())}, len(regexp_extract_all(text, '(?m)^[ 	]*(?:[-*]|[0-9]+\\.)[ 	]')) AS list,
          {words_sql('text')} AS w FROM conversations),
    p AS (SELECT role, ({' + '.join(f'sum({n})' for n in S.MARKS)}) * 100 / sum(w) AS marks, sum(question)::BIGINT AS question, sum(exclamation)::BIGINT AS exclamation,
          sum(list)::BIGINT AS list FROM m GROUP BY role)
    SELECT role, messages, printf('{_SUMMARY}',
        {_grade_sql('avg_words', 8, 16, ('short', 'medium', 'long'))}, format('{{:,.1f}}', avg_words), format('{{:,}}', max_words), format('{{:,}}', messages),
        {_grade_sql('letters', 4, 6, ('plain', 'mixed', 'formal'))}, format('{{:,.2f}}', ratio), format('{{:,.1f}}', letters), format('{{:,.2f}}', long),
        {_grade_sql('hedge', 0.5, 2, ('direct', 'measured', 'hedged'))}, format('{{:,.1f}}', hedge), format('{{:,.1f}}', certain), format('{{:,.1f}}', direct),
        {_grade_sql('marks', 8, 16, ('sparse', 'regular', 'dense'))}, format('{{:,.1f}}', marks), format('{{:,}}', question), format('{{:,}}', exclamation), format('{{:,}}', list)) AS summary
    FROM a JOIN v USING (role) JOIN p USING (role)""",
)
def rendered_summaries(spark, sf):
    profile = S.style_profile(table(spark, sf, "conversations"), "role")
    return S.render_summary(profile).select("role", "messages", "summary")
