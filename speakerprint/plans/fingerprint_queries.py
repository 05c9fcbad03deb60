"""Hypervectors, seeds, identification and retrieval over the embeddings table.

Speaker = label, message order = vec_id; the first 70 % of a speaker train. SQL checks use 64
dimensions, ``speaker_fingerprints`` the full 10,000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.functions.mixing import MODULUS, coin_sql, mix_sql
from speakerprint.functions.vectors import bit_signs
from speakerprint.operators import basis as B
from speakerprint.operators import hypervectors as H
from speakerprint.operators import match as J
from speakerprint.operators.embed import EMBED_DIM, embed
from speakerprint.operators.hamming_index import build_index, pruning
from speakerprint.operators.messages import select_messages, split
from speakerprint.plans.catalog import query, table
from speakerprint.plans.registry_queries import REGISTRY_SQL, registry_rows
from speakerprint.session import materialised, shared_dir
from speakerprint.sources.fingerprints import read_fingerprints, write_fingerprints
from speakerprint.streaming.fingerprints import read_stream_fingerprints, stream_fingerprints

DIM = 64


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Train and held-out messages ``(label, vec_id, pos, embedding)``, split once."""
    rows = split(table(spark, sf, "embeddings"), "label", "vec_id").select("label", "vec_id", "pos", "part", "embedding")
    rows = materialised(rows, "split")
    return rows.where("part = 'train'").drop("part"), rows.where("part = 'heldout'").drop("part")


def train_center(train: DataFrame) -> H.Center:
    return H.shared_center(train)


def train_seeds(train: DataFrame, center: H.Center | None, dim: int = DIM, bind: str = "positional") -> DataFrame:
    """Seeds of the training messages; their split position already is the message index."""
    encoded = H.hv_encode(train.select("label", "pos", "embedding"), dim=dim, center=center)
    return H.hv_bundle(encoded, "label", "pos", dim, bind=bind, position="turn")


def as_candidates(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("label").alias("candidate"), F.col("label").alias("ord"), "bits")


def as_queries(heldout: DataFrame, center: H.Center | None, dim: int = DIM) -> DataFrame:
    coded = H.hv_query(heldout.select("vec_id", "label", "embedding"), center, dim=dim)
    return coded.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), "bits")


BASE_SQL = f"""
r AS (SELECT j, m, CASE WHEN {coin_sql('j', '(m + 42000000)', '//')} = 0 THEN 1 ELSE -1 END AS r
      FROM (SELECT range AS j FROM range(64)), (SELECT range AS m FROM range({DIM}))),
placed AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
x AS (SELECT vec_id, label, pos, pos < (n * 70) // 100 AS train, generate_subscripts(embedding, 1) - 1 AS j,
             CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000000) AS BIGINT) AS x FROM placed),
tc AS (SELECT j, sum(x)::BIGINT AS s, count(*) AS n FROM x WHERE train GROUP BY j),
h AS (SELECT x.vec_id, x.label, x.pos, x.train, r.m,
             CASE WHEN sum((tc.n * x.x - tc.s) * r.r) >= 0 THEN 1 ELSE -1 END AS h
      FROM x JOIN tc ON x.j = tc.j JOIN r ON x.j = r.j GROUP BY ALL),
tn AS (SELECT label, count(DISTINCT vec_id) AS n FROM h WHERE train GROUP BY label),
seed AS (SELECT h.label, (h.m + tn.n - 1 - h.pos) % {DIM} AS m, sum(h.h)::BIGINT AS acc FROM h JOIN tn ON h.label = tn.label
         WHERE h.train GROUP BY ALL),
score AS (SELECT h.vec_id AS query_id, h.label AS truth, seed.label AS candidate,
                 sum(h.h * CASE WHEN seed.acc >= 0 THEN 1 ELSE -1 END) / {DIM}.0 AS score
          FROM h JOIN seed ON h.m = seed.m WHERE NOT h.train GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) AS rank FROM score)"""
_SEED_COLUMNS = "label, m, acc, CASE WHEN acc >= 0 THEN 1 ELSE -1 END AS seed"


def _long_seeds(seeds: DataFrame, by: str = "label") -> DataFrame:
    both = F.arrays_zip(F.col("acc"), bit_signs("bits", DIM).alias("seed"))
    rows = seeds.select(by, F.posexplode(both).alias("m", "e"))
    return rows.select(by, F.col("m").cast("bigint").alias("m"), F.col("e.acc").alias("acc"), F.col("e.seed").alias("seed"))


@query(
    "message_hypervectors",
    f"""WITH {BASE_SQL}, ac AS (SELECT j, sum(x)::BIGINT AS s, count(*) AS n FROM x GROUP BY j)
    SELECT x.vec_id, r.m, CASE WHEN sum((ac.n * x.x - ac.s) * r.r) >= 0 THEN 1 ELSE -1 END AS h
    FROM x JOIN ac ON x.j = ac.j JOIN r ON x.j = r.j GROUP BY x.vec_id, r.m""",
)
def message_hypervectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    coded = H.hv_encode(rows, dim=DIM, center=H.shared_center(rows))
    signs = coded.select("vec_id", F.posexplode(bit_signs("bits", DIM)).alias("m", "h"))
    return signs.select("vec_id", F.col("m").cast("bigint").alias("m"), "h")


@query("query_hypervectors", f"WITH {BASE_SQL} SELECT vec_id AS query_id, label AS truth, m, h FROM h WHERE NOT train")
def query_hypervectors(spark, sf):
    train, heldout = parts(spark, sf)
    coded = as_queries(heldout, train_center(train))
    signs = coded.select("query_id", "truth", F.posexplode(bit_signs("bits", DIM)).alias("m", "h"))
    return signs.withColumn("m", F.col("m").cast("bigint"))


@query("speaker_seed_positional", f"WITH {BASE_SQL} SELECT {_SEED_COLUMNS} FROM seed")
def speaker_seed_positional(spark, sf):
    train, _ = parts(spark, sf)
    return _long_seeds(train_seeds(train, train_center(train)))


@query(
    "speaker_seed_bag",
    f"WITH {BASE_SQL}, bag AS (SELECT label, m, sum(h)::BIGINT AS acc FROM h WHERE train GROUP BY label, m) SELECT {_SEED_COLUMNS} FROM bag",
)
def speaker_seed_bag(spark, sf):
    train, _ = parts(spark, sf)
    return _long_seeds(train_seeds(train, train_center(train), bind="bag"))


@query(
    "speaker_seed_own_center",
    f"""WITH {BASE_SQL}, sc AS (SELECT label, j, sum(x)::BIGINT AS s, count(*) AS n FROM x GROUP BY label, j),
    o AS (SELECT x.label, x.vec_id, x.pos, r.m, CASE WHEN sum((sc.n * x.x - sc.s) * r.r) >= 0 THEN 1 ELSE -1 END AS h
          FROM x JOIN sc ON x.label = sc.label AND x.j = sc.j JOIN r ON x.j = r.j GROUP BY ALL),
    on_ AS (SELECT label, count(DISTINCT vec_id) AS n FROM o GROUP BY label),
    own AS (SELECT o.label, (o.m + on_.n - 1 - o.pos) % {DIM} AS m, sum(o.h)::BIGINT AS acc
            FROM o JOIN on_ ON o.label = on_.label GROUP BY ALL)
    SELECT {_SEED_COLUMNS} FROM own""",
)
def speaker_seed_own_center(spark, sf):
    return _long_seeds(H.fingerprints(table(spark, sf, "embeddings"), "label", "vec_id", dim=DIM, center="speaker"))


@query("composed_seeds", f"WITH {BASE_SQL} SELECT {_SEED_COLUMNS} FROM seed")
def composed_seeds(spark, sf):
    train, _ = parts(spark, sf)
    coded = H.hv_encode(train.select("label", "pos", "embedding"), dim=DIM, center=train_center(train))
    chunked = coded.withColumn("chunk", F.expr("pos div 8")).withColumn("inner", F.expr("pos % 8"))
    chunks = H.hv_bundle(chunked, ["label", "chunk"], "inner", DIM, position="turn")
    return _long_seeds(H.hv_compose(chunks, "label", "chunk", DIM))


@query("stream_seeds", f"WITH {BASE_SQL} SELECT {_SEED_COLUMNS} FROM seed")
def stream_seeds(spark, sf):
    train, _ = parts(spark, sf)
    center = train_center(train)
    folder = shared_dir(spark, "stream-seeds")
    rows = train.select("label", "pos", "embedding")
    rows.write.parquet(f"{folder}/messages")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/messages")
    writer = stream_fingerprints(stream, f"{folder}/partials", f"{folder}/checkpoint", "label", "pos", dim=DIM, center=center)
    writer.trigger(availableNow=True).start().awaitTermination()
    return _long_seeds(read_stream_fingerprints(spark, f"{folder}/partials", "label", DIM))


@query(
    "identify_top1",
    f"WITH {BASE_SQL} SELECT query_id, truth, candidate, score, truth = candidate AS correct FROM ranked WHERE rank = 1",
)
def identify_top1(spark, sf):
    train, heldout = parts(spark, sf)
    center = train_center(train)
    won = J.identify(as_queries(heldout, center), as_candidates(train_seeds(train, center)), DIM)
    return won.select("query_id", "truth", "candidate", "score", (F.col("truth") == F.col("candidate")).alias("correct"))


@query("candidate_ranking", f"WITH {BASE_SQL} SELECT query_id, candidate, score, rank FROM ranked")
def candidate_ranking(spark, sf):
    train, heldout = parts(spark, sf)
    center = train_center(train)
    hits = J.rank_candidates(as_queries(heldout, center), as_candidates(train_seeds(train, center)), DIM)
    return hits.select("query_id", "candidate", "score", F.col("rank").cast("bigint").alias("rank"))


@query("retrieve_topk", f"WITH {BASE_SQL} SELECT query_id, candidate, score, rank FROM ranked WHERE rank <= 3 AND score > 0.1")
def retrieve_topk(spark, sf):
    train, heldout = parts(spark, sf)
    center = train_center(train)
    hits = J.retrieve(as_queries(heldout, center), as_candidates(train_seeds(train, center)), 3, 0.1, DIM)
    return hits.select("query_id", "candidate", "score", F.col("rank").cast("bigint").alias("rank"))


@query("retrieve_topk_blocks", f"WITH {BASE_SQL} SELECT query_id, candidate, score, rank FROM ranked WHERE rank <= 3 AND score > 0.1")
def retrieve_topk_blocks(spark, sf):
    """The same retrieval when the candidates are too many to broadcast."""
    train, heldout = parts(spark, sf)
    center = train_center(train)
    hits = J.retrieve(as_queries(heldout, center), as_candidates(train_seeds(train, center)), 3, 0.1, DIM, broadcast_limit=4)
    return hits.select("query_id", "candidate", "score", F.col("rank").cast("bigint").alias("rank"))


#: Rows of the sign matrix as lists, at the full width.
FULL_SQL = f"""
r AS (SELECT m, list(CASE WHEN {coin_sql('j', '(m + 42000000)', '//')} = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY j) AS r
      FROM (SELECT range AS j FROM range(64)), (SELECT range AS m FROM range({H.HV_DIM})) GROUP BY m)"""


@query(
    "speaker_fingerprints",
    f"""WITH {FULL_SQL},
    x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000000) AS BIGINT) AS x
          FROM embeddings),
    tc AS (SELECT j, sum(x)::BIGINT AS s, count(*) AS n FROM x GROUP BY j),
    v AS (SELECT vec_id, label, list((tc.n * x.x - tc.s)::DOUBLE ORDER BY x.j) AS v FROM x JOIN tc ON x.j = tc.j GROUP BY vec_id, label),
    p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM v),
    seed AS (SELECT label, n, (m + n - 1 - pos) % {H.HV_DIM} AS m, sum(CASE WHEN list_dot_product(v, r) >= 0 THEN 1 ELSE -1 END) AS acc
             FROM p, r GROUP BY ALL),
    w AS (SELECT label, n, m // 64 AS w, sum(CASE WHEN acc >= 0 THEN 1 ELSE 0 END) AS ones,
                 sum(CASE WHEN acc >= 0 THEN (1::HUGEINT << (m % 64)::INT) ELSE 0 END)::HUGEINT AS v FROM seed GROUP BY ALL)
    SELECT label, n, false AS degenerate, sum(ones)::INT AS ones,
           sha256(string_agg((CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::VARCHAR, ',' ORDER BY w)) AS digest
    FROM w GROUP BY label, n""",
)
def speaker_fingerprints(spark, sf):
    """Full-size fingerprints: seed of every speaker at 10,000 dimensions with its count of +1."""
    seeds = H.fingerprints(table(spark, sf, "embeddings"), "label", "vec_id")
    ones = F.aggregate("bits", F.lit(0), lambda s, w: s + F.bit_count(w))
    return seeds.select("label", "n", "degenerate", ones.alias("ones"), F.sha2(F.concat_ws(",", F.col("bits").cast("array<string>")), 256).alias("digest"))


@query(
    "conversation_fingerprints",
    f"""WITH {FULL_SQL.replace('range(64)', f'range({EMBED_DIM})')},
    u AS (SELECT conv_id, turn, lower(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n
          FROM conversations WHERE role = 'user'),
    c AS (SELECT conv_id, turn, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ''), lambda x: unicode(x)) END AS c FROM u),
    f AS (SELECT conv_id, turn, CASE len(c) WHEN 1 THEN c || [0, 0] WHEN 2 THEN c || [0] ELSE c END AS c FROM c),
    g AS (SELECT conv_id, turn, c, unnest(range(1, len(c) - 1)) AS i FROM f),
    k AS (SELECT conv_id, turn, (c[i] * 1114112::BIGINT + c[i + 1]) % {MODULUS} AS a, c[i + 2] AS b FROM g),
    tf AS (SELECT conv_id, turn, {mix_sql('a', 'b')} % {EMBED_DIM} AS j, count(*) AS tf FROM k GROUP BY ALL),
    idf AS (SELECT j, round(ln(((SELECT count(*) FROM u) + 1)::DOUBLE / (count(*) + 1)), 6) AS idf FROM tf GROUP BY j),
    w AS (SELECT conv_id, turn, tf.j, CAST(round(CAST(CAST(tf * idf AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT) AS x FROM tf JOIN idf ON tf.j = idf.j),
    tc AS (SELECT j, sum(x)::BIGINT AS s FROM w GROUP BY j),
    d AS (SELECT u.conv_id, u.turn, u.pos, u.n, a.j, coalesce(w.x, 0) AS x, coalesce(tc.s, 0) AS s FROM u CROSS JOIN (SELECT range AS j FROM range({EMBED_DIM})) a
          LEFT JOIN w ON w.conv_id = u.conv_id AND w.turn = u.turn AND w.j = a.j LEFT JOIN tc ON tc.j = a.j),
    v AS (SELECT conv_id, turn, pos, n, list(((SELECT count(*) FROM u) * x - s)::DOUBLE ORDER BY j) AS v FROM d GROUP BY ALL),
    seed AS (SELECT conv_id, n, (m + n - 1 - pos) % {H.HV_DIM} AS m, sum(CASE WHEN list_dot_product(v, r) >= 0 THEN 1 ELSE -1 END) AS acc FROM v, r GROUP BY ALL)
    SELECT conv_id, n, (count(*) FILTER (acc >= 0))::INT AS ones FROM seed GROUP BY conv_id, n""",
)
def conversation_fingerprints(spark, sf):
    """From text to fingerprint: user messages, hashed n-gram vectors, a seed per conversation."""
    users = select_messages(table(spark, sf, "conversations")).select("conv_id", "turn", "text")
    vectors = materialised(embed(users, "hash").select("conv_id", "turn", "embedding"), "vectors")
    seeds = H.fingerprints(vectors, "conv_id", "turn", keep_acc=False)
    ones = F.aggregate("bits", F.lit(0), lambda s, w: s + F.bit_count(w))
    return seeds.select("conv_id", "n", ones.alias("ones"))


@query("stored_fingerprints", f"WITH {BASE_SQL} SELECT {_SEED_COLUMNS} FROM seed")
def stored_fingerprints(spark, sf):
    """Seeds written to a fingerprint table and read back."""
    train, _ = parts(spark, sf)
    path = shared_dir(spark, "fingerprints")
    write_fingerprints(train_seeds(train, train_center(train)), path)
    return _long_seeds(read_fingerprints(spark, path, "identity", ["label", "acc", "bits"]))


#: Planted copies: every message blended into the message that leads its fifty, as candidates of 10,000 dimensions. The
#: leaders (every id divisible by 50) are the queries.
LEADERS = 50
PLANTED_SQL = f"""{FULL_SQL},
c AS (SELECT e.vec_id, generate_subscripts(e.embedding, 1) - 1 AS j,
             CAST(round((0.9 * CAST(unnest(coalesce(b.embedding, e.embedding)) AS DOUBLE) + 0.1 * CAST(unnest(e.embedding) AS DOUBLE)) * 1000000) AS BIGINT) AS x
      FROM embeddings e LEFT JOIN embeddings b ON b.vec_id = e.vec_id - e.vec_id % {LEADERS}),
q AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000000) AS BIGINT) AS x
      FROM embeddings WHERE vec_id % {LEADERS} = 0),
tc AS (SELECT j, sum(x)::BIGINT AS s, count(*) AS n FROM c GROUP BY j),
cv AS (SELECT vec_id, list((tc.n * c.x - tc.s)::DOUBLE ORDER BY c.j) AS v FROM c JOIN tc ON c.j = tc.j GROUP BY vec_id),
qv AS (SELECT vec_id, list((tc.n * q.x - tc.s)::DOUBLE ORDER BY q.j) AS v FROM q JOIN tc ON q.j = tc.j GROUP BY vec_id),
cb AS (SELECT vec_id, string_agg(CASE WHEN list_dot_product(v, r) >= 0 THEN '1' ELSE '0' END, '' ORDER BY m)::BIT AS b FROM cv, r GROUP BY vec_id),
qb AS (SELECT vec_id, string_agg(CASE WHEN list_dot_product(v, r) >= 0 THEN '1' ELSE '0' END, '' ORDER BY m)::BIT AS b FROM qv, r GROUP BY vec_id),
score AS (SELECT qb.vec_id AS query_id, cb.vec_id AS candidate, ({H.HV_DIM} - 2 * bit_count(xor(qb.b, cb.b))) / {H.HV_DIM}.0 AS score FROM qb, cb),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) AS rank FROM score)"""


def planted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, bits) and candidates (candidate, ord, bits) at the full width, encoded once."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    lead = rows.select(F.col("vec_id").alias("lead"), F.col("embedding").alias("leader"))
    own, led = F.col("embedding").cast("array<double>"), F.coalesce("leader", "embedding").cast("array<double>")
    both = rows.join(lead, F.col("lead") == F.col("vec_id") - F.col("vec_id") % LEADERS, "left")
    copies = both.select("vec_id", F.zip_with(led, own, lambda c, x: F.lit(0.9) * c + F.lit(0.1) * x).alias("embedding"))
    center = H.shared_center(copies)
    queries = H.hv_encode(rows.where(F.col("vec_id") % LEADERS == 0), center=center).select(F.col("vec_id").alias("query_id"), "bits")
    coded = materialised(H.hv_encode(copies, center=center), "planted")
    return queries, coded.select(F.col("vec_id").alias("candidate"), F.col("vec_id").alias("ord"), "bits")


@query("retrieve_banded", f"WITH {PLANTED_SQL} SELECT query_id, candidate, score, rank FROM ranked WHERE rank <= 10 AND score > 0.75")
def retrieve_banded(spark, sf):
    """Banded retrieval at 10,000 dimensions, 64 bands over the whole width: copies differ from their leader in 4 % of the bits, so that none is missed."""
    queries, candidates = planted(spark, sf)
    hits = J.retrieve(queries, candidates, 10, 0.75, method="banded")
    return hits.select("query_id", "candidate", "score", F.col("rank").cast("bigint").alias("rank"))


@query("retrieve_pruned", f"WITH {PLANTED_SQL} SELECT query_id, candidate, score, rank FROM ranked WHERE rank <= 60 AND score > 0.75")
def retrieve_pruned(spark, sf):
    """Exact retrieval at 10,000 dimensions through the metric index: all copies of every leader."""
    queries, candidates = planted(spark, sf)
    hits = J.retrieve(queries, candidates, 60, 0.75, method="pruned")
    return hits.select("query_id", "candidate", "score", F.col("rank").cast("bigint").alias("rank"))


@query("identify_pruned", f"WITH {PLANTED_SQL} SELECT query_id, candidate, score FROM ranked WHERE rank = 1")
def identify_pruned(spark, sf):
    """The closest candidate of every leader, without a threshold, through the metric index."""
    queries, candidates = planted(spark, sf)
    return J.identify(queries, candidates, method="pruned").select("query_id", "candidate", "score")


@query(
    "retrieval_pruning",
    f"""SELECT vec_id AS query_id, (SELECT count(*) FROM embeddings) AS candidates, true AS half_skipped FROM embeddings WHERE vec_id % {LEADERS} = 0""",
)
def retrieval_pruning(spark, sf):
    """Whether the index spares a query at least half of all comparisons."""
    queries, candidates = planted(spark, sf)
    seen = pruning(queries, build_index(candidates), 60, 0.75)
    return seen.select("query_id", "candidates", (2 * F.col("compared") <= F.col("candidates")).alias("half_skipped"))


_MEMBERS = f"""reg AS ({REGISTRY_SQL}),
best AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY success_score DESC, created_at DESC, id) AS member
         FROM reg WHERE success_score >= 0.8)"""


@query(
    "consensus_selection",
    f"WITH {_MEMBERS} SELECT task_type, id, success_score, member FROM best WHERE member <= 5",
)
def consensus_selection(spark, sf):
    members = H.consensus_members(registry_rows(spark, sf))
    return members.select("task_type", "id", "success_score", F.col("member").cast("bigint").alias("member"))


@query(
    "consensus_seed",
    f"""WITH {BASE_SQL},
    v AS (SELECT x.vec_id, r.m, CASE WHEN sum(x.x * r.r) >= 0 THEN 1 ELSE -1 END AS h FROM x JOIN r ON x.j = r.j GROUP BY ALL),
    reg AS ({REGISTRY_SQL}),
    best AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY success_score DESC, created_at DESC, id) AS member
             FROM reg WHERE success_score >= 0.8 AND id IN (SELECT vec_id FROM embeddings))
    SELECT task_type, v.m, count(*) AS members,
           CASE WHEN sum(v.h * CAST(round(success_score * 1000000) AS BIGINT)) >= 0 THEN 1 ELSE -1 END AS seed
    FROM best JOIN v ON best.id = v.vec_id WHERE member <= 5 GROUP BY task_type, v.m""",
)
def consensus_seed(spark, sf):
    vectors = H.hv_encode(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), dim=DIM)
    merged = H.hv_merge(registry_rows(spark, sf).join(vectors, "id"), DIM)
    signs = merged.select("task_type", "members", F.posexplode(bit_signs("bits", DIM)).alias("m", "seed"))
    return signs.withColumn("m", F.col("m").cast("bigint"))


@query(
    "speaker_centroids",
    """WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim,
        CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000000) AS BIGINT) AS q FROM embeddings),
    s AS (SELECT label, dim, count(*) AS n, sum(q)::HUGEINT AS s, sum(q * q)::HUGEINT AS ss FROM x GROUP BY label, dim)
    SELECT label, dim, n, round(s::DOUBLE / n / 1000000, 6) AS mean,
           round((n * ss - s * s)::DOUBLE / (n::DOUBLE * n) / 1e12, 6) AS var FROM s""",
)
def speaker_centroids(spark, sf):
    stats = B.speaker_stats(table(spark, sf, "embeddings"), "label")
    return stats.select("label", "dim", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("speaker_bases")
def speaker_bases(spark, sf):
    bases = B.fit_speaker_bases(table(spark, sf, "embeddings"), "label", "vec_id")
    return bases.select("label", "n", "d", "k", F.round(B.variance_k("evr", 4), 6).alias("variance_k4"), "degenerate")


@query("projected_messages")
def projected_messages(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    shared = B.project(rows, B.fit_shared_basis(rows, k=4))
    return shared.select("vec_id", "label", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query("projected_by_speaker")
def projected_by_speaker(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    bases = B.fit_speaker_bases(rows, "label", "vec_id", k=4)
    own = B.project_by_speaker(rows, bases, "label", "vec_id")
    return own.select("vec_id", "label", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


# Vectors of two dimensions, where components have a closed form: l is the larger eigenvalue of [[a, b], [b, c]], (b, l - a) its direction.
_PLANE = """p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""


def _plane_sql(keys: str) -> str:
    over = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""{_PLANE}, m AS (SELECT {head}count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p {over}),
    s AS (SELECT {'p.' + keys + ', ' if keys else ''}any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) ** 2) AS a, sum((x - mx) * (y - my)) AS b,
          sum((y - my) ** 2) AS c FROM p {'JOIN m USING (' + keys + ')' if keys else ', m'} {'GROUP BY p.' + keys if keys else ''}),
    l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l FROM s),
    u AS (SELECT *, b / sqrt(b * b + (l - a) ** 2) AS u, (l - a) / sqrt(b * b + (l - a) ** 2) AS v FROM l),
    d AS (SELECT *, CASE WHEN greatest(abs(u), abs(v)) = abs(u) THEN sign(u) ELSE sign(v) END AS s1,
                 CASE WHEN greatest(abs(u), abs(v)) = abs(u) THEN sign(u) ELSE -sign(v) END AS s2 FROM u)"""


_PROJECTED = "vec_id, label, round(s1 * ((x - mx) * u + (y - my) * v), 6) AS p1, round(s2 * ((y - my) * u - (x - mx) * v), 6) AS p2"


def plane(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 2).alias("embedding"))


@query("plane_bases", f"WITH {_plane_sql('label')} SELECT label, n, 2 AS k, round(l / (a + c), 6) AS variance_1, round(mx, 6) AS mean_x, round(s1 * u, 6) AS first_x, round(s1 * v, 6) AS first_y FROM d")
def plane_bases(spark, sf):
    """A basis per speaker of two-dimensional vectors: mean, first component, its share of the variance."""
    bases = B.fit_speaker_bases(plane(spark, sf), "label", "vec_id")
    first = F.flatten("components") if bases.schema["components"].dataType.elementType.simpleString() != "double" else F.col("components")
    return bases.select(
        "label", "n", "k", F.round(B.variance_k("evr", 1), 6).alias("variance_1"), F.round(F.col("mean")[0], 6).alias("mean_x"),
        F.round(first[0], 6).alias("first_x"), F.round(first[1], 6).alias("first_y"),
    )


@query("plane_projected", f"WITH {_plane_sql('')} SELECT {_PROJECTED} FROM p, d")
def plane_projected(spark, sf):
    """All messages in one shared basis."""
    rows = plane(spark, sf)
    out = B.project(rows, B.fit_shared_basis(rows))
    return out.select("vec_id", "label", F.round(F.col("projected")[0], 6).alias("p1"), F.round(F.col("projected")[1], 6).alias("p2"))


@query("plane_projected_by_speaker", f"WITH {_plane_sql('label')} SELECT {_PROJECTED} FROM p JOIN d USING (label)")
def plane_projected_by_speaker(spark, sf):
    rows = plane(spark, sf)
    out = B.project_by_speaker(rows, B.fit_speaker_bases(rows, "label", "vec_id"), "label", "vec_id")
    return out.select("vec_id", "label", F.round(F.col("projected")[0], 6).alias("p1"), F.round(F.col("projected")[1], 6).alias("p2"))


@query(
    "projection_lengths",
    """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    m AS (SELECT j, avg(x) AS m FROM x GROUP BY j), l AS (SELECT label, j, avg(x) AS m FROM x GROUP BY label, j)
    SELECT vec_id, round(sum((x - m.m) ** 2), 6) AS shared, round(sum((x - l.m) ** 2), 6) AS own FROM x JOIN m USING (j) JOIN l USING (label, j) GROUP BY vec_id""",
)
def projection_lengths(spark, sf):
    """Whole bases keep distances from the mean: squared lengths of all messages in the shared basis and in their speaker's."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")

    def length(df: DataFrame, name: str) -> DataFrame:
        return df.select("vec_id", F.round(F.aggregate("projected", F.lit(0.0), lambda s, x: s + x * x), 6).alias(name))

    shared = length(B.project(rows, B.fit_shared_basis(rows)), "shared")
    own = length(B.project_by_speaker(rows, B.fit_speaker_bases(rows, "label", "vec_id"), "label", "vec_id"), "own")
    return shared.join(own, "vec_id")
