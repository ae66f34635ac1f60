"""Search, scoring, ranking and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions import vector as V
from tidemark.operators import graph, rank, search
from tidemark.plans import recall as R
from tidemark.registry import query

ids = lambda c: F.col(c).cast("string")
r6 = lambda c: F.round(c, 6)
#: Edges, of two numbers each, that may be sent to every task.
EDGES = 1_000_000


@query("SELECT query_id, chunk_id, memory_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM knn) WHERE rank <= 10")
def knn_cosine_top10(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest(X.query_vectors(spark, sf), X.chunks(spark, sf), 10)


@query("SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM lexical) WHERE k <= 10")
def fts_or_rank(spark: SparkSession, sf: str) -> DataFrame:
    return search.lexical(X.queries(spark, sf), X.searched(spark, sf), 10)


@query("SELECT term, count(*) AS df, round(sum(weight), 4) AS weight FROM postings GROUP BY term")
def postings_summary(spark: SparkSession, sf: str) -> DataFrame:
    return X.index(spark, sf).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("weight"), 4).alias("weight"))


@query("SELECT query_id, memory_id AS id, chunk_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, memory_id ORDER BY cosine DESC, chunk_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM knn) WHERE r <= 30) WHERE k = 1")
def best_hit_per_record(spark: SparkSession, sf: str) -> DataFrame:
    return search.best_hits(search.nearest(X.query_vectors(spark, sf), X.chunks(spark, sf), 30))


@query("""SELECT cluster_id, pos, round(avg(x), 6) AS value FROM (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM chunks) GROUP BY ALL""")
def centroid_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return V.centroids(X.chunks(spark, sf), ["cluster_id"]).select("cluster_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query("""SELECT cluster_id, count(*) AS pairs, round(avg(c), 6) AS mean_cosine FROM (
  SELECT a.cluster_id, list_cosine_similarity(a.embedding, b.embedding) AS c FROM chunks a JOIN chunks b ON a.cluster_id = b.cluster_id AND a.chunk_id < b.chunk_id) GROUP BY cluster_id""")
def pairwise_mean_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over all pairs follows from the length of the sum of unit vectors, so no pair is formed."""
    unit = X.chunks(spark, sf).select("cluster_id", V.normalised(F.col("embedding")).alias("u"))
    n = unit.groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = unit.select("cluster_id", F.posexplode("u").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.sum("x").alias("s")).groupBy("cluster_id").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return total.join(n, "cluster_id").where("n > 1").select("cluster_id", pairs.cast("long").alias("pairs"), r6((F.col("sq") - F.col("n")) / 2 / pairs).alias("mean_cosine"))


_CELLS = """WITH cent AS (SELECT cluster_id, list(value ORDER BY pos) AS centroid FROM (SELECT cluster_id, pos, avg(x) AS value FROM (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM chunks) GROUP BY ALL) GROUP BY cluster_id),
cells AS (SELECT query_id, vector, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector, centroid), 6) DESC, cluster_id) AS k FROM qvectors, cent)"""


@query(_CELLS + """ SELECT query_id, chunk_id, cosine, rank FROM (SELECT query_id, chunk_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(list_cosine_similarity(vector, embedding), 6) AS cosine FROM cells JOIN chunks USING (cluster_id) WHERE k <= 3)) WHERE rank <= 10""")
def cluster_pruned_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest three clusters by centroid, then nearest chunks of those: pairs within a cluster in place of all."""
    chunks, q = X.chunks(spark, sf), X.query_vectors(spark, sf)
    centroids = V.gathered(V.centroids(chunks, ["cluster_id"]), ["cluster_id"]).select(F.col("cluster_id").alias("chunk_id"), F.col("cluster_id").alias("memory_id"), F.col("centroid").alias("embedding"))
    cells = search.nearest(q, centroids, 3).select("query_id", F.col("memory_id").alias("cell")).join(q, "query_id")
    return search.nearest(cells, chunks.withColumn("cell", F.col("cluster_id")), 10).drop("memory_id")


_ASKS = ("", "when was ", "where are the current ", "what would I prefer of ")
_LEGS = f"""WITH rq AS (SELECT id AS query_id, [{', '.join(f"'{x}'" for x in _ASKS)}][CAST(id // 20 % 4 + 1 AS INTEGER)] || array_to_string(string_split(content, ' ')[1:12], ' ') AS text, id // 50 AS episode FROM records WHERE id % 20 = 0),
rt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM rq) WHERE term <> ''),
rlex AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM rt JOIN postings USING (term) GROUP BY ALL),
vq AS (SELECT query_id, memory_id AS id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id) AS vr FROM knn WHERE query_id IN (SELECT query_id FROM rq) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) <= 30),
x AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS xr FROM rlex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30),
xn AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS lexical, xr FROM x),
c AS (SELECT query_id, id, coalesce(cosine, 0) AS cosine, coalesce(lexical, 0) AS lexical, vr, xr FROM vq FULL JOIN xn USING (query_id, id)),
f AS (SELECT c.*, importance, retrieval_precision, coalesce(valid_from, last_accessed) AS stamp FROM c JOIN records USING (id) WHERE valid_to IS NULL)"""
_BOOST = "greatest(0.1, 5.0 - importance) / 3"
_TIMED = f"exp(-0.01 * greatest(0, epoch(TIMESTAMP '{X.NOW}' - stamp) / 3600.0::DOUBLE))"
_PLACED = "CASE WHEN count(*) OVER q = 1 THEN 1.0 WHEN max(epoch(stamp)) OVER q = min(epoch(stamp)) OVER q THEN 0.5 ELSE (epoch(stamp) - min(epoch(stamp)) OVER q) / nullif(max(epoch(stamp)) OVER q - min(epoch(stamp)) OVER q, 0) END"


def _recall_sql(recency: str, score: str) -> str:
    return _LEGS + f""", s AS (SELECT *, {recency} AS rec FROM f WINDOW q AS (PARTITION BY query_id)),
t AS (SELECT query_id, id, round({score}, 6) AS score, round(cosine, 6) AS cosine, round(lexical, 6) AS lexical, round(rec, 6) AS recency FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 10"""


def _weighted(w: S.Weights) -> str:
    return f"({w.vector} * cosine + {w.lexical} * lexical + {w.recency} * rec + {w.precision} * coalesce(retrieval_precision, 0.5)) * {_BOOST}"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with id divisible by 20 asks with its first twelve words, opened in four ways, and its own vector, where it has one."""
    start = F.element_at(F.array(*map(F.lit, _ASKS)), (F.floor(F.col("id") / 20) % 4 + 1).cast("int"))
    q = X.records(spark, sf).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(start, F.array_join(F.slice(F.split("content", " "), 1, 12), " ")).alias("text"), F.floor(F.col("id") / 50).alias("episode"))
    return q.join(X.query_vectors(spark, sf), "query_id", "left")


def _recall(spark: SparkSession, sf: str, weights: S.Weights = S.DEFAULT, fusion: str = "weighted") -> DataFrame:
    q = _asked(spark, sf)
    return R.recall(q, X.records(spark, sf), X.chunks(spark, sf), X.searched(spark, sf), X.now(), weights=weights, fusion=fusion)


@query(_recall_sql(_TIMED, _weighted(S.DEFAULT)))
def hybrid_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf)


@query(_recall_sql(_TIMED, _weighted(S.UPDATE)))
def recall_update_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, S.UPDATE)


@query(_recall_sql(_PLACED, _weighted(S.TEMPORAL)))
def composite_temporal_ranknorm(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, S.TEMPORAL, "rank")


@query(_recall_sql(_TIMED, f"((coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + xr), 0)) * 61 / 2 * 0.7 + 0.15 * rec + 0.15 * coalesce(retrieval_precision, 0.5)) * {_BOOST}"))
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, fusion="rrf")


_WANTS = lambda words: f"list_has_any(toks, [{', '.join(f'{chr(39)}{w}{chr(39)}' for w in words)}])"
_PAIRS = "list_filter(list_transform(range(1, len(ws)), lambda i: CASE WHEN regexp_matches(ws[i], '^[A-Z]') AND regexp_matches(ws[i + 1], '^[A-Z]') THEN [lower(ws[i]), lower(ws[i + 1])] END), lambda p: p IS NOT NULL)"


def _composed_sql(score: str, preference: float) -> str:
    pick = lambda k: f"CASE WHEN temporal THEN {getattr(S.TEMPORAL, k)}::DOUBLE WHEN updates THEN {getattr(S.UPDATE, k)} ELSE {getattr(S.DEFAULT, k)} END"
    return _LEGS + f""", qi AS (SELECT *, {_WANTS(T.TEMPORAL)} AS temporal, {_WANTS(T.UPDATE)} AS updates, {_WANTS(T.PREFERENCE_QUERY)} AS prefers, list_filter(toks, lambda w: w <> '' AND w NOT IN ({', '.join(f"'{w}'" for w in T.NO_TOPIC)})) AS anchors, {_PAIRS} AS pairs, list_concat(regexp_extract_all(text, '{T.URL}'), regexp_extract_all(text, '{T.PHONE}')) AS exact
  FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS toks, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS ws FROM rq)),
m AS (SELECT f.*, q.*, d.content, d.tags, d.id // 50 = q.episode AS by_episode, prefers AND memory_type = 'preference' AS by_preference FROM f JOIN qi q USING (query_id) JOIN (SELECT id, content, tags, memory_type FROM records) d USING (id)),
b AS (SELECT *, by_preference AND len(list_filter(anchors, lambda w: contains(lower(content), w))) > 0 AS by_anchor, len(list_filter(exact, lambda w: contains(content, w))) > 0 OR len(list_filter(pairs, lambda p: contains(lower(content), p[1] || ' ' || p[2]) OR contains(lower(content), p[2] || ' ' || p[1]))) > 0 AS by_identifier FROM m),
s AS (SELECT *, CASE WHEN temporal THEN {_PLACED} ELSE {_TIMED} END AS rec, {pick('vector')} AS wv, {pick('lexical')} AS wx, {pick('recency')} AS wr, {pick('precision')} AS wp FROM b WINDOW q AS (PARTITION BY query_id)),
t AS (SELECT query_id, id, by_episode, by_preference, by_anchor, by_identifier, substr(list_filter(tags, lambda t: starts_with(t, 'sid:'))[1], 5) AS session, round((({score} + wr * rec + wp * coalesce(retrieval_precision, 0.5)) * CASE WHEN by_episode THEN {S.EPISODE} ELSE 1 END * CASE WHEN by_preference THEN {preference} ELSE 1 END * CASE WHEN by_anchor THEN {S.ANCHOR} ELSE 1 END + CASE WHEN by_identifier THEN {S.IDENTIFIER} ELSE 0 END) * {_BOOST}, 6) AS score FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, id) AS k, (SELECT count(DISTINCT session) FROM t o WHERE o.query_id = t.query_id) AS sessions FROM t)
SELECT query_id, id, score, session, by_episode, by_preference, by_anchor, by_identifier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u WHERE k <= 2 OR sessions < 2) WHERE rank <= 10"""


def _composed(spark: SparkSession, sf: str, fusion: str = "weighted") -> DataFrame:
    q = _asked(spark, sf)
    r = X.records(spark, sf).withColumn("episode", F.floor(F.col("id") / 50))
    return R.composed(q, r, X.chunks(spark, sf), X.searched(spark, sf), X.now(), fusion=fusion)


@query(_composed_sql("wv * cosine + wx * lexical", S.PREFERENCE))
def composed_recall(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of a recall: weights by intent, both legs, boosts of what matches, sessions of at most two results."""
    return _composed(spark, sf)


@query(_composed_sql("(coalesce(1.0 / (60 + vr), 0) + coalesce(1.0 / (60 + xr), 0)) * 61 / 2 * (wv + wx)", S.PREFERENCE_RRF))
def composed_recall_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _composed(spark, sf, "rrf")


@query(f"SELECT id, round(exp(-0.01 * epoch(TIMESTAMP '{X.NOW}' - last_accessed) / 3600.0::DOUBLE), 6) AS recency, round({_BOOST}, 6) AS boost, round(greatest(0.1, dynamic_importance), 6) AS dynamic_boost FROM records")
def recency_and_importance(spark: SparkSession, sf: str) -> DataFrame:
    hours = (F.unix_timestamp(X.now().cast("timestamp")) - F.unix_timestamp(F.col("last_accessed").cast("timestamp"))) / 3600.0
    return X.records(spark, sf).select("id", r6(S.recency(hours)).alias("recency"), r6(S.importance_boost(F.col("importance"))).alias("boost"), r6(S.importance_boost(F.col("importance"), F.col("dynamic_importance"))).alias("dynamic_boost"))


_RESULTS = """WITH res AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30),
det AS (SELECT res.*, content, summary, tags, memory_type, substr(list_filter(tags, lambda t: starts_with(t, 'sid:'))[1], 5) AS session FROM res JOIN records USING (id))"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    r = X.records(spark, sf)
    hits = rank.ranked(search.lexical(X.queries(spark, sf), X.searched(spark, sf), 30), k=30)
    return hits.join(r.select("id", "content", "summary", "tags", "memory_type"), "id").withColumn("session", rank.session_of(F.col("tags")))


@query(_RESULTS + """ SELECT query_id, session, round(sum(score / log2(k + 1)), 6) AS dcg, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, id) AS k FROM det) GROUP BY ALL""")
def session_dcg(spark: SparkSession, sf: str) -> DataFrame:
    return rank.session_dcg(_results(spark, sf).withColumn("cosine", F.col("score"))).withColumn("dcg", r6("dcg"))


@query(_RESULTS + """ SELECT query_id, id, session, rank FROM (SELECT query_id, id, session, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, id) AS k, (SELECT count(DISTINCT session) FROM det d WHERE d.query_id = det.query_id) AS s FROM det) WHERE k <= 2 OR s < 2) WHERE rank <= 10""")
def session_cap(spark: SparkSession, sf: str) -> DataFrame:
    return rank.session_capped(_results(spark, sf), 2, 10).select("query_id", "id", "session", "rank")


@query(_RESULTS + """ SELECT query_id, id, is_preference, rank FROM (SELECT query_id, id, is_preference, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN is_preference AND k <= 5 THEN 0 WHEN NOT is_preference THEN 1 ELSE 2 END, score DESC, id) AS rank FROM (
  SELECT *, memory_type = 'preference' AS is_preference, row_number() OVER (PARTITION BY query_id, memory_type = 'preference' ORDER BY score DESC, id) AS k FROM det)) WHERE rank <= 10""")
def preference_slots(spark: SparkSession, sf: str) -> DataFrame:
    df = _results(spark, sf).withColumn("is_preference", F.col("memory_type") == "preference")
    return rank.preference_slots(df, 10).select("query_id", "id", "is_preference", "rank")


_TELLING = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: len(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_RAW = "list_transform(regexp_split_to_array(lower(summary), '\\s+'), lambda x: trim(x, '.,;:!?\"''()[]{}–—'))"
_VERBS = ", ".join(f"'{w}'" for w in T.ANSWER_VERBS)


@query(_RESULTS + f""", qt AS (SELECT query_id, {_TELLING.format('text')} AS q FROM queries),
m AS (SELECT query_id, id, score, q, list_distinct({_TELLING.format('summary')}) AS s, {_RAW} AS raw FROM (SELECT * REPLACE (coalesce(summary, content) AS summary) FROM det) JOIN qt USING (query_id)),
a AS (SELECT query_id, id, score, len(list_filter(q, lambda a: len(list_filter(s, lambda b: a = b OR (len(a) >= 4 AND starts_with(b, a)) OR (len(a) >= 4 AND len(b) >= 4 AND starts_with(a, b)))) > 0))::DOUBLE / nullif(len(q), 0) AS share,
  CASE WHEN len(list_filter(raw, lambda b: b IN ({_VERBS}))) > 0 THEN 0.15::DOUBLE WHEN len(list_filter(raw, lambda b: regexp_full_match(b, '[0-9]+'))) > 0 THEN 0.08 ELSE 0 END AS bonus, len(q) = 0 OR len(s) = 0 AS none FROM m),
o AS (SELECT query_id, id, round(0.4::DOUBLE * CASE WHEN none THEN 0 ELSE share * (1 - bonus) + bonus END + 0.6::DOUBLE * score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM a)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o""")
def answerability_rerank(spark: SparkSession, sf: str) -> DataFrame:
    df = _results(spark, sf).withColumn("summary", F.coalesce("summary", "content")).join(X.queries(spark, sf).withColumnRenamed("text", "query"), "query_id")
    return rank.answerability_rerank(df).select("query_id", "id", "score", "rank")


@query(_RESULTS + """, sig AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: len(x) > 1)) AS t FROM queries)
SELECT query_id, id, round(len(list_filter(t, lambda x: contains(lower(content), x)))::DOUBLE / nullif(len(t), 0), 6) AS share FROM det JOIN sig USING (query_id)""")
def keyword_fallback(spark: SparkSession, sf: str) -> DataFrame:
    q = X.queries(spark, sf).select("query_id", F.filter(T.token_set(F.col("text")), lambda x: F.length(x) > 1).alias("terms"))
    return _results(spark, sf).join(q, "query_id").select("query_id", "id", r6(search.keyword_share(F.col("content"), F.col("terms"))).alias("share"))


@query(_RESULTS + """, q AS (SELECT query_id, regexp_extract(text, '[A-Za-z]+') AS w FROM queries)
SELECT query_id, id, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, rank, id) AS rank FROM (SELECT query_id, id, rank, CASE WHEN w <> '' AND contains(lower(content), lower(w)) THEN 3 ELSE 0 END AS points FROM det JOIN q USING (query_id))""")
def evidence_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first word of each query in quotes stands for its exact signal."""
    q = X.queries(spark, sf).select("query_id", F.concat(F.lit('"'), F.regexp_extract("text", "[A-Za-z]+", 0), F.lit('"')).alias("query"))
    return rank.evidence_first(_results(spark, sf).join(q, "query_id")).select("query_id", "id", "points", "rank")


@query(_RESULTS + """, win AS (SELECT query_id, id, score FROM lexical JOIN records USING (id) WHERE valid_from >= TIMESTAMP '2023-12-08 00:00:00' AND valid_from < TIMESTAMP '2024-01-01 00:00:00'),
two AS (SELECT query_id, id, 0 AS pass, rank AS pos, score FROM det UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos, score FROM win QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY pass, pos, id) AS place FROM (SELECT query_id, id, min(pass) AS pass, min_by(pos, (pass, pos)) AS pos, max(score) AS score FROM two GROUP BY ALL)""")
def two_pass_merge(spark: SparkSession, sf: str) -> DataFrame:
    """An unfiltered pass and one that searches a time window anew, united in the order first seen."""
    a = _results(spark, sf)
    inside = X.records(spark, sf).where((F.col("valid_from") >= X.ntz("2023-12-08 00:00:00")) & (F.col("valid_from") < X.ntz("2024-01-01 00:00:00"))).select("id", "content")
    b = rank.ranked(search.lexical(X.queries(spark, sf), X.searched(spark, sf).join(inside.select("id"), "id", "left_semi"), 30), k=30).join(inside, "id")
    cols = lambda df, k: df.select("query_id", "id", F.lit(k).alias("pass"), F.col("rank").alias("pos"), "score", "content")
    m = rank.merged(cols(a, 0).union(cols(b, 1)))
    return m.select("query_id", "id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("pass", "pos", "id")).alias("place"))


@query("""SELECT query_id, id, max(s) AS score FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id, project ORDER BY s DESC, id) AS k FROM (SELECT query_id, id, project, score AS s FROM lexical JOIN records USING (id))) WHERE k <= 5 GROUP BY ALL""")
def federated_max(spark: SparkSession, sf: str) -> DataFrame:
    """The best five of every project, united; an id has its highest score."""
    r = X.records(spark, sf)
    df = search.lexical(X.queries(spark, sf), X.searched(spark, sf, F.col("project")), 5).join(r.select("id", "project"), "id")
    k = F.row_number().over(Window.partitionBy("query_id", "project").orderBy(F.desc("score"), "id"))
    return df.withColumn("k", k).where("k <= 5").groupBy("query_id", "id").agg(F.max("score").alias("score"))


@query("""SELECT id, other, rel_type, round(strength, 6) AS strength, direction FROM both_ways WHERE id IN (SELECT memory_id FROM chunks)""")
def one_hop_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(X.chunks(spark, sf).select(F.col("memory_id").alias("id")), X.edges(spark, sf)).withColumn("strength", r6("strength"))


@query("""WITH b AS (SELECT DISTINCT id, other FROM both_ways), a AS (SELECT id FROM records WHERE valid_to IS NULL), s AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 = 0),
h1 AS (SELECT DISTINCT s.id, b.other FROM s JOIN b ON b.id = s.id JOIN a ON a.id = b.other), h2 AS (SELECT DISTINCT h1.id, b.other FROM h1 JOIN b ON b.id = h1.other JOIN a ON a.id = b.other), h3 AS (SELECT DISTINCT h2.id, b.other FROM h2 JOIN b ON b.id = h2.other JOIN a ON a.id = b.other)
SELECT id, other, min(hop) AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) WHERE other <> id GROUP BY ALL""")
def bfs_depth3(spark: SparkSession, sf: str) -> DataFrame:
    live = X.records(spark, sf).where("valid_to is null")
    return graph.reachable(X.query_vectors(spark, sf).select(F.col("query_id").alias("id")), X.edges(spark, sf), live, 3)


@query(_RESULTS + """, l AS (SELECT res.query_id, res.id, rank, other, strength FROM res JOIN both_ways USING (id) WHERE rel_type = 'contradicts'),
m AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.query_id = l.query_id AND r.id = l.other) QUALIFY row_number() OVER (PARTITION BY query_id, other ORDER BY rank, id) = 1),
n AS (SELECT m.query_id, m.id AS result_id, m.other AS conflict_id, strength, substr(content, 1, CAST(len(list_filter(range(1, 501), lambda i: strlen(substr(content, 1, i)) <= 500)) AS BIGINT)) AS chunk, row_number() OVER (PARTITION BY query_id ORDER BY rank, other) AS k FROM m JOIN records x ON x.id = m.other WHERE valid_to IS NULL)
SELECT query_id, result_id, conflict_id, strength, sha256(chunk) AS chunk FROM n WHERE k <= 50""")
def conflict_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return graph.conflicts(_results(spark, sf).select("query_id", "id", "rank"), X.edges(spark, sf), X.records(spark, sf)).withColumn("chunk", F.sha2("chunk", 256))


@query("""WITH w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')) AS s FROM records),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM w a JOIN w b ON a.id < b.id AND least(len(a.s), len(b.s)) >= 0.75 * greatest(len(a.s), len(b.s)) AND len(a.s) > 0)
SELECT a, b, round(c / (n - c), 6) AS similarity FROM p WHERE c / (n - c) >= 0.75""")
def word_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of records, copies included."""
    sets = X.records(spark, sf).select("id", T.token_set(F.col("content")).alias("items"))
    return search.similar_sets(sets, 0.75).withColumn("similarity", r6("similarity"))


@query("""SELECT query_id AS a, chunk_id AS b, cosine FROM knn WHERE cosine >= 0.3 AND query_id <> chunk_id AND NOT EXISTS (SELECT 1 FROM both_ways x WHERE x.id = query_id AND x.other = chunk_id)""")
def infer_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """New edges from the stated query set to similar chunks among all, where no edge is yet.

    A query has few edges, so those of queries alone are counted and sent to every task while they are few: pairs, of which
    there may be as many as the square of the rows, aren't shuffled.
    """
    asked = X.query_vectors(spark, sf)
    pairs = search.similar(asked, X.chunks(spark, sf), 0.3).select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"), "cosine").where("a <> b")
    known = graph.neighbours(asked.select(F.col("query_id").alias("id")), X.edges(spark, sf)).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    return pairs.join(F.broadcast(known) if known.count() <= EDGES else known, ["a", "b"], "left_anti")


@query("""SELECT source_id, target_id, coalesce(round(min(1 - list_cosine_similarity(a.embedding, b.embedding)), 6), 2.0) AS distance FROM edges LEFT JOIN chunks a ON a.memory_id = source_id LEFT JOIN chunks b ON b.memory_id = target_id GROUP BY ALL""")
def min_chunk_distance(spark: SparkSession, sf: str) -> DataFrame:
    c = X.chunks(spark, sf)
    side = lambda k: c.select(F.col("memory_id").alias(f"{k}_id"), F.col("embedding").alias(k))
    df = X.edges(spark, sf).join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    d = F.when(F.col("source").isNotNull() & F.col("target").isNotNull(), 1 - V.cosine(F.col("source"), F.col("target")))
    return df.groupBy("source_id", "target_id").agg(F.coalesce(F.round(F.min(d), 6), F.lit(2.0)).alias("distance"))


@query("""WITH g AS (SELECT query_id, list(x ORDER BY pos) AS centroid FROM (SELECT query_id, pos, avg(x) AS x FROM (SELECT query_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM (SELECT k.query_id, embedding FROM knn k JOIN chunks c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY k.query_id ORDER BY cosine DESC, k.chunk_id) <= 10)) GROUP BY ALL) GROUP BY query_id),
t AS (SELECT query_id, chunk_id, cosine FROM knn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) <= 30),
m AS (SELECT t.query_id, t.chunk_id, round(0.7::DOUBLE * cosine - 0.3::DOUBLE * list_cosine_similarity(embedding, centroid), 6) AS score FROM t JOIN chunks c USING (chunk_id) JOIN g USING (query_id))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m""")
def mmr_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """.7 relevance less .3 likeness to the centroid of the query's ten best."""
    c = X.chunks(spark, sf)
    hits = search.nearest(X.query_vectors(spark, sf), c, 30).join(c.select("chunk_id", "embedding"), "chunk_id")
    mid = V.gathered(V.centroids(hits.where("rank <= 10"), ["query_id"]), ["query_id"])
    score = r6(0.7 * F.col("cosine") - 0.3 * V.cosine(F.col("embedding"), F.col("centroid")))
    df = hits.join(mid, "query_id").select("query_id", "chunk_id", score.alias("score"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


@query("""WITH a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM knn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) <= 20),
h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS r FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(list_reverse(vector), embedding), 6) AS c FROM qvectors, chunks) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) <= 20)
SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + coalesce(a.r, 21)) + 1.0::DOUBLE / (60 + coalesce(h.r, 21)), 6) AS score FROM a FULL JOIN h USING (query_id, chunk_id)""")
def hyde_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the query vector and of a stand-in question vector (its reverse), united by reciprocal ranks; what a leg lacks is placed after its last."""
    q, c = X.query_vectors(spark, sf), X.chunks(spark, sf)
    leg = lambda v, name: search.nearest(v, c, 20).select("query_id", "chunk_id", F.col("rank").alias(name))
    both = leg(q, "a").join(leg(q.withColumn("vector", F.reverse("vector")), "h"), ["query_id", "chunk_id"], "full")
    part = lambda k: 1.0 / (S.RRF_K + F.coalesce(k, F.lit(21)))
    return both.select("query_id", "chunk_id", r6(part("a") + part("h")).alias("score"))


@query()
def minhash_lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate records: MinHash candidates of 50 to 4000 bytes, then the exact Jaccard of character pairs, .85 and more."""
    r = X.records(spark, sf).where(~F.col("immutable") & F.octet_length("content").between(50, 4000)).select("id", F.col("content").alias("text"))
    return search.near_texts(r).withColumn("similarity", r6("similarity"))
