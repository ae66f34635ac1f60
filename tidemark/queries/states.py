"""Queries of writes, upserts, deletions, reports and rerankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark import registry
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.operators import aggregate as A
from tidemark.operators import evaluate as E
from tidemark.operators import knowledge, rank
from tidemark.operators import records as M
from tidemark.operators import writes as W
import tidemark.queries.history  # noqa: F401  registers weight_tuner, whose SQL is used again
from tidemark.queries.retrieval import _RESULTS, _results
from tidemark.registry import query

r6 = lambda c: F.round(c, 6)
text = lambda c: F.col(c).cast("string").alias(c)


@query("SELECT chunk_id, memory_id, project FROM chunks WHERE memory_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chunks_of_records(spark: SparkSession, sf: str) -> DataFrame:
    wanted = X.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return M.chunks_of(X.chunks(spark, sf), wanted).select("chunk_id", "memory_id", "project")


@query("SELECT chunk_id, memory_id, CAST(last_accessed AS VARCHAR) AS last_accessed FROM chunks JOIN records ON memory_id = id WHERE valid_to IS NULL ORDER BY records.last_accessed DESC, chunk_id LIMIT 100")
def chunks_by_recency(spark: SparkSession, sf: str) -> DataFrame:
    return M.recent_chunks(X.chunks(spark, sf), X.records(spark, sf), 100).select("chunk_id", "memory_id", text("last_accessed"))


@query("SELECT chunk_id, sha256(chunk_text) AS chunk_text FROM chunks JOIN records ON memory_id = id WHERE valid_to IS NULL")
def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    return M.recent_chunks(X.chunks(spark, sf), X.records(spark, sf)).select("chunk_id", F.sha2("chunk_text", 256).alias("chunk_text"))


@query("SELECT id, memory_type FROM records WHERE valid_to IS NULL")
def id_types(spark: SparkSession, sf: str) -> DataFrame:
    return M.live(X.records(spark, sf)).select("id", "memory_type")


_KINDS = (*X.TYPES, "other")


@query(f"""WITH b AS (SELECT doc_id AS id, text AS content, [{', '.join(f"'{k}'" for k in _KINDS)}][CAST(doc_id % 7 + 1 AS INTEGER)] AS memory_type, source AS project, [lang, substr(text, 1, 300)] AS tags FROM documents)
SELECT id, array_to_string(list_filter([CASE WHEN trim(coalesce(content, '')) = '' THEN 'content_empty' END, CASE WHEN strlen(content) > 500000 THEN 'content_too_long' END, CASE WHEN memory_type = 'other' THEN 'bad_type' END,
  CASE WHEN NOT regexp_full_match(coalesce(project, ''), '[a-z0-9_-]{{1,64}}') THEN 'bad_project' END, CASE WHEN len(list_filter(tags, lambda t: strlen(t) > 256)) > 0 THEN 'long_tag' END], lambda x: x IS NOT NULL), ',') AS faults FROM b""")
def batch_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a record to be stored, with its source as project, a seventh kind that there isn't, and its start as a tag."""
    i = F.col("doc_id")
    new = X.table(spark, sf, "documents").select(i.alias("id"), F.col("text").alias("content"), F.element_at(F.array(*map(F.lit, _KINDS)), (i % 7 + 1).cast("int")).alias("memory_type"), F.col("source").alias("project"), F.array(F.col("lang"), F.substring("text", 1, 300)).alias("tags"))
    return new.select("id", F.array_join(W.faults(X.TYPES), ",").alias("faults"))


_PAIRS = "pairs AS (SELECT id AS loser, w AS winner FROM (SELECT id, immutable, min(id) OVER (PARTITION BY project, sha256(content)) AS w FROM records WHERE valid_to IS NULL) WHERE id <> w AND NOT immutable)"


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """Mutable live copies with the first record of their project and content as winner."""
    r = M.live(X.records(spark, sf)).withColumn("h", T.content_hash(F.col("content")))
    first = r.groupBy("project", "h").agg(F.min("id").alias("winner"))
    return r.join(first, ["project", "h"]).where("id <> winner and not immutable").select("winner", F.col("id").alias("loser"))


@query(f"""WITH {_PAIRS} SELECT 'record' AS kind, id AS a, NULL::BIGINT AS b FROM records WHERE id NOT IN (SELECT loser FROM pairs)
UNION ALL SELECT 'edge', source_id, target_id FROM edges WHERE source_id NOT IN (SELECT loser FROM pairs) AND target_id NOT IN (SELECT loser FROM pairs)
UNION ALL SELECT DISTINCT 'version', winner, NULL FROM pairs""")
def merge_winner_loser(spark: SparkSession, sf: str) -> DataFrame:
    r, e, v = W.merged(X.records(spark, sf), X.edges(spark, sf), _copies(spark, sf), X.now())
    none = F.lit(None).cast("long").alias("b")
    return r.select(F.lit("record").alias("kind"), F.col("id").alias("a"), none).union(e.select(F.lit("edge"), "source_id", "target_id")).union(v.select(F.lit("version"), "id", none))


@query("""WITH g AS (SELECT id FROM records WHERE project = 'fr') SELECT 'records' AS name, count(*) AS n FROM records WHERE project <> 'fr' UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE project <> 'fr'
UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id NOT IN (FROM g) AND target_id NOT IN (FROM g) UNION ALL SELECT 'events', count(*) FROM revents WHERE project <> 'fr'""")
def delete_project(spark: SparkSession, sf: str) -> DataFrame:
    left = W.without_project("fr", X.records(spark, sf), X.chunks(spark, sf), X.edges(spark, sf), X.events(spark, sf))
    counted = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in left.items()]
    out = counted[0]
    for x in counted[1:]:
        out = out.union(x)
    return out


_DUE = "CAST(o_orderdate AS TIMESTAMP)"


@query(f"""WITH t AS (SELECT 'p' || CAST(o_custkey AS VARCHAR) AS project, arg_max({_DUE}, ({_DUE}, o_orderkey)) AS expires_at FROM orders GROUP BY ALL)
SELECT project, CAST(expires_at AS VARCHAR) AS expires_at FROM t WHERE expires_at < (SELECT max({_DUE}) FROM orders) - INTERVAL 60 DAY AND starts_with(project, 'p1')""", views=False)
def ttl_expired(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as upserts of a project's time to live; what expires 60 days before the last of all, by prefix."""
    o = X.table(spark, sf, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project"), F.col("o_orderdate").cast("timestamp_ntz").alias("expires_at"), F.col("o_orderkey").alias("seq"))
    ttl = o.groupBy("project").agg(F.max_by("expires_at", F.struct("expires_at", "seq")).alias("expires_at"))
    last = o.agg(F.max("expires_at").alias("last"))
    return W.expired(ttl.crossJoin(F.broadcast(last)), F.col("last") - F.make_dt_interval(F.lit(60)), "p1").select("project", text("expires_at"))


@query("SELECT event_id FROM revents WHERE created_at >= (SELECT max(created_at) FROM revents) - INTERVAL 7 DAY")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the last seven days there are."""
    e = X.events(spark, sf)
    last = e.agg(F.max("created_at").alias("last"))
    return W.retained(e.crossJoin(F.broadcast(last)), "created_at", F.col("last"), 7).select("event_id")


@query("SELECT project, event_type AS key, arg_max(event_id, (created_at, event_id)) AS value FROM revents GROUP BY ALL")
def meta_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and purchases are there, the other events are upserted: the last of each project and kind stays."""
    e = X.events(spark, sf).select("project", F.col("event_type").alias("key"), "created_at", F.col("event_id").alias("value"))
    old = F.col("key").isin("error", "purchase")
    return W.keep_last(e.where(old), e.where(~old), ["project", "key"], "created_at").select("project", "key", "value")


@query("SELECT id, cluster_id FROM records LEFT JOIN (SELECT memory_id, arg_min(cluster_id, chunk_id) AS cluster_id FROM chunks GROUP BY memory_id) ON memory_id = id")
def cluster_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return W.clustered(X.records(spark, sf), X.chunks(spark, sf)).select("id", "cluster_id")


@query("SELECT chunk_id, last_matched IS NULL AS was_empty, round(CASE WHEN last_matched IS NULL THEN list_reverse(embedding)[1] ELSE embedding[1] END, 6) AS first FROM chunks")
def embeddings_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Never matched chunks stand for those without an embedding; they get the reversed vector, the others keep theirs."""
    c = X.chunks(spark, sf)
    left = c.withColumn("embedding", F.when(F.col("last_matched").isNotNull(), F.col("embedding")))
    got = W.filled(left, c.withColumn("embedding", F.reverse("embedding")))
    return got.select("chunk_id", F.col("last_matched").isNull().alias("was_empty"), r6(F.get("embedding", F.lit(0))).alias("first"))


@query("SELECT id, sha256(CASE WHEN valid_to IS NULL AND summary IS NULL THEN substr(content, 1, 40) ELSE coalesce(summary, '') END) AS summary FROM records")
def summaries_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a summary get the start of their content."""
    r = X.records(spark, sf)
    new = r.where("summary is null").select("id", F.substring("content", 1, 40).alias("summary"))
    return W.summarised(r, new).select("id", F.sha2(F.coalesce("summary", F.lit("")), 256).alias("summary"))


@query("""WITH e AS (SELECT id, list(CASE WHEN useful THEN 0.1 ELSE -0.05 END::DOUBLE ORDER BY event_id) AS d, count(*) FILTER (useful) AS n FROM (SELECT unnest(result_ids) AS id, event_id, useful FROM revents WHERE useful IS NOT NULL) GROUP BY id)
SELECT r.id, round(CASE WHEN d IS NULL THEN dynamic_importance ELSE list_reduce(list_concat([dynamic_importance::DOUBLE], d), lambda x, y: greatest(0.1::DOUBLE, x + y)) END, 6) AS dynamic_importance,
  round(log2(CASE WHEN n > 0 THEN greatest(1, retrieval_interval_hrs * 1.5::DOUBLE) * pow(1.5::DOUBLE, n - 1) ELSE retrieval_interval_hrs END), 6) AS interval_log2 FROM records r LEFT JOIN e USING (id)""")
def feedback_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Events' results as reports of use, in the order of events."""
    reports = X.events(spark, sf).select(F.explode("result_ids").alias("id"), F.col("event_id").alias("seq"), "useful")
    return W.learned(X.records(spark, sf), reports, X.now()).select("id", r6("dynamic_importance").alias("dynamic_importance"), r6(F.log2("retrieval_interval_hrs")).alias("interval_log2"))


@query("""WITH m AS (SELECT CAST(min(o_orderdate) AS DATE) + 100 AS since FROM orders), a AS (SELECT o_orderpriority AS project, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders, m WHERE CAST(o_orderdate AS DATE) >= since - 7 AND CAST(o_orderdate AS DATE) < since + 14)
SELECT project, id, CAST(d AS VARCHAR) AS valid_from, place, greatest(0, n - 30) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY d, id) AS place, count(*) OVER (PARTITION BY project) AS n FROM a) WHERE place <= 30""", views=False)
def event_window_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated events: a week from the hundredth day on, with padding and the cap."""
    o = X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("valid_from"))
    first = o.agg(F.date_add(F.min("valid_from"), 100).alias("since"))
    found = W.event_window(o.crossJoin(F.broadcast(first)), F.col("since"), F.date_add("since", 7))
    return found.select("project", "id", text("valid_from"), "place", "omitted")


@query("""WITH a AS (SELECT event_id AS id, project, user_id AS subject, event_type AS predicate, CASE WHEN event_id % 5 <> 0 THEN created_at END AS observed_at, (event_id % 10) / 10.0::DOUBLE AS confidence FROM revents),
l AS (SELECT * FROM a WHERE observed_at IS NULL OR observed_at <= (SELECT max(created_at) FROM revents) - INTERVAL 5 DAY QUALIFY row_number() OVER (PARTITION BY project, subject, predicate ORDER BY observed_at DESC NULLS LAST, id DESC) = 1)
SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY observed_at DESC NULLS LAST, confidence DESC, id DESC) AS rank FROM l""")
def preference_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a user's preferences, every fifth undated, as of five days before the last."""
    e = X.events(spark, sf)
    i = F.col("event_id")
    atoms = e.select(i.alias("id"), "project", F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.when(i % 5 != 0, F.col("created_at")).alias("observed_at"), (i % 10 / 10.0).alias("confidence"))
    last = e.agg((F.max("created_at") - F.make_dt_interval(F.lit(5))).alias("as_of"))
    return W.active_preferences(atoms.crossJoin(F.broadcast(last)), F.col("as_of")).select("project", "id", "rank")


@query("""WITH e AS (SELECT DISTINCT source AS name, [lower(source) || 'x'] AS aliases FROM documents WHERE source IS NOT NULL), k AS (SELECT name, lower(unnest(list_concat([name], aliases))) AS key FROM e),
c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(source) WHEN 1 THEN upper(source) || 'X' ELSE 'New ' || lang || CAST(doc_id % 50 AS VARCHAR) END AS name FROM documents)
SELECT 'fresh' AS kind, lower(c.name) AS name, min(doc_id) AS seq FROM c LEFT JOIN k ON k.key = lower(c.name) WHERE k.key IS NULL AND c.name IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'merged', e.name, len(aliases) FROM e""")
def entity_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as known entities with an alias; documents name them in capitals, by the alias, or name new ones."""
    d = X.table(spark, sf, "documents")
    i, src = F.col("doc_id"), F.col("source")
    known = d.where("source is not null").select(src.alias("name"), F.array(F.concat(F.lower("source"), F.lit("x"))).alias("aliases")).distinct()
    names = d.select(i.alias("seq"), F.when(i % 3 == 0, F.upper("source")).when(i % 3 == 1, F.concat(F.upper("source"), F.lit("X"))).otherwise(F.concat(F.lit("New "), F.col("lang"), (i % 50).cast("string"))).alias("name")).where("name is not null")
    grown, fresh = W.entities_merged(known, names)
    return fresh.select(F.lit("fresh").alias("kind"), F.col("key").alias("name"), "seq").union(grown.select(F.lit("merged"), "name", (F.size("aliases") + F.size("added")).cast("long")))


_SCORED = "s AS (SELECT doc_id, coalesce(lang, 'none') AS kind, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'incorrect' ELSE 'partial' END AS label FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {_SCORED} SELECT coalesce(kind, 'overall') AS kind, count(*) AS total, count(*) FILTER (label = 'correct') AS correct, count(*) FILTER (label = 'partial') AS partial, count(*) FILTER (label = 'incorrect') AS incorrect,
  round(count(*) FILTER (label = 'correct') / count(*)::DOUBLE, 6) AS strict, round(count(*) FILTER (label <> 'incorrect') / count(*)::DOUBLE, 6) AS lenient FROM s GROUP BY ROLLUP (kind)""", views=False)
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as scores of documents, by language and over all."""
    d = X.table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("kind"))
    label = F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "incorrect").otherwise("partial")
    rows = X.table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "kind", label.alias("label"))
    return E.score_report(rows).select("kind", "total", "correct", "partial", "incorrect", r6("strict").alias("strict"), r6("lenient").alias("lenient"))


@query("SELECT doc_id AS id, lang, quality, label AS cluster_id FROM documents JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id", views=False)
def evaluation_join(spark: SparkSession, sf: str) -> DataFrame:
    """Items, scores and runs by their id."""
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    s = X.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return d.join(s, "id").join(X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id")), "id")


@query(f"SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY abs(date_diff('day', CAST(valid_from AS DATE), DATE '{X.BASE[:10]}' + 20)) NULLS LAST, id) AS place FROM records")
def nearest_dates(spark: SparkSession, sf: str) -> DataFrame:
    target = F.date_add(F.lit(X.BASE[:10]).cast("date"), 20)
    return E.by_nearness(X.records(spark, sf), target).select("project", "id", "place")


@query("SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY valid_from NULLS FIRST, id) AS place FROM records")
def chronological_order(spark: SparkSession, sf: str) -> DataFrame:
    return E.in_time(X.records(spark, sf)).select("project", "id", "place")


@query("""SELECT project, count(*) FILTER (event_type IN ('purchase', 'signup')) AS keep, count(*) FILTER (event_type IN ('view', 'click')) AS tune, count(*) FILTER (event_type = 'error') AS reject,
  round(count(*) FILTER (event_type = 'error') / nullif(count(*), 0)::DOUBLE, 6) AS false_positive_rate FROM revents GROUP BY project""")
def pattern_audit(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "KEEP").when(F.col("event_type").isin("view", "click"), "TUNE").when(F.col("event_type") == "error", "REJECT")
    return A.pattern_audit(X.events(spark, sf).withColumn("verdict", kind), ["project"]).withColumn("false_positive_rate", r6("false_positive_rate"))


@query("SELECT user_id, event_type AS main, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM revents GROUP BY ALL)) WHERE k = 1")
def primary_kind(spark: SparkSession, sf: str) -> DataFrame:
    return A.most_frequent(X.events(spark, sf), ["user_id"], "event_type").select("user_id", F.col("event_type").alias("main"), "n")


@query("SELECT id, octet_length(encode(content)) AS bytes, octet_length(encode(content)) > 1000 AS truncated, len(list_filter(range(0, 1001), lambda i: strlen(substr(content, 1, i)) <= 1000 AND i <= length(content))) - 1 AS kept FROM records")
def fetch_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Contents up to 1000 bytes, by the characters that stay."""
    r = X.records(spark, sf)
    got = W.fetched(r, "full", 1000).join(r.select("id", F.octet_length("content").cast("long").alias("bytes")), "id")
    return got.select("id", "bytes", "truncated", F.length("text").cast("long").alias("kept"))


@query("""WITH t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM records WHERE valid_to IS NULL) GROUP BY tag) SELECT tag AS label, n FROM t WHERE tag ILIKE '%_:1%' ESCAPE '!' ORDER BY n DESC, tag LIMIT 20""")
def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Tags that fit a pattern in any case, filtered after they are counted; the twenty most frequent."""
    return A.tags_like(X.records(spark, sf), "%_:1%", 20).select("label", "n")


@query("SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)", views=False)
def orphan_documents(spark: SparkSession, sf: str) -> DataFrame:
    refs = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    return M.orphans(X.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), refs)


@query(f"""SELECT r.project, {', '.join(f'coalesce(w.{k}, {getattr(S.DEFAULT, k)}::DOUBLE) AS {k}' for k in knowledge.BOUNDS)} FROM (SELECT DISTINCT CAST(user_id % 5 AS VARCHAR) AS project FROM events) r LEFT JOIN ({registry.ORACLE["weight_tuner"]}) w ON w.project = r.project""", views=False)
def learned_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Every project's weights: what weight_tuner learns, else the usual."""
    new = knowledge.tuned(A.failure_dominance(X.events(spark, sf), X.now()), 20, 0.2, 0.0001).select("project", *[r6(k).alias(k) for k in knowledge.BOUNDS])
    return rank.with_weights(X.events(spark, sf).select("project").distinct(), new).select("project", *knowledge.BOUNDS)


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''))"
_OVERLAP = f""", j AS (SELECT det.query_id, id, score, rank, {_WORDS.format('text')} AS a, {_WORDS.format('content')} AS b FROM det JOIN queries USING (query_id)),
o AS (SELECT query_id, id, score, rank, round(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0)::DOUBLE, 6) AS sim FROM j)"""


def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Results with the likeness of query's and content's words, in place of a model's score."""
    q = X.queries(spark, sf).withColumnRenamed("text", "query")
    return _results(spark, sf).join(q, "query_id").withColumn("sim", r6(T.jaccard(T.token_set(F.col("query")), T.token_set(F.col("content")))))


@query(_RESULTS + _OVERLAP + """, m AS (SELECT *, min(sim) OVER w AS lo, max(sim) OVER w AS hi FROM o WINDOW w AS (PARTITION BY query_id, rank <= 20)),
n AS (SELECT query_id, id, rank <= 20 AS inside, CASE WHEN rank > 20 THEN score WHEN hi = lo THEN 0.5 ELSE round((sim - lo) / (hi - lo), 6) END AS score FROM m)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY inside DESC, score DESC, id) AS rank FROM n""")
def dense_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.dense_rerank(_overlap(spark, sf), "sim").select("query_id", "id", "score", "rank")


@query(_RESULTS + _OVERLAP + """, f AS (SELECT query_id, id, CASE WHEN rank <= 5 THEN sim ELSE score END AS score FROM o) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f""")
def final_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The five best get other scores; all are sorted again."""
    df = _overlap(spark, sf)
    return rank.rescored(df, df.where("rank <= 5").select("query_id", "id", F.col("sim").alias("score"))).select("query_id", "id", "score", "rank")


@query(_RESULTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, id) AS k, max(score) OVER (PARTITION BY query_id, session) AS best FROM det),
g AS (SELECT *, round(sum(score / log2(k + 1)) OVER (PARTITION BY query_id, session), 6) AS dcg FROM k) SELECT query_id, id, session, row_number() OVER (PARTITION BY query_id ORDER BY dcg DESC, best DESC, session, score DESC, id) AS rank FROM g""")
def session_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.session_reranked(_results(spark, sf).withColumn("cosine", F.col("score"))).select("query_id", "id", "session", "rank")


@query(_RESULTS + f""", q AS (SELECT query_id, lower(text) SIMILAR TO '.*\\b({'|'.join(T.PREFERENCE_QUERY)})\\b.*' AS wants FROM queries)
SELECT query_id, id FROM det JOIN records r USING (id) JOIN q USING (query_id) WHERE (id % 9 <> 0 OR wants) AND created_at >= TIMESTAMP '2023-12-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-05 00:00:00' AND list_contains(r.tags, r.project)""")
def suppressed_and_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth record was extracted as a preference; then a scope of dates and a tag."""
    r = X.records(spark, sf).select("id", "created_at", F.when(F.col("id") % 9 == 0, F.array_append("tags", F.lit("extracted-preference"))).otherwise(F.col("tags")).alias("tags"), "project")
    df = _results(spark, sf).drop("tags").join(r, "id").join(X.queries(spark, sf).withColumnRenamed("text", "query"), "query_id")
    return rank.in_scope(rank.visible(df), X.ntz("2023-12-05 00:00:00"), X.ntz("2024-01-05 00:00:00")).where(F.array_contains("tags", F.col("project"))).select("query_id", "id")


_TOK = "list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))"
_NAMES = f"(SELECT query_id, list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN regexp_matches(w[i], '^[A-Z]') AND regexp_matches(w[i + 1], '^[A-Z]') THEN [lower(w[i]), lower(w[i + 1])] END), lambda p: p IS NOT NULL) AS pairs FROM (SELECT query_id, {_TOK.format('text')} AS w FROM queries))"


@query(_RESULTS + f""", n AS {_NAMES} SELECT query_id, id, len(pairs) > 0 AS asks, len(list_filter(pairs, lambda p: contains(lower(content), p[1] || ' ' || p[2]) OR contains(lower(content), p[2] || ' ' || p[1]))) > 0 AS hit FROM det JOIN n USING (query_id)""")
def identifier_boost(spark: SparkSession, sf: str) -> DataFrame:
    df = _results(spark, sf).join(X.queries(spark, sf).withColumnRenamed("text", "query"), "query_id")
    return df.select("query_id", "id", (F.size(T.name_pairs(F.col("query"))) > 0).alias("asks"), T.identifier_hit(F.col("content"), F.col("query")).alias("hit"))


@query(_RESULTS + f""", a AS (SELECT query_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda x: x <> '' AND x NOT IN ({', '.join(f"'{w}'" for w in T.NO_TOPIC)})) AS t FROM queries)
SELECT query_id, id, len(t) AS anchors, len(list_filter(t, lambda x: contains(lower(content), x))) > 0 AS hit FROM det JOIN a USING (query_id)""")
def topic_anchor(spark: SparkSession, sf: str) -> DataFrame:
    q = X.queries(spark, sf).select("query_id", T.topic_anchors(F.col("text")).alias("t"))
    return _results(spark, sf).join(q, "query_id").select("query_id", "id", F.size("t").cast("long").alias("anchors"), T.has_topic(F.col("content"), F.col("t")).alias("hit"))


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_LIKES = f"(len(list_filter([{_quoted(T.NO_PREFERENCE)}], lambda p: contains(lower({{0}}), p))) = 0 AND (len(list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9]+'), lambda x: x IN ({_quoted(T.PREFERENCE_WORDS)}))) > 0 OR len(list_filter([{_quoted(T.PREFERENCE_PHRASES)}], lambda p: contains(lower({{0}}), p))) > 0))"
#: A statement put before every fourth turn, so that the rules meet what they look for.
_SAY = ("I love jazz. ", "I'd like to go. ", "She is vegetarian! ", "")


@query(f"""WITH c AS (SELECT conv_id, turn, [{_quoted(_SAY)}][CAST((conv_id + turn) % 4 + 1 AS INTEGER)] || coalesce(text, '') AS said FROM conversations), s AS (SELECT conv_id, turn, said, list_filter(list_transform(regexp_split_to_array(said, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '' AND {_LIKES.format('x')}) AS own FROM c)
SELECT conv_id, turn, {_LIKES.format('said')} AS states, sha256(array_to_string(list_transform(own, lambda x: CASE WHEN starts_with(x, 'I ') THEN 'User ' || substr(x, 3) ELSE x END), '|')) AS preferences FROM s""")
def preference_statements(spark: SparkSession, sf: str) -> DataFrame:
    c = X.table(spark, sf, "conversations")
    said = F.concat(F.element_at(F.array(*map(F.lit, _SAY)), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")), F.coalesce("text", F.lit("")))
    c = c.select("conv_id", "turn", said.alias("said"))
    return c.select("conv_id", "turn", T.is_preference_content(F.col("said")).alias("states"), F.sha2(F.array_join(T.stated_preferences(F.col("said")), "|"), 256).alias("preferences"))


@query("SELECT page_id, sha256(regexp_replace(coalesce(html, '') || chr(7) || chr(9), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS clean FROM pages", views=False)
def without_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a bell and a tab at their ends: the bell goes."""
    return X.table(spark, sf, "pages").select("page_id", F.sha2(T.without_controls(F.concat(F.coalesce("html", F.lit("")), F.lit("\x07\t"))), 256).alias("clean"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 0 ELSE round(value, 6) END AS value FROM revents")
def finite_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the values is not a number, a third infinite."""
    i = F.col("event_id")
    odd = F.when(i % 3 == 0, F.lit(float("nan"))).when(i % 3 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return X.events(spark, sf).select("event_id", r6(T.finite(odd)).alias("value"))


@query("""SELECT user_id, list(id ORDER BY first) AS ids FROM (SELECT user_id, id, min(event_id * 10 + pos) AS first FROM (SELECT user_id, event_id, unnest(result_ids) AS id, generate_subscripts(result_ids, 1) AS pos FROM revents) GROUP BY ALL) GROUP BY user_id""")
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    """A user's result lists united in the order first seen."""
    rows = X.events(spark, sf).select("user_id", "event_id", F.posexplode("result_ids").alias("pos", "id"))
    return rank.united(rows, ["user_id"], ["event_id", "pos"])
