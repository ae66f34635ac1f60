"""Counts, scans, streams and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.functions import ranking as K
from tidemark.functions import text as T
from tidemark.operators import aggregate as A
from tidemark.operators import evaluate as E
from tidemark.operators import rank, records as M, search
from tidemark.registry import query
from tidemark.streaming import jobs

r6 = lambda c: F.round(c, 6)
text = lambda c: F.col(c).cast("string").alias(c)
_SPAN = "count(*) AS n, CAST(min(created_at) AS VARCHAR) AS oldest, CAST(max(created_at) AS VARCHAR) AS newest"


def _span(df: DataFrame) -> DataFrame:
    return df.select("label", "n", text("oldest"), text("newest"))


@query(f"SELECT tag AS label, {_SPAN} FROM (SELECT unnest(tags) AS tag, created_at FROM records WHERE valid_to IS NULL) GROUP BY tag")
def agg_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return _span(A.by_tag(X.records(spark, sf)))


@query(f"SELECT memory_type AS label, {_SPAN} FROM records WHERE valid_to IS NULL GROUP BY memory_type")
def agg_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _span(A.by_type(X.records(spark, sf)))


@query("SELECT failure_class AS label, count(*) AS n, epoch_us(min(created_at)) AS oldest, epoch_us(max(created_at)) AS newest FROM revents WHERE failure_class IS NOT NULL GROUP BY failure_class")
def agg_by_failure_class(spark: SparkSession, sf: str) -> DataFrame:
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    return A.by_failure_class(X.events(spark, sf)).select("label", "n", us("oldest").alias("oldest"), us("newest").alias("newest"))


@query("""SELECT project, count(*) AS total, count(*) FILTER (importance = 0) AS importance_0, count(*) FILTER (importance = 1) AS importance_1, count(*) FILTER (importance = 2) AS importance_2, count(*) FILTER (importance = 3) AS importance_3, count(*) FILTER (importance = 4) AS importance_4,
  count(*) FILTER (summary IS NULL) AS pending_summaries, CAST(min(created_at) AS VARCHAR) AS oldest, CAST(max(created_at) AS VARCHAR) AS newest FROM records WHERE valid_to IS NULL GROUP BY project""")
def project_stats(spark: SparkSession, sf: str) -> DataFrame:
    df = A.project_stats(X.records(spark, sf))
    return df.withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})


@query("SELECT project, count(*) AS total, count(content_hash) AS hashed, count(*) FILTER (sha256(content) <> content_hash) AS corrupt, round(count(content_hash) * 100.0::DOUBLE / count(*), 6) AS coverage FROM records WHERE valid_to IS NULL GROUP BY project")
def integrity_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.integrity(X.records(spark, sf)).withColumn("coverage", r6("coverage"))


@query("SELECT DISTINCT project FROM records WHERE valid_to IS NULL")
def distinct_projects(spark: SparkSession, sf: str) -> DataFrame:
    return M.live(X.records(spark, sf)).select("project").distinct()


@query("""WITH c AS (SELECT project, count(*) AS chunks, count(*) FILTER (embedding IS NULL) AS pending_vectors FROM chunks GROUP BY project), r AS (SELECT project, count(*) FILTER (summary IS NULL OR summary = content) AS pending_summaries FROM records WHERE valid_to IS NULL GROUP BY project)
SELECT project, coalesce(chunks, 0) AS chunks, coalesce(pending_vectors, 0) AS pending_vectors, coalesce(pending_summaries, 0) AS pending_summaries FROM r FULL JOIN c USING (project)""")
def pending_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.pending(X.chunks(spark, sf), X.records(spark, sf))


_DOM = f"""WITH n AS (SELECT project, failure_class, count(*) AS n FROM revents WHERE failure_class IS NOT NULL AND created_at >= TIMESTAMP '{X.NOW}' - INTERVAL 30 DAY GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, failure_class) AS k FROM n),
d AS (SELECT project, max(CASE WHEN k = 1 THEN failure_class END) AS top_class, CAST(sum(n) AS BIGINT) AS total, max(CASE WHEN k = 1 THEN n END)::DOUBLE / sum(n) AS top_share, coalesce(max(CASE WHEN k = 2 THEN n END), 0)::DOUBLE / sum(n) AS next_share FROM k GROUP BY project)"""


@query(_DOM + " SELECT project, top_class, total, round(top_share, 6) AS top_share, round(next_share, 6) AS next_share FROM d")
def failure_dominance(spark: SparkSession, sf: str) -> DataFrame:
    df = A.failure_dominance(X.events(spark, sf), X.now())
    return df.withColumns({c: r6(c) for c in ("top_share", "next_share")})


@query("SELECT coalesce(memory_type, 'overall') AS memory_type, count(*) AS n, round(avg(access_count), 6) AS mean_access, count(*) FILTER (immutable) AS fixed FROM records GROUP BY ROLLUP (memory_type)")
def rollup_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return A.rolled_up(X.records(spark, sf), "memory_type", n=F.count("*"), mean_access=r6(F.avg("access_count")), fixed=F.count_if("immutable"))


@query("SELECT project, lower(name) AS name, string_agg(alias, ',' ORDER BY alias) AS aliases FROM (SELECT DISTINCT lang AS project, source AS name, source || '-' || CAST(doc_id % 3 AS VARCHAR) AS alias FROM documents) GROUP BY ALL")
def alias_union(spark: SparkSession, sf: str) -> DataFrame:
    d = X.table(spark, sf, "documents").select(F.col("lang").alias("project"), F.col("source").alias("name"), F.concat("source", F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("alias"))
    return A.merged_aliases(d).withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT id, project, memory_type, sha256(content) = content_hash AS intact FROM records JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = id WHERE valid_to IS NULL")
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    return M.lookup(X.records(spark, sf), X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))).select("id", "project", "memory_type", "intact")


@query("SELECT id, CAST(updated_at AS VARCHAR) AS updated_at FROM records WHERE valid_to IS NULL AND memory_type = 'decision' AND importance <= 3 AND list_contains(tags, 'en')")
def list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return M.listed(X.records(spark, sf), "decision", 3, ["en"], None).select("id", text("updated_at"))


@query("SELECT id, CAST(updated_at AS VARCHAR) AS updated_at FROM records WHERE valid_to IS NULL ORDER BY records.updated_at DESC, id LIMIT 20 OFFSET 20")
def list_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of twenty."""
    return M.listed(X.records(spark, sf), offset=20).select("id", text("updated_at"))


@query("SELECT id, memory_type FROM records WHERE created_at <= TIMESTAMP '2023-12-20 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2023-12-20 00:00:00')")
def time_travel_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return M.as_of(X.records(spark, sf), X.ntz("2023-12-20 00:00:00")).select("id", "memory_type")


@query("SELECT id FROM records WHERE valid_from >= TIMESTAMP '2023-12-05 00:00:00' AND valid_from < TIMESTAMP '2023-12-25 00:00:00'")
def date_range_half_open(spark: SparkSession, sf: str) -> DataFrame:
    return M.valid_between(X.records(spark, sf), X.ntz("2023-12-05 00:00:00"), X.ntz("2023-12-25 00:00:00")).select("id")


@query(r"""SELECT id, CAST(regexp_matches(content, '(?i)(postgresql|postgres|redis|mongodb|mysql|https?)://\S+') AS INT) + CAST(regexp_matches(content, '\S+\s*(→|->)\s*\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') AS INT) + CAST(regexp_matches(content, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d{2,5}') AS INT) + CAST(regexp_matches(content, '[A-Z][A-Z0-9_]+=https?://\S+') AS INT) >= 2 AS config FROM records""")
def operational_config_filter(spark: SparkSession, sf: str) -> DataFrame:
    return X.records(spark, sf).select("id", T.is_operational_config(F.col("content")).alias("config"))


@query("SELECT id, array_to_string(tags, ',') AS tags, strlen(content) AS bytes, CASE WHEN strlen(content) <= 500000 THEN 'focused' ELSE 'synopsis' END AS tier, CASE WHEN strlen(content) > 10000 THEN 'document' ELSE 'focused' END AS mode, summary IS NOT NULL OR strlen(content) <= 500 AS whole FROM records")
def handle_projection(spark: SparkSession, sf: str) -> DataFrame:
    r = X.records(spark, sf)
    whole = r.select("id", (F.col("summary").isNotNull() | (T.excerpt(F.col("content")) == F.col("content"))).alias("whole"), T.size_tier(F.col("content")).alias("tier"), T.storage_mode(F.col("content")).alias("mode"))
    return M.handles(r).join(whole, "id").select("id", F.array_join("tags", ",").alias("tags"), "bytes", "tier", "mode", "whole")


@query(r"SELECT id, sha256(content) AS content_hash, substr(sha256(regexp_replace(trim(lower(content)), '\s+', ' ', 'g')), 1, 32) AS chunk_hash FROM records")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return X.records(spark, sf).select("id", T.content_hash(F.col("content")).alias("content_hash"), T.chunk_hash(F.col("content")).alias("chunk_hash"))


@query("SELECT project, sha256(content) AS content_hash, min(id) AS first_id, count(*) AS n FROM records WHERE valid_to IS NULL GROUP BY ALL HAVING count(*) > 1")
def exact_hash_dups(spark: SparkSession, sf: str) -> DataFrame:
    return M.hash_groups(X.records(spark, sf))


@query("SELECT chunk_id, r.project, memory_type, importance FROM chunks c JOIN records r ON r.id = c.memory_id AND r.project = c.project WHERE valid_to IS NULL")
def chunk_memory_join(spark: SparkSession, sf: str) -> DataFrame:
    r = M.live(X.records(spark, sf)).select(F.col("id").alias("memory_id"), "project", "memory_type", "importance")
    return X.chunks(spark, sf).select("chunk_id", "memory_id", "project").join(r, ["memory_id", "project"]).select("chunk_id", "project", "memory_type", "importance")


@query(f"SELECT id FROM records WHERE NOT immutable AND created_at < TIMESTAMP '{X.NOW}' - INTERVAL 30 DAY AND NOT EXISTS (SELECT 1 FROM chunks WHERE memory_id = id AND last_matched IS NOT NULL)")
def cold_documents_anti(spark: SparkSession, sf: str) -> DataFrame:
    return M.cold(X.records(spark, sf), X.chunks(spark, sf), X.now(), 30).select("id")


@query("SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id")
def session_render(spark: SparkSession, sf: str) -> DataFrame:
    return E.rendered(X.table(spark, sf, "conversations")).withColumn("rendered", F.sha2("rendered", 256))


_INTENT = r"""SELECT conv_id, turn, len(list_intersect(t, ['when','ago','before','after','first','last','recent','recently','long','sequence','order','earliest','latest','previous','prior','since'])) > 0 AS temporal, len(list_intersect(t, ['currently','anymore','still','current'])) > 0 AS updating,
  NOT regexp_matches(text, '(?i)\bhow many (days?|weeks?|months?|years?) (ago|before|after)\b') AND (regexp_matches(text, '(?i)\b(how many(?: times)?|how often|how much total|total number of|sum of|count of|list (?:all|every|everything)|every time|all occasions?)\b') OR regexp_matches(text, '(?i)\bhow much\b.*\b(save|saved|spend|spent|raised?|earn|earned|in total|altogether)\b')) AS counting
FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS t FROM conversations)"""


@query(_INTENT)
def query_intents(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return X.table(spark, sf, "conversations").select("conv_id", "turn", T.is_temporal(t).alias("temporal"), T.is_update(t).alias("updating"), T.is_aggregation(t).alias("counting"))


# Evaluation: relevant records of a query are those labelled good among its lexical hits' sources of truth.
_EVAL = """WITH f AS (SELECT query_id, list(id ORDER BY score DESC, id) AS found FROM (SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20) GROUP BY query_id),
g AS (SELECT query_id, list(DISTINCT doc_id) AS gold FROM (SELECT l.query_id, doc_id FROM lexical l JOIN labels ON doc_id = l.id WHERE quality = 1 QUALIFY row_number() OVER (PARTITION BY l.query_id ORDER BY l.score DESC, doc_id) <= 10) GROUP BY query_id),
e AS (SELECT f.query_id, found, gold, list_transform(found, lambda x: CASE WHEN list_contains(gold, x) THEN 1 ELSE 0 END) AS hit FROM f JOIN g USING (query_id))"""


def _eval(spark: SparkSession, sf: str) -> DataFrame:
    good = X.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    records = X.searched(spark, sf).join(good.withColumn("good", F.lit(True)), "id", "left").select("id", "content", F.coalesce("good", F.lit(False)).alias("group"))
    # Twenty of the good and of the others hold the best twenty of all, and the best ten good ones.
    hits = search.lexical(X.queries(spark, sf), records, 20)
    found = rank.ranked(hits, k=20).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("found"))
    gold = rank.ranked(hits.join(good, "id"), k=10).groupBy("query_id").agg(F.collect_set("id").alias("gold"))
    return found.join(gold, "query_id")


@query(_EVAL + """ SELECT query_id, round(list_sum(hit[1:5])::DOUBLE / least(len(found), 5), 6) AS precision_5, round(coalesce(1.0::DOUBLE / nullif(list_position(hit, 1), 0), 0), 6) AS reciprocal_rank,
  round(list_sum(list_transform(range(1, least(len(hit), 10) + 1), lambda i: hit[i]::DOUBLE / log2(i + 1))) / list_sum(list_transform(range(1, least(len(gold), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg_10 FROM e""")
def precision_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    f, g = F.col("found"), F.col("gold")
    return _eval(spark, sf).select("query_id", r6(K.precision_at(f, g, 5)).alias("precision_5"), r6(K.reciprocal_rank(f, g)).alias("reciprocal_rank"), r6(K.ndcg_at(f, g, 10)).alias("ndcg_10"))


@query(_EVAL + " SELECT query_id, len(list_intersect(found[1:10], gold)) > 0 AS recall_any, len(list_intersect(found[1:10], gold)) = len(gold) AS recall_all, len(list_intersect(found, gold)) > 0 AS in_context, len(gold) - len(list_intersect(found, gold)) AS missing FROM e")
def recall_any_all(spark: SparkSession, sf: str) -> DataFrame:
    return E.recall_flags(_eval(spark, sf), 10)


@query("""WITH s AS (SELECT id, ('sid:' || CAST(id % 40 AS VARCHAR)) AS session FROM records), h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
n AS (SELECT query_id, session, count(*) AS n FROM h JOIN s USING (id) GROUP BY ALL) SELECT query_id, max(n) AS top, CAST(sum(n) AS BIGINT) AS mapped, round(max(n)::DOUBLE / sum(n), 6) AS dominance FROM n GROUP BY query_id""")
def session_dominance(spark: SparkSession, sf: str) -> DataFrame:
    r = X.records(spark, sf)
    hits = rank.ranked(search.lexical(X.queries(spark, sf), X.searched(spark, sf), 20), k=20).join(r.select("id", rank.session_of(F.col("tags")).alias("session")), "id")
    return E.dominance(hits).withColumn("dominance", r6("dominance"))


@query("""WITH t AS (SELECT u.conv_id, u.turn, u.text AS gold, a.text AS hyp FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
w AS (SELECT conv_id, turn, gold, list_distinct(list_filter(list_transform(string_split_regex(lower(gold), '\\s+'), lambda x: trim(x, '.,!?;:"''()-')), lambda x: x <> '')) AS g, list_distinct(list_filter(list_transform(string_split_regex(lower(hyp), '\\s+'), lambda x: trim(x, '.,!?;:"''()-')), lambda x: x <> '')) AS h FROM t),
j AS (SELECT *, CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0 ELSE len(list_intersect(g, h))::DOUBLE / (len(g) + len(h) - len(list_intersect(g, h))) END AS overlap FROM w)
SELECT conv_id, turn, CASE WHEN regexp_full_match(gold, '\\s*\\d+(\\.\\d+)?\\s*') THEN 'aggregation_failure' WHEN overlap >= 0.5 THEN 'generation_failure' ELSE 'missing_recall' END AS class, round(overlap, 6) AS overlap FROM j""".replace("\\\\", "\\"))
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as the gold answer and the next turn as the answer given."""
    c = X.table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    df = c.select("conv_id", "turn", F.col("text").alias("gold")).join(nxt, ["conv_id", "turn"]).withColumn("retrieved", F.lit(True))
    return E.taxonomy(df).select("conv_id", "turn", "class", r6("overlap").alias("overlap"))


@query("SELECT id, memory_type FROM (SELECT id, memory_type, row_number() OVER (PARTITION BY memory_type ORDER BY id) AS k FROM records) WHERE k <= 25")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 of each type."""
    return E.first_of_each(X.records(spark, sf), "memory_type", "id", 25).select("id", "memory_type")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", views=False)
def tumbling_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tumbling(jobs.with_time(X.table(spark, sf, "events")), "1 hour").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) - k * 3600000000 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 3) r(k) GROUP BY ALL", views=False)
def sliding_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tumbling(jobs.with_time(X.table(spark, sf, "events")), "3 hours", "1 hour").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""", views=False)
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sessions(jobs.with_time(X.table(spark, sf, "events")), "6 hours")


@query("SELECT id, count(*) AS retrieved, count(*) FILTER (useful) AS useful, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (useful)::DOUBLE / count(*), 6) END AS precision FROM (SELECT unnest(result_ids) AS id, useful FROM revents) GROUP BY id")
def stream_feedback_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.feedback(X.events(spark, sf)).withColumn("precision", r6("precision"))


@query("SELECT user_id AS session, event_type AS tool, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2", views=False)
def tool_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tool_counts(X.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("tool")), 2)
