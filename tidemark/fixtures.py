"""Views of the given tables as records, chunks, edges, events and queries, for the registered queries.

Each Spark view has its equal in SQL (VIEWS), which the checks prepend to a query's own SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import records as M
from tidemark.operators import search

BASE, NOW = "2023-12-01 00:00:00", "2024-02-01 00:00:00"
TYPES = ("decision", "pattern", "error", "context", "architecture", "preference")
CLASSES = {"error": "missing_content", "click": "vocabulary_mismatch", "view": "stale_ranking", "purchase": "scope_mismatch"}


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def now() -> Column:
    return ntz(NOW)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    hours = lambda h: ntz(BASE) + F.make_dt_interval(hours=h.cast("int"))
    created = hours(i)
    return d.select(
        i.alias("id"), F.col("text").alias("content"), F.col("lang").alias("project"), F.element_at(F.array(*map(F.lit, TYPES)), (i % 6 + 1).cast("int")).alias("memory_type"), (i % 5).cast("int").alias("importance"),
        F.array(F.col("lang"), F.col("source"), F.concat(F.lit("sid:"), (i % 40).cast("string"))).alias("tags"), created.alias("created_at"), hours(i + i % 48).alias("updated_at"), hours(i + i % 72).alias("last_accessed"),
        (i % 4).alias("access_count"), F.when(i % 7 != 0, created).alias("valid_from"), F.when(i % 23 == 0, hours(i + 240)).alias("valid_to"), (i % 31 == 0).alias("immutable"), F.when(i % 29 == 0, hours(i + 480)).alias("expires_at"),
        F.when(i % 101 == 0, F.lit("damaged")).otherwise(F.sha2("text", 256)).alias("content_hash"), F.when(i % 3 != 0, F.substring("text", 1, 80)).alias("summary"), (i % 13).alias("times_retrieved"),
        F.when(i % 4 != 0, (i % 10) / 10.0).alias("retrieval_precision"), ((i % 17) / 8.0).alias("dynamic_importance"), (i % 5 * 24 + 24).alias("retrieval_interval_hrs"), hours(i + 700).alias("next_review_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("project"), F.substring("text", 1, 300).alias("chunk_text")), "vec_id").select(
        i.alias("chunk_id"), i.alias("memory_id"), "project", "chunk_text", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("cluster_id"), F.when(i % 5 != 0, ntz(BASE)).alias("last_matched")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document relates to the one 20 further on (the next of its source); every eleventh contradicts the one 7 on."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id")
    a = d.select(i.alias("source_id"), (i + 20).alias("target_id"), F.lit("relates_to").alias("rel_type"), ((i % 10) / 10.0).alias("strength"))
    return a.union(d.where(i % 11 == 0).select(i, i + 7, F.lit("contradicts"), F.lit(0.5)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    cls = F.when(kind == "error", CLASSES["error"])
    for k, v in list(CLASSES.items())[1:]:
        cls = cls.when(kind == k, v)
    u = F.col("event_id")
    return e.select("event_id", (F.col("user_id") % 5).cast("string").alias("project"), "user_id", F.col("ts").alias("created_at"), cls.alias("failure_class"), F.array(u * 7 % 200, (u * 7 + 1) % 200, (u * 7 + 2) % 200).alias("result_ids"), (F.col("value") > 50).alias("useful"), "event_type", "value")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark: SparkSession, sf_dir: str, terms: DataFrame | None = None) -> DataFrame:
    """Postings of the live records: closed ones take no candidate's place."""
    return search.postings(M.live(records(spark, sf_dir)), terms)


def searched(spark: SparkSession, sf_dir: str, group: Column | None = None) -> DataFrame:
    """(id, content) of the live records, for searches that need no postings; with their group, if one is named."""
    by = [] if group is None else [group.alias("group")]
    return M.live(records(spark, sf_dir)).select("id", "content", *by)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_H = f"TIMESTAMP '{BASE}' + "
VIEWS = f"""
WITH records AS (
  SELECT doc_id AS id, text AS content, lang AS project, [{', '.join(f"'{x}'" for x in TYPES)}][CAST(doc_id % 6 + 1 AS INTEGER)] AS memory_type, CAST(doc_id % 5 AS INTEGER) AS importance,
    [lang, source, 'sid:' || CAST(doc_id % 40 AS VARCHAR)] AS tags, {_H}to_hours(doc_id) AS created_at, {_H}to_hours(doc_id + doc_id % 48) AS updated_at, {_H}to_hours(doc_id + doc_id % 72) AS last_accessed,
    doc_id % 4 AS access_count, CASE WHEN doc_id % 7 <> 0 THEN {_H}to_hours(doc_id) END AS valid_from, CASE WHEN doc_id % 23 = 0 THEN {_H}to_hours(doc_id + 240) END AS valid_to, doc_id % 31 = 0 AS immutable,
    CASE WHEN doc_id % 29 = 0 THEN {_H}to_hours(doc_id + 480) END AS expires_at, CASE WHEN doc_id % 101 = 0 THEN 'damaged' ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 3 <> 0 THEN substr(text, 1, 80) END AS summary,
    doc_id % 13 AS times_retrieved, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS retrieval_precision, (doc_id % 17) / 8.0::DOUBLE AS dynamic_importance, doc_id % 5 * 24 + 24 AS retrieval_interval_hrs, {_H}to_hours(doc_id + 700) AS next_review_at
  FROM documents),
chunks AS (
  SELECT vec_id AS chunk_id, vec_id AS memory_id, lang AS project, substr(text, 1, 300) AS chunk_text, embedding::DOUBLE[] AS embedding, label AS cluster_id, CASE WHEN vec_id % 5 <> 0 THEN TIMESTAMP '{BASE}' END AS last_matched
  FROM embeddings JOIN documents ON vec_id = doc_id),
edges AS (
  SELECT doc_id AS source_id, doc_id + 20 AS target_id, 'relates_to' AS rel_type, (doc_id % 10) / 10.0::DOUBLE AS strength FROM documents
  UNION ALL SELECT doc_id, doc_id + 7, 'contradicts', 0.5::DOUBLE FROM documents WHERE doc_id % 11 = 0),
revents AS (
  SELECT event_id, CAST(user_id % 5 AS VARCHAR) AS project, user_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'missing_content' WHEN 'click' THEN 'vocabulary_mismatch' WHEN 'view' THEN 'stale_ranking' WHEN 'purchase' THEN 'scope_mismatch' END AS failure_class,
    [event_id * 7 % 200, (event_id * 7 + 1) % 200, (event_id * 7 + 2) % 200] AS result_ids, value > 50 AS useful, event_type, value FROM events),
queries AS (SELECT item_id AS query_id, text FROM benchmark),
qvectors AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 20 = 0),
both_ways AS (
  SELECT source_id AS id, target_id AS other, rel_type, strength, 'outgoing' AS direction FROM edges
  UNION ALL SELECT target_id, source_id, rel_type, strength, 'incoming' FROM edges WHERE source_id <> target_id),
knn AS (
  SELECT query_id, chunk_id, memory_id, round(coalesce(list_cosine_similarity(vector, embedding), 0), 6) AS cosine FROM qvectors, chunks),
postings AS (
  SELECT term, id, list_sum(list_transform(range(1, least(tf, 256) + 1), lambda i: 1.0::DOUBLE / (i * i))) AS weight
  FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) AS term FROM records WHERE valid_to IS NULL) WHERE term <> '' GROUP BY ALL)),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM queries) WHERE term <> ''),
lexical AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM terms JOIN postings USING (term) GROUP BY ALL)
"""
