"""Atoms, spans, stored indexes and counting over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.functions.stem import stems_sql
from tidemark.operators import ann, atoms, index, records as M, spans
from tidemark.registry import query
from tidemark.session import new_folder

_ATOMS = f"""WITH RECURSIVE a AS (
  SELECT event_id AS id, CAST(user_id % 50 AS VARCHAR) AS subject, event_type AS type, CAST(floor(value / 25) AS VARCHAR) AS value, event_id % 10 / 10.0::DOUBLE AS confidence, event_id AS seq, CASE WHEN event_id % 9 <> 0 THEN ts ELSE TIMESTAMP '{X.NOW}' END AS asserted, CASE WHEN event_id % 4 = 0 THEN ts - to_days(CAST(event_id % 3 AS INTEGER)) END AS valid_from
  FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'event' WHEN 'view' THEN 'status_change' WHEN 'error' THEN 'preference' ELSE 'fact' END AS event_type, value, ts FROM events)),
k AS (SELECT *, row_number() OVER (PARTITION BY subject, type, value, CASE WHEN type = 'event' THEN CAST(valid_from AS DATE) END ORDER BY seq) AS nth FROM a),
n AS (SELECT *, coalesce(valid_from, asserted) AS start, CAST(valid_from AS DATE) AS day, row_number() OVER (PARTITION BY subject, type ORDER BY CASE WHEN type = 'status_change' THEN asserted END, seq) AS rn FROM k WHERE nth = 1),
f AS (
  SELECT subject, type, rn, id, 'fresh' AS status, CAST(NULL AS BIGINT) AS old_id, CAST(NULL AS TIMESTAMP) AS retired_at, CASE WHEN type <> 'event' THEN id END AS c_id, CASE WHEN type <> 'event' THEN value END AS c_value, CASE WHEN type <> 'event' THEN confidence END AS c_conf, CASE WHEN type <> 'event' THEN start END AS c_start FROM n WHERE rn = 1
  UNION ALL
  SELECT n.subject, n.type, n.rn, n.id, s.status, CASE WHEN s.status = 'supersedes' THEN c_id END, CASE WHEN s.status = 'supersedes' THEN n.asserted END,
    CASE WHEN s.status = 'supersedes' OR (c_id IS NULL AND n.type <> 'event') THEN n.id ELSE c_id END, CASE WHEN s.status = 'supersedes' OR (c_id IS NULL AND n.type <> 'event') THEN n.value ELSE c_value END,
    CASE WHEN s.status = 'supersedes' OR (c_id IS NULL AND n.type <> 'event') THEN n.confidence ELSE c_conf END, CASE WHEN s.status = 'supersedes' OR (c_id IS NULL AND n.type <> 'event') THEN n.start ELSE c_start END
  FROM f JOIN n ON n.subject = f.subject AND n.type = f.type AND n.rn = f.rn + 1,
  LATERAL (SELECT CASE WHEN c_id IS NULL THEN 'fresh' WHEN n.value = c_value THEN 'duplicate' WHEN n.type = 'event' OR n.confidence + 0.2 + 1e-9 < c_conf OR n.asserted < c_start THEN 'fresh' ELSE 'supersedes' END AS status) s)
SELECT id, status, old_id, strftime(retired_at, '%Y-%m-%d %H:%M:%S.%f') AS retired_at FROM f UNION ALL SELECT id, 'repeated', NULL, NULL FROM k WHERE nth > 1"""


@query(_ATOMS, views=False)
def atom_supersession(spark: SparkSession, sf: str) -> DataFrame:
    """Events as assertions: clicks are events, views status changes, errors preferences, all else facts about one of 50 subjects."""
    e, i = X.table(spark, sf, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "event").when(F.col("event_type") == "view", "status_change").when(F.col("event_type") == "error", "preference").otherwise("fact")
    rows = e.select(
        i.alias("id"), F.lit("p").alias("project"), kind.alias("type"), (F.col("user_id") % 50).cast("string").alias("subject"), F.lit("level").alias("predicate"), F.floor(F.col("value") / 25).cast("string").alias("value"), (i % 10 / 10.0).alias("confidence"),
        i.alias("seq"), F.when(i % 9 != 0, F.col("ts")).alias("asserted"), F.when(i % 4 == 0, F.col("ts") - F.make_dt_interval(days=(i % 3).cast("int"))).alias("valid_from"),
    )
    return atoms.folded(rows, X.now()).withColumn("retired_at", F.date_format("retired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_SPANS = """, asked AS (SELECT id, content, [x FOR x IN [w[3], w[10]] IF x <> ''] AS subs FROM (SELECT id, content, string_split(content, ' ') AS w FROM records) WHERE id % 3 <> 0),
hits AS (SELECT id, sub, strlen(content) AS size, string_split(content, sub) AS parts FROM (SELECT id, content, unnest(list_distinct(subs)) AS sub FROM asked)),
places AS (SELECT id, sub, size, CAST(list_sum(list_transform(parts[1 : k], lambda x: strlen(x))) AS BIGINT) + (k - 1) * strlen(sub) AS start FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM hits)),
windows AS (SELECT id, greatest(0, start - 150) AS start, least(start + strlen(sub) + 150, size) AS stop, sub AS matched FROM places),
marked AS (SELECT *, CASE WHEN start <= max(stop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM windows WINDOW w AS (PARTITION BY id ORDER BY start, stop, matched)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY start, stop, matched ROWS UNBOUNDED PRECEDING) AS island FROM marked),
joined AS (SELECT id, min(start) AS start, max(stop) AS stop, arg_min(matched, (start, stop, matched)) AS matched FROM islands GROUP BY id, island
  UNION ALL SELECT id, 0, least(300, strlen(content)), NULL FROM records WHERE (id % 3 = 0 OR id IN (SELECT id FROM asked WHERE len(subs) = 0)) AND strlen(content) > 0),
sums AS (SELECT *, 1200 - coalesce(sum(stop - start) OVER (PARTITION BY id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM joined),
flags AS (SELECT *, bool_or(stop - start > room) OVER (PARTITION BY id) AS truncated FROM sums),
raws AS (SELECT f.*, hex(encode(content)) AS raw FROM flags f JOIN records USING (id) WHERE room > 0),
lens AS (SELECT *, CASE WHEN stop - start <= room THEN stop - start ELSE list_max([r FOR r IN [room, room - 1, room - 2, room - 3] IF NOT regexp_matches(substr(raw, CAST(2 * (start + r) + 1 AS BIGINT), 1), '[89AB]')]) END AS bytes FROM raws)
SELECT id AS query_id, id, CAST(start AS BIGINT) AS "offset", CAST(bytes AS BIGINT) AS bytes, matched, truncated, substr(raw, CAST(2 * start + 1 AS BIGINT), CAST(2 * bytes AS BIGINT)) AS raw FROM lens WHERE bytes > 0"""


@query("WITH asked0 AS (SELECT 1)" + _SPANS)
def document_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Records asked for two of their own words, windows of 300 bytes, 1200 bytes a record; every third record without a filter."""
    w = F.split("content", " ")
    subs = F.when(F.col("id") % 3 != 0, F.array_distinct(F.filter(F.array(F.get(w, F.lit(2)), F.get(w, F.lit(9))), lambda x: x != "")))
    asked = X.records(spark, sf).select(F.col("id").alias("query_id"), "id", "content", F.lit(None).cast("string").alias("pattern"), subs.alias("subs"))
    return spans.document_spans(asked, 300, 300).withColumn("raw", F.hex("text")).drop("text")


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_STEMMED = f""", sposts AS (SELECT term, id, list_sum(list_transform(range(1, least(tf, 256) + 1), lambda i: 1.0::DOUBLE / (i * i))) AS weight
  FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({stems_sql(_WORDS.format('content'))}) AS term FROM records WHERE valid_to IS NULL {{0}}) GROUP BY ALL)),
sterms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({stems_sql(_WORDS.format('text'))}) AS term FROM queries)),
sscored AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM sterms JOIN sposts USING (term) GROUP BY ALL)
SELECT query_id, id, score FROM sscored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"""
#: Folders of indexes that this session has built, by application and tables.
_KEPT: dict[tuple[str, str], str] = {}


def _kept(spark: SparkSession, sf: str) -> str:
    """The index of all live records, built when it is first asked for and kept for the session's other queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        path = new_folder(spark, "index")
        index.build(M.live(X.records(spark, sf)).select("id", "content"), path)
        _KEPT[key] = path
    return _KEPT[key]


@query("WITH s0 AS (SELECT 1)" + _STEMMED.format(""))
def stemmed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item's ten best records by stems, from the kept index: only its terms' buckets and promising blocks are read."""
    return index.search(X.queries(spark, sf), _kept(spark, sf), 10)


@query("WITH s0 AS (SELECT 1)" + _STEMMED.format("AND id % 17 <> 5"))
def updated_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same after the index has been built from two thirds of the records with other contents, and told of the rest, of new contents and of closed records."""
    live, path = M.live(X.records(spark, sf)).select("id", "content"), new_folder(spark, "index")
    index.build(live.where("id % 3 <> 0").withColumn("content", F.when(F.col("id") % 2 == 0, F.col("content")).otherwise(F.reverse("content"))), path)
    index.update(live.where("id % 3 = 0 or id % 2 = 1"), live.where("id % 17 = 5").select("id"), path)
    return index.search(X.queries(spark, sf), path, 10)


@query("WITH s0 AS (SELECT 1)" + _STEMMED.format("AND id % 17 <> 5"))
def compacted_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same once more, after generations have been merged."""
    live, path, to = M.live(X.records(spark, sf)).select("id", "content"), new_folder(spark, "index"), new_folder(spark, "index")
    index.build(live.where("id % 3 <> 0"), path)
    index.update(live.where("id % 3 = 0"), live.where("id % 17 = 5").select("id"), path)
    index.compact(spark, path, to)
    return index.search(X.queries(spark, sf), to, 10)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query()
def ivfpq_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with id divisible by 20 against all, through cells and codes; tests hold its recall against the exact search."""
    v, path = vectors(spark, sf), new_folder(spark, "cells")
    ann.build(v, path, ann.train(v))
    found = ann.search(X.query_vectors(spark, sf), v, path, 10, ann.probes_for(v, path))
    return found.select("query_id", F.col("id").alias("chunk_id"), "cosine", "rank")
