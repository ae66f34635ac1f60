"""Reports over retrieval by questions and over scored attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.functions import ranking as K
from tidemark.operators import rank, reports as R, search
from tidemark.queries.analytics import _EVAL, _eval
from tidemark.registry import query

r6 = lambda c: F.round(c, 6).alias(c)
_KINDS = "[" + ", ".join(f"'{k}'" for k in R.KINDS) + "]"
_GAIN = "list_sum(list_transform(range(1, least(wanted, {0}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1)))"
_ITEMS = f"""WITH kinds AS (SELECT query_id, CASE WHEN query_id % 5 <> 0 THEN {_KINDS}[CAST(query_id % 4 AS INTEGER) + 1] END AS kind FROM queries),
h AS (SELECT query_id, CAST(id % 40 AS VARCHAR) AS session, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM lexical QUALIFY k <= 20),
gold AS (SELECT DISTINCT query_id, CAST(unnest([query_id * 7 % 40, query_id * 3 % 40]) AS VARCHAR) AS session FROM queries),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM (SELECT query_id, session, min(k) AS first, count(*) AS n FROM h GROUP BY query_id, session)),
m AS (SELECT query_id, min(first) FILTER (g.session IS NOT NULL) AS gold_rank, count(g.session) AS met, max(n)::DOUBLE / sum(n) AS dominance,
  {', '.join(f"coalesce(sum(1.0::DOUBLE / log2(place + 1)) FILTER (g.session IS NOT NULL AND place <= {k}), 0) AS dcg_{k}, count(*) FILTER (g.session IS NOT NULL AND place <= {k}) > 0 AS any_{k}" for k in R.DEPTHS)}
  FROM o LEFT JOIN gold g USING (query_id, session) GROUP BY query_id),
items AS (SELECT query_id, kind, coalesce(gold_rank, 0) AS gold_rank, gold_rank IS NOT NULL AS in_context, coalesce(met = wanted, false) AS all_in_context, coalesce(gold_rank <= 8, false) AS visible, coalesce(dominance, 0) AS dominance,
  {', '.join(f"CASE WHEN any_{k} THEN 1.0::DOUBLE ELSE 0 END AS recall_{k}, coalesce(dcg_{k} / {_GAIN.format(k)}, 0) AS ndcg_{k}" for k in R.DEPTHS)}
  FROM kinds LEFT JOIN m USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS wanted FROM gold GROUP BY query_id) USING (query_id))"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical recall of each query, with two sessions that its number names as gold and a context of eight."""
    q, i = X.queries(spark, sf), F.col("query_id")
    hits = rank.ranked(search.lexical(q, X.searched(spark, sf), 20), k=20)
    sessions = X.records(spark, sf).select("id", rank.session_of(F.col("tags")).alias("session"))
    gold = q.select("query_id", F.explode(F.array((i * 7 % 40).cast("string"), (i * 3 % 40).cast("string"))).alias("session"))
    kinds = q.select("query_id", F.when(i % 5 != 0, F.element_at(F.array(*map(F.lit, R.KINDS)), (i % 4 + 1).cast("int"))).alias("kind"))
    return R.measured(hits, sessions, gold, kinds, 8)


@query(_ITEMS + " SELECT query_id, kind, gold_rank, in_context, all_in_context, visible, round(dominance, 6) AS dominance, recall_5, recall_10, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10 FROM items")
def question_measures(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).withColumns({c: F.round(c, 6) for c in ("dominance", "ndcg_5", "ndcg_10")})


@query(_ITEMS + f""" SELECT CASE WHEN grouping(k) = 1 THEN 'overall' ELSE k END AS kind, count(*) AS n, round(coalesce(avg(gold_rank) FILTER (gold_rank > 0), 0), 6) AS gold_rank,
  {', '.join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in R.MEASURES if c != "gold_rank")} FROM (SELECT *, coalesce(kind, '_unknown') AS k FROM items) GROUP BY ROLLUP (k)""")
def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.retrieval_report(_items(spark, sf)).select("kind", "n", *map(r6, R.MEASURES))


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as attempts at one question, of four kinds; errors aren't done."""
    e, kind = X.table(spark, sf, "events"), F.col("event_type")
    label = F.when(kind == "purchase", "correct").when(kind == "click", "partial").otherwise("other")
    name = F.element_at(F.array(F.lit("extra"), *map(F.lit, R.KINDS[:3])), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), name.alias("kind"), F.when(kind == "error", "error").otherwise("done").alias("status"), label.alias("label"))


_ATTEMPTS = f"""WITH a AS (SELECT user_id AS query_id, event_id AS seq, (['extra'] || {_KINDS}[1:3])[CAST(user_id % 4 AS INTEGER) + 1] AS kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
  CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'partial' ELSE 'incorrect' END AS label FROM events),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seq DESC) = 1)"""


@query(f"""{_ATTEMPTS}, k AS (SELECT unnest(['overall', 'extra'] || {_KINDS}) AS kind), d AS (SELECT kind, label FROM l WHERE status = 'done' UNION ALL SELECT 'overall', label FROM l WHERE status = 'done')
SELECT kind, count(label) AS total, count(*) FILTER (label = 'correct') AS correct, count(*) FILTER (label = 'partial') AS partial, count(*) FILTER (label = 'incorrect') AS incorrect,
  round(coalesce(count(*) FILTER (label = 'correct')::DOUBLE / nullif(count(label), 0), 0), 6) AS strict, round(coalesce(count(*) FILTER (label IN ('correct', 'partial'))::DOUBLE / nullif(count(label), 0), 0), 6) AS lenient
FROM k LEFT JOIN d USING (kind) GROUP BY kind""", views=False)
def score_report_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return R.score_report(_attempts(spark, sf)).select("kind", "total", "correct", "partial", "incorrect", r6("strict"), r6("lenient"))


@query(f"{_ATTEMPTS} SELECT query_id, seq, kind FROM l WHERE status <> 'done'", views=False)
def failed_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return R.failed(_attempts(spark, sf)).select("query_id", "seq", "kind")


@query(_EVAL + """, m AS (SELECT query_id, list_sum(hit[1:5])::DOUBLE / least(len(found), 5) AS p, coalesce(1.0::DOUBLE / nullif(list_position(hit, 1), 0), 0) AS r,
  list_sum(list_transform(range(1, least(len(hit), 10) + 1), lambda i: hit[i]::DOUBLE / log2(i + 1))) / list_sum(list_transform(range(1, least(len(gold), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS n FROM e)
SELECT count(*) AS queries, round(avg(coalesce(p, 0)), 6) AS precision_5, round(avg(coalesce(r, 0)), 6) AS reciprocal_rank, round(avg(coalesce(n, 0)), 6) AS ndcg_10 FROM queries LEFT JOIN m USING (query_id)""")
def evaluation_averages(spark: SparkSession, sf: str) -> DataFrame:
    f, g = F.col("found"), F.col("gold")
    m = _eval(spark, sf).select("query_id", K.precision_at(f, g, 5).alias("precision_5"), K.reciprocal_rank(f, g).alias("reciprocal_rank"), K.ndcg_at(f, g, 10).alias("ndcg_10"))
    names = ("precision_5", "reciprocal_rank", "ndcg_10")
    return R.averages(m, X.queries(spark, sf), *names).select("queries", *map(r6, names))
