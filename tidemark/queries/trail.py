"""Queries over the trail of retrievals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.operators import rank, search, trail as T, writes as W
from tidemark.registry import query

r6 = lambda c: F.round(c, 6)


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    """An event's feedback: of useful ones the first two results and a record it may not have returned; every ninth names an event that isn't there."""
    u = F.col("event_id")
    ids = F.when(F.col("useful"), F.array(F.col("result_ids")[0], F.col("result_ids")[1], u * 11 % 200)).otherwise(F.array().cast("array<bigint>"))
    unknown = F.when(u % 9 == 0, -u - 1).otherwise(u)
    return X.events(spark, sf).select(unknown.alias("event_id"), u.alias("seq"), ids.alias("useful_ids"), F.when(u % 2 == 0, F.col("failure_class")).alias("failure_class"))


_FEEDBACK = """feedback AS (SELECT CASE WHEN event_id % 9 = 0 THEN -event_id - 1 ELSE event_id END AS event_id, event_id AS seq,
  CASE WHEN useful THEN [result_ids[1], result_ids[2], event_id * 11 % 200] ELSE [] END AS useful_ids, CASE WHEN event_id % 2 = 0 THEN failure_class END AS failure_class FROM revents),
known AS (SELECT f.*, result_ids FROM feedback f JOIN revents USING (event_id))"""


@query("""WITH h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lexical QUALIFY rank <= 10)
SELECT q.query_id, q.text AS query, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank), '') AS result_ids FROM queries q LEFT JOIN h USING (query_id) GROUP BY ALL""")
def recall_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events that lexical recall leaves, the ten best records of each query by rank."""
    q = X.queries(spark, sf)
    hits = rank.ranked(search.lexical(q, X.searched(spark, sf), 10), k=10)
    e = T.events_of(hits, q.withColumn("project", F.lit("all")), X.now())
    return e.select("query_id", "query", F.array_join(F.col("result_ids").cast("array<string>"), ",").alias("result_ids"))


@query("""WITH n AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT event_id, unnest(result_ids) AS id FROM revents) GROUP BY id)
SELECT id, times_retrieved + coalesce(n, 0) AS times_retrieved FROM records LEFT JOIN n USING (id)""")
def retrieval_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.retrieved(X.records(spark, sf), X.events(spark, sf)).select("id", "times_retrieved")


@query(f"""WITH {_FEEDBACK}, got AS (SELECT id, max(seq) AS last FROM (SELECT unnest(result_ids) AS id, seq FROM known) GROUP BY id),
marks AS (SELECT DISTINCT seq, unnest(useful_ids) AS id FROM known),
n AS (SELECT id, count(*) AS n, count(*) FILTER (seq <= last) AS then_n FROM marks LEFT JOIN got USING (id) GROUP BY id)
SELECT id, coalesce(n, 0) AS times_useful, round(CASE WHEN last IS NOT NULL AND times_retrieved >= 5 THEN coalesce(then_n, 0)::DOUBLE / times_retrieved ELSE retrieval_precision END, 6) AS retrieval_precision
FROM records LEFT JOIN got USING (id) LEFT JOIN n USING (id)""")
def feedback_precision(spark: SparkSession, sf: str) -> DataFrame:
    r = X.records(spark, sf).withColumn("times_useful", F.lit(0).cast("long"))
    return T.judged(r, X.events(spark, sf), _feedback(spark, sf)).select("id", "times_useful", r6("retrieval_precision").alias("retrieval_precision"))


@query(f"""WITH {_FEEDBACK}, b AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT seq, unnest(useful_ids) AS id FROM known WHERE failure_class IS NULL) GROUP BY id)
SELECT id, round(CASE WHEN n IS NULL THEN dynamic_importance ELSE greatest(0.1, dynamic_importance + 0.1) + 0.1 * (n - 1) END, 6) AS dynamic_importance FROM records LEFT JOIN b USING (id)""")
def feedback_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Importance after useful feedback, of which that with a failure class boosts nothing."""
    reports = T.boosts(X.events(spark, sf), _feedback(spark, sf))
    return W.learned(X.records(spark, sf), reports, X.now()).select("id", r6("dynamic_importance").alias("dynamic_importance"))


@query(f"""WITH {_FEEDBACK} SELECT event_id, array_to_string(f.useful_ids, ',') AS feedback_ids, f.failure_class FROM revents e LEFT JOIN feedback f USING (event_id)""")
def events_with_feedback(spark: SparkSession, sf: str) -> DataFrame:
    e = T.events_answered(X.events(spark, sf), _feedback(spark, sf))
    return e.select("event_id", F.array_join(F.col("feedback_ids").cast("array<string>"), ",").alias("feedback_ids"), "failure_class")


@query(f"WITH {_FEEDBACK} SELECT f.event_id, seq FROM feedback f ANTI JOIN revents e ON e.event_id = f.event_id")
def feedback_on_unknown_events(spark: SparkSession, sf: str) -> DataFrame:
    return T.unanswerable(X.events(spark, sf), _feedback(spark, sf)).select("event_id", "seq")


_SETS = """sets AS (SELECT DISTINCT set_id, id, valid_to FROM (SELECT user_id AS set_id, unnest(result_ids) AS id FROM revents) JOIN records USING (id)),
pairs AS (SELECT x.set_id, x.id AS a, y.id AS b, strength FROM edges JOIN sets x ON x.id = source_id JOIN sets y ON y.id = target_id AND y.set_id = x.set_id WHERE rel_type = 'contradicts')"""


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """What a user's retrievals returned."""
    return X.events(spark, sf).select(F.col("user_id").alias("set_id"), F.explode("result_ids").alias("id"))


@query(f"""WITH {_SETS}, n AS (SELECT set_id, count(*) AS n FROM pairs GROUP BY set_id)
SELECT set_id, count(*) AS records, count(valid_to) AS invalidated, coalesce(max(n), 0) AS conflicts, round(1.0::DOUBLE / (1 + coalesce(max(n), 0)), 6) AS confidence FROM sets LEFT JOIN n USING (set_id) GROUP BY set_id""")
def evidence_maps(spark: SparkSession, sf: str) -> DataFrame:
    return T.evidence_maps(_sets(spark, sf), X.records(spark, sf), X.edges(spark, sf)).withColumn("confidence", r6("confidence"))


@query(f"WITH {_SETS} SELECT set_id, a, b, strength FROM pairs")
def conflict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    live = X.records(spark, sf).select("id")
    return T.conflicts(_sets(spark, sf).join(live, "id", "left_semi"), X.edges(spark, sf))
