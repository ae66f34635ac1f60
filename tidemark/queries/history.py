"""Changes, maintenance and knowledge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixtures as X
from tidemark.operators import graph, knowledge, rank, records as M, search
from tidemark.queries.analytics import _DOM
from tidemark.operators import aggregate as A
from tidemark.registry import query

r6 = lambda c: F.round(c, 6)
text = lambda c: F.col(c).cast("string").alias(c)


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as the versions of a record."""
    return X.table(spark, sf, "orders").select(F.col("o_custkey").alias("memory_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("system_from"), F.col("o_totalprice").alias("content"))


@query("SELECT o_custkey AS memory_id, o_orderkey AS version_id, CAST(CAST(lead(o_orderdate) OVER w AS DATE) AS VARCHAR) AS system_to, row_number() OVER w AS version_no FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", views=False)
def version_chain(spark: SparkSession, sf: str) -> DataFrame:
    return M.version_chain(_versions(spark, sf)).select("memory_id", "version_id", F.col("system_to").cast("date").cast("string").alias("system_to"), "version_no")


@query("SELECT o_custkey AS memory_id, o_orderkey AS version_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", views=False)
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest(_versions(spark, sf), ["memory_id"], [F.desc("system_from"), F.desc("version_id")]).select("memory_id", "version_id")


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_custkey AS memory_id, min(o_orderkey) AS version_id FROM orders GROUP BY ALL", views=False)
def chrono_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One entry for each day and subject."""
    v = _versions(spark, sf).withColumn("day", F.col("system_from").cast("date").cast("string"))
    return M.latest(v, ["day", "memory_id"], [F.col("version_id")]).select("day", "memory_id", "version_id")


@query(f"SELECT id, CAST(CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND valid_to IS NULL AND NOT immutable THEN TIMESTAMP '{X.NOW}' ELSE valid_to END AS VARCHAR) AS valid_to FROM records")
def soft_delete_next_state(spark: SparkSession, sf: str) -> DataFrame:
    """Records labelled toxic are forgotten."""
    bad = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return M.soft_deleted(X.records(spark, sf), bad, X.now(), "toxic").select("id", text("valid_to"))


@query("""WITH n AS (SELECT l_orderkey % 200 AS source_id, (l_orderkey % 200 + 20) AS target_id, 'relates_to' AS rel_type, l_quantity / 100.0::DOUBLE AS strength, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
a AS (SELECT id FROM records WHERE valid_to IS NULL), ok AS (SELECT n.* FROM n JOIN a x ON x.id = source_id JOIN a y ON y.id = target_id),
u AS (SELECT source_id, target_id, rel_type, strength, -1 AS seq FROM edges UNION ALL SELECT * FROM ok) SELECT source_id, target_id, rel_type, round(arg_max(strength, (seq, strength)), 6) AS strength FROM u GROUP BY ALL""")
def edge_upsert_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a log of edge strengths, the last line of an edge being the one that counts."""
    li, o = X.table(spark, sf, "lineitem"), F.col("l_orderkey")
    new = li.select((o % 200).alias("source_id"), (o % 200 + 20).alias("target_id"), F.lit("relates_to").alias("rel_type"), (F.col("l_quantity") / 100.0).alias("strength"), (o * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.upserted(X.edges(spark, sf), new, M.live(X.records(spark, sf))).withColumn("strength", r6("strength"))


@query("SELECT source_id, target_id, rel_type, round(greatest(0, strength - 0.02), 6) AS strength FROM edges WHERE round(greatest(0, strength - 0.02), 9) >= 0.1")
def edge_decay_prune(spark: SparkSession, sf: str) -> DataFrame:
    return graph.decayed(X.edges(spark, sf)).withColumn("strength", r6("strength"))


@query(f"SELECT id FROM records WHERE NOT immutable AND ((importance >= 3 AND last_accessed < TIMESTAMP '{X.NOW}' - INTERVAL 40 DAY AND access_count = 0) OR coalesce(expires_at < TIMESTAMP '{X.NOW}', false))")
def stale_prune(spark: SparkSession, sf: str) -> DataFrame:
    return M.stale(X.records(spark, sf), X.now(), 40).select("id")


@query(f"SELECT id, round(CASE WHEN next_review_at < TIMESTAMP '{X.NOW}' THEN greatest(0.1, dynamic_importance * 0.95) ELSE dynamic_importance END, 6) AS dynamic_importance, CAST(CASE WHEN next_review_at < TIMESTAMP '{X.NOW}' THEN next_review_at + to_hours(retrieval_interval_hrs) ELSE next_review_at END AS VARCHAR) AS next_review_at FROM records")
def importance_decay(spark: SparkSession, sf: str) -> DataFrame:
    return M.decayed(X.records(spark, sf), X.now()).select("id", r6("dynamic_importance").alias("dynamic_importance"), text("next_review_at"))


@query(f"SELECT r.id, r.access_count + coalesce(n, 0) AS access_count, CAST(CASE WHEN n IS NOT NULL THEN TIMESTAMP '{X.NOW}' ELSE last_accessed END AS VARCHAR) AS last_accessed FROM records r LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT unnest(result_ids) AS id FROM revents) GROUP BY id) h ON h.id = r.id")
def touch_results(spark: SparkSession, sf: str) -> DataFrame:
    hits = X.events(spark, sf).select(F.explode("result_ids").alias("id"))
    return M.touched(X.records(spark, sf), hits, X.now()).select("id", "access_count", text("last_accessed"))


_NEG = " OR ".join("contains({0}, '" + p.replace("'", "''") + "')" for p in ("not ", "no ", "never ", "does not", "do not", "is not", "are not", "cannot", "can't", "don't", "doesn't", "isn't", "won't", "wasn't", "weren't", "didn't", "hasn't", "haven't", "hadn't"))
_PAST = " OR ".join("contains({0}, '" + p + "')" for p in ("was ", "were ", "previously ", "used to ", "had been ", "no longer "))
_PRES = " OR ".join("contains({0}, '" + p + "')" for p in (" is ", " are ", " now ", "currently ", "today "))
_SIGNIF = "list_filter(list_distinct(list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: len(w) > 3)), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in knowledge.PLAIN_WORDS) + "], w))"
_V = r"'v?\d+\.\d+(?:\.\d+)*'"
#: A line put at the end of even and odd records, so that the rules meet what they look for.
_SAYS = ("The harbour engine and window market bridge does not open", "The harbour engine and window market bridge does open")
_CONTRA = f"""WITH parts AS (SELECT DISTINCT id, line, created_at FROM (SELECT id, unnest(string_split(content || chr(10) || CASE WHEN id % 2 = 0 THEN '{_SAYS[0]}' ELSE '{_SAYS[1]}' END, chr(10))) AS line, created_at FROM records WHERE valid_to IS NULL) WHERE strlen(line) BETWEEN 1 AND 400),
p AS (SELECT a.id AS a, b.id AS b, lower(a.line) AS x, lower(b.line) AS y, a.created_at AS ta, b.created_at AS tb FROM edges JOIN parts a ON a.id = source_id JOIN parts b ON b.id = target_id),
q AS (SELECT *, len(list_intersect({_SIGNIF.format('x')}, {_SIGNIF.format('y')})) AS shared, ({_NEG.format('x')}) AS nx, ({_NEG.format('y')}) AS ny, ({_PAST.format('x')}) AS px, ({_PAST.format('y')}) AS py, ({_PRES.format('x')}) AS cx, ({_PRES.format('y')}) AS cy, regexp_extract_all(x, {_V}) AS vx, regexp_extract_all(y, {_V}) AS vy,
  len(list_intersect({_SIGNIF.format(f"regexp_replace(x, {_V}, '', 'g')")}, {_SIGNIF.format(f"regexp_replace(y, {_V}, '', 'g')")})) AS sharedv FROM p),
c AS (SELECT *, (shared >= 5 AND nx <> ny) OR (len(vx) > 0 AND len(vy) > 0 AND sharedv >= 3 AND NOT (len(vx) = len(vy) AND len(list_filter(vy, lambda v: NOT list_contains(vx, v))) = 0)) OR (shared >= 4 AND ((px AND cy AND NOT py) OR (py AND cx AND NOT px))) AS contra FROM q)"""


def _contra(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours along edges of which two paragraphs of at most 400 bytes contradict each other; all paragraphs are read."""
    r = M.live(X.records(spark, sf)).select("id", F.explode(F.split(F.concat("content", F.lit("\n"), F.when(F.col("id") % 2 == 0, _SAYS[0]).otherwise(_SAYS[1])), "\n")).alias("c")).where(F.octet_length("c").between(1, 400)).distinct()
    side = lambda k: r.select(F.col("id").alias(k), F.col("c").alias(f"{k}_c"))
    e = X.edges(spark, sf).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return e.join(side("a"), "a").join(side("b"), "b").where(knowledge.contradicts(F.col("a_c"), F.col("b_c"))).select("a", "b").distinct()


@query(_CONTRA + " SELECT DISTINCT a, b FROM c WHERE contra")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return _contra(spark, sf)


@query(_CONTRA + " SELECT DISTINCT CASE WHEN ta > tb THEN a ELSE b END AS winner, CASE WHEN ta > tb THEN b ELSE a END AS loser FROM c WHERE contra AND abs(epoch(ta) - epoch(tb)) > 5 * 3600")
def auto_supersede(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.superseded(_contra(spark, sf), X.records(spark, sf), 5)


@query("""WITH l AS (SELECT query_id, id, score, importance FROM lexical JOIN records USING (id)), s AS (SELECT query_id, 1 AS run, list(id ORDER BY score DESC, id) AS ids FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20) GROUP BY query_id
  UNION ALL SELECT query_id, 2, list(id ORDER BY t DESC, id) FROM (SELECT query_id, id, round(score * (5 - importance), 6) AS t FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY t DESC, id) <= 20) GROUP BY query_id),
p AS (SELECT *, lag(ids) OVER (PARTITION BY query_id ORDER BY run) AS prev FROM s), q AS (SELECT query_id, run, ids, prev, least(len(ids), len(prev)) AS n FROM p WHERE prev IS NOT NULL)
SELECT query_id, run, round(0.1::DOUBLE * list_sum(list_transform(range(1, greatest(len(ids), len(prev)) + 1), lambda d: len(list_intersect(ids[1:d], prev[1:d]))::DOUBLE / d * pow(0.9::DOUBLE, d - 1))), 6) AS rbo,
  round(len(list_intersect(ids[1:least(n, 5)], prev[1:least(n, 5)]))::DOUBLE / len(list_distinct(list_concat(ids[1:least(n, 5)], prev[1:least(n, 5)]))), 6) AS jaccard_5, round(len(list_intersect(ids[1:n], prev[1:n]))::DOUBLE / len(list_distinct(list_concat(ids[1:n], prev[1:n]))), 6) AS jaccard_full,
  len(list_filter(ids, lambda i: NOT list_contains(prev, i))) AS added FROM q""")
def drift_rbo_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings by lexical score, and by the score weighed with importance, as two runs."""
    r = X.records(spark, sf)
    # A record's weight is that of its importance, so twenty of each importance hold the best twenty of both runs.
    hits = search.lexical(X.queries(spark, sf), X.searched(spark, sf, F.col("importance")), 20).join(r.select("id", "importance"), "id")
    ids = lambda df, run: rank.ranked(df, k=20).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids")).withColumn("run", F.lit(run))
    d = knowledge.drift(ids(hits, 1).unionByName(ids(hits.withColumn("score", r6(F.col("score") * (5 - F.col("importance")))), 2)))
    return d.select("query_id", "run", r6("rbo").alias("rbo"), r6("jaccard_5").alias("jaccard_5"), r6("jaccard_full").alias("jaccard_full"), F.size("added").cast("long").alias("added"))


_B = knowledge.BOUNDS
_NEW = {k: "CASE top_class " + " ".join(f"WHEN '{c}' THEN least(greatest({knowledge.START[k] + d.get(k, 0.0)!r}::DOUBLE, {lo}), {hi})" for c, d in knowledge.DELTAS.items()) + " END" for k, (lo, hi) in _B.items()}


@query(_DOM + f""", w AS (SELECT project, top_class, {', '.join(f'{v}::DOUBLE AS {k}' for k, v in _NEW.items())} FROM d WHERE total >= 20 AND top_share >= 0.2 AND top_share - next_share >= 0.0001 AND top_class IN ('stale_ranking', 'vocabulary_mismatch', 'scope_mismatch')),
x AS (SELECT *, 1 - ({' + '.join(_B)}) AS rest FROM w), y AS (SELECT *, {', '.join(f'greatest(CASE WHEN rest > 0 THEN {hi} - {k} ELSE {k} - {lo} END, 0)::DOUBLE AS room_{k}' for k, (lo, hi) in _B.items())} FROM x)
SELECT project, top_class, {', '.join(f'round(CASE WHEN abs(rest) < 1e-9 THEN {k} ELSE {k} + rest * room_{k} / ({" + ".join("room_" + j for j in _B)}) END, 6) AS {k}' for k in _B)} FROM y""")
def weight_tuner(spark: SparkSession, sf: str) -> DataFrame:
    """With low thresholds, as the events' classes are about even."""
    d = knowledge.tuned(A.failure_dominance(X.events(spark, sf), X.now()), 20, 0.2, 0.0001)
    return d.select("project", "top_class", *[r6(k).alias(k) for k in _B])
