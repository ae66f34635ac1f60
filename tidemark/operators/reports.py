"""Reports over evaluated questions: measures of each by sessions, their means by kind, scores with the last attempt of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E

# Kinds of questions that a score report always lists, in this order.
KINDS = ("single-session-preference", "multi-session", "temporal-reasoning", "single-session-user", "knowledge-update", "single-session-assistant")
#: Depths at which recall and NDCG are told.
DEPTHS = (5, 10)
MEASURES = ("gold_rank", "in_context", "all_in_context", "visible", "dominance", *[f"{m}_{k}" for k in DEPTHS for m in ("recall", "ndcg")])


def measured(hits: DataFrame, sessions: DataFrame, gold: DataFrame, queries: DataFrame, context: int = 0) -> DataFrame:
    """One row for each query (query_id, kind) with MEASURES, from ranked hits (query_id, rank, id), (id, session) and gold (query_id, session).

    Sessions are ranked by their first hit. gold_rank is the rank of the first hit of a gold session, 0 where none is;
    visible: it is within the context (0: unlimited). dominance is the largest session's share of the hits that have a
    session. recall: 1 if a gold session is among the first k. A query without hits, or without gold, has zeros.
    """
    gold = gold.select("query_id", "session").distinct()
    of = hits.join(sessions.select("id", "session").distinct(), "id").groupBy("query_id", "session").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    of = of.join(gold.withColumn("gold", F.lit(True)), ["query_id", "session"], "left")
    of = of.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "session")))
    within = lambda k: F.col("gold") & (F.col("place") <= k)
    gains = [F.coalesce(F.sum(F.when(within(k), 1 / F.log2(F.col("place") + 1.0))), F.lit(0.0)).alias(f"dcg_{k}") for k in DEPTHS]
    recalls = [F.max(F.when(within(k), 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in DEPTHS]
    found = of.groupBy("query_id").agg(F.min(F.when(F.col("gold"), F.col("first"))).alias("gold_rank"), F.count("gold").alias("met"), (F.max("n") / F.sum("n")).alias("dominance"), *gains, *recalls)
    df = queries.join(found, "query_id", "left").join(gold.groupBy("query_id").agg(F.count("*").alias("wanted")), "query_id", "left")
    rank = F.coalesce("gold_rank", F.lit(0)).cast("int")
    best = lambda k: sum((F.when(F.col("wanted") >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.select(
        "query_id", "kind", rank.alias("gold_rank"), (rank > 0).alias("in_context"), F.coalesce(F.col("met") == F.col("wanted"), F.lit(False)).alias("all_in_context"),
        ((rank > 0) & ((F.lit(context) <= 0) | (rank <= context))).alias("visible"), zero(F.col("dominance")).alias("dominance"),
        *[zero(F.col(f"recall_{k}")).alias(f"recall_{k}") for k in DEPTHS], *[zero(F.col(f"dcg_{k}") / F.nullif(best(k), F.lit(0.0))).alias(f"ndcg_{k}") for k in DEPTHS],
    )


def retrieval_report(items: DataFrame) -> DataFrame:
    """Means of measured's rows by kind and overall, by rollup; rows without a kind are of kind _unknown; the mean rank is over found gold only, 0 without any."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("_unknown"))
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    means = [rate(c) for c in MEASURES if c != "gold_rank"]
    out = items.withColumn("kind", kind).rollup("kind").agg(F.grouping("kind").alias("_all"), F.count("*").alias("n"), F.coalesce(F.avg(F.when(F.col("gold_rank") > 0, F.col("gold_rank"))), F.lit(0.0)).alias("gold_rank"), *means)
    return out.withColumn("kind", F.when(F.col("_all") == 1, "overall").otherwise(F.col("kind"))).drop("_all")


def last_attempts(scores: DataFrame) -> DataFrame:
    """The last row of each query_id by seq: an attempt written later counts."""
    return scores.groupBy("query_id").agg(F.max_by(F.struct(*[c for c in scores.columns if c != "query_id"]), "seq").alias("_s")).select("query_id", "_s.*")


def score_report(scores: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Counts and accuracy by kind and overall of the last attempts (query_id, seq, kind, status, label) that are done.

    A label other than correct and partial is incorrect. Each of kinds is listed, with zeros where it has no rows; other
    kinds follow from the rows.
    """
    done = last_attempts(scores).where("status = 'done'")
    label = F.when(F.col("label").isin("correct", "partial"), F.col("label")).otherwise("incorrect")
    told = E.score_report(done.select("kind", label.alias("label")))
    listed = scores.sparkSession.createDataFrame([(k,) for k in ("overall", *kinds)], "kind string")
    full = told.join(F.broadcast(listed), "kind", "full")
    return full.select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "correct", "partial", "incorrect")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("strict", "lenient")])


def failed(scores: DataFrame) -> DataFrame:
    """Last attempts that aren't done."""
    return last_attempts(scores).where(F.coalesce(F.col("status") != "done", F.lit(True)))


def averages(measures: DataFrame, queries: DataFrame, *names: str) -> DataFrame:
    """One row: the means of these measures over all queries; one without measures counts with zeros."""
    mean = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0)).alias(c)
    return queries.select("query_id").distinct().join(measures, "query_id", "left").agg(F.count("*").alias("queries"), *[mean(c) for c in names])
