"""The trail of retrievals: what a recall returned, what was useful of it, and what contradicts itself within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retrievals from which on a record's precision is told.
LEAST_RETRIEVED = 5


def events_of(hits: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """One event for each query (query_id, project, text), also for those without hits: (query_id, project, query, result_ids, created_at).

    hits: (query_id, rank, id), a recall's top k; result_ids holds the ids by rank, ties by id.
    """
    ids = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("result_ids"))
    df = queries.join(ids, "query_id", "left")
    none = F.array().cast(ids.schema["result_ids"].dataType)
    return df.select("query_id", "project", F.col("text").alias("query"), F.coalesce("result_ids", none).alias("result_ids"), at.alias("created_at"))


def retrieved(records: DataFrame, events: DataFrame) -> DataFrame:
    """records with times_retrieved one higher for each event (result_ids) that returned them; an id repeated in an event counts once."""
    hits = events.select(F.explode(F.array_distinct("result_ids")).alias("id")).groupBy("id").agg(F.count("*").alias("_n"))
    df = records.join(hits, "id", "left")
    more = F.coalesce("times_retrieved", F.lit(0)) + F.col("_n")
    return df.withColumn("times_retrieved", F.when(F.col("_n").isNull(), F.col("times_retrieved")).otherwise(more)).drop("_n")


def events_answered(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """events with feedback_ids and failure_class of their last feedback (event_id, seq, useful_ids, failure_class); an empty class is none."""
    last = feedback.groupBy("event_id").agg(F.max_by(F.struct("useful_ids", F.nullif("failure_class", F.lit("")).alias("failure_class")), "seq").alias("_f"))
    df = events.drop("feedback_ids", "failure_class").join(last, "event_id", "left")
    return df.withColumns({"feedback_ids": F.col("_f.useful_ids"), "failure_class": F.col("_f.failure_class")}).drop("_f")


def unanswerable(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback on events that aren't there; it changes nothing."""
    return feedback.join(events.select("event_id"), "event_id", "left_anti")


def judged(records: DataFrame, events: DataFrame, feedback: DataFrame) -> DataFrame:
    """records with times_useful and retrieval_precision after feedback in order of seq.

    Every feedback counts its useful ids, whatever its event returned and whatever its class; then the precision of the
    event's results is taken anew, if they were retrieved often enough. So a record's precision holds what was useful up
    to the last feedback on an event that returned it, and later useful marks show in times_useful alone. Both are counts
    by record: nothing is folded in order.
    """
    known = feedback.join(events.select("event_id", "result_ids"), "event_id")
    returned = known.select(F.explode(F.array_distinct("result_ids")).alias("id"), "seq").groupBy("id").agg(F.max("seq").alias("_last"))
    useful = known.select(F.explode(F.array_distinct("useful_ids")).alias("id"), "seq")
    counts = useful.join(returned, "id", "left").groupBy("id").agg(F.count("*").alias("_all"), F.count_if(F.col("seq") <= F.col("_last")).alias("_then"))
    df = records.join(returned, "id", "left").join(counts, "id", "left")
    before = F.coalesce("times_useful", F.lit(0))
    told = F.col("_last").isNotNull() & (F.col("times_retrieved") >= LEAST_RETRIEVED)
    precision = (before + F.coalesce("_then", F.lit(0))).cast("double") / F.col("times_retrieved")
    df = df.withColumn("retrieval_precision", F.when(told, precision).otherwise(F.col("retrieval_precision")))
    return df.withColumn("times_useful", F.when(F.col("_all").isNull(), F.col("times_useful")).otherwise(before + F.col("_all"))).drop("_last", "_all", "_then")


def boosts(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Reports (id, seq, useful) for writes.learned: a useful id of feedback on a known event; feedback with a failure class boosts nothing."""
    plain = feedback.where(F.coalesce("failure_class", F.lit("")) == "").join(events.select("event_id"), "event_id", "left_semi")
    return plain.select(F.explode(F.array_distinct("useful_ids")).alias("id"), "seq", F.lit(True).alias("useful"))


def conflicts(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, a, b, strength): contradicting edges whose both ends are in the same set of results (set_id, id)."""
    one = results.select("set_id", "id").distinct()
    said = edges.where("rel_type = 'contradicts'").select(F.col("source_id").alias("id"), F.col("target_id").alias("b"), "strength")
    found = one.join(said, "id").withColumnRenamed("id", "a")
    return found.join(one.withColumnRenamed("id", "b"), ["set_id", "b"], "left_semi").select("set_id", "a", "b", "strength")


def evidence_maps(results: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, records, conflicts, invalidated, confidence) of each set of results (set_id, id).

    Counts of its records, of the contradicting edges within it and of its closed records; confidence is 1 / (1 + conflicts).
    Ids without a record count for nothing. A set's pairs are in `conflicts`, a row each.
    """
    have = results.select("set_id", "id").distinct().join(records.select("id", "valid_to"), "id")
    size = have.groupBy("set_id").agg(F.count("*").alias("records"), F.count_if(F.col("valid_to").isNotNull()).alias("invalidated"))
    pairs = conflicts(have, edges).groupBy("set_id").agg(F.count("*").alias("conflicts"))
    df = size.join(pairs, "set_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0).cast("long")))
    return df.withColumn("confidence", 1.0 / (1.0 + F.col("conflicts")))
