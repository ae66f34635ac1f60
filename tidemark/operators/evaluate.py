"""Evaluation of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendered(turns: DataFrame) -> DataFrame:
    """One text for each conversation: its turns in order, a line `role: text` each; a conversation's own size bounds the row."""
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("rendered"))


def recall_flags(df: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, found, gold): whether any and all gold ids are in the first k, any in all, and how many are missing."""
    top = F.array_intersect(F.slice("found", 1, k), "gold")
    n = F.size("gold")
    return df.select("query_id", (F.size(top) > 0).alias("recall_any"), (F.size(top) == n).alias("recall_all"), F.arrays_overlap("found", "gold").alias("in_context"), F.size(F.array_except("gold", "found")).cast("long").alias("missing"))


def dominance(hits: DataFrame) -> DataFrame:
    """Rows (query_id, session): the largest session's count and its share."""
    n = hits.groupBy("query_id", "session").agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.max("n").alias("top"), F.sum("n").alias("mapped"), (F.max("n") / F.sum("n")).alias("dominance"))


def _words(text: Column) -> Column:
    parts = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,!?;:"'()\-]+|[.,!?;:"'()\-]+$""", ""))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def taxonomy(df: DataFrame) -> DataFrame:
    """Why an answer failed. Rows (gold, hypothesis, retrieved): a number that was retrieved wasn't aggregated; else by the overlap of words."""
    g, h = _words(F.col("gold")), _words(F.col("hypothesis"))
    common = F.size(F.array_intersect(g, h))
    overlap = F.when((F.size(g) == 0) | (F.size(h) == 0), F.lit(0.0)).otherwise(common / F.nullif(F.size(g) + F.size(h) - common, F.lit(0)))
    number = F.col("gold").rlike(r"^\s*\d+(\.\d+)?\s*$")
    kind = F.when(number & F.col("retrieved"), "aggregation_failure").when(number, "missing_recall").when(F.col("overlap") >= 0.5, "generation_failure").otherwise("missing_recall")
    return df.withColumn("overlap", overlap).withColumn("class", kind)


def first_of_each(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def score_report(rows: DataFrame) -> DataFrame:
    """Rows (kind, label: correct, partial or incorrect): counts and strict and lenient accuracy of each kind and overall, by rollup."""
    n = {k: F.count_if(F.col("label") == k) for k in ("correct", "partial", "incorrect")}
    out = rows.rollup("kind").agg(F.grouping("kind").alias("_all"), F.count("*").alias("total"), *[v.alias(k) for k, v in n.items()])
    total = F.nullif("total", F.lit(0))
    return out.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("kind")).alias("kind"), "total", *n, (F.col("correct") / total).alias("strict"), ((F.col("correct") + F.col("partial")) / total).alias("lenient"))


def by_nearness(df: DataFrame, day: Column, stamp: str = "valid_from", by: str = "project") -> DataFrame:
    """Rows of each group with their place by days from a date; undated ones last."""
    w = Window.partitionBy(by).orderBy(F.asc_nulls_last(F.abs(F.datediff(F.col(stamp).cast("date"), day))), "id")
    return df.withColumn("place", F.row_number().over(w))


def in_time(df: DataFrame, stamp: str = "valid_from", by: str = "project") -> DataFrame:
    """Rows of each group with their place in time; undated ones first."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_first(stamp), "id")))
