"""Grouped counts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def _span(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("label")).agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def by_tag(records: DataFrame) -> DataFrame:
    return _span(records.where("valid_to is null").select(F.explode("tags").alias("tag"), "created_at"), "tag")


def by_type(records: DataFrame) -> DataFrame:
    return _span(records.where("valid_to is null"), "memory_type")


def by_failure_class(events: DataFrame) -> DataFrame:
    return _span(events.where("failure_class is not null"), "failure_class")


def project_stats(records: DataFrame) -> DataFrame:
    """One row for each project, with counts by type and importance as columns' maps flattened to text."""
    counts = [F.count_if(F.col("importance") == k).alias(f"importance_{k}") for k in range(5)]
    return records.where("valid_to is null").groupBy("project").agg(F.count("*").alias("total"), *counts, F.count_if(F.col("summary").isNull()).alias("pending_summaries"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def integrity(records: DataFrame) -> DataFrame:
    right = T.content_hash(F.col("content")) == F.col("content_hash")
    out = records.where("valid_to is null").groupBy("project").agg(F.count("*").alias("total"), F.count("content_hash").alias("hashed"), F.count_if(~right).alias("corrupt"))
    return out.withColumn("coverage", F.col("hashed") * 100.0 / F.col("total"))


def pending(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Per project: chunks, chunks without a vector, records without a summary."""
    c = chunks.groupBy("project").agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("pending_vectors"))
    r = records.where("valid_to is null").groupBy("project").agg(F.count_if(F.col("summary").isNull() | (F.col("summary") == F.col("content"))).alias("pending_summaries"))
    return r.join(c, "project", "full").select("project", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("chunks", "pending_vectors", "pending_summaries")])


def failure_dominance(events: DataFrame, at: Column, days: int = 30) -> DataFrame:
    """Per project over the last days: the most frequent failure class, its share, and the runner-up's share."""
    recent = events.where(F.col("failure_class").isNotNull() & (F.col("created_at") >= at - F.make_dt_interval(F.lit(days))))
    n = recent.groupBy("project", "failure_class").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "failure_class"))
    n = n.withColumn("k", rank)
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    out = n.groupBy("project").agg(pick(1, "failure_class").alias("top_class"), F.sum("n").alias("total"), pick(1, "n").alias("n1"), pick(2, "n").alias("n2"))
    return out.select("project", "top_class", "total", (F.col("n1") / F.col("total")).alias("top_share"), (F.coalesce("n2", F.lit(0)) / F.col("total")).alias("next_share"))


def rolled_up(df: DataFrame, by: str, **aggregates: Column) -> DataFrame:
    """Aggregates by group and over all rows (group `overall`) in one pass."""
    out = df.rollup(by).agg(F.grouping(by).alias("_all"), *[c.alias(k) for k, c in aggregates.items()])
    return out.withColumn(by, F.when(F.col("_all") == 1, "overall").otherwise(F.col(by))).drop("_all")


def merged_aliases(entities: DataFrame) -> DataFrame:
    """One row for each (project, lower name) with all its aliases, each once."""
    return entities.groupBy("project", F.lower("name").alias("name")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def pattern_audit(df: DataFrame, by: list[str]) -> DataFrame:
    """How many verdicts KEEP, TUNE and REJECT each group has, and the share of rejected ones."""
    tally = {k.lower(): F.count_if(F.col("verdict") == k) for k in ("KEEP", "TUNE", "REJECT")}
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in tally.items()], (tally["reject"] / F.nullif(F.count("*"), F.lit(0))).alias("false_positive_rate"))


def most_frequent(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Each group's most frequent value and how often it occurs; of equally frequent ones the first."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(F.struct(column, "n"), F.struct(-F.col("n"), column)).alias("x")).select(*by, f"x.{column}", "x.n")


def tags_like(records: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Counts of the tags that fit the pattern in any case, the most frequent first."""
    return by_tag(records).where(F.col("label").ilike(pattern)).orderBy(F.desc("n"), "label").limit(limit)
