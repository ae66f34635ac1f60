"""Joins along edges (source_id, target_id, rel_type, strength)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, rel_type, strength, direction); a self-loop once."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "rel_type", "strength", F.lit("outgoing").alias("direction"))
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "rel_type", "strength", F.lit("incoming").alias("direction"))
    return out.union(back)


def neighbours(ids: DataFrame, edges: DataFrame) -> DataFrame:
    return both_ways(edges).join(ids.select("id").distinct(), "id", "left_semi")


def reachable(seeds: DataFrame, edges: DataFrame, live: DataFrame, hops: int = 2) -> DataFrame:
    """(id, other, hop): live records reached from each seed in at most 1 to 5 steps along edges either way, with the fewest.

    Breadth first: every step joins the frontier with the edges and drops what was reached before, so cycles end.
    """
    if not 1 <= hops <= 5:
        raise ValueError("hops from 1 to 5")
    links = both_ways(edges).select(F.col("id").alias("_at"), F.col("other").alias("_to")).distinct()
    alive = live.select(F.col("id").alias("_to"))
    found = [seeds.select("id", F.col("id").alias("other"), F.lit(0).alias("hop")).distinct()]
    for k in range(1, hops + 1):
        nxt = found[-1].join(links, F.col("other") == F.col("_at")).select("id", "_to").distinct().join(alive, "_to", "left_semi").select("id", F.col("_to").alias("other"), F.lit(k).alias("hop"))
        found.append(nxt.join(reduce(DataFrame.union, found).select("id", "other"), ["id", "other"], "left_anti"))
    return reduce(DataFrame.union, found[1:])


def upserted(edges: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """Edges after new ones whose ends are live; an edge that is there gets the last strength (seq)."""
    ends = live.select("id").distinct()
    ok = new.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    cols = ["source_id", "target_id", "rel_type", "strength"]
    both = edges.select(*cols, F.lit(-1).cast("long").alias("seq")).union(ok.select(*cols, F.col("seq").cast("long")))
    return both.groupBy(*cols[:3]).agg(F.max_by("strength", F.struct("seq", "strength")).alias("strength"))


def decayed(edges: DataFrame, step: float = 0.02, least: float = 0.1) -> DataFrame:
    """Every edge loses a step, not below 0; those below `least` go."""
    return edges.withColumn("strength", F.greatest(F.lit(0.0), F.col("strength") - step)).where(F.round("strength", 9) >= least)


def boosted(edges: DataFrame, ids: DataFrame, by: float = 1.05) -> DataFrame:
    hit = ids.select(F.col("id")).distinct()
    marks = edges.join(hit.select(F.col("id").alias("source_id"), F.lit(True).alias("_a")), "source_id", "left").join(hit.select(F.col("id").alias("target_id"), F.lit(True).alias("_b")), "target_id", "left")
    return marks.withColumn("strength", F.when(F.col("_a") | F.col("_b"), F.least(F.lit(1.0), F.col("strength") * by)).otherwise(F.col("strength"))).drop("_a", "_b")


def conflicts(results: DataFrame, edges: DataFrame, records: DataFrame, most: int = 50) -> DataFrame:
    """Per query: live records that contradict a result and aren't results, from the best-ranked result, at most `most`.

    results: (query_id, id, rank).
    """
    links = both_ways(edges.where("rel_type = 'contradicts'")).select("id", "other", "strength")
    hit = results.join(links, "id").join(results.select("query_id", F.col("id").alias("other")), ["query_id", "other"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "other").orderBy("rank", "id"))
    hit = hit.withColumn("k", first).where("k = 1")
    hit = hit.join(records.where("valid_to is null").select(F.col("id").alias("other"), "content"), "other")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "other"))
    return hit.withColumn("k", place).where(F.col("k") <= most).select("query_id", F.col("id").alias("result_id"), F.col("other").alias("conflict_id"), "strength", T.first_bytes(F.col("content"), 500).alias("chunk"))
