"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, join_sized, unused

#: Documents in one range of the sorted keys, about: the unit of the prefix sums.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, rows, target) from (source, size).

    Sources in code point order, null last, take the weights in turn. Targets share `share` times all sizes by weight;
    none goes over `most` times its source's size, and what is over is shared again by weight among the others. With
    sources sorted by limit / weight that is a prefix sum: the first ones stop at their limits, and the others get
    level x weight. The sort runs over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))).withColumn("limit", most * F.col("source_size"))
    line = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, onward = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("all", share * F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(everything))
    return per.select("source", "source_size", "rows", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Every row of docs (doc_id, source, text) as (doc_id, text_hash, size, source_size, target, taken).

    size counts words (null text: 0). Each source takes complete epochs while they fit its target; the rest goes to the
    documents with the smallest keys -ln(u) / weight, whole documents only, while they fit, and then to the one other
    document that brings the source nearest its target. u is a hash of seed, doc_id and text, so reruns agree, and a document's weight is its quality (doc_id, weight > 0;
    1 where it has none, the largest of repeated ones). taken is the number of words taken, repeats counted: at most
    `most` (a whole number) times the size. Repeated rows are taken apart, ties broken by doc_id and hash; rows equal
    in all of these are interchangeable. Null sources are one source. An empty table gives an empty result.

    A source that holds most rows is not gathered: documents are range partitioned by (source, key), sums are taken
    within ranges, and the ranges' sums, a row for each, give the offsets.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        best = quality.where("weight > 0").groupBy(F.col("doc_id").cast("long").alias("_q")).agg(F.max("weight").alias("weight"))
        rows = rows.join(best, F.col("doc_id") == F.col("_q"), "left").drop("_q").withColumn("weight", F.coalesce("weight", F.lit(1.0)).cast("double"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + F.lit(0.5)) / F.lit(2.0**53)
    rows = cut(rows.select("doc_id", "source", "text_hash", "size", (-F.log(u) / F.col("weight")).alias("key")))
    targets = cut(source_targets(rows.select("source", "size"), weights, share, most))
    n, sources = targets.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    order = [F.col("key"), F.col("doc_id"), F.col("text_hash")]
    ranged = cut(rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), F.col("source"), *order).withColumn("part", F.spark_partition_id()))
    running = F.sum("size").over(Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    blocks = ranged.groupBy("source", "part").agg(F.sum("size").alias("block"))
    offset = F.sum("block").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.coalesce(offset, F.lit(0)).alias("offset"))
    placed = ranged.withColumn("running", running).join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    targets = targets.withColumnRenamed("source", "_t").drop("rows")
    placed = join_sized(placed, targets, F.col("source").eqNullSafe(F.col("_t")), "inner", sources)
    # A target that its limit set is a whole multiple of the size but for rounding.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(F.lit(0))
    left = F.when(epochs < int(most), F.greatest(F.col("target") - epochs * F.col("source_size"), F.lit(0.0))).otherwise(F.lit(0.0))
    placed = cut(placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", epochs.alias("epochs"), left.alias("left"), (F.col("offset") + F.col("running")).alias("sum")))
    # The sorted documents are taken while they fit; then the one of the others that brings the source nearest its target.
    fits = F.col("sum") <= F.col("left")
    gaps = placed.groupBy("source").agg((F.max("left") - F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0))).alias("gap")).withColumnRenamed("source", "_t")
    same = F.col("source").eqNullSafe(F.col("_t"))
    others = join_sized(placed.where(~fits & (F.col("size") > 0)), gaps, same, "inner", sources).where(F.abs(F.col("gap") - F.col("size")) < F.col("gap"))
    last = others.groupBy("_t").agg(F.min_by("sum", F.struct(F.abs(F.col("gap") - F.col("size")), "sum")).alias("last"))
    placed = join_sized(placed, last, same, "left", sources)
    more = (fits | (F.col("sum") == F.coalesce("last", F.lit(-1)))) & (F.col("left") > 0)
    return placed.select("doc_id", "text_hash", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + more.cast("long"))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with all their columns.

    A document without words has nothing to take: it stays away.
    """
    d, h, n, k = unused(docs, "_doc", "_hash", "_times", "_time")
    times = mix(docs, quality, weights, share, most, seed).where("taken > 0")
    times = times.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), (F.col("taken") / F.col("size")).cast("int").alias(n))
    times = times.groupBy(d, h).agg(F.max(n).alias(n))  # rows repeated in full share their outcome
    met = docs.join(times, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)))
    return met.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
