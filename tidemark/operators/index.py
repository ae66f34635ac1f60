"""An inverted index that is kept: postings in buckets of terms, written once, with generations of changes beside them.

A folder holds `postings` (by generation and bucket of the term) and `changes` (records that a later generation replaced or
removed). A term's postings are cut into shards, so that a term of all records is no one task's work, and a shard into blocks
by falling weight. A search reads the buckets of its terms alone, and of a query with one term only the blocks that hold each
shard's best k: a second shared term weighs more than any difference between a term's postings, so other queries need all.
Postings are then dealt by record, so a record's changes and its scores for all queries are one task's work, and what is
shuffled grows with the postings read, not with the pairs of queries and records.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.stem import stem

if TYPE_CHECKING:
    import pyarrow as pa

#: Folders that a generation's postings are dealt to, postings of a block, and of a shard of a term that all records have, about.
BUCKETS, BLOCK, SHARD = 64, 128, 100_000
#: Pairs of a query and a posting that a task of a search adds up, about.
PAIRS = 4_000_000
#: Rows of ids or terms that may be sent to every task.
FEW = 20_000


def _sized(df: DataFrame, side: DataFrame, on: list[str], how: str) -> DataFrame:
    return df.join(F.broadcast(side) if side.count() <= FEW else side, on, how)


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counts(records: DataFrame) -> DataFrame:
    """(id, term, tf long) of each row of records (id, content): how often it has each stem; null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            ids, lists = batch.columns
            words = lists.flatten().dictionary_encode()
            found = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()  # a stop word is null
            code = found.indices.fill_null(-1).to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            key, tf = np.unique((row * max(1, len(found.dictionary)) + code)[code >= 0], return_counts=True)
            row, code = np.divmod(key, max(1, len(found.dictionary)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), found.dictionary.take(pa.array(code)), pa.array(tf, pa.int64())], names=["id", "term", "tf"])

    kind = records.schema["id"].dataType.simpleString()
    return records.select("id", T.tokens(F.col("content")).alias("words")).mapInArrow(run, f"id {kind}, term string, tf long")


def weights(records: DataFrame) -> DataFrame:
    """(term, shard, id, weight) of records (id, content): sums of 1 / i² over a stem's first 256 occurrences; null contents have none."""
    tf = _dealt(counts(records), records.count()).groupBy("term", "shard", "id").agg(F.sum("tf").alias("tf"))
    return tf.select("term", "shard", "id", F.aggregate(F.sequence(F.lit(1), F.least("tf", F.lit(256)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / (i * i)).alias("weight"))


def _dealt(rows: DataFrame, records: int) -> DataFrame:
    """Rows (term, id, ...) of so many records with their shard, dealt by term and shard: what follows needs no shuffle."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-records // SHARD)))).cast("int")).repartition("term", "shard")


def _write(postings: DataFrame, path: str, generation: int) -> None:
    place = F.row_number().over(Window.partitionBy("term", "shard").orderBy(F.desc("weight"), "id")) - 1
    blocks = postings.withColumn("block", F.floor(place / BLOCK).cast("int")).groupBy("term", "shard", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "id"))).alias("x"))
    blocks = blocks.select(_bucket("term").alias("bucket"), "term", "block", F.size("x").alias("n"), F.transform("x", lambda s: s["id"]).alias("ids"), F.transform("x", lambda s: -s["minus"]).alias("weights"))
    blocks.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings/generation={generation}")


def build(records: DataFrame, path: str) -> None:
    """Writes the index of records (id, content) to a new folder."""
    _write(weights(records), path, 0)
    records.select("id", F.lit(False).alias("_")).limit(0).select("id").write.parquet(f"{path}/changes/generation=0")


def _generation(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/changes").agg(F.max("generation")).first()[0] or 0


def update(changed: DataFrame, removed: DataFrame, path: str) -> None:
    """Records (id, content) that are new or have new contents, and ids (id) that are gone, as one more generation.

    What is written before stays as it is, so a search that runs sees either state; `compact` merges generations.
    A record that is both changed and removed is gone. The list of changes is written last: it makes the generation count.
    """
    spark = changed.sparkSession
    generation = spark.read.parquet(f"{path}/postings").agg(F.max("generation")).first()[0] or 0
    generation = max(generation, _generation(spark, path)) + 1
    kept = changed.join(removed.select("id").distinct(), "id", "left_anti")
    _write(weights(kept), path, generation)
    changed.select("id").union(removed.select("id")).distinct().write.parquet(f"{path}/changes/generation={generation}")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    last = _generation(spark, path)
    schema = "term string, block int, n int, ids array<bigint>, weights array<double>, generation int, bucket int"
    return spark.read.schema(schema).option("basePath", f"{path}/postings").parquet(f"{path}/postings").where(F.col("generation") <= last)


def _current(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows (id, generation, ...) that no later generation has replaced or removed."""
    changes = spark.read.parquet(f"{path}/changes").groupBy("id").agg(F.max("generation").alias("_last"))
    return _sized(rows, changes, ["id"], "left").where("_last is null or generation >= _last").drop("_last")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The present state of the index as one generation in a new folder."""
    rows = _postings(spark, path).select("term", "generation", F.explode(F.arrays_zip("ids", "weights")).alias("p")).select("term", "generation", F.col("p.ids").alias("id"), F.col("p.weights").alias("weight"))
    records = rows.agg(F.approx_count_distinct("id")).first()[0]
    _write(_dealt(_current(spark, path, rows).select("term", "id", "weight"), records), to, 0)
    spark.range(0).write.parquet(f"{to}/changes/generation=0")


def search(queries: DataFrame, path: str, k: int = 10, digits: int = 6) -> DataFrame:
    """Each query's k records of highest score, as (query_id, id, score); ties go by id. queries: (query_id, text), a stated set.

    A term's blocks are left out only on an index without later generations, as some of its best may have been changed.
    """
    spark = queries.sparkSession
    terms = counts(queries.select(F.col("query_id").alias("id"), F.col("text").alias("content"))).select(F.col("id").alias("query_id"), "term").distinct()
    several = F.count("*").over(Window.partitionBy("query_id")) > 1
    asked = terms.withColumn("several", several).groupBy("term").agg(F.count("*").alias("asked"), F.max("several").alias("several")).withColumn("bucket", _bucket("term"))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    rows = _sized(_postings(spark, path).where(F.col("bucket").isin(buckets)), asked, ["bucket", "term"], "inner")
    changed = _generation(spark, path) > 0
    if not changed and digits >= 6:  # weights of a term that differ at all still do when rounded
        rows = rows.where(F.col("several") | (F.col("block") < -(-k // BLOCK)))
    parts = max(1, -(-(rows.agg(F.sum(F.col("n") * F.col("asked"))).first()[0] or 0) // PAIRS))
    found = rows.select("term", "generation", F.explode(F.arrays_zip("ids", "weights")).alias("p")).select("term", "generation", F.col("p.ids").alias("id"), F.col("p.weights").alias("weight")).repartition(parts, "id")
    if changed:
        changes = spark.read.parquet(f"{path}/changes").repartition(parts, "id").groupBy("id").agg(F.max("generation").alias("_last"))
        found = found.join(changes, "id", "left").where("_last is null or generation >= _last")
    scored = _sized(found.select("id", "term", "weight"), terms, ["term"], "inner").groupBy("query_id", "id").agg(F.round(F.sum("weight"), digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
