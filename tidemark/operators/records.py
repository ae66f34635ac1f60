"""Scans, projections and filters of records, chunks and their history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def live(df: DataFrame) -> DataFrame:
    return df.where("valid_to is null")


def lookup(records: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Live records with the wanted ids, and whether their content is what its hash says."""
    return live(records).join(ids, on, "left_semi").withColumn("intact", T.content_hash(F.col("content")).eqNullSafe(F.col("content_hash")))


def listed(records: DataFrame, memory_type: str | None = None, most_importance: int | None = None, tags: Sequence[str] = (), limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Live records, newest change first: of a type, up to an importance, with all the tags."""
    df = live(records)
    if memory_type is not None:
        df = df.where(F.col("memory_type") == memory_type)
    if most_importance is not None:
        df = df.where(F.col("importance") <= most_importance)
    for tag in tags:
        df = df.where(F.array_contains("tags", tag))
    df = df.orderBy(F.desc("updated_at"), "id")
    return df if limit is None else df.offset(offset).limit(limit)


def as_of(records: DataFrame, at: Column) -> DataFrame:
    """Records that were there at a time."""
    return records.where((F.col("created_at") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def valid_between(records: DataFrame, since: Column | None = None, before: Column | None = None) -> DataFrame:
    """valid_from in [since, before); a record without valid_from only if no bound is given."""
    for bound, ok in ((since, lambda x: F.col("valid_from") >= x), (before, lambda x: F.col("valid_from") < x)):
        if bound is not None:
            records = records.where(ok(bound))
    return records


def handles(records: DataFrame) -> DataFrame:
    return records.select("id", F.coalesce("summary", T.excerpt(F.col("content"))).alias("summary"), "tags", F.octet_length("content").cast("long").alias("bytes"))


def stored(new: DataFrame, at: Column) -> DataFrame:
    """Columns that storing a record (content, importance) derives."""
    importance = F.least(F.greatest("importance", F.lit(0)), F.lit(4))
    return new.withColumns({"importance": importance, "content_hash": T.content_hash(F.col("content")), "storage_mode": T.storage_mode(F.col("content")), "dynamic_importance": F.greatest(F.lit(0.1), (5.0 - importance) / 3), "created_at": at, "updated_at": at, "last_accessed": at})


def new_only(incoming: DataFrame, records: DataFrame) -> DataFrame:
    """Incoming rows whose (project, content_hash) no live record has; of equal ones the smallest id."""
    fresh = incoming.join(live(records).select("project", "content_hash"), ["project", "content_hash"], "left_anti")
    first = F.row_number().over(Window.partitionBy("project", "content_hash").orderBy("id"))
    return fresh.withColumn("_k", first).where("_k = 1").drop("_k")


def hash_groups(records: DataFrame) -> DataFrame:
    """Live records with equal content in a project: (project, content_hash, first id, n)."""
    return live(records).groupBy("project", T.content_hash(F.col("content")).alias("content_hash")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def soft_deleted(records: DataFrame, ids: DataFrame, at: Column, reason: str) -> DataFrame:
    """The next state: live mutable records with these ids are closed."""
    hit = records.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    close = F.coalesce("_hit", F.lit(False)) & F.col("valid_to").isNull() & ~F.col("immutable")
    return hit.withColumn("valid_to", F.when(close, at).otherwise(F.col("valid_to"))).withColumn("invalidation_reason", F.when(close, F.lit(reason))).drop("_hit")


def corrected(records: DataFrame, updates: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(next records, version rows) after updates (id, content): the old content becomes a version, the summary goes."""
    news = updates.select("id", F.col("content").alias("_new"))
    both = records.join(news, "id", "left")
    hit = F.col("_new").isNotNull() & F.col("valid_to").isNull() & ~F.col("immutable")
    versions = both.where(hit).select("id", "content", "memory_type", F.col("updated_at").alias("system_from"), at.alias("system_to"), F.lit("update").alias("change_type"))
    nxt = both.withColumns({"summary": F.when(~hit | F.col("_new").isNull(), F.col("summary")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at")), "content": F.when(hit, F.col("_new")).otherwise(F.col("content"))})
    return nxt.withColumn("content_hash", F.when(hit, T.content_hash(F.col("content"))).otherwise(F.col("content_hash"))).drop("_new"), versions


def without(records: DataFrame, chunks: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hard delete: records, their chunks and the edges at either end."""
    gone = ids.select("id").distinct()
    ends = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return records.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti"), ends


def version_chain(versions: DataFrame) -> DataFrame:
    """Each version's end is the start of the next one of its record."""
    w = Window.partitionBy("memory_id").orderBy("system_from", "version_id")
    return versions.withColumn("system_to", F.lead("system_from").over(w)).withColumn("version_no", F.row_number().over(w))


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def touched(records: DataFrame, hits: DataFrame, at: Column) -> DataFrame:
    """Records with access_count raised by how often they were hit."""
    n = hits.groupBy("id").agg(F.count("*").alias("_n"))
    got = F.col("_n").isNotNull()
    return records.join(n, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.when(got, at).otherwise(F.col("last_accessed"))}).drop("_n")


def stale(records: DataFrame, at: Column, days: int = 90) -> DataFrame:
    """Never the immutable: unimportant ones that nobody has read for so long, and expired ones."""
    old = (F.col("importance") >= 3) & (F.col("last_accessed") < at - F.make_dt_interval(F.lit(days))) & (F.col("access_count") == 0)
    return records.where(~F.col("immutable") & (old | F.coalesce(F.col("expires_at") < at, F.lit(False))))


def cold(records: DataFrame, chunks: DataFrame, at: Column, days: int = 60) -> DataFrame:
    """Mutable records older than so many days of which no chunk was ever matched."""
    old = records.where(~F.col("immutable") & (F.col("created_at") < at - F.make_dt_interval(F.lit(days))))
    return old.join(chunks.where("last_matched is not null").select(F.col("memory_id").alias("id")), "id", "left_anti")


def decayed(records: DataFrame, at: Column, rate: float = 0.95) -> DataFrame:
    due = F.col("next_review_at") < at
    step = F.make_dt_interval(hours=F.col("retrieval_interval_hrs").cast("int"))
    return records.withColumns({"dynamic_importance": F.when(due, F.greatest(F.lit(0.1), F.col("dynamic_importance") * rate)).otherwise(F.col("dynamic_importance")), "next_review_at": F.when(due, F.col("next_review_at") + step).otherwise(F.col("next_review_at"))})


def chunks_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of some records (their ids in the first column)."""
    return chunks.join(ids.select(F.col(ids.columns[0]).alias("memory_id")).distinct(), "memory_id", "left_semi")


def recent_chunks(chunks: DataFrame, records: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks of live records with the record's last_accessed; with a limit those of the most recently read records."""
    df = chunks.join(live(records).select(F.col("id").alias("memory_id"), "last_accessed"), "memory_id")
    return df if limit is None else df.orderBy(F.desc("last_accessed"), "chunk_id").limit(limit)


def orphans(documents: DataFrame, references: DataFrame) -> DataFrame:
    """Documents (id) that no record refers to by its document_id."""
    return documents.join(references.where("document_id is not null").select(F.col("document_id").alias("id")), "id", "left_anti")
