"""Next states: what batches of stores, merges, deletions, feedback and upserts make of the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import records as M

#: Limits of a stored record; fixed values.
MOST_BYTES, MOST_TAGS, MOST_TAG = 500_000, 64, 256
PROJECT = "^[a-z0-9_-]{1,64}$"
#: Changes by one report of use or of none, and what use does to the interval of reviews.
USEFUL, USELESS, STRETCH, LEAST_IMPORTANCE = 0.1, -0.05, 1.5, 0.1


def faults(types: Sequence[str]) -> Column:
    """What is wrong with a record to be stored (content, memory_type, project, tags), as an array; empty if nothing is."""
    found = [
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "content_empty"),
        F.when(F.octet_length("content") > MOST_BYTES, "content_too_long"),
        F.when(~F.coalesce(F.col("memory_type").isin(*types), F.lit(False)), "bad_type"),
        F.when(~F.coalesce(F.col("project").rlike(PROJECT), F.lit(False)), "bad_project"),
        F.when(F.size("tags") > MOST_TAGS, "too_many_tags"),
        F.when(F.exists("tags", lambda t: F.octet_length(t) > MOST_TAG), "long_tag"),
    ]
    return F.array_compact(F.array(*found))


def merged(records: DataFrame, edges: DataFrame, pairs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, edges, version rows) after pairs (winner, loser): losers go with their edges, each winner gets a version row."""
    gone = pairs.select(F.col("loser").alias("id")).distinct()
    left, _, ends = M.without(records, records.limit(0).select(F.col("id").alias("memory_id")), edges, gone)
    won = pairs.select(F.col("winner").alias("id")).distinct()
    versions = records.join(won, "id", "left_semi").select("id", "content", F.col("updated_at").alias("system_from"), at.alias("system_to"), F.lit("merge").alias("change_type"))
    return left.join(won.withColumn("_won", F.lit(True)), "id", "left").withColumn("updated_at", F.when(F.col("_won"), at).otherwise(F.col("updated_at"))).drop("_won"), ends, versions


def without_project(project: str, records: DataFrame, chunks: DataFrame, edges: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """All tables after a project is deleted; edges go with either end."""
    gone = records.where(F.col("project") == project).select("id")
    left, kept, ends = M.without(records, chunks, edges, gone)
    return {"records": left, "chunks": kept.where(F.col("project") != project), "edges": ends, "events": events.where(F.col("project") != project)}


def keep_last(old: DataFrame, new: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Upsert: of the rows of each key the one that is last by `order`; max_by is combined before the shuffle."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c not in by]
    return every.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def expired(ttl: DataFrame, cutoff: Column, prefix: str = "") -> DataFrame:
    """Projects (project, expires_at) that expire before the cutoff, of names with the prefix; null never expires."""
    return ttl.where((F.col("expires_at") < cutoff) & F.col("project").startswith(prefix))


def retained(df: DataFrame, stamp: str, at: Column, days: int) -> DataFrame:
    """Rows not older than so many days."""
    return df.where(F.col(stamp) >= at - F.make_dt_interval(F.lit(days)))


def filled(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings where there was none; those that are there stay, so it may run twice."""
    both = chunks.join(new.select("chunk_id", F.col("embedding").alias("_new")), "chunk_id", "left")
    return both.withColumn("embedding", F.coalesce("embedding", "_new")).drop("_new")


def summarised(records: DataFrame, summaries: DataFrame) -> DataFrame:
    """Live records get new summaries (id, summary)."""
    both = records.join(summaries.select("id", F.col("summary").alias("_new")), "id", "left")
    return both.withColumn("summary", F.when(F.col("valid_to").isNull(), F.coalesce("_new", "summary")).otherwise(F.col("summary"))).drop("_new")


def clustered(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records with the cluster of their first embedded chunk, and null without one."""
    first = chunks.groupBy(F.col("memory_id").alias("id")).agg(F.min_by("cluster_id", "chunk_id").alias("cluster_id"))
    return records.join(first, "id", "left")


def learned(records: DataFrame, reports: DataFrame, at: Column) -> DataFrame:
    """dynamic_importance, retrieval_interval_hrs and next_review_at after reports (id, seq, useful) in order of seq.

    Each report adds its change and lifts what falls below the floor. Such steps x -> max(floor, x + d) compose to
    max(x + all changes, floor + the largest sum of changes after some step), so sums are enough and nothing is folded.
    """
    d = F.when(F.col("useful"), USEFUL).otherwise(USELESS)
    after = F.sum("d").over(Window.partitionBy("id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    steps = reports.where("useful is not null").withColumn("d", d).withColumn("after", F.coalesce(after, F.lit(0.0)))
    total = steps.groupBy("id").agg(F.sum("d").alias("_sum"), F.max("after").alias("_after"), F.count_if("useful").alias("_useful"))
    df = records.join(total, "id", "left")
    importance = F.greatest(F.coalesce("dynamic_importance", F.lit(1.0)) + F.col("_sum"), LEAST_IMPORTANCE + F.col("_after"))
    hours = F.greatest(F.lit(1.0), F.coalesce("retrieval_interval_hrs", F.lit(168)) * STRETCH) * F.pow(F.lit(STRETCH), F.col("_useful") - 1)
    used = F.coalesce(F.col("_useful") > 0, F.lit(False))
    df = df.withColumn("dynamic_importance", F.when(F.col("_sum").isNull(), F.col("dynamic_importance")).otherwise(importance))
    df = df.withColumn("retrieval_interval_hrs", F.when(used, hours).otherwise(F.col("retrieval_interval_hrs")))
    return df.drop("_sum", "_after", "_useful")


def event_window(atoms: DataFrame, since: Column, before: Column, pad: int = 7, cap: int = 30) -> DataFrame:
    """Event atoms (project, id, valid_from) of the days from since to before, with padding: the first `cap` of each project by date, and how many are left out."""
    inside = atoms.where((F.col("valid_from") >= F.date_sub(since, pad)) & (F.col("valid_from") < F.date_add(before, pad)))
    n = inside.groupBy("project").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("project").orderBy("valid_from", "id"))
    first = inside.withColumn("place", place).where(F.col("place") <= cap)
    return first.join(n, "project").select("project", "id", "valid_from", "place", F.greatest(F.lit(0), F.col("n") - cap).alias("omitted"))


def active_preferences(atoms: DataFrame, as_of: Column) -> DataFrame:
    """The latest atom of each (project, subject, predicate) observed by then (or never dated), ranked in its project: newest first, undated last, then by confidence."""
    known = atoms.where(F.col("observed_at").isNull() | (F.col("observed_at") <= as_of))
    one = M.latest(known, ["project", "subject", "predicate"], [F.desc_nulls_last("observed_at"), F.desc("id")])
    order = Window.partitionBy("project").orderBy(F.desc_nulls_last("observed_at"), F.desc("confidence"), F.desc("id"))
    return one.withColumn("rank", F.row_number().over(order))


def entities_merged(existing: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing entities with new aliases, fresh candidates) of entities (name, aliases) and candidates (seq, name).

    A candidate is an entity whose name or an alias it equals in any case; what spelling it adds becomes an alias once.
    Of candidates that match none the first of each name stays.
    """
    key = existing.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a")).groupBy(F.lower("_a").alias("_key")).agg(F.max("name").alias("_name"))
    both = candidates.withColumn("_key", F.lower("name")).join(key, "_key", "left")
    more = both.where("_name is not null").where(F.lower("_name") != F.col("_key")).groupBy(F.col("_name").alias("name")).agg(F.array_sort(F.collect_set("_key")).alias("_more"))
    grown = existing.join(more, "name", "left")
    have = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a))
    grown = grown.withColumn("added", F.coalesce(F.array_except("_more", have), F.array().cast("array<string>"))).drop("_more")
    return grown, both.where("_name is null").groupBy(F.col("_key").alias("key")).agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))


def fetched(records: DataFrame, detail: str = "full", most: int = 65_536) -> DataFrame:
    """(id, text, truncated): the summary (or excerpt), or the content up to so many bytes, cut between characters."""
    if detail == "summary":
        return records.select("id", F.coalesce("summary", T.excerpt(F.col("content"))).alias("text"), F.lit(False).alias("truncated"))
    return records.select("id", T.first_bytes(F.col("content"), most).alias("text"), (F.octet_length("content") > most).alias("truncated"))
