"""Passes over ranked lists (query_id, id, score, ...), all by window or join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as T


def ranked(df: DataFrame, by: str = "query_id", score: str = "score", k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id")))
    return out if k is None else out.where(F.col("rank") <= k)


def rank_normal(stamp: Column, by: str = "query_id") -> Column:
    """Place of a time between the query's earliest and latest: .5 for all if these are equal, 1 for a single row."""
    w = Window.partitionBy(by)
    low, high = F.min(stamp).over(w), F.max(stamp).over(w)
    return F.when(F.count("*").over(w) == 1, 1.0).when(high == low, 0.5).otherwise((stamp - low) / F.nullif(high - low, F.lit(0)))


def session_of(tags: Column) -> Column:
    """The session that a tag names: sid: goes before session:."""
    named = lambda p: F.get(F.transform(F.filter(tags, lambda t: t.startswith(p)), lambda t: F.substr(t, F.lit(len(p) + 1))), F.lit(0))
    return F.coalesce(named("sid:"), named("session:"), F.lit(""))


def session_dcg(df: DataFrame, by: str = "query_id") -> DataFrame:
    """Per query and session: the sum of cosine / log2(place + 1), best first; an untagged record is a session of its own."""
    group = F.when(F.col("session") == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.col("session"))
    df = df.withColumn("session", group)
    place = F.row_number().over(Window.partitionBy(by, "session").orderBy(F.desc("cosine"), "id"))
    return df.withColumn("_k", place).groupBy(by, "session").agg(F.sum(F.col("cosine") / F.log2(F.col("_k") + 1.0)).alias("dcg"), F.count("*").alias("n"))


def session_capped(df: DataFrame, cap: int, k: int, by: str = "query_id") -> DataFrame:
    """At most `cap` of each session, in the order of score, k in all; a list of one session stays as it is."""
    sessions = F.size(F.collect_set("session").over(Window.partitionBy(by)))
    place = F.row_number().over(Window.partitionBy(by, "session").orderBy(F.desc("score"), "id"))
    return ranked(df.withColumn("_s", sessions).withColumn("_k", place).where((F.col("_k") <= cap) | (F.col("_s") < 2)).drop("_s", "_k"), by, k=k)


def preference_slots(df: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The best preferences take the first min(10, max(1, k // 2)) places, then come the others, then what is left."""
    slots = min(10, max(1, k // 2))
    place = F.row_number().over(Window.partitionBy(by, "is_preference").orderBy(F.desc("score"), "id"))
    group = F.when(F.col("is_preference") & (F.col("_k") <= slots), 0).when(~F.col("is_preference"), 1).otherwise(2)
    df = df.withColumn("_k", place).withColumn("_g", group)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_g", F.desc("score"), "id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).drop("_k", "_g")


def merged(df: DataFrame, by: str = "query_id") -> DataFrame:
    """Lists united: an id once, at its first place, with its best score and longest content. Rows: (pass, pos, id, score, content)."""
    return df.groupBy(by, "id").agg(F.min(F.struct("pass", "pos")).alias("first"), F.max("score").alias("score"), F.max_by("content", F.struct(F.length("content"), "content")).alias("content")).select(by, "id", F.col("first.pass").alias("pass"), F.col("first.pos").alias("pos"), "score", "content")


def evidence_first(df: DataFrame, by: str = "query_id") -> DataFrame:
    """Rows (query, content, rank) with the most exact signals of the query first; otherwise the order stays."""
    low = F.lower("content")
    points = 3 * F.size(F.filter(T.exact_signals(F.col("query")), lambda s: F.contains(low, F.lower(s))))
    df = df.withColumn("points", points)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("points"), "rank", "id")))


def answerability(query: Column, summary: Column) -> Column:
    """Share of the query's words that the summary holds, exactly or as a prefix of four letters and more, stop words and single
    letters left out; .15 of what is missing for a verb that answers have, else .08 for a number."""
    telling = lambda t: F.filter(T.tokens(t), lambda w: (F.length(w) > 1) & ~w.isin(*T.STOP_WORDS))
    q, s = telling(query), F.array_distinct(telling(summary))
    near = lambda a, b: ((F.length(a) >= 4) & b.startswith(a)) | ((F.length(a) >= 4) & (F.length(b) >= 4) & a.startswith(b))
    hits = F.size(F.filter(q, lambda a: F.exists(s, lambda b: (a == b) | near(a, b))))
    raw = F.transform(F.filter(F.split(F.lower(summary), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()\[\]{}–—]+|[.,;:!?"'()\[\]{}–—]+$""", ""))
    bonus = F.when(F.exists(raw, lambda w: w.isin(*T.ANSWER_VERBS)), 0.15).when(F.exists(raw, lambda w: w.rlike("^[0-9]+$")), 0.08).otherwise(0.0)
    share = hits / F.nullif(F.size(q), F.lit(0))
    return F.when((F.size(q) == 0) | (F.size(s) == 0), F.lit(0.0)).otherwise(share * (1 - bonus) + bonus)


def dense_rerank(df: DataFrame, scorer: str, most: int = 20, by: str = "query_id") -> DataFrame:
    """The best `most` rows of each query take the scorer's column, stretched from 0 to 1 among them, as their score; the others keep theirs behind them."""
    w = Window.partitionBy(by, "_in")
    low, high = F.min(scorer).over(w), F.max(scorer).over(w)
    stretched = F.when(high == low, 0.5).otherwise((F.col(scorer) - low) / F.nullif(high - low, F.lit(0.0)))
    df = df.withColumn("_in", F.col("rank") <= most)
    df = df.withColumn("score", F.when(F.col("_in"), F.round(stretched, 6)).otherwise(F.col("score")))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_in"), F.desc("score"), "id"))
    return df.withColumn("rank", place).drop("_in")


def rescored(df: DataFrame, scores: DataFrame, by: str = "query_id") -> DataFrame:
    """New scores (query_id, id, score) replace those of the rows that they name; then all are ranked again."""
    new = scores.select(by, "id", F.col("score").alias("_new"))
    return ranked(df.join(new, [by, "id"], "left").withColumn("score", F.coalesce("_new", "score")).drop("_new"), by)


def session_reranked(df: DataFrame, by: str = "query_id") -> DataFrame:
    """Sessions by their DCG, then their best score; within them rows by score. An untagged record is a session of its own."""
    group = F.when(F.col("session") == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.col("session"))
    df = df.withColumn("session", group)
    dcg = session_dcg(df, by).select(by, "session", F.round("dcg", 6).alias("dcg"))
    best = F.max("score").over(Window.partitionBy(by, "session"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("dcg"), F.desc("_best"), "session", F.desc("score"), "id"))
    return df.join(dcg, [by, "session"]).withColumn("_best", best).withColumn("rank", place).drop("_best")


def visible(df: DataFrame, query: str = "query", tag: str = "extracted-preference") -> DataFrame:
    """Rows with the tag only for queries that ask for preferences."""
    return df.where(~F.array_contains("tags", tag) | T.is_preference(F.col(query)))


def in_scope(df: DataFrame, since: Column | None = None, until: Column | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """Results created from since to until, both included, that have all the tags."""
    if since is not None:
        df = df.where(F.col("created_at") >= since)
    if until is not None:
        df = df.where(F.col("created_at") <= until)
    for t in tags:
        df = df.where(F.array_contains("tags", t))
    return df


def answerability_rerank(df: DataFrame, weight: float = 0.4, by: str = "query_id") -> DataFrame:
    top = F.max("score").over(Window.partitionBy(by))
    blended = weight * answerability(F.col("query"), F.col("summary")) + (1 - weight) * F.when(top > 0, F.col("score") / F.nullif(top, F.lit(0.0))).otherwise(0.0)
    return ranked(df.withColumn("score", F.round(blended, 6)), by)


def with_weights(projects: DataFrame, learned: DataFrame, default: S.Weights = S.DEFAULT) -> DataFrame:
    """Each project's learned weights (project, vector, lexical, recency, precision), or the default ones."""
    names = ["vector", "lexical", "recency", "precision"]
    both = projects.join(learned.select("project", *[F.col(k).alias(f"_{k}") for k in names]), "project", "left")
    return both.withColumns({k: F.coalesce(f"_{k}", F.lit(getattr(default, k))) for k in names}).drop(*[f"_{k}" for k in names])


def united(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows (*by, *order, id) as one list of distinct ids for each group, in the order first seen; a group's list is bounded by its ids."""
    first = rows.groupBy(*by, "id").agg(F.min(F.struct(*order)).alias("first"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "id"))), lambda s: s["id"]).alias("ids"))
