"""Contradictions, supersession, atoms, ranking drift and weight tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranking as K
from tidemark.functions import text as T

# Words that say nothing about a text's subject here.
PLAIN_WORDS = (
    "pattern", "patterns", "session", "sessions", "memory", "memories", "project", "projects", "system", "systems", "context", "contexts", "feedback", "completed", "complete", "using", "used", "based", "current", "currently",
    "should", "always", "never", "when", "where", "that", "this", "with", "from", "into", "over", "have", "will", "been", "they", "their", "work", "works", "working", "data", "result", "results", "agent", "agents", "tool", "tools", "file", "files",
)
# Bounds of the weights, and what each dominant failure class changes.
BOUNDS = {"vector": (0.30, 0.65), "lexical": (0.15, 0.45), "recency": (0.05, 0.20), "precision": (0.05, 0.25)}
DELTAS = {"stale_ranking": {"vector": -0.05, "recency": 0.05}, "vocabulary_mismatch": {"vector": 0.05, "lexical": -0.05}, "scope_mismatch": {"precision": 0.03, "lexical": -0.03}}
START = {"vector": 0.45, "lexical": 0.30, "recency": 0.10, "precision": 0.15}


def significant(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(T.tokens(text), lambda w: F.length(w) > 3)), F.array(*map(F.lit, PLAIN_WORDS)))


def contradicts(a: Column, b: Column) -> Column:
    """Same subject, but one negates, names other versions, or is of another tense."""
    x, y = F.lower(a), F.lower(b)
    shared = F.size(F.array_intersect(significant(x), significant(y)))
    negated = (shared >= 5) & (T.contains_any(x, T.NEGATIONS) != T.contains_any(y, T.NEGATIONS))
    found = lambda t: F.regexp_extract_all(t, F.lit(T.VERSION), F.lit(0))
    bare = lambda t: F.regexp_replace(t, T.VERSION, "")
    same = (F.size(found(x)) == F.size(found(y))) & (F.size(F.array_except(found(y), found(x))) == 0)
    versions = (F.size(found(x)) > 0) & (F.size(found(y)) > 0) & (F.size(F.array_intersect(significant(bare(x)), significant(bare(y)))) >= 3) & ~same
    was = lambda t: T.contains_any(t, T.PAST)
    tense = (shared >= 4) & ((was(x) & T.contains_any(y, T.PRESENT) & ~was(y)) | (was(y) & T.contains_any(x, T.PRESENT) & ~was(x)))
    return negated | versions | tense


def superseded(pairs: DataFrame, records: DataFrame, hours: int = 24) -> DataFrame:
    """Of contradicting live records over so many hours apart the newer supersedes the older: (winner, loser)."""
    side = lambda k: records.where("valid_to is null").select(F.col("id").alias(k), F.col("created_at").alias(f"{k}_at"))
    df = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.abs(F.unix_timestamp(F.col("a_at").cast("timestamp")) - F.unix_timestamp(F.col("b_at").cast("timestamp")))
    newer = F.col("a_at") > F.col("b_at")
    return df.where(apart > hours * 3600).select(F.when(newer, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("loser"))


def drift(snapshots: DataFrame, alert: float = 0.5) -> DataFrame:
    """Rows (query_id, run, ids) against the run before: RBO, Jaccard at 5, 10 and in full, ids that came and went."""
    df = snapshots.withColumn("prev", F.lag("ids").over(Window.partitionBy("query_id").orderBy("run"))).where("prev is not null")
    a, b = F.col("ids"), F.col("prev")
    return df.select("query_id", "run", K.rbo(a, b).alias("rbo"), K.jaccard_at(a, b, 5).alias("jaccard_5"), K.jaccard_at(a, b, 10).alias("jaccard_10"), K.jaccard_at(a, b).alias("jaccard_full"), F.array_except(a, b).alias("added"), F.array_except(b, a).alias("removed")).withColumn("alert", F.col("rbo") < alert)


def tuned(dominant: DataFrame, least_events: int = 20, share: float = 0.40, margin: float = 0.10) -> DataFrame:
    """New weights for projects (top_class, total, top_share, next_share) whose failures have a clear main class.

    The class's change is added, each weight is held within its bounds, and what is missing or over is spread in proportion to
    the room that each has left.
    """
    df = dominant.where((F.col("total") >= least_events) & (F.col("top_share") >= share) & (F.col("top_share") - F.col("next_share") >= margin) & F.col("top_class").isin(*DELTAS))
    for k, (low, high) in BOUNDS.items():
        change = F.lit(0.0)
        for c, d in DELTAS.items():
            change = F.when(F.col("top_class") == c, d.get(k, 0.0)).otherwise(change)
        df = df.withColumn(k, F.least(F.greatest(F.lit(START[k]) + change, F.lit(low)), F.lit(high)))
    df = df.withColumn("_rest", 1.0 - sum((F.col(k) for k in BOUNDS), F.lit(0.0)))
    room = {k: F.greatest(F.when(F.col("_rest") > 0, F.lit(high) - F.col(k)).otherwise(F.col(k) - F.lit(low)), F.lit(0.0)) for k, (low, high) in BOUNDS.items()}
    df = df.withColumns({f"_room_{k}": v for k, v in room.items()}).withColumn("_all", sum((F.col(f"_room_{k}") for k in BOUNDS), F.lit(0.0)))
    even = F.abs("_rest") < 1e-9
    new = {k: F.when(even, F.col(k)).otherwise(F.least(F.greatest(F.col(k) + F.col("_rest") * F.col(f"_room_{k}") / F.nullif(F.col("_all"), F.lit(0.0)), F.lit(low)), F.lit(high))) for k, (low, high) in BOUNDS.items()}
    return df.withColumns(new).drop("_rest", "_all", *[f"_room_{k}" for k in BOUNDS])
