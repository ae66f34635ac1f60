"""Comparisons and measures of ranked id lists, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rbo(a: Column, b: Column, p: float = 0.9) -> Column:
    """Rank-biased overlap of the prefixes seen, without extrapolation: a lower bound."""
    depth = F.greatest(F.size(a), F.size(b))
    part = lambda d: F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d))) / d * F.pow(F.lit(p), (d - 1).cast("double"))
    return F.when(depth == 0, F.lit(0.0)).otherwise((1 - p) * F.aggregate(F.sequence(F.lit(1), depth), F.lit(0.0), lambda s, d: s + part(d)))


def jaccard_at(a: Column, b: Column, k: int | None = None) -> Column:
    """Jaccard similarity of the first k ids; k is at most the shorter list's length."""
    n = F.least(F.size(a), F.size(b), *([F.lit(k)] if k else []))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    union = F.size(F.array_union(x, y))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0)))


def precision_at(found: Column, gold: Column, k: int) -> Column:
    n = F.least(F.size(found), F.lit(k))
    hits = F.size(F.filter(F.slice(found, 1, k), lambda x: F.array_contains(gold, x)))
    return F.when(n <= 0, F.lit(0.0)).otherwise(hits / F.nullif(n, F.lit(0)))


def reciprocal_rank(found: Column, gold: Column) -> Column:
    first = F.array_min(F.transform(F.array_intersect(found, gold), lambda x: F.array_position(found, x)))
    return F.coalesce(1.0 / first, F.lit(0.0))


def ndcg_at(found: Column, gold: Column, k: int) -> Column:
    """Binary relevance; the ideal has as many hits as there are gold ids, up to k."""
    gain = lambda n, ok: F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.when(ok(i), 1 / F.log2((i + 1).cast("double"))).otherwise(0.0))
    ideal_n = F.least(F.size(gold), F.lit(k))
    n = F.least(F.size(found), F.lit(k))
    ideal = F.when(ideal_n > 0, gain(F.greatest(ideal_n, F.lit(1)), lambda i: F.lit(True)))
    got = F.when(n > 0, gain(F.greatest(n, F.lit(1)), lambda i: F.array_contains(gold, F.get(found, i - 1)))).otherwise(0.0)
    return F.coalesce(got / ideal, F.lit(0.0))
