"""Near copies by the exact Jaccard similarity of their sets of word shingles, found through SimHash and MinHash bands.

The pipeline's near-dedup stage. Candidates are the texts of each component that op10 makes of their fingerprints, and those
that share a MinHash band. SimHash alone doesn't serve: at Jaccard 0.8 two fingerprints differ in 9.7 of 64 bits on average,
and keys that let so many pass are too short to be looked up; nor do its links say that the sets are similar. A band is the least hashes of the set under ROWS
orders; equal bands are candidates, and every link is verified on the whole sets. At similarity 0.8, 1 - (1 - 0.8^6)^18 =
99.6 % of single pairs are candidates, at 0.85 over 99.9 %, and a component is missed only where every path of links is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucket_components, cut, keep_firsts, shuffled
from .simhash import MOST, WORDS, linked, shingle_hashes, simhash

#: Words of a shingle, and the similarity from which on two texts are near copies.
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 18, 6
#: Hashes put under all orders at once.
BLOCK = 4096
#: An order is the product with one of these odd numbers, modulo 2^64.
ORDERS = np.random.default_rng(42).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Bucket keys of a set; all empty sets have the same."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK, None] * ORDERS).min(0), out=least)
    return np.array([xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _alike(g: Column, h: Column, similar: float) -> Column:
    common = F.size(F.array_intersect(g, h))
    return (F.least(F.size(g), F.size(h)) >= similar * F.greatest(F.size(g), F.size(h))) & (common >= similar * (F.size(g) + F.size(h) - common))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("node"), "text")


def near_parts(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(node, component) of the texts that are similar to others, by their hashes."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [shingle_set(x, shingle) for x in part["text"]]
            fps = np.array([simhash(x, WORDS) for x in part["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": part["node"], "size": [len(x) for x in sets], "bands": [bands(x) for x in sets], "fp": fps})

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"node": part["node"], "grams": [shingle_set(x, shingle).view(np.int64) for x in part["text"]]})

    signed = _texts(docs).mapInPandas(sign, "node long, size long, bands array<long>, fp long")
    one = cut(signed.groupBy("node").agg(F.max("size").alias("size"), F.max("bands").alias("bands"), F.max("fp").alias("fp")))
    printed = one.join(linked(one.select("fp").distinct(), MOST), "fp", "left").select("node", "size", F.xxhash64(F.coalesce("component", "fp")).alias("key"))
    rows = one.select("node", "size", F.explode("bands").alias("key")).union(printed)
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut(shuffled(rows).join(many, "key"))
    wanted = buckets.select("node").distinct()
    sets = cut(_texts(docs).join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInPandas(put, "node long, grams array<long>"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("g")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("h")), "b")
        return both.where(_alike(F.col("g"), F.col("h"), similar)).select("a", "b")

    sizes = lambda left, right: F.least(f"{left}.size", f"{right}.size") >= similar * F.greatest(f"{left}.size", f"{right}.size")
    return bucket_components(buckets, verify, where=sizes, counted=True)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that stay when each component of near copies keeps its first text, by doc_id (null last), then text hash.

    Texts are near copies if the Jaccard similarity of their sets of shingles is at least `similar`; texts without words,
    null among them, are copies of each other. Rows that repeat doc_id and text of one that stays, stay too.
    """
    return keep_firsts(docs, near_parts(docs, shingle, similar))
