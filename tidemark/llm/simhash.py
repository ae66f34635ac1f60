"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 21, 21 and 22 bits. Each segment is read as a word of the binary Golay
code of length 23, which is perfect: every word lies within three bits of exactly one codeword, its home. The codewords
within four bits are its neighbours, six at most. Facts used, each checked exhaustively in the tests:

* words one bit apart: the home of either is a neighbour of the other;
* words two bits apart have a neighbour in common.

With at most four differing bits in three segments, either two segments differ in at most one bit each, or one is equal
and the others differ in two bits each. The first case meets in a bucket (home of one segment, neighbour of another),
the second in a bucket (equal segment, common neighbour of the next). So no link is lost, and every bucket key has
24 bits or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, combinations
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucket_components, cut, join_hot, keep_firsts, with_texts

if TYPE_CHECKING:
    import pyarrow as pa

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Words of a shingle and differing bits of a link, where nothing else is said.
WORDS, MOST = 4, 4
#: Words read at once, so that a very long text needs no more memory than this.
BLOCK = 100_000


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; for each syndrome up to six error patterns (home first) and their number."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << bit - 11
        return word

    one = [syndrome(1 << k) for k in range(23)]
    tables = [np.zeros(1 << n, np.int64) for n in (12, 11)]
    for table, first in zip(tables, (0, 12), strict=True):
        for k in range(len(table).bit_length() - 1):
            table[1 << k : 2 << k] = table[: 1 << k] ^ one[first + k]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for k in bits:
                s ^= one[k]
            found[s].append(sum(1 << k for k in bits))
    patterns = np.array([x + [0] * (6 - len(x)) for x in found], np.int64)
    return tables[0], tables[1], patterns, np.array([len(x) for x in found])


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits of each word, home first, and how many there are."""
    low, high, patterns, number = golay()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[s]) >> 11, number[s]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints: (position in fps, key, side), side 0 or 1 of the home case, 2 of the equal case."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [neighbours(x) for x in seg]
    where, out, side = [], [], []

    def put(kind: int, first: np.ndarray, j: int, which: int, swap: bool) -> None:
        many, number = near[j]
        at, k = np.nonzero(np.arange(6)[None, :] < number[:, None])
        x, y = first[at], many[at, k]
        if swap:
            x, y = y, x
        where.append(at)
        out.append((np.int64(kind) << 36) | (x << 12) | y)
        side.append(np.full(len(at), which, np.int8))

    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        put(kind, near[i][0][:, 0], j, 0, False)
        put(kind, near[j][0][:, 0], i, 1, True)
    for i in range(3):
        put(3 + i, seg[i], (i + 1) % 3, 2, False)
    return np.concatenate(where), np.concatenate(out), np.concatenate(side)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of so many words, in blocks; a text with fewer words is one shingle, without words none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return
    for at in range(0, max(1, len(words) - shingle + 1), BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        joined = b" ".join(part)
        ends = list(accumulate(len(w) + 1 for w in part))
        starts = [0, *ends]
        last = ends[shingle - 1 :] or ends[-1:]
        yield np.array([xxh64_intdigest(joined[s : e - 1], 42) for s, e in zip(starts, last, strict=False)], np.uint64)


def simhash(text: str | None, shingle: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words. Reads the whole text in blocks."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every row; texts are read whole."""

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        import pyarrow as pa

        return lambda texts: [pa.array(np.array([simhash(x, shingle) for x in texts], np.uint64).view(np.int64))]

    return with_texts(docs, start, "fp long")


def _bucket_rows(fps: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = part["fp"].to_numpy(np.int64)
            at, key, side = keys(fp.view(np.uint64))
            yield pd.DataFrame({"key": key, "node": fp[at], "side": side})

    return fps.select("fp").mapInPandas(run, "key long, node long, side byte")


def _once(left: str, right: str, most: int) -> Column:
    """Holds in one of the buckets that a linked pair shares: the case which its differing bits in each segment call for."""
    apart = F.col(f"{left}.node").bitwiseXOR(F.col(f"{right}.node"))
    e = [F.bit_count(F.shiftrightunsigned(apart, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))) for at, n in SEGMENTS]
    kind, sides = F.shiftright(F.col(f"{left}.key"), 36), F.col(f"{left}.side") * 3 + F.col(f"{right}.side")
    home = [((0, 1), None), ((0, 2), 1), ((1, 2), 0)]
    case = [(kind == k) & (sides == 1) & (e[i] <= 1) & (e[j] <= 1) & (e[other] >= 2 if other is not None else F.lit(True)) for k, ((i, j), other) in enumerate(home)]
    case += [(kind == 3 + i) & (e[i] == 0) & (e[(i + 1) % 3] == 2) & (e[(i + 2) % 3] == 2) for i in range(3)]
    any_case = case[0]
    for x in case[1:]:
        any_case |= x
    return (F.bit_count(apart) <= most) & any_case


def linked(fps: DataFrame, most: int) -> DataFrame:
    """(fp, component) of the distinct fingerprints that are linked to others."""
    if not 0 <= most <= 4:
        raise ValueError("the bucket scheme finds links of at most 4 differing bits")
    holds = lambda pairs: pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return bucket_components(_bucket_rows(fps), holds, where=lambda left, right: _once(left, right, most)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, shingle: int = WORDS, most: int = MOST) -> DataFrame:
    """Every row of docs (doc_id, text) as (doc_id, fingerprint, component_id).

    Fingerprints link at most `most` (up to 4) differing bits apart; component_id is the smallest doc_id reachable.
    Equal fingerprints are one node, so copies are never paired. A null text counts as empty: fingerprint zero, linked
    like any other. Repeated rows each come back. A null doc_id comes back null, and is never a component_id unless a
    component holds nothing else. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    part = linked(fps, most)
    mates = fps.join(part, "fp")
    least = cut(mates.groupBy("component").agg(F.min("first").alias("component_id")))
    some = join_hot(mates.select("fp", "component"), least, "component", F.xxhash64("fp"), least.count()).select("fp", "component_id")
    ids = fps.join(part, "fp", "left_anti").select("fp", F.col("first").alias("component_id")).union(some)
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = WORDS, most: int = MOST) -> DataFrame:
    """The rows of docs that stay when each component keeps its first text, by doc_id (null last), then text hash.

    Rows that repeat doc_id and text of one that stays, stay too: they can't be told from it.
    """
    signed = cut(fingerprints(docs.select(F.xxhash64("text").alias("doc_id"), "text"), shingle).distinct())
    part = signed.join(linked(signed.select("fp").distinct(), most), "fp", "left")
    return keep_firsts(docs, part.select(F.col("doc_id").alias("node"), F.coalesce("component", "fp").alias("component")))
