"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case, with runs of white space as one space and none at the ends. Two lines are near duplicates
when the Jaccard similarity of their sets of all character 5-grams is at least 0.8: that is verified exactly. Signatures are
of the same sets, ten bands of six hashes, and bands are buckets. Components of the verified links, found by a
distributed union-find, keep the line that comes first and lose the others.

Lines are linked, joined and dropped by DataFrame functions. Cutting, signatures and the exact comparison run on Arrow
batches: their native forms, array functions over all 5-grams, took four times the CPU that the work may take.

MinHash is a randomised filter: ten bands of six make 1 - (1 - s^6)^10 of single pairs candidates, 95 % at similarity 0.8
and 99 % at 0.85, and a line is missed only where every path of links is. Bands of fewer hashes would fill with lines
that share no more than common letters, and with more of them the more lines there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucket_components, cut, join_hot, join_sized, text_bytes, unused

if TYPE_CHECKING:
    import pyarrow as pa

#: Lines with fewer characters than this stay as they are: what is so short repeats by chance.
LEAST_CHARS = 24
#: Characters of a shingle, in signatures and in the exact comparison.
GRAM = 5
BANDS, ROWS = 10, 6
SIMILAR = 0.8
#: Rows of one or two longs that may be broadcast; more are joined by a shuffle.
FETCH_ROWS = 500_000
#: Rows of a batch looked at together, and pairs compared together.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 500, 1024
#: Longs of 64 bits in which lines of crowded buckets are compared before their texts are.
SKETCH = 16
#: Characters put under all orders at once.
BLOCK = 1 << 16
#: An order of 32-bit hashes is the product with one of these odd numbers.
ORDERS = np.random.default_rng(42).integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Odd multipliers that stir.
STIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


_byte = np.arange(256)
SPACE = (_byte == 32) | (_byte >= 9) & (_byte <= 13)


def normal_lines(texts: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, pos, line) of the normalised lines of at least so many characters: the text's row, the line's place in it from 0."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, ends = text_bytes(pc.utf8_lower(texts))
    data = data.copy()
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    feeds = np.flatnonzero(data == 10) + 1
    lines = np.sort(np.concatenate([first, feeds]))  # where lines start
    # A text's first line: those that line feeds begin up to there are of texts before, as each of them has one more.
    before = np.searchsorted(feeds, first, "right") + np.arange(len(first))
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = ~SPACE[data]
    begin = inside[1:] & ~inside[:-1]
    inner = first[first < len(data)]
    begin[inner] = inside[inner + 1]
    starts = np.flatnonzero(begin)
    # A line's words stay with one space before each but the first.
    line = np.searchsorted(lines, starts, "right")
    later = starts[1:][line[1:] == line[:-1]] - 1
    keep = inside[1:]
    keep[later] = True
    data[later] = 32
    at = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    held = data[keep]
    found = pa.LargeStringArray.from_buffers(len(lines), pa.py_buffer(np.append(at[lines], at[-1])), pa.py_buffer(held))
    long = np.flatnonzero(pc.utf8_length(found).to_numpy() >= max(least_chars, 1))
    row = np.searchsorted(before, long, "right") - 1
    return row, long - before[row], found.take(pa.array(long))


def _hashes(lines: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    data, ends = text_bytes(lines)
    raw = memoryview(data)
    start = [0, *ends.tolist()]
    return np.array([xxh64_intdigest(raw[a:b], 42) for a, b in zip(start, start[1:], strict=False)], np.uint64).view(np.int64)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _lines(docs: DataFrame, least_chars: int, among: np.ndarray | None) -> DataFrame:
    """Long enough lines as (doc_id, text_hash, pos, node, norm), node being the hash of the normalised line; all or those among some sorted nodes."""
    wanted = None if among is None else docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                row, pos, line = normal_lines(part.column(2), least_chars)
                node = _hashes(line)
                some = np.arange(len(node)) if wanted is None else np.flatnonzero(_among(node, wanted.value))
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(pos[some].astype(np.int32)), pa.array(node[some]), line.take(pa.array(some)).cast(pa.string())], names=["doc_id", "text_hash", "pos", "node", "norm"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, pos int, node long, norm string")


def bands(texts: pa.Array) -> np.ndarray:
    """(BANDS, texts) bucket keys of texts of at least GRAM characters, from the least hashes of their 5-grams under each order."""
    data, ends = text_bytes(texts)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)[ends - 1] if len(ends) else []]).astype(np.int64)
    out = np.empty((BANDS, len(texts)), np.uint64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
        c = code[ends[at] : ends[to]].astype(np.uint64)
        n = len(c) - GRAM + 1
        h = c[:n].copy()
        for k in range(1, GRAM):
            h *= STIR[0]
            h += c[k : k + n]
        h *= STIR[1]
        g = (h >> np.uint64(32)).astype(np.uint32)
        g ^= g >> np.uint32(15)
        start = ends[at:to] - ends[at]
        # A text's last grams run on into the next one: they are taken for its first, which changes no least hash.
        last = np.arange(1, GRAM)[None, :]
        over = ((ends[at + 1 : to] - ends[at])[:, None] - last).ravel()
        g[over] = np.repeat(g[start[:-1]], GRAM - 1)
        least = [np.minimum.reduceat(g * a, start).astype(np.uint64) for a in ORDERS]
        for k in range(BANDS):
            key = np.full(to - at, k + 1, np.uint64)
            for x in least[k * ROWS : (k + 1) * ROWS]:
                key = (key + x) * STIR[0]
                key ^= key >> np.uint64(29)
                key *= STIR[1]
            out[k, at:to] = key
        at = to
    return out


def _signatures(docs: DataFrame, least_chars: int, every: int) -> DataFrame:
    """(node, n, b0, b1, ...) of every distinct line of at least `every` characters, with n its occurrences; bands of too short lines are null."""
    names = [f"b{k}" for k in range(BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                line = normal_lines(batch.column(0).slice(k, ROWS_AT_ONCE), every)[2]
                node, first, n = np.unique(_hashes(line), return_index=True, return_counts=True)
                texts = line.take(pa.array(first))
                long = pc.greater_equal(pc.utf8_length(texts), max(least_chars, GRAM)).to_numpy(zero_copy_only=False)
                found = np.zeros((BANDS, len(node)), np.int64)
                found[:, long] = bands(texts.filter(pa.array(long))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), *(pa.array(x, mask=~long) for x in found)], names=["node", "n", *names])

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{x} long" for x in ["node", "n", *names]))
    return rows.groupBy("node").agg(F.sum("n").alias("n"), *[F.max(x).alias(x) for x in names])


def _gram_sets(texts: pa.Array) -> np.ndarray:
    """Sorted distinct (text's number, 52 bits of a 5-gram's hash), as one number each, of at most PAIRS_AT_ONCE texts."""
    data, ends = text_bytes(texts)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.diff(np.cumsum((data & 0xC0) != 0x80)[ends - 1], prepend=0) - GRAM + 1
    first = np.cumsum(size + GRAM - 1) - (size + GRAM - 1)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    h = code[at]
    for k in range(1, GRAM):
        h = h * STIR[0] + code[at + k]
    h ^= h >> np.uint64(29)
    h *= STIR[1]
    out = np.sort(np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(52), size) | (h >> np.uint64(12)))
    return out[np.append(True, out[1:] != out[:-1])]


def alike(x: pa.Array, y: pa.Array, similar: float) -> np.ndarray:
    """Which of the pairs (x[k], y[k]) of lines of at least GRAM characters have similar sets of 5-grams."""
    out = []
    for k in range(0, len(x), PAIRS_AT_ONCE):
        a, b = _gram_sets(x.slice(k, PAIRS_AT_ONCE)), _gram_sets(y.slice(k, PAIRS_AT_ONCE))
        both = np.sort(np.concatenate([a, b]))
        n = len(x.slice(k, PAIRS_AT_ONCE))
        m, common = (np.bincount((c >> np.uint64(52)).astype(np.int64), minlength=n) for c in (np.concatenate([a, b]), both[1:][both[1:] == both[:-1]]))
        out.append(common >= similar * (m - common))
    return np.concatenate(out) if out else np.zeros(0, bool)


def _marks(texts: pa.Array) -> np.ndarray:
    """(SKETCH + 1, texts): the number of a text's 5-grams, and 64 * SKETCH bits that say of which hash values their number is odd."""
    out = np.zeros((SKETCH + 1, len(texts)), np.int64)
    for k in range(0, len(texts), PAIRS_AT_ONCE):
        n = len(texts.slice(k, PAIRS_AT_ONCE))
        grams = _gram_sets(texts.slice(k, PAIRS_AT_ONCE))
        text, bit = (grams >> np.uint64(52)).astype(np.int64), ((grams >> np.uint64(40)) % np.uint64(64 * SKETCH)).astype(np.int64)
        odd = np.bincount(text * 64 * SKETCH + bit, minlength=n * 64 * SKETCH).astype(np.uint8) & 1
        out[0, k : k + n] = np.bincount(text, minlength=n)
        out[1:, k : k + n] = np.packbits(odd.reshape(n, -1), axis=1).view(np.int64).T
    return out


def _may_be_alike(left: str, right: str, similar: float) -> Column:
    """False where two rows with _marks can't be similar: each odd bit that differs stands for at least one 5-gram that only one of them has."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))) for k in range(SKETCH)])
    # Similar sets share similar / (1 + similar) of the sum of their sizes; doubles are given some room.
    return apart * (1 + similar) <= (F.col(f"{left}.size") + F.col(f"{right}.size")) * (1 - similar) + 1e-6


def line_places(docs: DataFrame, least_chars: int = LEAST_CHARS, similar: float = SIMILAR, short_exact: bool = False) -> DataFrame:
    """(doc_id, text_hash, pos, class) of the lines that occur more than once or are near duplicates of others."""
    every = 1 if short_exact else least_chars
    one = cut(_signatures(docs, least_chars, every))
    rows = one.where("b0 is not null").select("node", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("key"))
    # Only (key, node) is shuffled; a bucket of two lines is a pair as it stands.
    by = cut(rows.repartition("key").groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"))
    pairs = cut(by.where("n = 2").select("a", "b").distinct())
    many = by.where("n > 2").select("key", "n")
    crowd = cut(join_sized(rows, many, ["key"], "inner", many.count(), FETCH_ROWS))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct().select("node", F.lit(True).alias("wanted"))
    wanted = cut(one.where("n > 1").select("node").join(wanted, "node", "full").select("node", F.coalesce("wanted", F.lit(False)).alias("wanted")))
    # The only place where lines are read again; texts come along where they are to be compared.
    few = wanted.count() <= FETCH_ROWS
    lines = _lines(docs, every, np.sort(wanted.select("node").toPandas()["node"].to_numpy(np.int64)) if few else None)
    found = join_sized(lines, wanted, ["node"], "inner", 0 if few else FETCH_ROWS + 1, FETCH_ROWS)
    found = cut(found.select("doc_id", "text_hash", "pos", "node", "wanted", F.when(F.col("wanted"), F.col("norm")).alias("norm")))
    texts = cut(found.where("wanted").groupBy("node").agg(F.max("norm").alias("norm")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(alike(batch.column(2), batch.column(3), similar)))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("norm").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _marks(batch.column(1)))], names=["node", *marks])

    marks = ["size", *[f"s{k}" for k in range(SKETCH)]]
    sketched = lambda rows: rows.join(texts.join(rows.select("node").distinct(), "node", "left_semi").mapInArrow(sketch, ", ".join(f"{x} long" for x in ["node", *marks])), "node")
    parts = bucket_components(crowd, verify, where=lambda a, b: _may_be_alike(a, b, similar), attach=sketched, counted=True, pairs=pairs)
    places = join_sized(found.drop("norm", "wanted"), parts, ["node"], "left", parts.count(), FETCH_ROWS)
    return places.select("doc_id", "text_hash", "pos", F.coalesce("component", "node").alias("class"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, similar: float = SIMILAR, short_exact: bool = False, counts: bool = True) -> DataFrame:
    """The rows of docs, all columns, with text without the lines that repeat an earlier one, and `lines`, `dropped_lines`.

    Of a class of near-equal lines the first stays, by doc_id (null first), then text hash, then place in the text.
    Texts are cut at line feeds; a text of which all lines go becomes empty, and the row stays; null stays null, with
    0 lines. Lines of fewer than least_chars characters stay, or, with short_exact, go where they equal an earlier one; blank
    lines always stay. Rows with equal doc_id and text are one document here and share its outcome. Where docs has columns named lines or
    dropped_lines, those stay as they are and the counts' names get underscores; counts=False adds none. An empty table
    gives an empty result.
    """
    places = cut(line_places(docs, least_chars, similar, short_exact))
    place = F.struct("doc_id", "text_hash", "pos")
    firsts = cut(places.groupBy("class").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("class", "first"))
    gone = join_hot(places, firsts, "class", F.xxhash64("doc_id", "text_hash", "pos"), firsts.count()).where(place != F.col("first"))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_gone"))
    d, h, g, n, dropped = unused(docs, "_doc", "_hash", "_gone", "lines", "dropped_lines")
    gone = gone.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("_gone").alias(g))
    rows = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left")
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), g)
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    if counts:
        rows = rows.withColumn(n, F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).withColumn(dropped, F.when(F.col(g).isNull(), 0).otherwise(F.size(g)))
    return rows.withColumn("text", text).drop(d, h, g)
