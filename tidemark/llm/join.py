"""Similarity join of documents by the exact Jaccard similarity of their sets of word shingles.

The sets are the rows of a sparse matrix, documents by shingles. What is written is each row's text, less than half as large as its
set, and steps make the set again, as only words are hashed as bytes and a shingle is a sum of its words' hashes. The product of
the matrix with its transpose holds the sizes of all intersections; it is never made in full:

* Equal sets are one row, and rows whose sizes alone rule a link out never meet.
* Only a row's first columns are multiplied, in one order for all rows: of linked sets, the first n - ceil(0.8 n) + 1
  columns have one in common. Shingles that many rows have stand last in that order, so passages which many documents
  share seldom meet at all. The order decides what the join costs, not what it finds.
* Tasks multiply blocks of columns: a column of few rows gives its pairs, a block adds up how often a pair meets, and
  the blocks' sums are added. A pair whose sum and remaining columns can't reach the overlap that its sizes call for
  is discarded; the others are counted on the whole rows.
* Columns of many rows never give all their pairs: rows are compared with hubs, then across the components that are
  left (shared.bucket_components), where odd sketches rule out most before whole rows are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .lines import SKETCH, _may_be_alike
from .shared import bucket_components, cut, join_hot, join_sized, merged, stored

if TYPE_CHECKING:
    import pyarrow as pa

#: Words of a shingle, and the similarity in percent from which on two documents link.
SHINGLE, PERCENT = 5, 80
#: Rows of a column up to which it gives all its pairs.
FEW = 16
#: Shingles put last in the order, at most; they are found in blocks of COLUMNS entries, where they are in over FEW rows.
LAST, COLUMNS = 1 << 20, 1 << 22
#: Rows of one or two longs that may be broadcast.
FETCH_ROWS = 500_000
#: Words hashed at once; bytes of sets that a task keeps while it compares pairs.
BLOCK, KEPT = 100_000, 1 << 25
#: Columns by which two rows are compared before their texts are.
MARKS = ["size", *[f"s{k}" for k in range(SKETCH)]]
#: Odd multipliers of a shingle's words are powers of the first; the second mixes the sum.
TURN, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words in order, A-Z in lower case; bytes.split knows the same white space as WORD."""
    rest, parts = (text or "").encode().lower(), [np.zeros(0, np.uint64)]
    while rest:
        some = rest.split(None, BLOCK)
        rest = some.pop() if len(some) > BLOCK else b""
        parts.append(np.fromiter(map(xxh64_intdigest, some), np.uint64, len(some)))
    return np.concatenate(parts)


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = _word_hashes(text)
    width = min(shingle, len(words))
    if not width:
        return np.zeros(0, np.int64)
    sums = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        sums += words[k : len(words) - width + 1 + k] * np.uint64(pow(TURN, k + 1, 1 << 64))
    sums = (sums ^ sums >> np.uint64(32)) * np.uint64(MIX)
    sums = np.sort((sums ^ sums >> np.uint64(32)).view(np.int64))
    return sums[np.append(True, sums[1:] != sums[:-1])]


def _sketch(sets: list[np.ndarray]) -> np.ndarray:
    """(SKETCH, sets): 64 * SKETCH bits that say of which hash values a set's number is odd."""
    out = np.zeros((SKETCH, len(sets)), np.int64)
    for k, x in enumerate(sets):
        out[:, k] = np.packbits((np.bincount(x & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)
    return out


def matrix(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, size, k1, k2, s0, s1, ..., text) of every row of docs: its number, its set's size, two hashes and an odd sketch of the set, its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [grams(x, shingle) for x in part.column(1).to_pylist()]
                raw = [x.tobytes() for x in sets]
                keys = [pa.array(np.array([xxh64_intdigest(x, seed) for x in raw], np.uint64).view(np.int64)) for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), *keys, *map(pa.array, _sketch(sets)), part.column(1)], names=["doc_id", "size", "k1", "k2", *MARKS[1:], "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{x} long" for x in ["doc_id", "size", "k1", "k2", *MARKS[1:]]) + ", text string")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "zstd")


def _rows(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch.column(0).to_numpy(), [grams(x, shingle) for x in batch.column(1).to_pylist()]


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's members come first: one more than a linked set may lack."""
    return size - (-(-size * percent // 100)) + 1


def _frequent(rows: DataFrame, shingle: int) -> np.ndarray:
    """Sorted shingles that are in more than FEW rows of blocks of the matrix, added up; the most frequent LAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def count(held: list[np.ndarray]) -> pa.RecordBatch:
            col, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(col[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["col", "n"])

        held, size = [np.zeros(0, np.int64)], 0
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            for x in _rows(batch, shingle)[1]:
                held.append(x)
                size += len(x)
                if size >= COLUMNS:
                    yield count(held)
                    held, size = [np.zeros(0, np.int64)], 0
        yield count(held)

    found = rows.select("row", "text").mapInArrow(run, "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).where(F.col("n") > FEW)
    return np.sort(found.orderBy(F.desc("n"), "col").limit(LAST).toPandas()["col"].to_numpy(np.int64))


def _entries(rows: DataFrame, last, shingle: int, percent: int) -> DataFrame:  # noqa: ANN001
    """(late, col, row, size, pos): the columns of each row that are multiplied, the first in the order, with their place in it; late ones are in `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        known = last.value
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            row, sets = _rows(batch, shingle)
            size = np.array([len(x) for x in sets], np.int64)
            col = np.concatenate([np.zeros(0, np.int64), *sets])
            of = np.repeat(np.arange(len(row)), size)
            late = known[np.minimum(np.searchsorted(known, col), len(known) - 1)] == col if len(known) else np.zeros(len(col), bool)
            order = np.lexsort((late, of))  # stable: columns ascend among the early and the late ones of a row
            begin = np.cumsum(size) - size
            pos = np.arange(len(col)) - begin[of]
            first = pos < _need(size, percent)[of]
            some = order[first]
            pos, col, of, late = pos[first], col[some], of[some], late[some]
            yield pa.RecordBatch.from_arrays([pa.array(late), pa.array(col), pa.array(row[of]), pa.array(size[of].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["late", "col", "row", "size", "pos"])

    return rows.select("row", "text").mapInArrow(run, "late boolean, col long, row long, size int, pos int")


def _outer(block: np.ndarray, percent: int) -> np.ndarray:
    """(a, b, size of a, size of b, met) of (col, row, size, ...) sorted by col: pairs whose sizes allow a link, with the number of columns they share."""
    found = [np.zeros((4, 0), np.int64)]
    for gap in range(1, FEW):
        same = block[0, gap:] == block[0, :-gap]
        if not same.any():
            break
        x, y = block[1:, :-gap][:, same], block[1:, gap:][:, same]
        ok = np.minimum(x[1], y[1]) * 100 >= percent * np.maximum(x[1], y[1])
        x, y = x[:, ok], y[:, ok]
        swap = x[0] > y[0]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        found.append(np.array([x[0], y[0], x[1], y[1]]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    first = np.flatnonzero(np.append(True, (pairs[:2, 1:] != pairs[:2, :-1]).any(0))[: pairs.shape[1]])
    return np.concatenate([pairs[:, first], np.diff(np.append(first, pairs.shape[1]))[None, :]])


def _product(entries: DataFrame, percent: int) -> DataFrame:
    """Blocks of columns, multiplied: rows (a, b, na, nb, met) for pairs, and (a, na, met, col), met being the place, for the entries of columns with more than FEW rows."""
    names = ["a", "b", "na", "nb", "met", "col"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def crowd(x: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(x.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x[1]), none, pa.array(x[2]), none, pa.array(x[3]), pa.array(x[0])], names=names)

        rest, over = np.zeros((4, 0), np.int64), None
        for batch in chain(batches, [None]):
            if batch is not None:
                late, *new = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                new = np.array(new, np.int64)
                if late.any():
                    yield crowd(new[:, late])
                rest = np.concatenate([rest, new[:, ~late]], axis=1)
            # The last column may go on in the next batch, of which this keeps no more than FEW rows.
            whole = rest.shape[1] if batch is None else int(np.searchsorted(rest[0], rest[0, -1])) if rest.shape[1] else 0
            if over is not None:
                to = int(np.searchsorted(rest[0], over, "right"))
                if to:
                    yield crowd(rest[:, :to])
                rest, whole = rest[:, to:], max(whole - to, 0)
            block, rest = rest[:, :whole], rest[:, whole:]
            if rest.shape[1] > FEW:
                yield crowd(rest)
                over, rest = int(rest[0, 0]), rest[:, :0]
            if whole:
                first = np.flatnonzero(np.append(True, block[0, 1:] != block[0, :-1]))
                many = np.repeat(np.diff(np.append(first, whole)) > FEW, np.diff(np.append(first, whole)))
                if many.any():
                    yield crowd(block[:, many])
                pairs = _outer(block[:, ~many], percent)
                yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), pa.nulls(pairs.shape[1], pa.int64())], names=names)

    # A column's entries come together, those of a frequent one stay dealt out by row.
    dealt = entries.repartition(F.when(F.col("late"), F.col("row")).otherwise(F.col("col"))).sortWithinPartitions("late", "col")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def links(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the rows (row, size, s0, ..., text), all sets different, that are linked to others."""
    last = rows.sparkSession.sparkContext.broadcast(_frequent(rows, shingle))
    made = cut(_product(_entries(rows, last, shingle, percent), percent))
    crowd = made.where("b is null").select("col", F.col("a").alias("row"), F.col("met").alias("pos"))
    crowded = cut(crowd.groupBy("row").agg(F.count("*").alias("k")))
    met = made.where("b is not null").groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))
    of = lambda x: crowded.select(F.col("row").alias(x), F.col("k").alias(f"k{x}"))
    met = met.join(of("a"), "a", "left").join(of("b"), "b", "left")
    # Of two rows, the one whose first columns end earlier has met the other in all that both have up to there.
    beyond = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    most = F.col("met") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) + F.greatest(beyond("na"), beyond("nb"))
    pairs = cut(met.where(most * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "met"))
    # Whole rows are compared for each row's likeliest pair first, then only across the components that these leave.
    likely = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a")).select("a", "b"))

    def whole(nodes: DataFrame, *columns: str) -> DataFrame:
        """These columns of the rows with these numbers (row)."""
        nodes = cut(nodes.distinct())
        return join_sized(rows.select("row", *columns), nodes, ["row"], "left_semi", nodes.count(), FETCH_ROWS)

    def alike(left: str, right: str) -> Column:
        sizes = F.least(f"{left}.size", f"{right}.size") * 100 >= F.greatest(f"{left}.size", f"{right}.size") * percent
        return sizes & _may_be_alike(left, right, percent / 100)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kept, size = {}, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for k, (pair, *texts) in enumerate(zip(ids, batch.column(2), batch.column(3), strict=True)):
                for row, text in zip(pair, texts, strict=True):
                    if row not in kept:
                        found = grams(text.as_py(), shingle)
                        if size + found.nbytes > KEPT:
                            kept, size = {x: kept[x] for x in pair if x in kept}, 0
                        kept[row] = found
                        size += found.nbytes
                x, y = (kept[row] for row in pair)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def verify(pairs: DataFrame) -> DataFrame:
        # Sizes and sketches, of some hundred bytes a row, rule out most pairs; only texts of the others are shuffled.
        pairs = cut(pairs.select("a", "b"))
        ends = lambda: pairs.select(F.explode(F.array("a", "b")).alias("row"))
        marks = whole(ends(), *MARKS)
        met = pairs.join(marks.alias("l"), F.col("a") == F.col("l.row")).join(marks.alias("r"), F.col("b") == F.col("r.row"))
        pairs = cut(met.where(alike("l", "r")).select("a", "b"))
        every = whole(ends(), "text")
        side = lambda x: every.select(F.col("row").alias(x), F.col("text").alias(f"t{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")

    def sketched(placed: DataFrame) -> DataFrame:
        return placed.join(whole(placed.select(F.col("node").alias("row")), *MARKS).withColumnRenamed("row", "node"), "node")

    def near(left: str, right: str) -> Column:
        # The first column that two rows share and what follows it must hold all that they share; so a pair seldom comes once for each column.
        rest = F.least(*[F.col(f"{x}.size") - F.col(f"{x}.pos") for x in (left, right)])
        return (rest * (100 + percent) >= (F.col(f"{left}.size") + F.col(f"{right}.size")) * percent) & alike(left, right)

    buckets = crowd.select(F.col("col").alias("key"), F.col("row").alias("node"), "pos")
    found = bucket_components(buckets, verify, where=near, attach=sketched, counted=True, pairs=likely)
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"{x}c"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")
    return merged(found, verify(rest.join(likely, ["a", "b"], "left_anti")))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Every row of docs (doc_id, text), read whole, as (doc_id, n_shingles, component_id).

    A set holds the distinct shingles of the text's words, A-Z in lower case; a text with fewer words than a shingle has
    is one shingle; null or without words: the empty set, linked with nothing. Sets link when 100 * intersection >=
    percent * union, so equal sets do. component_id is the smallest doc_id reachable; for an empty set its own. Repeated
    rows each come back; a null doc_id comes back null and is never a component_id unless a component holds nothing
    else. Other columns aren't read. An empty table gives an empty result. Shingles are compared by 64-bit hashes.
    """
    every = matrix(docs, shingle)
    sets = cut(every.where("size > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("n")))
    copies = cut(every.where("size > 0").join(sets.where("n > 1").select("k1", "k2", "node"), ["k1", "k2"]).where("row <> node").select("row"))
    rows = join_sized(every.where("size > 0").select("row", *MARKS, "text"), copies, ["row"], "left_anti", copies.count(), FETCH_ROWS)
    part = links(rows, shingle, percent)
    linked = sets.join(part, "node")
    least = cut(linked.groupBy("component").agg(F.min("first").alias("component_id")))
    some = join_hot(linked.select("k1", "k2", "component"), least, "component", F.col("k1"), least.count()).select("k1", "k2", "component_id")
    found = sets.join(part, "node", "left_anti").select("k1", "k2", F.col("first").alias("component_id")).union(some)
    own = every.where("size > 0").select("doc_id", "size", "k1", "k2").join(found, ["k1", "k2"])
    return own.select("doc_id", F.col("size").alias("n_shingles"), "component_id").union(every.where("size = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))
