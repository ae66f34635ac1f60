"""Approximate nearest vectors by cosine: cells of k-means, residual product codes, a file folder for each cell.

Vectors are scaled to length 1. Cells are centroids that several rounds of Lloyd's algorithm over all vectors settle,
started by k-means++ on a bounded sample; tasks send sums for each cell, never vectors. A cell that holds more than its
share is split. What is left of a vector after its cell's centroid is coded in PARTS bytes, by codewords fitted on the
sample. A search reads the folders of the cells nearest to its queries, ranks by codes, and scores the best again exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators.search import nearest as nearest_exact

if TYPE_CHECKING:
    import pyarrow as pa

#: Vectors with the smallest hashes on which starts and codewords are fitted, at most; codewords of a part.
SAMPLE, WORDS = 20_000, 256
#: Cells at most, rounds over all vectors, queries looked up together, and candidates scored again for each result.
CELLS, ROUNDS, QUERIES, REFINE = 4096, 6, 1024, 32
#: Rows of ids that may be sent to every task.
FEW = 20_000


@dataclass
class Codebook:
    """cells (c, d) and words (parts, WORDS, d / parts)."""

    cells: np.ndarray
    words: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.cells)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (x - self.cells[cell]).reshape(len(x), len(self.words), -1)
        return np.stack([nearest(rest[:, j], w).astype(np.uint8) for j, w in enumerate(self.words)], axis=1)


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The row of `to` that is nearest to each row of x."""
    return np.argmax(x @ to.T - (to * to).sum(1) / 2, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next row is drawn by its squared distance from those drawn before."""
    picked = [int(rng.integers(len(x)))]
    gap = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < k and gap.sum() > 1e-12:
        picked.append(int(rng.choice(len(x), p=gap / gap.sum())))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def _words(x: np.ndarray, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """WORDS codewords of the sample's rows; where there are fewer different rows, some come more than once."""
    w = _spread(x, min(WORDS, len(x)), rng)
    for _ in range(rounds):
        at = nearest(x, w)
        n = np.bincount(at, minlength=len(w))
        sums = np.zeros_like(w)
        np.add.at(sums, at, x)
        w = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], w)
    return w[np.arange(WORDS) % len(w)]


def _batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        yield batch.column(0), unit(flat.reshape(-1, d))


def _usable(vectors: DataFrame, d: int) -> DataFrame:
    """(id, embedding) of vectors of the index's length; others, null among them, can't be found."""
    return vectors.where(F.size("embedding") == d).select("id", F.col("embedding").cast("array<float>").alias("embedding"))


def settled(vectors: DataFrame, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after so many rounds over all vectors, and how many vectors each had in the last."""
    cells, d = start.astype(np.float32), start.shape[1]
    names = [f"s{k}" for k in range(d)]
    count = np.zeros(len(cells), np.int64)
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(cells)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import pyarrow as pa

            c = shared.value
            total, n = np.zeros(c.shape, np.float64), np.zeros(len(c), np.int64)
            for _, x in _batches(batches, d):
                at = nearest(x, c)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(c))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array(total[some, k]) for k in range(d))], names=["cell", "n", *names])

        rows = vectors.mapInArrow(sums, ", ".join(["cell long", "n long", *(f"{x} double" for x in names)])).groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toPandas()
        count[:] = 0
        count[rows["cell"]] = rows["n"]
        cells[rows["cell"]] = rows[names].to_numpy() / rows[["n"]].to_numpy()
        shared.unpersist()
    return cells, count


def train(vectors: DataFrame, cells: int | None = None, parts: int = 8, most: float = 4.0, seed: int = 1) -> Codebook:
    """Fit on vectors (id, embedding): cells (about the root of their number if not given, CELLS at most) and codewords.

    A cell of over `most` times the mean is split in two and settled again, until none is or CELLS are reached; vectors
    that are all alike can't be split. parts must divide the vectors' length, that of the first by hash.
    """
    order = F.xxhash64(F.lit(seed), "id")
    sample = vectors.where("size(embedding) > 0").orderBy(order, "id").limit(SAMPLE).select(F.col("embedding").cast("array<float>")).toPandas()["embedding"]
    if not len(sample):
        raise ValueError("no vectors to fit on")
    d = len(sample.iloc[0])
    if d % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {d}")
    x = unit(np.stack([v for v in sample if len(v) == d]).astype(np.float32))
    rows = _usable(vectors, d)
    number = rows.count()
    rng = np.random.default_rng(seed)
    wanted = min(CELLS, cells or max(1, int(number**0.5)), len(x))
    found, count = settled(rows, _spread(x, wanted, rng), ROUNDS)
    for _ in range(8):
        full = np.flatnonzero(count > max(most * number / len(found), 1))
        if not len(full) or len(found) + len(full) > CELLS:
            break
        shift = rng.normal(scale=0.01, size=(len(full), d)).astype(np.float32)
        start = np.concatenate([found, found[full] + shift])
        start[full] -= shift
        found, count = settled(rows, start, 2)
    found = found[count > 0]
    rest = (x - found[nearest(x, found)]).reshape(len(x), parts, -1)
    return Codebook(found, np.stack([_words(rest[:, j], rng) for j in range(parts)]).astype(np.float32))


def build(vectors: DataFrame, path: str, book: Codebook) -> None:
    """Writes (id, code) of all vectors (id, embedding), a folder for each cell, and the codebook beside them."""
    spark, d = vectors.sparkSession, book.cells.shape[1]
    shared = spark.sparkContext.broadcast(book)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for ids, x in _batches(batches, d):
            cell = shared.value.nearest(x)
            codes = shared.value.encode(x, cell)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])

    rows = _usable(vectors.withColumn("id", F.col("id").cast("long")), d).mapInArrow(code, "id long, cell int, code binary")
    # Equal rows of a hot cell go to several tasks; a folder may hold several files.
    rows.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/codes")
    tables = [(name, list(x.shape), bytearray(x.astype("<f4").tobytes())) for name, x in (("cells", book.cells), ("words", book.words))]
    spark.createDataFrame(tables, "name string, shape array<int>, data binary").coalesce(1).write.parquet(f"{path}/book")


def read_book(spark: SparkSession, path: str) -> Codebook:
    return Codebook(**{r.name: np.frombuffer(bytes(r.data), "<f4").reshape(r["shape"]) for r in spark.read.parquet(f"{path}/book").collect()})


def search(queries: DataFrame, vectors: DataFrame, path: str, k: int = 10, probes: int = 16, digits: int = 6) -> DataFrame:
    """The k vectors found for each query, as (query_id, id, cosine, rank); cosines are exact, ties go by id.

    queries: (query_id, vector), a stated set, in blocks of QUERIES; vectors: (id, embedding), of which only the
    candidates' are looked at. probes: cells read for each query. A vector beyond them is missed, so recall has to be measured.
    """
    spark = queries.sparkSession
    book = read_book(spark, path)
    d = book.cells.shape[1]
    stated = queries.where(F.size("vector") == d).select("query_id", V.doubles(F.col("vector")).alias("v"))
    blocks = max(1, -(-stated.count() // QUERIES))
    out = None
    for b in range(blocks):
        rows = stated.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        q = unit(np.stack(rows["v"]).astype(np.float32)) if len(rows) else np.zeros((0, d), np.float32)
        near = q @ book.cells.T - (book.cells * book.cells).sum(1) / 2
        cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        wants = {int(c): np.flatnonzero((cells == c).any(1)) for c in np.unique(cells)}
        table = np.einsum("qjs,jws->qjw", q.reshape(len(q), len(book.words), -1), book.words)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), q @ book.cells.T, table, wants))
        keep = k * REFINE

        def rank(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import pyarrow as pa

            ids, base, table, wants = shared.value
            parts = np.arange(table.shape[1])
            held: dict[int, list] = {}  # query: vectors' ids and scores, some batches of them, and how many

            def best(i: int) -> tuple[np.ndarray, np.ndarray]:
                own, score = (np.concatenate(x) for x in zip(*held[i][0], strict=True))
                at = np.lexsort((own, -score))[:keep]
                return own[at], score[at]

            for batch in batches:
                own, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(own), -1)
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    mine, code = own[at], codes[at]
                    for i in wants.get(int(c), ()):
                        more = held.setdefault(int(i), [[], 0])
                        more[0].append((mine, base[i, c] + table[i][parts, code].sum(1)))
                        more[1] += len(mine)
                        if more[1] > 4 * keep:
                            more[0] = [best(int(i))]
                            more[1] = len(more[0][0][0])
            for i in held:
                found, score = best(i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ids[i])), pa.array(found), pa.array(score.astype(np.float64))], names=["query_id", "id", "near"])

        read = spark.read.schema("id long, code binary, cell int").parquet(f"{path}/codes").where(F.col("cell").isin(list(wants)))
        found = read.select("id", "code", "cell").mapInArrow(rank, "query_id long, id long, near double")
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))).where(F.col("n") <= keep).select("query_id", "id")
        out = found if out is None else out.union(found)
    exact = out.join(vectors.select("id", V.doubles(F.col("embedding")).alias("e")), "id").join(F.broadcast(stated) if blocks * QUERIES <= FEW else stated, "query_id")
    scored = exact.select("query_id", "id", F.round(V.cosine(F.col("v"), F.col("e")), digits).alias("cosine"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))).where(F.col("rank") <= k)


def probes_for(vectors: DataFrame, path: str, least: float = 0.93, k: int = 10, queries: int = 100) -> int:
    """The smallest number of probes, each half as many again as the one before, that finds the share `least` of the exact k nearest.

    It is measured on so many vectors, those with the smallest hashes, against all; with all cells at the most, where only
    the codes' order can miss.
    """
    some = vectors.where("embedding is not null").orderBy(F.xxhash64(F.lit(2), "id"), "id").limit(queries)
    asked = some.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = nearest_exact(asked, vectors.select(F.col("id").alias("chunk_id"), F.col("id").alias("memory_id"), "embedding"), k).select("query_id", F.col("chunk_id").alias("id"))
    want = {tuple(r) for r in exact.collect()}  # queries * k
    cells, probes = len(read_book(vectors.sparkSession, path).cells), 4
    while probes < cells:
        found = {(r.query_id, r.id) for r in search(asked, vectors, path, k, probes).collect()}
        if len(found & want) >= least * len(want):
            return probes
        probes += -(-probes // 2)
    return cells
