"""Helpers that several training-data operators use: cutting lineage, size-checked joins, linking and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: ASCII white space, the only characters that separate words here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table may be broadcast; a row here is a few numbers or a short name.
BROADCAST_ROWS = 20_000
#: Rows of a few numbers that a task takes where a table is counted: steps over small tables don't run as hundreds of tasks.
TASK_ROWS = 50_000


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset a temporary one on one machine, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep its rows in the shared folder, so that later steps don't compute them again."""
    folder(df.sparkSession)
    return df.checkpoint()


def for_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, whose rows are counted, in no more partitions than they need; what follows on one partition needs no shuffle."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut, for rows of a few numbers: in no more partitions than they need, with their number."""
    df = cut(df)
    rows = df.count()
    return for_tasks(df, rows), rows


def settle(df: DataFrame) -> DataFrame:
    return counted(df)[0]


def ordered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df's rows with their place from 0 in this order as column `name`: ranges are sorted side by side, then moved by the number of rows before them.

    Rows that are equal in `order` get places in any order, kept from then on. The driver gets one number for each partition.
    """
    bits = 33  # of the row's number within its partition, as Spark defines the function
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    sizes = sorted(rows.groupBy(F.shiftright(name, bits).cast("int").alias("p")).count().collect())
    before = dict(zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False))
    part = df.sparkSession.createDataFrame(list(before.items()), "_p int, _n long")
    rows = rows.join(F.broadcast(part), F.shiftright(name, bits).cast("int") == F.col("_p"))
    return rows.withColumn(name, F.col("_n") + F.col(name).bitwiseAND(F.lit((1 << bits) - 1))).drop("_p", "_n")


def stored(df: DataFrame, compression: str = "none") -> DataFrame:
    """df written once as a table in the shared folder and read again, for wide rows of which later steps read some columns."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever its case rules."""
    have = {c.lower() for c in df.columns}
    longest = max(map(len, have), default=0)
    return [n if n.lower() not in have else n + "_" * (longest + 1) for n in names]


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side that no join broadcasts: Spark sizes what Python or an explode makes of a small table by that table's rows, however many come of each."""
    return df.hint("merge")


def join_sized(df: DataFrame, side: DataFrame, on: list[str] | Column, how: str, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side of a known number of rows: broadcast while it is small, else shuffled, where AQE splits hot keys."""
    return df.join(F.broadcast(side) if rows <= most else side, on, how)


def join_hot(df: DataFrame, side: DataFrame, on: str, spread: Column, rows: int, salts: int = 32) -> DataFrame:
    """Join with a side of one row for each key, where one key may hold a third of df: broadcast while that is small, else salted.

    spread: a hash of what tells df's rows apart; it deals a key's rows to so many tasks, and the side is repeated for each.
    """
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), on)
    (salt,) = unused(df, "_salt")
    many = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int")).join(many, [on, salt]).drop(salt)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each ends in them; null is empty."""
    import pyarrow as pa

    plain = texts.fill_null("").cast(pa.large_string())
    _, ends, data = plain.buffers()
    ends = np.frombuffer(ends, np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends[1:] - ends[0]


def with_texts(docs: DataFrame, start: Callable[[], Callable[[list[str | None]], list[pa.Array]]], schema: str) -> DataFrame:
    """doc_id long of every row of docs, and columns made of its whole text, as schema says.

    start gives a task its function from a batch's texts to the columns. doc_id never leaves Arrow, so a null beside it
    doesn't round ids beyond 2^53.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        make = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(batch.column(1).to_pylist())], names=["doc_id", *[x.split()[0] for x in schema.split(", ")]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def pairs_of(df: DataFrame, names: tuple[str, str], *pairs: tuple[str, str]) -> DataFrame:
    """Pairs of df's columns, one below the other under these names; a union would have one partition more for each."""
    return df.select(F.explode(F.array(*[F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in pairs])).alias("p")).select("p.*")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs, as (node, component) with the smallest node as component.

    Alternates large-star and small-star steps: every round is a map-side combined minimum and a join by node, so no
    component is ever gathered in one task. The edges of each round go to the shared folder.
    """
    cur, rows = counted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = pairs_of(cur, ("u", "v"), ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = for_tasks(large, rows)  # a join of single partitions doesn't count as one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = for_tasks(large.join(low, "u"), rows)
        small = pairs_of(stars, ("u", "v"), ("u", "m"), ("v", "m"))
        cur = cut(small.where("u > v").distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rows = now[0]
        cur = for_tasks(cur, rows)
        if now == mark:
            break
        mark = now
    return pairs_of(cur, ("node", "component"), ("u", "v"), ("v", "v")).distinct()


def keep_firsts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of docs that stay when each component of texts keeps its first, by doc_id (null last), then text hash.

    parts: (node, component), node being xxhash64 of a text; texts that it lacks are components of their own. Rows that
    repeat doc_id and text of one that stays, stay too: they can't be told from it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    one = rows.groupBy("node").agg(F.min(order).alias("first")).join(parts, "node", "left")
    firsts = one.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    d, h = unused(docs, "_doc", "_hash")
    firsts = firsts.select(F.col("first.doc_id").alias(d), F.col("first.node").alias(h))
    return docs.join(firsts, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_semi")


def merged(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after more edges (a, b), of which only those between components are followed."""
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"{side}c"))
    e, rows = counted(edges)
    e = for_tasks(e.join(of("a"), "a", "left"), rows).join(of("b"), "b", "left")
    e, rows = counted(e.select("a", "b", F.coalesce("ac", "a").alias("ac"), F.coalesce("bc", "b").alias("bc")).where("ac <> bc"))
    up = components(e.select(F.col("ac").alias("a"), F.col("bc").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("up"))
    new = pairs_of(e, ("node", "new"), ("a", "ac"), ("b", "bc")).where("node = new").distinct()
    every = for_tasks(parts.join(new, "node", "full"), parts.count() + 2 * rows).select("node", F.coalesce("component", "new").alias("component"))
    return settle(every.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")))


def link_buckets(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """Edges (a, b), a star for each component of bucket_components."""
    return bucket_components(rows, verify, **how).where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def bucket_components(
    rows: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    where: Callable[[str, str], Column] | None = None,
    attach: Callable[[DataFrame], DataFrame] | None = None,
    holds: Callable[[str, str], Column] | None = None,
    hot: int = 16,
    rounds: int = 4,
    counted: bool = False,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """(node, component) of the nodes with links, links being all verified pairs that share a bucket; the smallest node names a component.

    rows: (key, node long, ...), one row for each bucket that a node is in; counted: they have their bucket's size n, are
    of buckets with more than one row, and are cheap to read again. verify: keeps the pairs (a, b) that hold. where: a
    condition on two rows, given their aliases, that a pair meets in at least one of its shared buckets. holds: the
    whole verification as such a condition (where, if that is one), on rows with what attach adds. pairs: those of buckets
    that rows leaves out; the others are then all crowded.

    Buckets of at most hot nodes are joined with themselves. Larger ones never give all their pairs: every node is
    compared with one hub of its bucket, then, in buckets that still hold two components, with a few more hubs of other
    components, and at last the nodes outside the largest with the nodes of other components. A pair within one component could not
    change the components, so nothing is lost and no bucket is capped.
    """
    if not counted:
        rows = cut(shuffled(rows).join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    ends = lambda x: x.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    if pairs is None:
        some = rows.where(F.col("n") <= hot).drop("n")
        cold = some.alias("l").join(some.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")))
        pairs = ends(cold if where is None else cold.where(where("l", "r")))
        rows = rows.where(F.col("n") > hot)
    crowd = settle(rows.drop("n"))
    if crowd.isEmpty():
        return settle(components(verify(pairs)))
    hub = lambda rows, k: rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), F.xxhash64("node", F.lit(k))).alias("hub"))
    spokes = lambda rows: rows.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    found = settle(components(verify(pairs.union(spokes(crowd.join(hub(crowd, 0), "key").where("node <> hub.node"))).distinct())))

    def place(found: DataFrame) -> DataFrame:
        """The rows of crowded buckets that hold more than one component, with their component (part) and the bucket's largest (main)."""
        placed = settle(crowd.join(found, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"))
        parts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("key").agg(F.count("*").alias("k"), F.max_by("part", F.struct("n", "part")).alias("main")).where("k > 1").drop("k")
        return settle(placed.join(mixed, "key"))

    placed = place(found)
    if placed.isEmpty():
        return found
    more = [spokes(placed.join(hub(placed, k), "key").where("part <> hub.part")) for k in range(1, rounds)]
    found = merged(found, verify(reduce(DataFrame.union, more).distinct()))
    placed = place(found)
    if placed.isEmpty():
        return found
    placed = placed if attach is None else attach(placed)
    apart = (F.col("l.part") != F.col("r.part")) & ((F.col("r.part") == F.col("r.main")) | (F.col("l.node") < F.col("r.node")))
    if holds:
        apart &= holds("l", "r")
    elif where:
        apart &= where("l", "r") | where("r", "l")
    rest = ends(placed.where("part <> main").alias("l").join(placed.alias("r"), (F.col("l.key") == F.col("r.key")) & apart))
    return merged(found, rest if holds else verify(rest))
