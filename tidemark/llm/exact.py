"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by their length and then, most significant bytes first, by successive runs of bytes, each run eight
times as long as the one before. A group leaves when it holds one document or when its bytes have ended: its members
are then equal, byte for byte, and no digest takes part in the decision. Each round is a map-side combined count for
each (group, run of bytes) and a join back, so copies of one text are never gathered in one task: AQE splits the join's
hot keys. Only documents that still share a group are carried, with their texts, to the next round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, cut

#: Bytes in the first run, how many times as long each next run is, and the longest run.
FIRST, TIMES, LONGEST = 64, 8, 1 << 20


def _split(rows: DataFrame, at: int, wide: int) -> DataFrame:
    """Rows (row, grp, bytes, ...) with their group after this run, and its size n; a group is named by its smallest row."""
    rows = rows.withColumn("digit", F.substring("bytes", at + 1, wide))
    many = rows.groupBy("grp", "digit").agg(F.count("*").alias("n"), F.min("row").alias("to")).where("n > 1")
    return rows.join(many, ["grp", "digit"], "left").drop("digit")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) as (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of ASCII white space is replaced by one space; null counts as empty.
    Of equal texts the row with the smallest doc_id stays (a null doc_id only where the group has no other; of repeated
    rows with that doc_id, one). text_sha256 is that of the normalised text in UTF-8 and only reported. An empty table
    gives an empty result; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("bytes"))
    base = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("bytes").cast("long").alias("grp"), F.sha2("bytes", 256).alias("text_sha256"), "bytes")
    # The row numbers hold from here on, as this table is written once. The length is the first group.
    digit = F.substring("bytes", 1, FIRST)
    many = docs.select(F.encode(text, "UTF-8").alias("bytes")).select(F.octet_length("bytes").cast("long").alias("grp"), digit.alias("digit")).groupBy("grp", "digit").agg(F.count("*").alias("n")).where("n > 1").select("grp", "digit", F.xxhash64("grp", "digit").alias("to"))
    first = base.withColumn("digit", digit).join(many, ["grp", "digit"], "left")
    first = cut(first.select("row", "doc_id", "text_sha256", F.col("grp").alias("size"), "digit", F.col("to").isNotNull().alias("shared"), F.when(F.col("to").isNotNull(), F.col("bytes")).alias("bytes")))
    # Groups after the first run: (length, run), named by their smallest row.
    shared = first.where("shared")
    names = shared.groupBy("size", "digit").agg(F.min("row").alias("grp"))
    cur = shared.join(names, ["size", "digit"]).select("row", "grp", "size", "bytes")
    done, at, wide = [cur.where(F.col("size") <= FIRST).select("row", "grp")], FIRST, FIRST * TIMES
    cur = cut(cur.where(F.col("size") > FIRST))
    while not cur.isEmpty():
        nxt = _split(cur, at, wide).where("n > 1").select("row", F.col("to").alias("grp"), "size", "bytes")
        at, wide = at + wide, min(wide * TIMES, LONGEST)
        nxt = cut(nxt.withColumn("bytes", F.when(F.col("size") > at, F.col("bytes"))))
        done.append(nxt.where(F.col("size") <= at).select("row", "grp"))
        cur = nxt.where(F.col("size") > at)
    equal = reduce(DataFrame.union, done)
    rows = first.drop("bytes", "size", "digit", "shared").join(equal, "row", "left").withColumn("grp", F.coalesce("grp", "row"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = rows.groupBy("grp").agg(F.count("*").alias("group_size"), best.alias("best"))
    out = rows.join(groups, "grp")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
