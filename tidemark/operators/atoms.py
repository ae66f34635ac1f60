"""Atoms: typed beliefs (project, type, subject, predicate) -> value, of which a newer one may retire the one before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much surer the current atom may be before a newer one no longer retires it.
TOLERANCE, EPSILON = 0.2, 1e-9
COLUMNS = ("id", "project", "type", "subject", "predicate", "value", "confidence", "seq", "asserted", "valid_from")
OUT = "id long, status string, old_id long, retired_at timestamp_ntz"


def plain(x: str) -> Column:
    return F.lower(F.trim(F.col(x)))


def _keyed(atoms: DataFrame, at: Column) -> DataFrame:
    key = F.struct(F.col("project"), F.col("type"), plain("subject").alias("subject"), plain("predicate").alias("predicate"))
    return atoms.select(*COLUMNS).withColumns({"key": F.to_json(key, {"ignoreNullFields": "false"}), "plain": plain("value"), "asserted": F.coalesce("asserted", at)})


def folded(candidates: DataFrame, at: Column, existing: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """What becomes of every candidate: (id, status, old_id, retired_at).

    candidates, existing: atoms with COLUMNS; seq is their order as extracted, asserted may be null (then it is `at`), and
    so may valid_from. Keys are compared in lower case, trimmed. Within the batch a candidate that repeats key and value
    (for events: and day of valid_from) is `repeated`. The others of a key come in their order, status changes by time
    of assertion. The first of a key is `fresh`; one of the current value is `duplicate`, unless it is an event of
    another day; an event, one that is less sure than the tolerance allows, and one asserted before the current atom
    began are fresh and change nothing; any other `supersedes` the current atom (old_id), which ends at retired_at. Of a
    key's existing atoms the one asserted last is current at first. A null value equals null alone. Rows that are
    repeated in full share the first one's seq and are repeated. An empty table gives an empty result.

    Each key's atoms pass by in order, sorted by Spark, and a task keeps one atom of one key: a key may be of any size.
    """
    day = F.when(F.col("type") == "event", F.to_date("valid_from"))
    same = Window.partitionBy("key", "plain", day).orderBy("seq", "id")
    rows = _keyed(candidates, at).withColumn("nth", F.row_number().over(same))
    repeated = rows.where("nth > 1").select("id", F.lit("repeated").alias("status"), F.lit(None).cast("long").alias("old_id"), F.lit(None).cast("timestamp_ntz").alias("retired_at"))
    rows = rows.where("nth = 1").drop("nth").withColumn("given", F.lit(False))
    if existing is not None:
        last = Window.partitionBy("key").orderBy(F.desc("asserted"), F.desc("seq"))
        rows = _keyed(existing, at).withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth").withColumn("given", F.lit(True)).unionByName(rows)
    turn = F.when(F.col("type") == "status_change", F.col("asserted"))
    rows = rows.withColumns({"turn": turn, "day": F.to_date("valid_from").cast("string"), "start": F.coalesce("valid_from", "asserted")})
    rows = rows.repartition("key").sortWithinPartitions("key", F.desc("given"), "turn", "seq", "id")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = now = None
        for part in parts:
            out = []
            for row in part.itertuples():
                if row.key != key:
                    key, now = row.key, None
                if row.given:
                    now = row
                    continue
                event = row.type == "event"
                status, old, end = "fresh", None, None
                if now is None:
                    now = None if event else row
                elif row.plain == now.plain or (row.plain is None and now.plain is None):
                    apart = event and row.day is not None and now.day is not None and row.day != now.day
                    status = "fresh" if apart else "duplicate"
                elif not (event or row.confidence + tolerance + EPSILON < now.confidence or row.asserted < now.start):
                    status, old, end, now = "supersedes", now.id, row.asserted, row
                out.append((row.id, status, old, end))
            frame = pd.DataFrame(out, columns=["id", "status", "old_id", "retired_at"])
            yield frame.astype({"old_id": "Int64", "retired_at": "datetime64[us]"})

    wanted = rows.select("id", "key", "type", "plain", "confidence", "asserted", "start", "day", "given")
    return wanted.mapInPandas(fold, OUT).unionByName(repeated)
