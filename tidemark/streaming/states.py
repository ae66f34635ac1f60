"""Streams with a state for each key: episodes that end or run out, and jobs that are claimed and completed once.

Each has a batch form (a DataFrame that is all there) that gives what the stream gives in the end, however its rows are
cut into micro-batches and wherever it is started again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.fold import folded

#: Milliseconds after which an episode that nobody ended is closed.
LIFE = 24 * 3_600_000


def episodes(events: DataFrame, until: Column, life: int = LIFE) -> DataFrame:
    """(episode_id, started, ended, closed_by) of rows (episode_id, kind start or end, at timestamp).

    An episode begins with its first start and ends with its first end (one before the start: with the start), if that is
    within `life` milliseconds, else it runs out then; only what has closed before `until` is given. Other kinds, and ends
    without a start, count for nothing; an id is used once. Null ids are one episode.
    """
    ms = F.unix_millis("at")
    e = events.groupBy("episode_id").agg(F.min(F.when(F.col("kind") == "start", ms)).alias("s"), F.min(F.when(F.col("kind") == "end", ms)).alias("e")).where("s is not null")
    ended, out = F.greatest("s", "e"), F.col("s") + life
    in_time = F.col("e").isNotNull() & (ended <= out)
    closed = e.select("episode_id", F.timestamp_millis("s").alias("started"), F.timestamp_millis(F.when(in_time, ended).otherwise(out)).alias("ended"), F.when(in_time, "end").otherwise("life").alias("closed_by"))
    return closed.where(F.col("ended") < until)


def episode_stream(events: DataFrame, late: str, life: int = LIFE) -> DataFrame:
    """The same of a stream, in append mode; rows may come up to `late` after others. An episode is given when the watermark has passed its close.

    The state is two times an episode; a timer drops it. An id that comes again after that is a new episode.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s, e = state.get
            state.remove()
            if s is not None:
                by = e is not None and max(s, e) <= s + life
                yield pd.DataFrame({"episode_id": [key[0]], "started_ms": [s], "ended_ms": [max(s, e) if by else s + life], "closed_by": ["end" if by else "life"]})
            return
        s, e = state.get if state.exists else (None, None)
        for rows in batches:
            for kind, ms in zip(rows["kind"], rows["ms"], strict=True):
                if kind == "start":
                    s = ms if s is None else min(s, ms)
                elif kind == "end":
                    e = ms if e is None else min(e, ms)
        if s is None and e is None:
            return
        s, e = (None if x is None else int(x) for x in (s, e))
        state.update((s, e))
        # A start may still come before an end that has none; it can't be earlier than the watermark.
        due = e + life if s is None else s + life if e is None else min(max(s, e), s + life)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("at", late).select("episode_id", "kind", "at", F.unix_millis("at").alias("ms"))
    out = rows.groupBy("episode_id").applyInPandasWithState(update, f"episode_id {events.schema['episode_id'].dataType.simpleString()}, started_ms long, ended_ms long, closed_by string", "s long, e long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("episode_id", F.timestamp_millis("started_ms").alias("started"), F.timestamp_millis("ended_ms").alias("ended"), "closed_by")


JOB = ["memory_id", "project"]
_TO = {"enqueue": "pending", "claim": "processing", "done": "done", "failed": "failed"}


def _taken(status: str | None, kind: str | None) -> bool:
    """Whether a job of this status takes such a step: one waits or runs at a time, is claimed once, and completed once."""
    return kind == "enqueue" and status not in ("pending", "processing") or kind == "claim" and status == "pending" or kind in ("done", "failed") and status == "processing"


def job_steps(steps: DataFrame) -> DataFrame:
    """(memory_id, project, seq, kind, accepted, status) of rows (memory_id, project, seq, kind): what each step did, and the job's status after it.

    Steps: enqueue, claim, done, failed, taken by seq (unique in a job). One that doesn't fit, or of another kind, changes nothing.
    """

    def step(status, row):
        if row is None:
            return None, []
        fits = _taken(status, row["kind"])
        status = _TO[row["kind"]] if fits else status
        return status, [{"seq": row["seq"], "kind": row["kind"], "accepted": fits, "status": status}]

    return folded(steps.select(*JOB, F.col("seq").cast("long").alias("seq"), "kind"), JOB, ["seq"], step, "seq long, kind string, accepted boolean, status string")


def job_stream(steps: DataFrame) -> DataFrame:
    """The same of a stream, in append mode; a job's steps come in the order of seq from one micro-batch to the next, in any within one."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        fits, after = [], []
        for kind in rows["kind"]:
            fits.append(_taken(status, kind))
            status = _TO[kind] if fits[-1] else status
            after.append(status)
        state.update((status,))
        yield pd.DataFrame({"memory_id": key[0], "project": key[1], "seq": rows["seq"].to_numpy(), "kind": rows["kind"].to_numpy(), "accepted": fits, "status": pd.Series(after, dtype=object).to_numpy()})

    kinds = {c: steps.schema[c].dataType.simpleString() for c in JOB}
    schema = f"memory_id {kinds['memory_id']}, project {kinds['project']}, seq long, kind string, accepted boolean, status string"
    return steps.select(*JOB, F.col("seq").cast("long").alias("seq"), "kind").groupBy(*JOB).applyInPandasWithState(update, schema, "status string", "append", GroupStateTimeout.NoTimeout)
