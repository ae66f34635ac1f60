"""Streams with states give what their batch forms give, in three batches with a new start from the checkpoint before each."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.streaming import states

T0 = dt.datetime(2024, 1, 1)


def in_batches(spark, tmp_path, job, rows, schema):
    """All that a job writes which is started anew for each of the lists of rows."""
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = job(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_episodes(spark, tmp_path):
    rng = random.Random(6)
    schema = "episode_id string, kind string, at timestamp"
    batches = [[(f"e{k}", rng.choice(["start", "start", "end", "other"]), T0 + dt.timedelta(minutes=rng.randint(b * 300, b * 300 + 299))) for k in range(b * 40, b * 40 + 60)] for b in range(3)]
    batches[0] += [("first", "start", T0), ("early", "end", T0), ("early", "start", T0 + dt.timedelta(minutes=5)), ("lone", "end", T0)]
    batches[1] += [("first", "end", T0 + dt.timedelta(minutes=310))]
    batches[2] += [("clock", "other", T0 + dt.timedelta(days=3))]
    batches.append([("clock2", "other", T0 + dt.timedelta(days=3))])  # the watermark that the batch before has moved is used here
    life = 100 * 60_000
    got = in_batches(spark, tmp_path, lambda s: states.episode_stream(s, "10 hours", life), batches, schema)
    want = states.episodes(spark.createDataFrame([r for b in batches for r in b], schema), F.lit(T0 + dt.timedelta(days=2)), life)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(want)
    by = {r.episode_id: (r.started, r.ended, r.closed_by) for r in got.collect()}
    assert by["first"] == (T0, T0 + dt.timedelta(minutes=100), "life") and "lone" not in by
    assert by["early"] == (T0 + dt.timedelta(minutes=5),) * 2 + ("end",)
    assert {"end", "life"} == {c for *_, c in by.values()}


def test_jobs(spark, tmp_path):
    rng = random.Random(7)
    schema = "memory_id long, project string, seq long, kind string"
    rows = [(rng.randint(0, 5), rng.choice(["p", "q", None]), k, rng.choice(["enqueue", "claim", "done", "failed", "other", None])) for k in range(600)]
    now, want = {}, []
    for m, p, seq, kind in rows:
        s = now.get((m, p))
        ok = (kind == "enqueue" and s not in ("pending", "processing")) or (kind == "claim" and s == "pending") or (kind in ("done", "failed") and s == "processing")
        if ok:
            now[m, p] = {"enqueue": "pending", "claim": "processing"}.get(kind, kind)
        want.append((m, p, seq, kind, ok, now.get((m, p))))
    order = lambda x: sorted(x, key=lambda r: r[2])
    df = spark.createDataFrame(rows, schema)
    assert order(map(tuple, states.job_steps(df.repartition(5)).collect())) == want
    got = in_batches(spark, tmp_path, states.job_stream, [rows[:200], rows[200:401], rows[401:]], schema)
    assert order(map(tuple, got.collect())) == want
    assert states.job_steps(df.where("false")).count() == 0
