"""Atoms and spans against plain versions."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import atoms, spans

ATOMS = "id long, project string, type string, subject string, predicate string, value string, confidence double, seq long, asserted timestamp_ntz, valid_from timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def plain_fold(candidates, existing):
    """The rules, one atom after the other."""
    low = lambda x: None if x is None else x.strip().lower()
    key = lambda a: (a[1], a[2], low(a[3]), low(a[4]))
    told = lambda a: a[8] or dt.datetime(2024, 2, 1)
    now, out, seen, unique = {}, {}, set(), []
    for a in existing:
        if key(a) not in now or (told(a), a[7]) > (told(now[key(a)]), now[key(a)][7]):
            now[key(a)] = a
    for a in sorted(candidates, key=lambda a: a[7]):
        k = (key(a), low(a[5]), a[9].date() if a[2] == "event" and a[9] else None)
        if k in seen:
            out[a[0]] = ("repeated", None, None)
        else:
            seen.add(k)
            unique.append(a)
    for a in sorted(unique, key=lambda a: (a[2] == "status_change", told(a) if a[2] == "status_change" else DAY)):
        c = now.get(key(a))
        if c is None:
            out[a[0]] = ("fresh", None, None)
            if a[2] != "event":
                now[key(a)] = a
        elif low(a[5]) == low(c[5]):
            apart = a[2] == "event" and a[9] and c[9] and a[9].date() != c[9].date()
            out[a[0]] = ("fresh" if apart else "duplicate", None, None)
        elif a[2] == "event" or a[6] + 0.2 + 1e-9 < c[6] or told(a) < (c[9] or told(c)):
            out[a[0]] = ("fresh", None, None)
        else:
            out[a[0]] = ("supersedes", c[0], told(a))
            now[key(a)] = a
    return out


def test_atoms_against_the_rules(spark):
    rng = random.Random(4)
    make = lambda i: (i, "p", rng.choice(["fact", "event", "status_change", "preference"]), rng.choice(["s", " S", "t", "hot", "hot"]), rng.choice(["q", "Q "]), rng.choice(["red", " RED", "blue", "none", None]), rng.randint(0, 10) / 10, i, rng.choice([None, DAY + dt.timedelta(hours=rng.randint(0, 99))]), rng.choice([None, None, DAY + dt.timedelta(hours=rng.randint(0, 99))]))
    old, new = [make(i) for i in range(20)], [make(i) for i in range(100, 500)]
    df = lambda x: spark.createDataFrame(x, ATOMS).repartition(7)
    for existing in ([], old):
        got = {r.id: (r.status, r.old_id, r.retired_at) for r in atoms.folded(df(new), at(), df(existing) if existing else None).collect()}
        assert got == plain_fold(new, existing)
        assert {"fresh", "repeated", "supersedes", *(["duplicate"] if existing else [])} == {s for s, *_ in got.values()}
    assert atoms.folded(df([]), at()).count() == 0


def test_a_hot_key_of_atoms(spark):
    """One key with all rows: values that alternate each retire the one before."""
    rows = spark.range(30_000).select("id", F.lit("p").alias("project"), F.lit("fact").alias("type"), F.lit("s").alias("subject"), F.lit("q").alias("predicate"), F.col("id").cast("string").alias("value"), F.lit(0.5).alias("confidence"), F.col("id").alias("seq"), at().alias("asserted"), F.lit(None).cast("timestamp_ntz").alias("valid_from"))
    got = atoms.folded(rows, at())
    assert got.where("status = 'supersedes' and old_id = id - 1").count() == 29_999


def plain_spans(text, subs, window, budget):
    raw, found = text.encode(), []
    for sub in dict.fromkeys(x for x in subs if x):
        at, s = 0, sub.encode()
        while (i := raw.find(s, at)) >= 0:
            at = i + len(s)
            found.append((max(0, i - window // 2), min(len(raw), at + window // 2), sub))
    out, left = [], budget * 4
    for s in sorted(found):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2])
        else:
            out.append(s)
    taken = []
    for a, b, m in out:
        if b - a > left:
            while left > 0 and a + left < len(raw) and raw[a + left] & 0xC0 == 0x80:
                left -= 1
            if left > 0:
                taken.append((a, raw[a : a + left], m, True))
            return [(*x[:3], True) for x in taken]
        taken.append((a, raw[a:b], m, False))
        left -= b - a
    return taken


def test_spans_against_the_rules(spark):
    rng = random.Random(8)
    texts = ["", "ab", "x" * 50 + "ab" + "y" * 30 + "ab" + "z" * 200 + "ab", "é" * 60 + "ab" + "ü" * 60, *["".join(rng.choice(["ab", "é", "c.d", " ", "漢", "q" * 9]) for _ in range(rng.randint(5, 300))) for _ in range(30)]]
    rows = [(1, k, t, None, ["ab", "", "c.d"]) for k, t in enumerate(texts)] + [(2, 0, None, None, ["ab"])]
    df = spark.createDataFrame(rows, "query_id long, id long, content string, pattern string, subs array<string>")
    for window, budget in ((20, 10), (40, 1000)):
        got = {}
        for r in spans.document_spans(df, window, budget).collect():
            got.setdefault(r.id, []).append((r.offset, bytes(r.text), r.matched, r.truncated))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, t in enumerate(texts) if (v := plain_spans(t, ["ab", "c.d"], window, budget))}


def test_spans_by_pattern(spark):
    df = spark.createDataFrame([(1, 1, "call 12 or 345 now", "[0-9]+", ["call"]), (1, 2, "no filter here", None, None), (1, 3, "none", "[0-9]+", None)], "query_id long, id long, content string, pattern string, subs array<string>")
    got = sorted((r.id, r.offset, bytes(r.text).decode(), r.matched) for r in spans.document_spans(df, 2).collect())
    assert got == [(1, 4, " 12 ", "12"), (1, 10, " 345 ", "345"), (2, 0, "no", None)]
    with pytest.raises(Exception, match="pattern too long"):
        spans.document_spans(df.withColumn("pattern", F.repeat(F.lit("a"), 1025))).collect()
