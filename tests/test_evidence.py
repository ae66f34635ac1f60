"""Folds, windows, uploads, ladders, counting and other wordings against plain versions."""

from __future__ import annotations

import base64
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsons, paraphrase as P
from tidemark.operators import counting, ladder, turns, uploads, variants

T0 = dt.datetime(2024, 1, 1)


def plain_windows(text, most):
    out, start = [], 0
    while len(text) - start > most:
        part, stop = text[start : start + most].lower(), start + most
        for i in range(most - 2, -1, -1):
            if part[i] == "\n" and part[i + 1 :].startswith(turns.OPENINGS):
                stop = start + i + 1 if i + 1 >= most // 2 else stop
                break
        out.append((start, stop))
        start = stop
    return [*out, (start, len(text))]


@pytest.mark.parametrize("most", [40, 41, 100])
def test_windows_against_the_rules(spark, most):
    rng = random.Random(most)
    said = lambda: "".join(rng.choice(["a", "é", " ", "\n", "\nUser: ", "\n[tool]", "tool:", "漢" * 9]) for _ in range(rng.randint(0, 60)))
    rows = [(c, t, rng.choice(["user", "assistant", "other", None]), rng.choice([said(), said(), None])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x" * 200), (99, 0, None, None), (98, 0, "user", "u" * most), (97, 0, "user", "y" * 90), (97, 0, "user", "y" * 90)]
    text: dict = {}
    for c, _, role, x in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        text[c] = text.get(c, "") + (f"{role}: " if role else "") + (x or "") + "\n"
    got: dict = {}
    for r in turns.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), most).orderBy("window").collect():
        got.setdefault(r.conv_id, []).append((r.start, r.end))
    assert got == {c: plain_windows(x, most) for c, x in text.items()}
    assert turns.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_long_conversation(spark):
    """One conversation with all rows: its windows touch and cover it, none is too long."""
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("text"))
    got = turns.windows(df, 1000).orderBy("window").collect()
    assert got[0].start == 0 and all(a.end == b.start for a, b in zip(got, got[1:], strict=False)) and max(r.end - r.start for r in got) <= 1000
    assert got[-1].end == sum(7 + k % 300 for k in range(20_000))


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_ladder_against_one_step_after_the_other(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), k * 3 + 1, rng.choice([True, False, False, None])) for k in range(400)]
    now, want = {}, {}
    for key, seq, down in rows:
        at = now.get(key, -1)
        now[key] = 0 if at < 0 else max(0, at - 1) if down else min(3, at + 1)
        want[key, seq] = ladder.STEPS[now[key]]
    df = spark.createDataFrame(rows, "signature string, seq long, correction boolean").withColumn("projects", F.lit(2)).withColumn("place", F.lit("mine"))
    got = ladder.climbed(df.repartition(6), ["signature"], block)
    assert got.columns == [*df.columns, "confidence"]
    assert {(r.signature, r.seq): r.confidence for r in got.collect()} == want
    first = {r.signature: r.seq for r in ladder.promoted(got).collect()}
    assert first == {k: min(s for (x, s), c in want.items() if x == k and c >= 0.8) for k in now}
    assert ladder.promoted(got.withColumn("projects", F.lit(1))).count() == 0
    assert ladder.climbed(df.where("false"), ["signature"], block).count() == 0


def test_uploads(spark):
    b = lambda x: base64.b64encode(x).decode()
    at = lambda m: T0 + dt.timedelta(minutes=m)
    raw = "añb漢".encode()
    rows = [
        ("u", 1, "append", 0, b(b"x"), at(0), "unknown"), ("u", 2, "start", None, None, at(1), "started"), ("u", 3, "start", None, None, at(2), "in_use"), ("u", 4, "append", 0, b(raw[:2]), at(3), "buffered"),
        ("u", 5, "append", 0, b(raw[:2]), at(4), "out_of_order"), ("u", 6, "append", 2, b(raw[4:]), at(5), "out_of_order"), ("u", 7, "append", 1, "no base64!", at(6), "bad_data"), ("u", 8, "append", None, b(raw), at(7), "no_part"),
        ("u", 9, "append", 1, b(raw[2:]), at(33), "buffered"), ("u", 10, "finish", None, None, at(63), "finished"), ("u", 11, "finish", None, None, at(64), "unknown"),
        ("u", 12, "start", None, None, at(65), "started"), ("u", 13, "append", 0, "", at(66), "buffered"), ("u", 14, "dance", 0, None, at(67), "bad_action"), ("u", 15, "finish", None, None, at(68), "finished"),
        ("late", 1, "start", None, None, at(0), "started"), ("late", 2, "append", 0, b(b"x"), at(31), "unknown"), ("late", 3, "start", None, None, at(32), "started"), ("late", 4, "finish", None, None, at(33), "finished"),
        ("big", 1, "start", None, None, at(0), "started"), ("big", 2, "append", 0, b(b"x" * 8), at(1), "buffered"), ("big", 3, "append", 1, b(b"x"), at(2), "too_large"), ("big", 4, "finish", None, None, at(3), "unknown"),
        ("a b", 1, "start", None, None, at(0), "bad_name"), (None, 1, "start", None, None, at(0), "bad_name"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "upload_id string, seq long, action string, part int, data string, at timestamp_ntz").repartition(4)
    assert {(r.upload_id, r.seq): r.status for r in uploads.judged(df, 8).collect()} == {(r[0], r[1]): r[6] for r in rows}
    got = {(r.upload_id, r.session): (r.parts, r.bytes, bytes(r.body)) for r in uploads.bodies(df, 8).collect()}
    assert got == {("u", 1): (2, len(raw), raw), ("u", 2): (1, 0, b""), ("late", 2): (0, 0, b"")}
    assert uploads.bodies(df.where("false")).count() == 0


def test_paraphrases(spark):
    cases = {
        "What's the wifi password": ["what is the wifi password", "the wifi password", "information about the wifi password"],
        "tell me about Anna": ["anna", "information about anna", "anna not"],
        "did Anna move": ["anna move", "information about anna move", "did anna move not"],
        "I don't know": ["i do not know", "information about i don't know", "i don't know not"],
        "x" * 61: ["information about " + "x" * 61],
        "  ": [], None: [],
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", P.paraphrases(F.col("q")).alias("p"))
    assert {r.q: r.p for r in df.collect()} == cases


def test_both_legs_of_all_wordings(spark):
    q = spark.createDataFrame([(1, "what is anna"), (2, "zebra")], "query_id long, text string")
    index = spark.createDataFrame([("anna", 10, 1.0), ("what", 11, 0.5), ("is", 11, 0.25), ("about", 12, 0.1)], "term string, id long, weight double")
    got = {(r.query_id, r.id): (r.score, r.variant) for r in variants.lexical_union(q, lambda terms: index.join(terms.select("term").distinct(), "term", "left_semi"), 1).collect()}
    assert got == {(1, 10): (1.0, 0), (2, 12): (0.1, 1)}
    chunks = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 11, [0.6, 0.8])], "chunk_id long, memory_id long, embedding array<double>")
    embed = lambda v: v.withColumn("vector", F.when(F.col("text") == "anna", F.array(F.lit(0.6), F.lit(0.8))).when(F.col("variant") == 0, F.array(F.lit(1.0), F.lit(0.0))))
    hits = {(r.query_id, r.id): (r.cosine, r.variant) for r in variants.vector_union(q, chunks, 1, embed).collect()}
    assert hits == {(1, 10): (1.0, 0), (1, 11): (1.0, 1), (2, 10): (1.0, 0)}


COUNTS = "id long, content string, stamp timestamp_ntz"


def counts(spark, question, *texts, stamps=()):
    stamps = [*stamps, *[None] * (len(texts) - len(stamps))]
    records = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(zip(texts, stamps, strict=True))], COUNTS)
    results = records.select(F.lit(1).cast("long").alias("query_id"), "id")
    q = spark.createDataFrame([(1, question)], "query_id long, text string")
    return counting.counted(q, results.union(results), records).orderBy("place").collect()


def test_counting(spark):
    ask = "How many times did I service the bike rack in March and plan a budget?"
    assert counts(spark, ask, "I serviced the bike rack in January.", "I plan the March budget next week.") == []  # nothing in common
    got = counts(spark, ask, "I serviced the bike rack in March. Rain.", "Then I plan the March budget next week!", stamps=[T0 + dt.timedelta(1), T0])
    assert [(r.id, r.text, r["count"], r.place) for r in got] == [(1, "Then I plan the March budget next week!", 2, 1), (0, "I serviced the bike rack in March.", 2, 2)]
    assert (got[1].start, got[1].end) == (0, 34)
    spread = counts(spark, "How many bikes were repaired?", "Bikes.\n  Täglich repaired. ")  # no sentence holds both: the whole record
    assert [(r.start, r.end, r.text) for r in spread] == [(0, 27, "Bikes.\n  Täglich repaired.")]
    assert counts(spark, "How many bikes were repaired?", "Bikes only.", "", None) == []
    assert counts(spark, "How many days ago did I repair bikes?", "I repaired bikes.") == []
    assert counts(spark, "When did I repair bikes?", "I repaired bikes.") == []
    assert counts(spark, "How many times?", "many times") == []


def test_what_hangs_together(spark):
    rows = [([["a", "b"], ["c", "d"], ["b", "c"]], True), ([["a"], ["b"]], False), ([["a", "b"], ["c"], ["d", "c"]], False), ([["a"]], True), ([], True)]
    df = spark.createDataFrame([(x,) for x, _ in rows], "s array<array<string>>")
    assert [r[0] for r in df.select(counting.connected(F.col("s"))).collect()] == [w for _, w in rows]


def test_json_out_of_texts(spark):
    deep = "[" * 3000
    cases = {
        '{"a": 1}': '{"a": 1}', " [1, 2]\n": "[1, 2]", "12": "12", 'Here: {"a": [1, {"b": "}]"}]} and {"c": 2}': '{"a": [1, {"b": "}]"}]}', 'say "[" then {"a": "\\"}"}': '{"a": "\\"}"}', "{see [1] below": "[1]",
        '<THINK>{"no": 1}\n</think>x {"yes": 1}': '{"yes": 1}', '<think>{"a": 1}': '{"a": 1}', '```json\n{"a":\n  1}\n  ```': '{"a":\n  1}', '{"a": [1, "}': '{"a": [1, "}', "[NaN] {}": "{}", "nothing": None, "": None, None: None, deep: deep,
    }
    got = {r.t: r.j for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", jsons.first_json(F.col("t")).alias("j")).collect()}
    assert got == cases
