"""Known values and edge rows of the column functions and operators."""

from __future__ import annotations

import datetime as dt
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranking as K
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.functions import vector as V
from tidemark.operators import aggregate, chunking, graph, knowledge, rank, records, search
from tidemark.sources import exports
from tidemark.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def words(text):
    return F.array(*map(F.lit, text))


def test_scores(spark):
    got = one(spark, S.recency(F.lit(0.0)), S.recency(F.lit(math.log(2) / 0.01)), S.importance_boost(F.lit(0)), S.importance_boost(F.lit(4)), S.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"), S.importance_boost(F.lit(2))), S.composite(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(None).cast("double"), S.importance_boost(F.lit(2))), S.importance_boost(F.lit(0), F.lit(0.01)))
    assert got == pytest.approx((1, 0.5, 5 / 3, 1 / 3, 0.925, 0.225, 0.1))


def test_rankings(spark):
    none = F.array().cast("array<string>")
    got = one(spark, K.rbo(words("abcde"), words("abcde")), K.rbo(words("a"), words("a")), K.rbo(none, none), K.jaccard_at(words("abc"), words("abd"), 2), K.jaccard_at(words("abc"), none), K.precision_at(words("ab"), words("a"), 5), K.reciprocal_rank(words("xya"), words("a")), K.reciprocal_rank(words("xy"), words("a")), K.ndcg_at(words("xa"), words("a"), 5), K.ndcg_at(none, none, 5))
    assert got == pytest.approx((1 - 0.9**5, 0.1, 0, 1, 0, 0.5, 1 / 3, 0, 1 / math.log2(3), 0))


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero, empty = F.array(F.lit(0.0), F.lit(0.0)), F.array().cast("array<double>")
    got = one(spark, V.cosine(a, a), V.cosine(a, zero), V.cosine(a, F.array(F.lit(1.0))), V.cosine(empty, empty), V.normalised(a), V.normalised(zero))
    assert got[:4] == pytest.approx((1, 0, 0, 0)) and got[4] == pytest.approx([0.6, 0.8]) and got[5] == [0, 0]


def test_texts(spark):
    got = one(spark, T.chunk_hash(F.lit("Hello, World!")), T.jaccard(T.bigrams(F.lit("")), T.bigrams(F.lit("")), 1.0), T.bigrams(F.lit("aba")), T.is_operational_config(F.lit("A_B=https://x y redis://z")), T.is_operational_config(F.lit("see https://x")), T.is_temporal(F.lit("What happened last week?")), T.is_aggregation(F.lit("How many times did I run?")), T.is_aggregation(F.lit("how many days ago was it")), T.exact_signals(F.lit('call 650-555-9999 at "the old mill" or https://a.b/c')))
    assert got[0] == "68e656b251e67e8358bef8483ab0d51c" and got[1] == 1.0 and sorted(got[2]) == ["ab", "ba"]
    assert got[3:8] == (True, False, True, True, False) and got[8] == ["https://a.b/c", "650-555-9999", "the old mill"]


@pytest.mark.parametrize(("question", "day", "want"), [("what did I do yesterday", "2024-03-01", ("2024-02-29", "2024-03-01")), ("two weeks ago?", "2024-03-20", ("2024-03-03", "2024-03-10")), ("a month ago", "2024-03-31", ("2024-02-24", "2024-03-10")), ("how many days ago", "2024-03-01", None), ("never", "2024-03-01", None)])
def test_temporal_window(spark, question, day, want):
    got = one(spark, T.temporal_window(F.lit(question), F.lit(day).cast("date")))[0]
    assert (None if got is None else (str(got.since), str(got.before))) == want


def test_date_tags(spark):
    got = one(spark, T.date_of_tags(F.array(F.lit("x"), F.lit("date:bad"), F.lit("date:2024/02/03 (Sat) 10:00"))), T.date_of_tags(F.array(F.lit("x"))))
    assert got == (dt.date(2024, 2, 3), None)


RECORD = "id long, content string, project string, memory_type string, importance int, tags array<string>, valid_to timestamp_ntz, immutable boolean, created_at timestamp_ntz, updated_at timestamp_ntz, last_accessed timestamp_ntz, access_count long, expires_at timestamp_ntz, content_hash string, summary string"
DAY = dt.datetime(2024, 1, 1)


def record(i, **more):
    base = dict(id=i, content=f"c{i}", project="p", memory_type="context", importance=3, tags=["t"], valid_to=None, immutable=False, created_at=DAY, updated_at=DAY, last_accessed=DAY, access_count=0, expires_at=None, content_hash=None, summary="s")
    return tuple((base | more).values())


def test_records(spark):
    now = F.lit(dt.datetime(2024, 6, 1)).cast("timestamp_ntz")
    df = spark.createDataFrame([record(1), record(2, valid_to=DAY), record(3, immutable=True), record(4, tags=None, importance=0), record(5, content=None)], RECORD)
    ids = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id long")
    assert {r.id: r.valid_to for r in records.soft_deleted(df, ids, now, "why").collect()} == {1: dt.datetime(2024, 6, 1), 2: DAY, 3: None, 4: None, 5: None}
    after, versions = records.corrected(df, spark.createDataFrame([(1, "new"), (3, "no")], "id long, content string"), now)
    got = {r.id: (r.content, r.summary) for r in after.collect()}
    assert got[1] == ("new", None) and got[3] == ("c3", "s") and [r.id for r in versions.collect()] == [1]
    assert {r.id for r in records.stale(df, now).collect()} == {1, 2, 5}
    assert {r.id for r in records.listed(df, tags=["t"]).collect()} == {1, 3, 5}
    assert records.listed(df.limit(0)).count() == 0


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "r", 0.5), (2, 1, "r", 0.5), (3, 3, "r", 0.1), (2, 3, "r", 1.0), (3, 4, "r", 0.11)], "source_id long, target_id long, rel_type string, strength double")
    live = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {(r.other, r.hop) for r in graph.reachable(spark.createDataFrame([(1,)], "id long"), edges, live, 3).collect()}
    assert got == {(2, 1), (3, 2)}
    assert graph.neighbours(spark.createDataFrame([(3,)], "id long"), edges).count() == 3
    assert {(r.source_id, r.target_id) for r in graph.decayed(edges).collect()} == {(1, 2), (2, 1), (2, 3)}
    up = graph.upserted(edges, spark.createDataFrame([(1, 2, "r", 0.9, 1), (1, 2, "r", 0.8, 2), (1, 9, "r", 0.8, 3)], "source_id long, target_id long, rel_type string, strength double, seq long"), live)
    assert {(r.source_id, r.target_id): r.strength for r in up.collect()} == {(1, 2): 0.8, (2, 1): 0.5, (3, 3): 0.1, (2, 3): 1.0, (3, 4): 0.11}


def test_shared_set_pairs_are_all_pairs(spark):
    import random

    rng = random.Random(2)
    sets = [(k, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 8))})) for k in range(60)]
    got = {(r.a, r.b) for r in search.shared_set_pairs(spark.createDataFrame(sets, "id long, items array<string>"), 0.6).collect()}
    assert got == {(i, j) for i, a in sets for j, b in sets if i < j and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= 0.6}


def test_rank_passes(spark):
    df = spark.createDataFrame([(1, k, 1.0 - k / 10, "s1" if k < 4 else "s2", k == 5) for k in range(6)], "query_id long, id long, score double, session string, is_preference boolean")
    assert [r.id for r in rank.session_capped(df, 2, 10).orderBy("rank").collect()] == [0, 1, 4, 5]
    assert [r.id for r in rank.preference_slots(df, 4).orderBy("rank").collect()] == [5, 0, 1, 2]
    assert rank.session_capped(df.where("session = 's1'"), 2, 10).count() == 4


def test_contradictions(spark):
    pairs = [("the release server uses postgres version 1.2 today", "the release server uses postgres version 1.3 today", True), ("alpha bravo charlie delta echoes foxtrot", "alpha bravo charlie delta echoes foxtrot is not", True), ("one two", "not one two", False), ("", "", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(knowledge.contradicts(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == [w for *_, w in pairs]


def test_tuner_keeps_the_sum(spark):
    df = spark.createDataFrame([("p", "stale_ranking", 50, 0.8, 0.1), ("q", "stale_ranking", 5, 0.8, 0.1), ("r", "other", 50, 0.8, 0.1)], "project string, top_class string, total long, top_share double, next_share double")
    rows = knowledge.tuned(df).collect()
    assert [r.project for r in rows] == ["p"] and rows[0].vector == pytest.approx(0.40) and rows[0].recency == pytest.approx(0.15)
    assert sum(rows[0][k] for k in knowledge.BOUNDS) == pytest.approx(1)


def test_chunking(spark):
    text = "Dr. Ash came. " + " ".join(f"Sentence number {k} is here." for k in range(60))
    parts = chunking.chunk_text(text, 50, 10)
    assert all(len(p.encode()) <= 200 for p in parts) and parts[0].startswith("Dr. Ash came.")
    assert parts[1].split(". ")[0] in parts[0]
    assert chunking.chunk_text(None) == [] and chunking.chunk_text("  ") == [] and chunking.chunk_text("short") == ["short"]
    doc = "# One\n\nFirst words. Last words.\n\n## Two\n\nOther words.\n"
    assert chunking.chunk_document(doc) == [("One", "paragraph", "First words. Last words."), ("Two", "paragraph", "Last words. Other words.")]
    df = spark.createDataFrame([(1, text, "focused"), (2, doc, "document"), (3, None, "focused"), (4, "same", "focused")], "id long, content string, storage_mode string")
    assert {r.id for r in chunking.chunked(df).collect()} == {1, 2, 4}


def test_budget_and_evidence(spark):
    df = spark.createDataFrame([(1, 1, 0.9, "x" * 40, 1), (1, 2, 0.8, "x" * 400, 2), (1, 3, 0.7, "", 3)], "query_id long, id long, score double, chunk string, rank int")
    assert {r.id for r in chunking.within_budget(df, 20).collect()} == {1, 3}
    found = spark.createDataFrame([(1, 1, "I ran a marathon in May. It rained."), (1, 2, "No sport."), (2, 3, "Nothing.")], "query_id long, id long, content string")
    anchors = spark.createDataFrame([(1, ["ran", "marathon"]), (2, ["ran", "marathon"])], "query_id long, terms array<string>")
    assert [(r.query_id, r.id, r.pos) for r in chunking.evidence(found, anchors).collect()] == [(1, 1, 0)]


def test_exports(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"uuid": "u", "name": " Talk ", "created_at": "2024-01-02T03:04:05Z", "updated_at": "2024-01-02T03:04:06Z", "chat_messages": [{"uuid": "m", "text": " hi ", "sender": "human", "created_at": "2024-01-02T03:04:05Z"}, {"text": "yes", "sender": "assistant"}]}, {"uuid": "none", "chat_messages": []}]))
    got = exports.read_list_export(spark, str(tmp_path / "list.json")).collect()
    assert [r.content for r in got] == ["# Talk\n\n**Human** (2024-01-02T03:04:05Z):\nhi\n\n**Assistant**:\nyes\n"]
    node = lambda parent, role, text: {"parent": parent, "message": {"author": {"role": role}, "create_time": 1.5, "content": {"content_type": "text", "parts": [text]}}}
    tree = [{"title": "T", "create_time": 1.0, "update_time": 2.0, "current_node": "c", "mapping": {"a": node(None, "system", "rules"), "b": node("a", "user", "ask"), "c": node("b", "assistant", "tell"), "d": node("b", "assistant", "other branch")}}]
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    assert exports.read_tree_export(spark, str(tmp_path / "tree.json")).first().content == "# T\n\n**User**:\nask\n\n**Assistant**:\ntell\n"
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("users.json", json.dumps([{"id": "U1", "name": "ann", "real_name": "Ann"}]))
        z.writestr("general/2024.json", json.dumps([{"type": "message", "user": "U1", "text": "hi <@U1> and <@U2>", "ts": "1.5"}, {"type": "message", "user": "U1", "text": "reply", "ts": "2.5", "thread_ts": "1.5"}, {"type": "join", "user": "U1", "ts": "3"}]))
    rows = exports.read_workspace(spark, str(tmp_path / "w.zip")).orderBy("ts").collect()
    assert [(r.channel, r.user, r.text) for r in rows] == [("general", "Ann", "hi @Ann and @U2"), ("general", "Ann", "-> reply")]
    (tmp_path / "n.md").write_text("---\na: b\n---\nintro\n## One\nbody\n## Two\n")
    assert [(r.heading, r.body) for r in exports.read_markdown(spark, str(tmp_path / "n.md")).orderBy("pos").collect()] == [("", "intro"), ("One", "body"), ("Two", "")]
    (tmp_path / "e.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","session_id":"s","tool_name":"t"}\n\nnot json\n')
    good, bad = exports.read_events(spark, str(tmp_path / "e.jsonl"))
    assert [r.session_id for r in good.collect()] == ["s"] and [r.value for r in bad.collect()] == ["not json"]
    assert one(spark, exports.export_format(F.lit("PK\x03\x04zz")), exports.export_format(F.lit('[{"mapping":{}}]')), exports.export_format(F.lit("x"))) == ("workspace", "tree", "unknown")
    exports.write_markdown(spark.createDataFrame([(7, "text", "p", "context", ["x", "y"])], "id long, content string, project string, memory_type string, tags array<string>"), str(tmp_path / "out"))
    assert next((tmp_path / "out" / "id=7").glob("part*")).read_text() == "---\nid: 7\ntype: context\nproject: p\ntags: [x, y]\n---\ntext\n"


def test_streams_are_their_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, job in (("tumbling", lambda e: jobs.tumbling(e, "1 hour")), ("sessions", lambda e: jobs.sessions(e, "6 hours"))):
        jobs.run_all(job(jobs.with_time(stream, "1 day")), f"t_{name}").awaitTermination()
        key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(key, spark.table(f"t_{name}").collect())) == sorted(map(key, job(jobs.with_time(events)).collect()))
    backlog = spark.createDataFrame([(1, "a", None), (2, "b", [1.0])], "id long, text string, embedding array<double>")
    backlog.write.parquet(str(tmp_path / "chunks"))
    hook = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("double")))
    jobs.embed_backlog(spark.readStream.schema(backlog.schema).parquet(str(tmp_path / "chunks")), hook, str(tmp_path / "done"), str(tmp_path / "cp")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "done")).collect()] == [1]


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([], RECORD)
    assert aggregate.by_tag(df).count() == 0 and aggregate.project_stats(df).count() == 0 and aggregate.integrity(df).count() == 0
