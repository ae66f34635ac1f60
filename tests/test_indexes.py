"""The kept inverted index and the vector index against plain versions."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stem import stem, stems
from tidemark.operators import ann, index
from tidemark.queries import documents
from tidemark.registry import QUERIES
from tidemark.session import new_folder

SF = "/root/testdata/sf0.01"


def test_stems(spark):
    words = "running runs run The studies studied study houses house boxes box stopped stop making make glass bus red sing tries played analysis"
    got = spark.range(1).select(F.lit(words).alias("text")).select(stems("text").alias("s")).first().s
    assert got == ["run", "run", "run", "studi", "studi", "studi", "hous", "hous", "box", "box", "stop", "stop", "mak", "mak", "glass", "bus", "red", "sing", "tri", "play", "analysis"]


def test_stem_of_a_word_equals_the_expression(spark):
    """The index stems each distinct word of a batch once; a text of all words has the same stems either way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = docs.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))).alias("w")).distinct().select("w", stems("w").alias("s")).collect()
    odd = ["", "s", "ss", "ies", "ied", "eed", "bbed", "yed", "0s", "9ing", "aing", "the"]
    pairs += [r for r in spark.createDataFrame([(x,) for x in odd if x], "w string").select("w", stems("w").alias("s")).collect()]
    assert len(pairs) > 1000 and all(([] if stem(r.w) is None else [stem(r.w)]) == r.s for r in pairs)
    got = {(r.id, r.term): r.tf for r in index.counts(spark.createDataFrame([(1, "Cats, cat the dog"), (2, None), (3, ""), (4, "the")], "id long, content string")).collect()}
    assert got == {(1, "cat"): 2, (1, "dog"): 1}


def test_search_shuffles_postings_and_not_pairs(spark, monkeypatch):
    """Many queries ask for a term that all records have: what is shuffled is the records' postings, and each query's best of a task."""
    monkeypatch.setattr(index, "PAIRS", 100_000)
    path = new_folder(spark, "test")
    index.build(spark.range(3000).select("id", F.concat(F.lit("cat dog "), F.expr("repeat('cat ', cast(id % 7 as int))")).alias("content")), path)
    df = index.search(spark.range(200).select(F.col("id").alias("query_id"), F.lit("cats dogs").alias("text")), path, 10)
    rows = df.collect()
    assert len(rows) == 2000 and {r.id for r in rows} == {7 * i + 6 for i in range(10)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)


def plain(records, text, k, stem):
    found = Counter()
    want = set(stem[text])
    for i, t in records.items():
        for w, n in Counter(stem[t]).items():
            if w in want:
                found[i] += sum(1 / j**2 for j in range(1, n + 1))
    return [i for i, s in sorted(((i, round(s, 6)) for i, s in found.items()), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize(("block", "shard"), [(128, 100_000), (2, 5)])
def test_index_through_changes(spark, monkeypatch, block, shard):
    monkeypatch.setattr(index, "BLOCK", block)
    monkeypatch.setattr(index, "SHARD", shard)
    animals = ["cats", "dogs run", "running cat", "a dog and a dog", "horses", "cat cat cats", "", "run run", "dog", "the horse runs"] * 3
    records = dict(enumerate(animals))
    df = lambda x: spark.createDataFrame(list(x.items()), "id long, content string")
    queries = spark.createDataFrame([(1, "cat"), (2, "dogs running"), (3, "horse dog cat"), (4, "the"), (5, "nothing")], "query_id long, text string")
    everything = [*animals, "cat", "dogs running", "horse dog cat", "the", "nothing", "new cat text", "running horses"]
    stem = {r.text: r.s for r in spark.createDataFrame([(x,) for x in set(everything)], "text string").select("text", stems("text").alias("s")).collect()}

    def check(path):
        got = {}
        for r in index.search(queries, path, 4).orderBy("query_id", F.desc("score"), "id").collect():
            got.setdefault(r.query_id, []).append(r.id)
        want = {q.query_id: plain(records, q.text, 4, stem) for q in queries.collect()}
        assert got == {k: v for k, v in want.items() if v}

    path, to = new_folder(spark, "test"), new_folder(spark, "test")
    index.build(df(records).union(spark.createDataFrame([(99, None)], "id long, content string")), path)
    check(path)
    records |= {0: "new cat text", 100: "running horses"}
    del records[5]
    index.update(df({0: "new cat text", 100: "running horses", 5: "cat"}), spark.createDataFrame([(5,)], "id long"), path)
    check(path)
    records[5] = "cat"
    index.update(df({5: "cat"}), spark.createDataFrame([], "id long"), path)
    check(path)
    index.compact(spark, path, to)
    check(to)


def test_ivfpq_recall(spark):
    exact, found = ({(r.query_id, r.chunk_id) for r in QUERIES[x](spark, SF).collect()} for x in ("knn_cosine_top10", "ivfpq_top10"))
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)


def test_cells_are_split(spark):
    """A third of all vectors around one place doesn't stay in one cell; short, null and zero vectors harm nothing."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1000, 16)), 5 + 0.2 * rng.normal(size=(500, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [1.0]), (2002, [0.0] * 16), (2003, x[7].tolist())]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    book = ann.train(v, cells=12)
    path = new_folder(spark, "test")
    ann.build(v, path, book)
    codes = spark.read.parquet(f"{path}/codes")
    assert codes.count() == 1502 and codes.groupBy("cell").count().agg(F.max("count")).first()[0] <= 4.5 * 1502 / len(book.cells)
    some = list(range(0, 1500, 50))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in some], "query_id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = {(r.query_id, r.id % 1996 if r.id == 2003 else r.id) for r in ann.search(queries, v, path, 10, probes=len(book.cells)).collect()}
    want = {(i, int(j)) for i in some for j in np.argsort(-(u @ u[i]), kind="stable")[:10]}
    assert len(hits & want) >= 0.9 * len(want)
    assert documents.vectors(spark, SF).columns == ["id", "embedding"]


def test_a_task_gives_a_querys_best_candidates_only(spark, monkeypatch):
    """However many cells a task reads, a query gets k x REFINE candidates from it, not so many from each cell."""
    monkeypatch.setattr(ann, "REFINE", 4)
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1200, 8)))], "id long, embedding array<double>").repartition(2)
    path = new_folder(spark, "test")
    ann.build(v, path, ann.train(v, cells=40))
    frame, given = type(v), []
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **b: given.append(run(self, f, schema, *a, **b)) or given[-1])
    queries = v.where("id < 20").selectExpr("id as query_id", "embedding as vector")
    assert ann.search(queries, v, path, 1, probes=40).count() == 20
    assert given[-1].count() <= 20 * 4 * given[-1].rdd.getNumPartitions() < 20 * 4 * 30
