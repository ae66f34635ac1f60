from __future__ import annotations

import random

import corpus_pipeline


def grams(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_near_copies_match_brute_force(spark):
    """Pairs of texts around Jaccard 0.8 of five-word shingles: those from 0.8 on lose the second, the others keep both."""
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(120):
        w = [f"w{rng.randrange(3000)}" for _ in range(300)]
        v = list(w)
        for at in rng.sample(range(300), 2 + k % 8):
            v[at] = f"x{rng.randrange(10**6)}"
        a, b = grams(" ".join(w)), grams(" ".join(v))
        rows += [(2 * k, " ".join(w), "s"), (2 * k + 1, " ".join(v), "s")]
        want[2 * k + 1] = len(a & b) / len(a | b)
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, " \t", "s"), (1003, "one two", "s"), (1004, "One  two", "s"), (1005, "one three", "s"), (None, "alone", "s"), (None, "ALONE", "s"), (None, rows[0][1], "s")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    got = kept.collect()
    ids = [r.doc_id for r in got]
    assert kept.columns == ["doc_id", "text", "source"] and set(range(0, 240, 2)) <= set(ids)
    alike = [i for i, s in want.items() if s >= 0.8]
    assert 30 <= len(alike) <= 100 and min(s for s in want.values() if s >= 0.8) < 0.85
    assert {i for i, s in want.items() if s < 0.8} <= set(ids)
    assert sum(i not in ids for i in alike) >= 0.97 * len(alike)
    assert {i for i in ids if i is not None and i >= 1000} == {1000, 1003, 1005} and ids.count(None) == 1


def test_fingerprints_bring_candidates(spark, monkeypatch):
    """Without any band in common, texts that op10 links are still compared, and go if their sets are similar; others stay."""
    from tidemark.llm import near, simhash

    w = [f"w{k * k}" for k in range(2000)]
    v = [*w[:1000], "changed", *w[1001:]]
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(w[::-1])), (4, "alone")]
    assert bin(simhash.simhash(rows[0][1], 4) ^ simhash.simhash(rows[1][1], 4)).count("1") <= 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "bands", lambda hashes: near.np.array([int(hashes.sum(dtype=near.np.uint64)) % 2**62], near.np.int64))  # no two sets have it in common
    assert sorted(r.doc_id for r in near.keep_one(docs).collect()) == [1, 3, 4]


def test_bucket_rows_are_not_broadcast(spark, monkeypatch):
    """Each fingerprint has some 50 bucket rows, which Spark sizes as one: their join with the counts is shuffled, whatever it takes them for."""
    from pyspark.sql import functions as F

    from tidemark.llm import shared, simhash

    plans, cut = [], shared.cut

    def keep(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(shared, "cut", keep)
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp")).distinct()
    simhash.linked(fps, 4)
    assert "MapInPandas" in plans[0] and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
