from math import isclose, log2

from tidemark.operators import reports as R

HITS, SESSIONS, GOLD, QUERIES = "query_id long, rank int, id long", "id long, session string", "query_id long, session string", "query_id long, kind string"


def test_measures_by_sessions(spark):
    hits = [(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 99), (2, 1, 12), (4, 1, 10)]
    sessions = [(10, "a"), (11, "a"), (12, "b")]
    gold = [(1, "b"), (1, "c"), (1, "b"), (2, "b"), (3, "a")]
    queries = [(1, "x"), (2, "x"), (3, None), (4, "")]
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    items = R.measured(d(hits, HITS), d(sessions, SESSIONS), d(gold, GOLD), d(queries, QUERIES), 2)
    got = {r.query_id: r for r in items.collect()}
    one = got[1]
    assert (one.gold_rank, one.in_context, one.all_in_context, one.visible) == (3, True, False, False)
    assert isclose(one.dominance, 2 / 3) and one.recall_5 == 1.0  # the hit without a session counts for none
    assert isclose(one.ndcg_5, (1 / log2(3)) / (1 + 1 / log2(3)))
    assert (got[2].gold_rank, got[2].all_in_context, got[2].visible, got[2].ndcg_10) == (1, True, True, 1.0)
    assert tuple(got[3])[2:] == (0, False, False, False, 0.0, 0.0, 0.0, 0.0, 0.0)  # no hits
    assert (got[4].gold_rank, got[4].in_context, got[4].dominance) == (0, False, 1.0)  # no gold
    report = {r.kind: r for r in R.retrieval_report(items).collect()}
    assert set(report) == {"overall", "x", "_unknown"}
    assert (report["overall"].n, report["overall"].gold_rank, report["_unknown"].gold_rank) == (4, 2.0, 0.0)
    assert [r.kind for r in R.retrieval_report(items.limit(0)).collect()] in ([], ["overall"])


def test_last_attempt_counts(spark):
    rows = [(1, 1, "x", "done", "correct"), (1, 2, "x", "done", "other"), (2, 1, "x", "done", "partial"), (3, 5, "y", "done", "correct"), (3, 6, "y", "error", None), (4, 1, "y", "done", None), (5, 1, "y", None, "correct")]
    scores = spark.createDataFrame(rows, "query_id long, seq long, kind string, status string, label string")
    got = {r.kind: tuple(r)[1:] for r in R.score_report(scores, ("x", "z")).collect()}
    assert got == {"overall": (3, 0, 1, 2, 0.0, 1 / 3), "x": (2, 0, 1, 1, 0.0, 0.5), "y": (1, 0, 0, 1, 0.0, 0.0), "z": (0, 0, 0, 0, 0.0, 0.0)}
    assert sorted(r.query_id for r in R.failed(scores).collect()) == [3, 5]
    none = {r.kind: r.total for r in R.score_report(scores.limit(0), ("x",)).collect()}
    assert none == {"overall": 0, "x": 0}


def test_failed_queries_count_with_zeros(spark):
    m = spark.createDataFrame([(1, 1.0), (2, 0.5), (9, 1.0)], "query_id long, p double")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    assert tuple(R.averages(m, q, "p").first()) == (3, 0.5)
    assert tuple(R.averages(m, q.limit(0), "p").first()) == (0, 0.0)
