from pyspark.sql import functions as F

from tidemark.operators import trail as T

RECORDS = "id long, times_retrieved long, times_useful long, retrieval_precision double, valid_to timestamp"
EVENTS = "event_id long, result_ids array<bigint>"
FEEDBACK = "event_id long, seq long, useful_ids array<bigint>, failure_class string"


def plain(records, events, feedback):
    """Feedback one after the other, as a store that is changed in place does it."""
    state, results = {r[0]: [r[2] or 0, r[3]] for r in records}, dict(events)
    retrieved = {r[0]: r[1] for r in records}
    for event, _, useful, _ in sorted(feedback, key=lambda f: f[1]):
        if event not in results:
            continue
        for i in set(useful) & set(state):
            state[i][0] += 1
        for i in set(results[event]) & set(state):
            if retrieved[i] is not None and retrieved[i] >= T.LEAST_RETRIEVED:
                state[i][1] = state[i][0] / retrieved[i]
    return state


def test_feedback_in_order(spark):
    records = [(k, [None, 3, 5, 9][k % 4], [None, 2][k % 2], 0.5 if k % 3 else None, None) for k in range(12)]
    events = [(e, [e % 12, (e * 5 + 1) % 12, e % 12]) for e in range(20)] + [(20, [])]
    feedback = [(e % 23, s, [s % 12, (s * 7) % 12, (s * 7) % 12][: s % 4], "missing" if s % 5 == 0 else None) for s, e in enumerate(range(0, 120, 3))]
    rows = T.judged(spark.createDataFrame(records, RECORDS), spark.createDataFrame(events, EVENTS), spark.createDataFrame(feedback, FEEDBACK)).collect()
    want = plain(records, events, feedback)
    assert len(rows) == 12
    for r in rows:
        assert [r.times_useful or 0, r.retrieval_precision] == want[r.id]
    assert any(r.retrieval_precision not in (None, 0.5) for r in rows)


def test_marks_after_the_last_return_dont_change_precision(spark):
    rows = T.judged(
        spark.createDataFrame([(1, 5, 0, None, None)], RECORDS), spark.createDataFrame([(1, [1]), (2, [7])], EVENTS), spark.createDataFrame([(1, 1, [1], None), (2, 2, [1], None)], FEEDBACK)
    ).collect()
    assert (rows[0].times_useful, rows[0].retrieval_precision) == (2, 0.2)


def test_failure_classes_boost_nothing(spark):
    feedback = spark.createDataFrame([(1, 1, [1, 1], None), (1, 2, [1], "stale"), (1, 3, [], None), (9, 4, [1], None), (1, 5, [2], "")], FEEDBACK)
    events = spark.createDataFrame([(1, [1])], EVENTS)
    assert sorted(map(tuple, T.boosts(events, feedback).collect())) == [(1, 1, True), (2, 5, True)]
    assert [r.seq for r in T.unanswerable(events, feedback).collect()] == [4]
    answered = T.events_answered(events, feedback).collect()[0]
    assert (answered.feedback_ids, answered.failure_class) == ([2], None)


def test_events_keep_the_order_of_ranks(spark):
    hits = spark.createDataFrame([(1, 2, 30), (1, 1, 40), (1, 3, 10)], "query_id long, rank int, id long")
    queries = spark.createDataFrame([(1, "p", "a"), (2, "p", None)], "query_id long, project string, text string")
    rows = {r.query_id: r.result_ids for r in T.events_of(hits, queries, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert rows == {1: [40, 30, 10], 2: []}


def test_repeated_results_count_once(spark):
    records = spark.createDataFrame([(1, None, 0, None, None), (2, 4, 0, None, None), (3, None, 0, None, None)], RECORDS)
    got = T.retrieved(records, spark.createDataFrame([(1, [1, 1, 2]), (2, [1]), (3, [])], EVENTS)).collect()
    assert {r.id: r.times_retrieved for r in got} == {1: 2, 2: 5, 3: None}


def test_evidence_within_a_set_only(spark):
    records = spark.createDataFrame([(1, None), (2, "2024-01-01"), (3, None)], "id long, valid_to string")
    edges = spark.createDataFrame([(1, 2, "contradicts", 0.5), (1, 3, "relates_to", 0.5), (2, 3, "contradicts", 0.1), (9, 9, "contradicts", 0.1)], "source_id long, target_id long, rel_type string, strength double")
    sets = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 9), (2, 3), (3, 1), (3, 2), (3, 3)], "set_id long, id long")
    got = sorted(tuple(r) for r in T.evidence_maps(sets, records, edges).select("set_id", "records", "conflicts", "invalidated", "confidence").collect())
    assert got == [(1, 2, 1, 1, 0.5), (2, 1, 0, 0, 1.0), (3, 3, 2, 1, 1 / 3)]
    assert T.evidence_maps(sets.limit(0), records, edges).count() == 0
