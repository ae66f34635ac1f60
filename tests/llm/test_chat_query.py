from __future__ import annotations

from collections import defaultdict

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def test_tool_calls_match_brute_force(spark):
    """Places and hops of the registered query against plain graph walks; forward needs, circles, faults and orphans occur."""
    calls, results = queries.tool_calls(spark.read.parquet(f"{SF}/conversations.parquet"))
    calls, results = calls.collect(), results.collect()
    assert len(calls) + len(results) == spark.read.parquet(f"{SF}/conversations.parquet").count()
    by = {(r.conv_id, r.call_id): r for r in calls}
    needs = {k: [(k[0], a) for a in r.after or [] if (k[0], a) in by] for k, r in by.items()}

    def reach(k: tuple) -> set:
        seen, left = set(), list(needs[k])
        while left:
            x = left.pop()
            if x not in seen:
                seen.add(x)
                left += needs[x]
        return seen

    far = {k: reach(k) for k in by}
    place = {k: max([by[k].turn, *(by[x].turn for x in far[k])]) for k in by}
    tight = {k: [x for x in needs[k] if place[x] == place[k]] for k in by}
    hops: dict = {k: 0 for k in by if not tight[k]}
    while True:
        more = {k: 1 + max(hops[x] for x in tight[k]) for k in by if k not in hops and all(x in hops for x in tight[k])}
        if not more:
            break
        hops |= more
    of = defaultdict(list)
    for r in results:
        of[r.conv_id, r.call_id].append(r)
    got = {(r.conv_id, r.call_id): r for r in queries.op3_tool_calls(spark, SF).collect()}
    assert set(got) == set(by) | set(of)
    seen = defaultdict(int)
    for k, r in got.items():
        seen[r.status] += 1
        seen[r.errors.split(":")[0]] += 1
        first = min((x.turn for x in of[k]), default=None) if k in of else None
        if k in by:
            assert (r.turn, r.place, r.hops) == (by[k].turn, place[k], hops.get(k))
            assert r.status == ("no_result" if first is None else "early_result" if first < r.turn else "linked")
        else:
            assert r.status == "orphan_result" and r.turn == first
    assert len(set(place.items()) - {(k, by[k].turn) for k in by}) > 0 and any(h is None for h in (hops.get(k) for k in by))
    assert all(seen[x] for x in ("linked", "no_result", "early_result", "orphan_result", "", "type", "missing", "extra", "not_an_object")), dict(seen)
