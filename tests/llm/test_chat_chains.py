from __future__ import annotations

from tidemark.llm import chat, queries


def test_long_chains_and_circles(spark):
    """Chains of 20 in one turn and over 20 turns settle whole; only a circle and what waits at its place for it don't."""
    calls = [(1, f"c{k:02}", 3, [f"c{k + 1:02}"]) for k in range(1, 20)] + [(1, "c20", 3, None)]
    calls += [(2, f"c{k:02}", k, [f"c{k + 1:02}"]) for k in range(1, 20)] + [(2, "c20", 20, None)]
    calls += [(3, "a", 5, ["b"]), (3, "b", 5, ["a"]), (3, "c", 1, ["a"]), (3, "d", 5, ["e"]), (3, "e", 5, None), (3, "f", 9, ["a"]), (3, "g", 2, ["g"])]
    rows = [(c, i, t, "reply", "{}", after) for c, i, t, after in calls]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): (r.place, r.hops) for r in chat.link_tools(df, none, queries.SCHEMAS).collect()}
    assert all(got[1, f"c{k:02}"] == (3, 20 - k) for k in range(1, 21))
    assert all(got[2, f"c{k:02}"] == (20, 20 - k) for k in range(1, 21))
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {"a": (5, None), "b": (5, None), "c": (5, None), "d": (5, 1), "e": (5, 0), "f": (9, 0), "g": (2, None)}
