"""What queries send between tasks: their exchanges, with the columns that each carries."""

from __future__ import annotations

import pytest

import tidemark.queries  # noqa: F401
from tidemark.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture
def exchanges(spark):
    """Of a query: (how rows are dealt, names of the columns) of each exchange, with no side broadcast but by a count of its rows."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)

    def of(name: str) -> list[tuple[str, set[str]]]:
        found, todo = [], [QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                found.append((node.outputPartitioning().toString(), {node.output().apply(i).name() for i in range(node.output().size())}))
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found

    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


def test_new_edges_are_found_without_a_shuffle_of_pairs(exchanges):
    assert not any("cosine" in columns for _, columns in exchanges("infer_relationships"))


@pytest.mark.parametrize("name", ["composed_recall", "composed_recall_rrf"])
def test_composed_recall_shuffles_contents_once(exchanges, name):
    """Contents are dealt by record for the join with the candidates, and not with each candidate again."""
    dealt = [(how, columns) for how, columns in exchanges(name) if "content" in columns and "query_id" in columns]
    assert not dealt
