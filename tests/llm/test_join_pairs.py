"""What op13 compares: few pairs of crowded columns, and texts of pairs that sketches leave."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.llm import join, shared


def test_pairs_of_crowded_columns_seldom_come_once_for_each_column(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(40):  # near copies that share most of their first columns
        t = list(base)
        t[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    kept, plain = [], shared.bucket_components
    monkeypatch.setattr(join, "bucket_components", lambda rows, verify, **how: kept.append((rows, how)) or plain(rows, verify, **how))
    got = join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}
    (rows, how), = kept
    rows = how["attach"](rows)
    met = lambda x: x.alias("l").join(x.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & how["where"]("l", "r")).select("l.node", "r.node")
    now, before = met(rows), met(rows.withColumn("pos", F.lit(0)))
    assert now.distinct().count() == 40 * 39 // 2
    assert now.count() < 0.6 * before.count()


def test_texts_of_unlike_pairs_arent_compared(spark, monkeypatch):
    """Texts of one size that share a long passage: sketches rule their pairs out before texts are joined."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(30)] + passage) for _ in range(30)]
    nodes, kept, asked = [], [], shared.bucket_components
    links, cut = join.links, join.cut

    def spy(rows, verify, **how):
        some = spark.createDataFrame(nodes, "a long")
        monkeypatch.setattr(join, "cut", lambda df: kept.append(cut(df)) or kept[-1])
        assert verify(some.crossJoin(some.withColumnRenamed("a", "b")).where("a < b")).count() == 0
        monkeypatch.setattr(join, "cut", cut)
        return asked(rows, verify, **how)

    monkeypatch.setattr(join, "links", lambda rows, *how: nodes.extend((r.row,) for r in rows.select("row").collect()) or links(rows, *how))
    monkeypatch.setattr(join, "bucket_components", spy)
    got = join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.component_id for r in got}) == 30
    counts = [x.count() for x in kept if x.columns == ["a", "b"]]
    assert counts == [435, 0]
