from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    held = queries.remainder("doc_id", 5) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for sample in (20, 4000):
        a, b = (toxicity.train(docs.where(~held), x, sample) for x in (labels, flipped))
        assert a.weights == b.weights and a.bias == b.bias


def test_counts_ratios_and_scores(spark):
    """Against a plain version: presence of n-grams by class, log-count ratios, and the score as a sum of weights."""
    rows = [("bad ugly bad", 1), ("ugly day", 1), ("good day", 0), ("fine good day", 0), ("bad day", 1), ("good", 0)] * 3
    df = spark.createDataFrame(rows, "text string, label int")
    model = toxicity.fit(df)
    n = Counter(y for _, y in rows)
    have = [(set().union(*[toxicity.grams(w) for w in toxicity.words(t)]), y) for t, y in rows]
    count = {k: Counter(g for s, y in have if y == k for g in s) for k in (0, 1)}
    ratio = {g: np.log((count[1][g] + 1) / (n[1] + 2)) - np.log((count[0][g] + 1) / (n[0] + 2)) for g in count[0] | count[1] if count[0][g] + count[1][g] >= 5}
    assert set(model.weights) <= set(ratio)
    assert all(w * ratio[g] > -1e-6 for g, w in model.weights.items() if abs(ratio[g]) > 0.5)  # a scaled weight is the ratio times the linear one
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    for k, (s, y) in enumerate(have):
        want = 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(g, 0) for g in s))))
        assert abs(got[k][0] - want) < 1e-9 and got[k][1] == y
    assert abs(got[99][0] - 1 / (1 + np.exp(-model.bias))) < 1e-9
