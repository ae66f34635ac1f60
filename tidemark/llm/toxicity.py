"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios (NB-SVM style)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, with_texts

if TYPE_CHECKING:
    import pyarrow as pa

#: Labelled documents of each class read to fit, at most: those with the smallest hashes.
SAMPLE = 4000
#: Character n-grams within a word, which has a mark at both ends.
ORDERS = (3, 4, 5)
#: N-grams that the linear model weighs: those whose log-count ratios stand out most from chance.
FEATURES = 2000
#: Tasks that read the sample.
PARTS = 24
#: Distinct words remembered for reuse by one task.
MEMORY = 100_000


def grams(word: str) -> set[str]:
    w = f"\x02{word}\x03"
    return {w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)} or {w}


def words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Model:
    """Weights of n-grams and a bias; at most FEATURES weights."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, memory: dict[str, tuple[str, ...]]) -> float:
        """Probability of label 1. Presence features: each n-gram counts once, however often and in whatever word."""
        if len(memory) > MEMORY:
            memory.clear()
        seen: set[str] = set()
        for word in words(text):
            have = memory.get(word)
            if have is None:
                have = memory[word] = tuple(g for g in grams(word) if g in self.weights)
            if have:
                seen.update(have)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[g] for g in seen), -50, 50))))


def _presence(rows: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Counts of documents (gram, n0, n1) by label; or (label, have) with the positions of each document's wanted n-grams."""
    place = None if wanted is None else {g: k for k, g in enumerate(wanted)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, list] = {}
        count: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for part in parts:
            out = []
            for text, label in zip(part["text"], part["label"], strict=True):
                seen: set = set()
                for word in words(text):
                    have = memory.get(word)
                    if have is None:
                        have = memory[word] = [g for g in grams(word)] if place is None else [place[g] for g in grams(word) if g in place]
                    seen.update(have)
                if len(memory) > MEMORY:
                    memory.clear()
                if place is None:
                    into = count[label]
                    for g in seen:
                        into[g] = into.get(g, 0) + 1
                else:
                    out.append((label, sorted(seen)))
            if place is not None:
                yield pd.DataFrame(out, columns=["label", "have"])
        if place is None:
            some = list(count[0].keys() | count[1].keys())
            yield pd.DataFrame({"gram": some, "n0": [count[0].get(g, 0) for g in some], "n1": [count[1].get(g, 0) for g in some]})

    return rows.select("text", "label").mapInPandas(run, "gram string, n0 long, n1 long" if wanted is None else "label int, have array<int>")


def fit(rows: DataFrame) -> Model:
    """Fit on a bounded table (text, label 0 or 1): log-count ratios of n-gram presence, then logistic regression on them.

    N-grams are counted and looked up in tasks; the driver gets FEATURES n-grams and each sampled document's positions
    among them. Without rows of both classes the score is the constant share of label 1 (one half without any).
    """
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model({}, float(np.log((n1 + 1) / (n0 + 1))))
    counts = _presence(rows, None).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 5")
    ratio = F.log((F.col("n1") + 1) / (n1 + 2)) - F.log((F.col("n0") + 1) / (n0 + 2))
    stands_out = F.abs(F.col("r")) / F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    chosen = counts.withColumn("r", ratio).orderBy(stands_out.desc(), "gram").limit(FEATURES).collect()
    if not chosen:
        return Model({}, float(np.log((n1 + 1) / (n0 + 1))))
    r = np.array([x["r"] for x in chosen], np.float32)
    docs = _presence(rows, [x["gram"] for x in chosen]).toPandas().sort_values("label", kind="stable")
    x = np.zeros((len(docs), len(r)), np.float32)
    for i, have in enumerate(docs["have"]):
        x[i, np.asarray(have, np.int64)] = r[np.asarray(have, np.int64)]
    y = docs["label"].to_numpy(np.float64)
    w, b = _logistic(x, y, np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0)))
    weight = w * r
    return Model({c["gram"]: float(v) for c, v in zip(chosen, weight, strict=True) if abs(v) > 1e-4}, b)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient steps with a fixed step size."""
    n = len(y)
    top = np.linalg.norm(x, axis=1).max() ** 2 + 1
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb, step = w.copy(), b, 4 / (top * weight.max() + 4 * penalty / n)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ vw.astype(np.float32) + vb, -50, 50)))
        e = (p - y) * weight / n
        nw, nb = vw - step * (x.T @ e.astype(np.float32) + penalty * vw / n), vb - step * float(e.sum())
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents of each class, those with the smallest hash of doc_id and text.

    docs: (doc_id, text); labels: (doc_id, toxic), null labels left out, of repeated ones the largest. Only the labels of
    docs' own rows are looked at, so what is held out of docs can't change the model.
    """
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(marks, "_id")
    order = F.xxhash64(F.lit(11), "_id")
    ids = known.select("_id", "label").distinct()  # labels of documents that aren't given have no part in this
    picked = [ids.where(F.col("label") == k).orderBy(order, "_id").limit(sample) for k in (0, 1)]
    rows = known.join(picked[0].union(picked[1]).select("_id"), "_id", "left_semi").orderBy(F.xxhash64(F.lit(12), "_id", "text")).limit(2 * sample)
    return fit(cut(rows.select("text", "label").repartition(PARTS)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Every row of docs (doc_id, text), read whole, as (doc_id, score, predicted); null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        import pyarrow as pa

        memory: dict[str, tuple[str, ...]] = {}

        def make(texts: list[str | None]) -> list[pa.Array]:
            s = [shared.value.score(x, memory) for x in texts]
            return [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]

        return make

    return with_texts(docs, start, "score double, predicted int")


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, as they are, repeated ones each; null counts as empty. An empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        memory: dict[str, tuple[str, ...]] = {}
        for part in parts:
            keep = [shared.value.score(x, memory) < threshold for x in part.column("text").to_pylist()]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
