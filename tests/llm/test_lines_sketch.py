from __future__ import annotations

import random

import pyarrow as pa

from tidemark.llm import lines


def grams(t: str) -> set:
    return {t[i : i + 5] for i in range(len(t) - 4)}


def test_odd_bits_rule_out_no_similar_line(spark):
    """Pairs from equal to unlike, short and far longer than the sketch: similar ones always pass, most of the others don't."""
    rng = random.Random(4)
    rows, similar, fits = [], [], []
    for k in range(600):
        a = "".join(rng.choice("etaoinshrd l") for _ in range(rng.choice([5, 30, 90, 300, 3000])))
        b = "".join(rng.choice("xyz") if rng.random() < k / 6000 else c for c in a)
        x, y = grams(a), grams(b)
        rows.append((k, *([int(v) for v in m] for m in lines._marks(pa.array([a, b])).T)))
        similar.append(len(x & y) >= 0.8 * len(x | y))
        fits.append(len(x) < 1000)
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>")
    names = ["size", *[f"s{k}" for k in range(lines.SKETCH)]]
    one = lambda c: df.select("k", *[df[c][i].alias(n) for i, n in enumerate(names)]).alias(c)
    got = {r[0] for r in one("a").join(one("b"), "k").where(lines._may_be_alike("a", "b", 0.8)).collect()}
    assert 50 < sum(similar) < 500
    assert all(k in got for k in range(600) if similar[k])
    unlike = [k for k in range(600) if fits[k] and not similar[k]]  # more 5-grams than bits make a sketch say little
    assert sum(k in got for k in unlike) < 0.25 * len(unlike)


def test_outliers_of_crowded_buckets(spark):
    """A crowd of near copies with chains that hang on single members: each link counts, as brute force finds them."""
    rng = random.Random(6)
    base = "".join(rng.choice("etaoinshrd l") for _ in range(200))
    rows = []
    for _ in range(150):
        t = list(base)
        for at in rng.sample(range(100, 200), rng.choice([1, 2, 3, 4, 6])):
            t[at] = rng.choice("XYZ#")
        rows.append("".join(t).lower())
    rows = list(dict.fromkeys(rows))
    part = list(range(len(rows)))
    sets = [grams(t) for t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                part = [part[i] if p == part[j] else p for p in part]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert 1 < len(set(part)) < len(rows) // 2
    assert all(part.index(part[k]) != k for k, t in got.items() if t == "")
    assert sum(t == "" for t in got.values()) >= 0.97 * (len(rows) - len(set(part)))
