"""Collocations, the manifest and the Jaccard join against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import join, manifest, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n long, k1 string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        some = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {q for p, a in some.items() for q in (p[1:], p[:-1]) if a == f[q]}
        found = []
        for p, a in some.items():
            if p not in inside:
                s, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                found.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(2)
    words = ["the", "Old", "mill", "on", "river", "été", "x\u00a0y", "is", "open", "here", "漢字"]
    rows = []
    for k in range(150):
        parts = ["the old mill on the river" if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        rows.append((k, "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for p in parts), rng.choice(["en", "en", "en", "fr", None, "und"]), "s", 0, 1, 2, "z"))
    return [*rows, rows[3], rows[3], (None, "the old mill. the OLD mill", "en", None, None, 1, 2, "z"), (500, None, "en", "s", 0, 1, 2, "z"), (501, "", None, "s", 0, 1, 2, "z")]


@pytest.mark.parametrize(("block", "held", "shard"), [(1 << 20, 1_000_000, 1 << 19), (64, 64, 7)])
def test_collocations(spark, spoken, monkeypatch, block, held, shard):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "PHRASES", shard)
    monkeypatch.setattr(phrases, "POSITIONS", block)
    monkeypatch.setattr(phrases, "WORDS", shard)
    monkeypatch.setattr(phrases, "BUCKETS", min(held, 1 << 16))
    df = spark.createDataFrame(spoken, SCHEMA).repartition(5)
    for least, top in ((4, 2000), (9, 6)):
        got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(df, least, top).collect())
        assert got == plain_collocations(spoken, least, top) and got


def test_collocations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en", "s", 0, 1, 2, "z")], SCHEMA)).count() == 0


def test_trie_finds_all():
    import numpy as np

    rng = np.random.default_rng(5)
    for k, top in ((1, 50), (2, 30), (3, 6), (5, 4)):
        some = np.unique(rng.integers(1, top, size=(300, k)), axis=0).astype(np.int32)
        t = phrases.trie(some)
        c = rng.integers(0, top + 2, size=5000).astype(np.int32)
        at, number = t.find(c)
        known = {tuple(x) for x in some.tolist()}
        want = [(i, w) for i in range(len(c) - k + 1) if (w := tuple(c[i : i + k].tolist())) in known]
        assert [(i, tuple(t.phrases[n].tolist())) for i, n in zip(at.tolist(), number.tolist(), strict=True)] == want
        assert len(phrases.trie(some[:1]).phrases) == 1


# ---------------------------------------------------------------- manifest


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def postorder(levels, level, i):
    if level:
        for k in (2 * i, 2 * i + 1):
            if k < len(levels[level - 1]):
                yield from postorder(levels, level - 1, k)
    yield level, levels[level][i]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    for name in ("_LEVELS", "_LOG", "_PROOF"):
        assert str(1 << 10) not in getattr(manifest, name)  # nothing else depends on the size of a builder
    rng = random.Random(6)
    rows = [(k, rng.choice([None, "", "text é " * rng.randint(1, 9)]), lang, rng.choice(["a", None]), rng.choice([None, 5]), 1, 2, "z") for lang, n in (("en", 21), ("é", 1), (None, 8), ("", 5)) for k in range(n)]
    rows += [rows[0], rows[0], (None, "x", "en", "s", 1, 1, 2, "z")]
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: h(part(r[0]), part(r[3]), part(r[2]), part(r[4]), part(r[1]))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x for *_, x in sorted(v)]) for g, v in groups.items()}
    top = plain_tree([trees[g][-1][0] for g in order])
    sibling = lambda levels, i: [lv[i >> k ^ 1] for k, lv in enumerate(levels) if i >> k ^ 1 < len(lv)]
    want = Counter()
    for g, v in groups.items():
        for i, (_, _, x) in enumerate(sorted(v)):
            proof = sibling(trees[g], i) + sibling(top, order.index(g))
            want[(x, trees[g][-1][0], top[-1][0], tuple(proof), h(*proof), top[-1][0], True)] += 1
    made = manifest.build(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = Counter((r.leaf, r.subroot, r.root, tuple(r.proof), r.proof_sha256, r.folded_root, r.verified) for r in manifest.verify(made).collect())
    assert got == want
    # The log holds every node once, in postorder.
    for g, key in ((None, "-"), ("en", "=en")):
        stood = [(r.level, r.node) for r in manifest.log(made.trees).where(F.col("tree") == key).orderBy("position").collect()]
        assert stood == list(postorder(trees[g], len(trees[g]) - 1, 0))
    # A leaf that shows anything else doesn't lead to the root.
    false = manifest.verify(manifest.build(spark.createDataFrame(rows, SCHEMA), shown=F.when(F.col("doc_id") == 3, F.sha2(F.lit("x"), 256))))
    assert false.where("not verified").count() == sum(r[0] == 3 for r in rows)


def test_manifest_of_nothing(spark):
    assert manifest.verify(manifest.build(spark.createDataFrame([], SCHEMA))).count() == 0


# ---------------------------------------------------------------- join


def plain_join(rows, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = re.findall("[^\\x20\\x09-\\x0D]+", low(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(7)
    make = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = [None, "", " \t", "one", "ONE ", "two three", "a b c d e", "A b  c d e"]
    passage = make(40)
    for n in (12, 30, 60, 200):
        base = make(n)
        for _ in range(12):  # near and not so near copies, at both sides of the bound
            t = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                t[rng.randrange(n)] = f"z{rng.randint(0, 99)}"
            texts.append(" ".join(t))
    texts += [" ".join(make(20) + passage + make(20)) for _ in range(40)]  # a passage that many share
    hot = make(80)
    for k in range(60):  # a large group of near copies, and one of copies
        t = list(hot)
        t[k] = "other"
        texts.append(" ".join(t))
    texts += [" ".join(passage)] * 30
    rows = [(100 + k, t, "en", "s", 0, 1, 2, "z") for k, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[20], None, None, None, 1, 2, "z"), (None, "nobody else has this text at all", None, None, None, 1, 2, "z"), (5, texts[21], "en", "s", 0, 1, 2, "z")]


@pytest.mark.parametrize(("few", "last", "fetch"), [(16, 1 << 20, 500_000), (3, 5, 0), (2, 1 << 20, 500_000)])
def test_join(spark, copies, monkeypatch, few, last, fetch):
    monkeypatch.setattr(join, "FEW", few)
    monkeypatch.setattr(join, "LAST", last)
    monkeypatch.setattr(join, "FETCH_ROWS", fetch)
    got = join.jaccard_components(spark.createDataFrame(copies, SCHEMA).repartition(5)).collect()
    want = plain_join(copies)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({c for _, n, c in want if n}) < sum(1 for _, n, _ in want if n)


def test_join_of_nothing(spark):
    assert join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in join.jaccard_components(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]
