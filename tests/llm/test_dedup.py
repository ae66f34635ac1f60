from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact, lines, shared, simhash


def test_exact_groups(docs, empty, texts):
    want = defaultdict(list)
    for r in texts:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_groups(docs).collect())
    least = {k: min((i for i in v if i is not None), default=None) for k, v in want.items()}
    assert got == Counter((i, least[k], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in want.items() for i in v)
    assert sum(r.kept for r in exact.exact_groups(docs).collect()) == len(want)
    assert exact.exact_groups(empty).count() == 0


def test_exact_groups_split_late(spark):
    """Texts of one length that differ at each side of a run's end, or in the last byte."""
    rows = []
    for at in (0, 62, 63, 64, 65, 574, 575, 576, 577, 4671, 4672, 4999):
        t = ["a"] * 5000
        t[at] = "b"
        rows += ["".join(t)] * 2
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_groups(df).collect()} == {(k, k - k % 2, 2) for k in range(len(rows))}


def test_golay_facts():
    """Words are a coset's pattern plus a codeword, so checking the patterns checks all words."""
    words = simhash.golay()[2][:, 0]
    many, number = simhash.neighbours(words)
    own = [set(many[i, : number[i]]) for i in range(2048)]
    flips = [1 << a for a in range(23)], [(1 << a) | (1 << b) for a in range(23) for b in range(a)]
    for i, w in enumerate(words.tolist()):
        k, n = simhash.neighbours(np.array([w ^ x for x in flips[0]]))
        for r in range(len(k)):
            assert many[i, 0] in set(k[r, : n[r]]) and k[r, 0] in own[i]
        k, n = simhash.neighbours(np.array([w ^ x for x in flips[1]]))
        assert all(own[i] & set(k[r, : n[r]]) for r in range(len(k)))


def fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, texts):
    fps = [(r[0], fingerprint(r[1])) for r in texts]
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in fps)
    distinct = sorted({f for _, f in fps})
    part = {f: f for f in distinct}
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 4 and part[a] != part[b]:
                old, new = part[a], part[b]
                part = {k: new if v == old else v for k, v in part.items()}
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[part[f]].append(i)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, min(least[part[f]], default=None)) for i, f in fps}
    assert len(set(part.values())) < len(distinct)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(min(v) for v in least.values() if v)}


def test_bucket_keys_lose_no_link():
    rng = random.Random(1)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = [x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}) for x in a]
    found = []
    for fps in (a, b):
        at, key, side = simhash.keys(np.array(fps, np.uint64))
        by = defaultdict(set)
        for i, k, s in zip(at.tolist(), key.tolist(), side.tolist(), strict=True):
            by[i].add((k, s))
        found.append(by)
    for i in range(len(a)):
        x, y = found[0][i], found[1][i]
        assert any((k, 1 - s if s < 2 else 2) in y for k, s in x)


def test_link_buckets_with_crowds(spark):
    """A crowded bucket of chains: every link within it is needed."""
    rows = spark.range(300).select(F.lit(1).alias("key"), F.col("id").alias("node")).union(spark.createDataFrame([(2, 299), (2, 1000), (3, 1000), (3, 5000)], "key int, node long"))
    edges = shared.link_buckets(rows, lambda p: p.where("b - a <= 2 or a = 299"))
    got = {r.node: r.component for r in shared.components(edges).collect()}
    assert got == {k: 0 for k in [*range(300), 1000]}


def test_components_of_paths_and_rings(spark):
    edges = [(k, k + 1) for k in range(200)] + [(300 + k, 300 + (k + 1) % 50) for k in range(50)] + [(400, k) for k in range(401, 500)] + [(7, 7)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 300 for k in range(300, 350)}, **{k: 400 for k in range(400, 500)}}


def test_lines(spark, docs, empty):
    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    base = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(30)]
    near = [" ".join(w if i != k else "zzz" for i, w in enumerate(b.split())) for k, b in enumerate(base[:15])]
    rows = [(i, "\n".join([b, "short", b.upper()])) for i, b in enumerate(base)] + [(100 + i, n) for i, n in enumerate(near)] + [(200, None), (201, ""), (202, base[3] + "\n" + "fresh line that nobody else has at all")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == f"{b}\nshort" and got[i].dropped_lines == 1 for i, b in enumerate(base))
    assert sum(got[100 + i].text == "" for i in range(15)) >= 14  # one word of forty changed: high recall
    assert got[200].text is None and got[200].lines == 0 and got[201].text == ""
    assert got[202].text == "fresh line that nobody else has at all"
    out = lines.dedup_lines(docs)
    assert out.count() == docs.count() and {*docs.columns, "dropped_lines"} < set(out.columns)
    assert {r.lines for r in out.collect()} == {1, None}  # the corpus's own column of that name stays
    assert lines.dedup_lines(docs, counts=False).columns == docs.columns
    short = lines.dedup_lines(spark.createDataFrame([(1, "a b\n\nonce\n"), (2, "A  b\n\nelse\n")], "doc_id long, text string"), short_exact=True)
    assert {r.doc_id: (r.text, r.dropped_lines) for r in short.collect()} == {1: ("a b\n\nonce\n", 0), 2: ("\nelse\n", 1)}
    assert lines.dedup_lines(empty).count() == 0
