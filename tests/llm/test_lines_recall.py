from __future__ import annotations

import random

from tidemark.llm import lines


def grams(t: str) -> set:
    return {t[i : i + 5] for i in range(len(t) - 4)}


def test_lines_without_spaces_and_short_words_are_found(spark):
    """Near copies that differ in their first characters, in CJK, tab-separated and plain lines, against brute force."""
    rng = random.Random(2)
    rows, alike = [], []
    for k in range(240):
        if k % 3 == 0:
            t = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
        else:
            t = "\t "[k % 3 - 1].join("".join(rng.choice("etaoinshrd") for _ in range(6)) for _ in range(10))
        v = list(t)
        for at in [1] if k % 2 else [0, 30]:
            v[at] = "#"
        v = "".join(v)
        a, b = grams(t), grams(v)
        rows += [(2 * k, t), (2 * k + 1, v)]
        if len(a & b) >= 0.8 * len(a | b):
            alike.append(2 * k + 1)
    rows += [(900, "white space that is wider\tin one of two"), (901, " white  space that\tis wider in one of two")]
    rows += [(902, "line\u2028separators\u2028inside\u2028this\u2028line"), (903, "Xine\u2028separators\u2028inside\u2028this\u2028line")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) >= 200
    assert sum(got[i] == "" for i in alike) >= 0.97 * len(alike)
    assert all(got[i] == t for i, t in rows if i % 2 == 0)
    assert all(got[i] == t for i, t in rows if i < 900 and i % 2 and i not in alike)
    assert got[901] == "" and got[903] == ""
