"""Words that were read once are known to later shards, with the library's ids."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import pack, queries

ODD = ["été", "ÉTÉ,", "straße.", "a×b", "a÷b!", "ñ", "Ñandú!!", "İstanbul", "ŠKODA,", "µm", "ªº", "漢字", "漢字,", "don't", "don't,", "...", "x" * 60, "x" * 47 + ",", "3.14", "é3", "çà—là", "ß"]


def texts(seed: int) -> pa.Array:
    rng = random.Random(seed)
    words = [*ODD, *("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) + rng.choice(["", ",", "!!"]) for _ in range(80))]
    return pa.array([" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(40)] + [None, " ".join(ODD)])


def ids(some: pa.Array, mine: pack.Tokens) -> list[list[int]]:
    have = pack.words(some)
    return [x.tolist() for x in pack.document_ids(some, have, *pack.distinct(have), mine, 2)]


def want(some: pa.Array, mine: pack.Tokens) -> list[list[int]]:
    return [[*mine.library([x or ""])[0].tolist(), 2] for x in some.to_pylist()]


def test_known_words_arent_read_again(monkeypatch):
    monkeypatch.setattr(pack, "_known", {})
    mine = pack.Tokens(queries.tokenizer_path())
    some = texts(1)
    assert ids(some, mine) == want(some, mine)
    later = pack.Tokens(queries.tokenizer_path(), mine.merges)
    expected = want(some, later)
    read = []
    monkeypatch.setattr(pack.Merges, "encode", lambda self, raw: read.append(raw))
    monkeypatch.setattr(later, "library", lambda x: read.append(x))
    assert ids(some, later) == expected and not read


@pytest.mark.parametrize("most", [1, 150, 1 << 20])
def test_shards_after_each_other(monkeypatch, most):
    """Also where little may be kept, and where different pieces have one first hash."""
    monkeypatch.setattr(pack, "_known", {})
    monkeypatch.setattr(pack, "KNOWN", most)
    plain = pack.hashes
    mine = pack.Tokens(queries.tokenizer_path())
    for seed in range(4):
        some = texts(seed)
        have = pack.words(some)
        first, code = pack.distinct(have)
        monkeypatch.setattr(pack, "hashes", lambda data, start, end, base: plain(data, start, end, base) & np.uint64(31 if base == pack.BASES[0] else 2**64 - 1))
        got = [x.tolist() for x in pack.document_ids(some, have, first, code, mine, 2)]
        monkeypatch.setattr(pack, "hashes", plain)
        assert got == want(some, mine)
