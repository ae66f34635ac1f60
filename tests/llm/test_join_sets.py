import random
import re
import string

import pytest

from tidemark.llm import join


def plain(text: str | None, shingle: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(shingle, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


@pytest.mark.parametrize("block", [3, join.BLOCK])
def test_sets_are_those_of_the_shingles(monkeypatch, block):
    """Sizes of sets, intersections and unions are those of sets of shingles, with blocks that end within a text."""
    monkeypatch.setattr(join, "BLOCK", block)
    r = random.Random(1)
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    words = ["a", "A", "É", "é", "\x85", " x", "\x1c", "ab", "b", "語"] + ["".join(r.choices(string.ascii_letters, k=3)) for _ in range(5)]
    texts = [None, "", " \n", *["".join(r.choice(words) + r.choice(spaces) for _ in range(r.randrange(1, 40))) for _ in range(150)]]
    texts += [t + " " + r.choice(words) for t in texts[3:60]] + [" " + t for t in texts[3:20]]
    for shingle in (1, 4, 5):
        sets = [(set(join.grams(t, shingle).tolist()), plain(t, shingle)) for t in texts]
        for a, x in sets:
            assert len(a) == len(x)
            for b, y in sets[::7]:
                assert len(a & b) == len(x & y) and (a == b) == (x == y)


def test_order_and_repeats_of_words_matter():
    one = join.grams("a b c d e")
    assert all(join.grams(t).tolist() != one.tolist() for t in ("b a c d e", "a a c d e", "e d c b a", "a b c d"))
    assert len(join.grams("a " * 1000)) == 1
