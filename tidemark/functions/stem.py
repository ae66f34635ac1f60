"""Stems of English words, as one SQL expression over an array of lower-case words, which any SQL with lambdas can run too, and of one word."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS

_VOWEL = "[aeiouy].*"
#: Steps, one after the other, each a (pattern, replacement) list of which the first that matches a word applies.
STEPS = (
    # plurals
    (("(ss|us|is)$", r"\1"), ("sses$", "ss"), ("([a-z][a-z])ies$", r"\1y"), ("([a-z][a-z])s$", r"\1")),
    # past and present forms, where a vowel is left before them
    (("([a-z][a-z])ied$", r"\1y"), (f"^(.*{_VOWEL}[a-z])ing$", r"\1"), (f"^(.*{_VOWEL}[a-z]|[aeiouy][a-z]+)ed$", r"\1")),
    # a doubled last consonant, which such endings bring
    (("bb$", "b"), ("dd$", "d"), ("gg$", "g"), ("mm$", "m"), ("nn$", "n"), ("pp$", "p"), ("rr$", "r"), ("tt$", "t")),
    # a last e and y, which the others' forms lose or change
    (("([a-z][a-z])e$", r"\1"), ("([bcdfghjklmnpqrstvwxz])y$", r"\1i")),
)


def _step(word: str, rules: tuple[tuple[str, str], ...], sql: bool) -> str:
    """The rules as a CASE; DuckDB and Spark write groups of a replacement differently."""
    out = " ".join(f"WHEN regexp_extract({word}, '{p}', 0) <> '' THEN regexp_replace({word}, '{p}', '{r if sql else r.replace(chr(92), '$')}')" for p, r in rules)
    return f"CASE {out} ELSE {word} END"


def stems_sql(words: str, sql: bool = True) -> str:
    """SQL for the stems of an array expression of lower-case words without the stop words; sql: DuckDB's, else Spark's."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    out = f"list_filter({words}, lambda w: w NOT IN ({stop}))" if sql else f"filter({words}, w -> w NOT IN ({stop}))"
    for rules in STEPS:
        out = f"list_transform({out}, lambda w: {_step('w', rules, True)})" if sql else f"transform({out}, w -> {_step('w', rules, False)})"
    return out


def stems(text: str) -> Column:
    """Stems of all words of a column, repeats included; words are runs of ASCII letters and digits."""
    return F.expr(stems_sql(f"filter(split(lower({text}), '[^a-z0-9]+'), w -> w <> '')", False))


_COMPILED = tuple(tuple((re.compile(p), r) for p, r in rules) for rules in STEPS)


@lru_cache(100_000)
def stem(word: str) -> str | None:
    """The same of one lower-case word, for batches that hold a word many times; a stop word has none."""
    if word in STOP_WORDS:
        return None
    for rules in _COMPILED:
        word = next((p.sub(r, word) for p, r in rules if p.search(word)), word)
    return word
