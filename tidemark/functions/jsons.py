"""JSON out of texts that say more than that."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def _value(text: str, at: int) -> str | None:
    """The JSON value that begins at a place, if there is a whole one; numbers that JSON lacks, and what is nested too deep to read, are none."""
    try:
        return text[at : _DECODER.raw_decode(text, at)[1]]
    except (ValueError, RecursionError):
        return None


def _first(text: str | None) -> str | None:
    text = (text or "").strip(" \t\r\n")
    if not text:
        return None
    if _value(text, 0) == text:
        return text
    for at, c in enumerate(text):
        if c in "[{" and (found := _value(text, at)) is not None:
            return found
    return text if text[0] in "[{" else None


def first_json(text: Column) -> Column:
    """A text that is JSON, or else the first whole object or array in it; thinking in tags and lines of fences are left out before.

    A text without one is given as it is if it begins like one (for what reports the fault), else it is null. A thought
    that isn't closed stays. Texts are looked at in Arrow batches; each is read from every bracket that opens nothing whole.
    """
    said = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    lines = F.filter(F.split(said, "\n"), lambda x: ~F.regexp_replace(x, r"^\s+", "").startswith("```"))

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_first)

    return found(F.array_join(lines, "\n"))
