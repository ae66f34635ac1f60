"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_sized, with_texts

if TYPE_CHECKING:
    import pyarrow as pa

#: Training documents of one language, about: those whose hash lies below the share that gives so many.
SAMPLE = 1500
#: Buckets that character trigrams are hashed to: what is learned is a number for each, by language.
BUCKETS = 1 << 17
#: What a change of language between two words costs, in nats.
SWITCH = 16.0
#: A script is a language's own if it holds this share of its training letters.
OWN_SHARE = 0.01
LETTERS = re.compile(r"[^\W\d_]+")
#: First and last code points of scripts in ascending order, fixed values; letters outside are of script "other".
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = sorted({x for x, _, _ in SCRIPTS}) + ["other"]
_FIRST, _LAST = np.array([a for _, a, _ in SCRIPTS]), np.array([b for _, _, b in SCRIPTS])
_NAME = np.array([NAMES.index(x) for x, _, _ in SCRIPTS])


def scripts(codes: np.ndarray) -> np.ndarray:
    """The script of each code point, as its place in NAMES."""
    at = np.maximum(np.searchsorted(_FIRST, codes, "right") - 1, 0)
    return np.where((codes >= _FIRST[at]) & (codes <= _LAST[at]), _NAME[at], len(NAMES) - 1)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, buckets of the trigrams from each on, first trigram of each word, its letters); words have a mark at both ends."""
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    mixed ^= mixed >> np.uint64(29)
    buckets = ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(47)).astype(np.int64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    return codes, buckets, np.cumsum(n + 2) - n - 2, n


@dataclass
class Model:
    """Log-probabilities of trigram buckets by language, and which languages use each script."""

    langs: list[str]
    logs: np.ndarray
    own: np.ndarray  # script, language

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each word by language, less the best one's; letters of each word)."""
        codes, buckets, first, n = trigrams(words)
        sums = np.zeros((len(buckets) + 1, len(self.langs)))
        np.cumsum(self.logs[buckets], axis=0, out=sums[1:])
        score = sums[first + n] - sums[first]
        if not self.own.all():  # scripts that not every language uses leave a word only those which do
            seen = np.bitwise_or.reduceat(np.where(codes > 3, 1 << scripts(codes), 0), first)
            kinds, kind = np.unique(seen, return_inverse=True)
            allowed = np.array([self.own[[k for k in range(len(NAMES)) if m >> k & 1]].any(axis=0) for m in kinds.tolist()])
            allowed[~allowed.any(axis=1)] = True
            score[~allowed[kind]] -= 1e3
        return score - score.max(axis=1, keepdims=True), n

    def label(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language of each word along the best path, letters of each word)."""
        e, n = self.scores(words)
        best = int(e.sum(axis=0).argmax())
        # One language throughout is best if no run of words would gain more than half a switch by another.
        gain = np.cumsum(e - e[:, [best]], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(e.shape[1]), gain[:-1]]), axis=0)
        if (gain - low).max(initial=0) <= SWITCH / 2:
            return np.full(len(words), best), n
        rows = e.tolist()
        value, back, every = rows[0], [], range(e.shape[1])
        for row in rows[1:]:
            top = max(value)
            from_, change = value.index(top), top - SWITCH
            back.append([k if value[k] >= change else from_ for k in every])
            value = [(x if x >= change else change) + s for x, s in zip(value, row, strict=True)]
        path = [value.index(max(value))]
        for b in reversed(back):
            path.append(b[path[-1]])
        return np.array(path[::-1]), n

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(language, first character, character after the last) of spans along the text; the letters decide, in runs."""
        low = text.lower()
        found = list(LETTERS.finditer(low if len(low) == len(text) else text))
        if not found or not self.langs:
            return []
        path, _ = self.label([m[0] for m in found])
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(self.langs[path[a]], found[a].start(), found[b - 1].end()) for a, b in zip(cuts, cuts[1:], strict=False)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most letters and its share of them; und without letters."""
        words = LETTERS.findall((text or "").lower())
        if not words or not self.langs:
            return "und", 0.0
        path, n = self.label(words)
        share = np.bincount(path, n, len(self.langs))
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs (doc_id, text, lang): about `sample` documents of each non-null lang, read whole.

    Trigrams are counted in tasks; the driver gets BUCKETS counts for each language at most.
    """
    rows = docs.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)).alias("h"))
    size = rows.groupBy("lang").agg(F.count("*").alias("all"))
    rows = join_sized(rows, size, ["lang"], "inner", size.count()).where(F.col("h") * F.col("all") < F.lit(sample << 30)).select("lang", "text").repartition(24)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                words = LETTERS.findall(text.lower())
                if words:
                    codes, buckets, first, n = trigrams(words)
                    inside = np.ones(len(codes), bool)
                    inside[first + n] = inside[first + n + 1] = False  # trigrams across two words
                    own = count.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    own[:BUCKETS] += np.bincount(buckets[inside[:-2]], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(scripts(codes[codes > 3]), minlength=len(NAMES))
        for lang, own in count.items():
            some = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": own[some]})

    table = rows.mapInPandas(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    n = np.zeros((BUCKETS + len(NAMES), len(langs)))
    if len(table):
        n[table["bucket"], table["lang"].map({x: k for k, x in enumerate(langs)})] = table["n"]
    seen, letters = n[:BUCKETS], n[BUCKETS:]
    logs = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * (seen.any(axis=1).sum() + 1)))
    # A script that none has learned tells nothing.
    own = (letters >= OWN_SHARE * np.maximum(letters.sum(axis=0), 1)) | ~letters.any(axis=1, keepdims=True)
    own[~own.any(axis=1)] = True
    return Model(langs, logs.astype(np.float32), own)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs (doc_id, text), read whole, as (doc_id, lang_pred, score): the language of most letters and its share.

    Null or letterless text: und, 0. With nothing learned every row is und. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        import pyarrow as pa

        def make(texts: list[str | None]) -> list[pa.Array]:
            found = [shared.value.predict(x) for x in texts]
            return [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

        return make

    return with_texts(docs, start, "lang_pred string, score double")


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, start, end) for each span of one language in each row of docs, in characters; none for null or letterless texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return lambda texts: [pa.array([[dict(zip(("lang", "start", "end"), x, strict=True)) for x in shared.value.spans(t or "")] for t in texts], kind)]

    spans = with_texts(docs, start, "spans array<struct<lang:string,start:bigint,end:bigint>>")
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
