"""Cutting records into chunks, packing a context, and counting evidence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Bytes of a token, about.
TOKEN = 4
# Abbreviations whose full stop ends no sentence.
ABBREVIATION = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\.g|i\.e|approx|Inc|Ltd|Co|Fig|No)\.")
HEADING = re.compile(r"^#{1,2} +(.+)$", re.M)


def sentences(text: str) -> list[str]:
    held = ABBREVIATION.sub(lambda m: m[0].replace(".", "\0"), text.strip())
    return [x.strip().replace("\0", ".") for x in re.split(r"(?<=[.!?])\s+", held) if x.strip()]


def _windows(parts: list[str], most: int, overlap: int, glue: str = " ") -> list[str]:
    """Parts joined into chunks of at most `most` bytes where they fit; the next starts with the last parts within `overlap` bytes."""
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if held and len(glue.join([*held, part]).encode()) > most:
            out.append(glue.join(held))
            while held and len(glue.join(held).encode()) > overlap:
                held.pop(0)
        held.append(part)
    return [*out, glue.join(held)] if held else out


def chunk_text(text: str | None, tokens: int = 512, overlap: int = 64) -> list[str]:
    if not (text or "").strip():
        return []
    return [text] if len(text.encode()) <= tokens * TOKEN else _windows(sentences(text), tokens * TOKEN, overlap * TOKEN)


def chunk_document(text: str | None, target: int = 2000) -> list[tuple[str, str, str]]:
    """(heading, kind, chunk): sections by headings of the first two ranks, paragraphs packed to about target bytes, long ones cut at sentences.

    A chunk that doesn't hold the last sentence before it begins with that sentence.
    """
    text = (text or "").strip()
    marks = list(HEADING.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    sections = [(m[1].strip(), text[m.end() : e]) for m, e in zip(marks, ends, strict=True)] if marks else [("", text)]
    out: list[tuple[str, str, str]] = []
    last = ""
    for heading, body in sections:
        held: list[str] = []
        paragraphs = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
        pieces: list[tuple[str, str]] = []
        for p in [*paragraphs, None]:
            long = p is not None and len(p.encode()) > target
            if held and (p is None or long or len("\n\n".join([*held, p]).encode()) > target):
                pieces.append(("paragraph", "\n\n".join(held)))
                held = []
            if long:
                pieces += [("sentence_window", w) for w in _windows(sentences(p), target, 0)]
            elif p is not None:
                held.append(p)
        for kind, piece in pieces:
            carried = f"{last} {piece}" if last and last not in piece else piece
            out.append((heading, kind, carried))
            last = (sentences(piece) or [""])[-1]
    return out


def chunked(records: DataFrame, tokens: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_index, chunk_text, chunk_hash) of rows (id, content, storage_mode); a chunk that repeats in its record comes once."""

    @F.pandas_udf("array<string>")
    def cut(content: pd.Series, mode: pd.Series) -> pd.Series:
        return pd.Series([[c for _, _, c in chunk_document(x)] if m == "document" else chunk_text(x, tokens, overlap) for x, m in zip(content, mode, strict=True)])

    df = records.select("id", F.posexplode(cut("content", "storage_mode")).alias("chunk_index", "chunk_text"))
    df = df.withColumn("chunk_hash", T.chunk_hash(F.col("chunk_text")))
    first = F.row_number().over(Window.partitionBy("id", "chunk_hash").orderBy("chunk_index"))
    return df.withColumn("_k", first).where("_k = 1").drop("_k")


def within_budget(df: DataFrame, tokens: int, by: str = "query_id") -> DataFrame:
    """Rows (query_id, id, score, chunk, rank) that fit: best score first, one that is too long for what is left is passed over.

    A fold over each query's list; a list has no more rows than a recall returns.
    """
    cost = F.greatest(F.lit(1), F.floor(F.octet_length("chunk") / TOKEN).cast("int"))
    packed = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", "id", cost.alias("c")))).alias("x"))
    start = F.struct(F.lit(tokens).alias("left"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda a, x: F.when(x["c"] <= a["left"], F.struct((a["left"] - x["c"]).alias("left"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    kept = packed.select(by, F.explode(F.aggregate("x", start, step)["ids"]).alias("id"))
    return df.join(kept, [by, "id"])


def evidence(results: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, id, pos, sentence, hits): sentences of results (query_id, id, content) with two of the query's anchor terms, or all if it has fewer.

    anchors: (query_id, terms array). Queries whose terms, over all results, miss more than one are left out.
    """
    cutting = F.split("content", r"(?<=[.!?])\s+")
    s = results.select("query_id", "id", F.posexplode(cutting).alias("pos", "sentence")).join(anchors, "query_id")
    found: Column = F.array_intersect(T.token_set(F.col("sentence")), "terms")
    s = s.withColumn("found", found).where(F.size("found") >= F.least(F.lit(2), F.size("terms")))
    enough = s.select("query_id", F.size("terms").alias("n"), F.explode("found").alias("t")).groupBy("query_id", "n").agg(F.countDistinct("t").alias("got")).where("got >= greatest(1, n - 1)").select("query_id")
    return s.join(enough, "query_id", "left_semi").select("query_id", "id", "pos", "sentence", F.size("found").alias("hits"))
