"""Spans of long records around what a filter matches, merged and cut to a budget. Offsets are bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes around a match (half before, half after), and tokens of about TOKEN bytes that all spans of a record may have.
WINDOW, BUDGET, TOKEN = 4000, 6000, 4
#: Longest pattern taken.
MOST_PATTERN = 1024


def quoted(text: Column) -> Column:
    """A pattern that matches exactly this text."""
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|\-])", r"\\$1")


def occurrences(df: DataFrame, content: str, pattern: Column) -> DataFrame:
    """df, a row for each match of the pattern in content, left to right, none overlapping: start and end, and `matched`.

    The text between matches and the matches themselves are cut out side by side; their lengths, added up, are the
    offsets. A pattern must not match the empty text.
    """
    df = df.withColumns({"_between": F.split(F.col(content), pattern, -1), "_found": F.regexp_extract_all(F.col(content), pattern, F.lit(0))})
    df = df.where(F.size("_found") > 0)
    sizes = F.zip_with("_between", "_found", lambda b, m: F.struct(F.octet_length(b).alias("b"), F.octet_length(m).alias("m"), m.alias("matched")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,matched:string>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["b"] + x["m"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["b"]).alias("start"), (s["at"] + x["b"] + x["m"]).alias("end"), x["matched"].alias("matched")))).alias("out"))
    placed = F.aggregate(F.slice(sizes, F.lit(1), F.size("_found")), start, step)["out"]
    return df.withColumn("_at", F.explode(placed)).select(*[c for c in df.columns if not c.startswith("_")], "_at.*")


def merged(windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end, matched) windows of one record that overlap or touch, as one with the first one's match."""
    order = Window.partitionBy(*by).orderBy("start", "end", "matched")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = windows.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = begins.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("matched", F.struct("start", "end", "matched")).alias("matched")).drop("_island")


def document_spans(asked: DataFrame, window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """The spans that answer a question about a record: (query_id, id, offset, bytes, matched, text, truncated).

    asked: (query_id, id, content, pattern, subs): pattern is a regular expression, subs an array of literal texts; a
    pattern goes before subs, empty subs count for nothing, and without either the first `window` bytes are the span.
    Windows of half of `window` on each side of every match are merged where they overlap or touch; from the first on they
    are taken while they fit in budget * TOKEN bytes; the one that doesn't is cut where a character begins, and it and
    what follows make the record truncated. A record without matches, or with null or empty content, has no rows. A
    pattern of over MOST_PATTERN characters is an error. Texts aren't carried through the merging: they are joined again.
    """
    by = ["query_id", "id"]
    size = F.octet_length("content")
    has_subs = F.size(F.filter(F.coalesce("subs", F.array()), lambda x: x != "")) > 0
    asked = asked.where(size > 0)
    patterns = F.when(F.coalesce(F.length("pattern"), F.lit(0)) > MOST_PATTERN, F.array(F.raise_error(F.lit("pattern too long")).cast("string"))).when(F.coalesce(F.col("pattern"), F.lit("")) != "", F.array("pattern"))
    patterns = patterns.otherwise(F.transform(F.filter("subs", lambda x: x != ""), quoted))
    filtered = asked.where((F.coalesce(F.col("pattern"), F.lit("")) != "") | has_subs).withColumn("p", F.explode(patterns)).withColumn("size", size)
    found = occurrences(filtered.select(*by, "content", "p", "size"), "content", F.col("p"))
    half = window // 2
    found = found.select(*by, F.greatest(F.lit(0), F.col("start") - half).alias("start"), F.least(F.col("end") + half, F.col("size")).alias("end"), "matched")
    whole = asked.where((F.coalesce(F.col("pattern"), F.lit("")) == "") & ~F.coalesce(has_subs, F.lit(False))).select(*by, F.lit(0).alias("start"), F.least(F.lit(window), size).alias("end"), F.lit(None).cast("string").alias("matched"))
    spans = merged(found, by).union(whole)
    order = Window.partitionBy(*by).orderBy("start")
    cap = budget * TOKEN
    spans = spans.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.withColumn("left", F.lit(cap) - F.col("before")).withColumn("over", F.max((F.col("end") - F.col("start") > F.col("left")).cast("int")).over(Window.partitionBy(*by)) > 0)
    spans = spans.where("left > 0").join(asked.select(*by, F.encode("content", "UTF-8").alias("raw")), by)
    # The longest part within what is left that ends where a character begins: a character has at most four bytes.
    goes_on = lambda k: F.hex(F.substring(F.col("raw"), (F.col("start") + k + 1).cast("int"), F.lit(1))).rlike("^[89AB]")
    left = F.col("left")
    cut = F.when(~goes_on(left), left)
    for back in (1, 2, 3):
        cut = cut.when(~goes_on(left - back), left - back)
    length = F.when(F.col("end") - F.col("start") <= left, F.col("end") - F.col("start")).otherwise(F.greatest(cut.otherwise(left), F.lit(0)))
    spans = spans.withColumn("bytes", length.cast("long")).where("bytes > 0")
    slice_ = F.substring(F.col("raw"), (F.col("start") + 1).cast("int"), F.col("bytes").cast("int"))
    return spans.select(*by, F.col("start").cast("long").alias("offset"), "bytes", "matched", slice_.alias("text"), F.col("over").alias("truncated"))
