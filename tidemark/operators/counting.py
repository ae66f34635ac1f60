"""Counting over evidence that is scattered over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.stem import stems

# How questions that count begin, and words that say nothing about what is counted.
COUNTING = "how many (times )?|how often |how much total |what is the total (number of )?|what is the sum of |give me a count of |count of "
NO_SUBJECT = (
    "a", "an", "the", "for", "on", "in", "of", "to", "and", "or", "about", "with", "at", "by", "from", "near", "around", "into", "through", "i", "me", "my", "you", "your", "do", "is", "are", "some", "any", "can", "could", "would", "should",
    "what", "which", "how", "when", "where", "recommend", "suggest", "advise", "like", "likes", "love", "loves", "enjoy", "enjoys", "prefer", "prefers", "favorite", "favourite", "avoid", "avoids",
)
NO_ANCHOR = ("did", "does", "have", "had", "many", "much", "times", "time", "was", "were")
SENTENCE = r"[^.!?\n]*[.!?\n]|[^.!?\n]+$"


def anchor(question: Column) -> Column:
    """What a counting question counts: without its opening, marks at its end, and words that name nothing; if none are left, with them."""
    rest = F.regexp_replace(F.regexp_replace(question, f"(?i)^({COUNTING})", ""), r"[?!.,;:]+$", "")
    rest = F.when(rest == "", question).otherwise(rest)
    words = F.filter(F.split(F.trim(rest), r"\s+"), lambda w: ~F.regexp_replace(F.lower(w), r"[?!.,;:]+$", "").isin(*NO_SUBJECT))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(rest)


def anchored(queries: DataFrame) -> DataFrame:
    """(query_id, terms) of rows (query_id, text) that ask for a count and name something: distinct stems of the anchor."""
    asked = queries.where(T.is_aggregation(F.col("text"))).select("query_id", anchor(F.col("text")).alias("anchor"))
    words = F.array_join(F.filter(T.tokens(F.col("anchor")), lambda w: ~w.isin(*NO_ANCHOR)), " ")
    told = asked.select("query_id", words.alias("words")).select("query_id", F.array_distinct(stems("words")).alias("terms"))
    return told.where(F.size("terms") > 0)


def near_complete(n: Column) -> Column:
    """Of n terms, all of up to two, all but one of more."""
    return F.when(n <= 2, n).otherwise(n - 1)


def sentences(records: DataFrame) -> DataFrame:
    """(id, start, end, text, terms) of rows (id, content): sentences without white space around them, offsets in bytes of UTF-8."""
    s = records.select("id", F.posexplode(F.regexp_extract_all("content", F.lit(SENTENCE), F.lit(0))).alias("pos", "raw"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("at", F.coalesce(F.sum(F.octet_length("raw")).over(before), F.lit(0)))
    return _spans(s, F.col("at"))


def _spans(rows: DataFrame, at: Column) -> DataFrame:
    left = F.regexp_replace("raw", r"^\s+", "")
    text = F.regexp_replace(left, r"\s+$", "")
    start = at + F.octet_length("raw") - F.octet_length(left)
    s = rows.select("id", start.cast("long").alias("start"), (start + F.octet_length(text)).cast("long").alias("end"), text.alias("text"))
    return s.where("text <> ''").withColumn("terms", F.array_distinct(stems("text")))


def connected(sets: Column) -> Column:
    """Whether an array of term sets hangs together by shared terms: the sets that meet are united, one after the other."""
    join = lambda groups, s: F.concat(F.filter(groups, lambda g: ~F.arrays_overlap(g, s)), F.array(F.array_distinct(F.concat(F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, s))), s))))
    return F.size(F.aggregate(sets, F.array().cast("array<array<string>>"), join)) <= 1


def counted(queries: DataFrame, results: DataFrame, records: DataFrame) -> DataFrame:
    """The evidence for counting questions: (query_id, anchor, count, place, id, start, end, text, stamp).

    queries: (query_id, text); results: (query_id, id), what a recall found; records: (id, content, stamp). Evidence is
    each sentence with two of the anchor's terms (all, if it has fewer), or, where a record has none, the whole record if
    its terms are near complete. A question is answered if the terms of all records with evidence are near complete
    together, and if these records hang together: fragments about different things, which share no term, are refused.
    count and place (by stamp, nulls last, then span and id) are those of the question's evidence. Other questions have
    no rows. A result that is repeated counts once. What hangs together is decided on the distinct sets of terms, subsets
    of a question's own words; texts are read once for each record, not for each question.
    """
    asked = anchored(queries)
    found = results.select("query_id", "id").distinct().join(asked, "query_id")
    kept = records.join(found.select("id").distinct(), "id", "left_semi").where(F.coalesce(F.trim("content"), F.lit("")) != "").select("id", "content", "stamp")
    parts = sentences(kept).withColumn("whole", F.lit(False)).union(_spans(kept.withColumnRenamed("content", "raw"), F.lit(0)).withColumn("whole", F.lit(True)))
    n = F.size("anchor")
    met = found.withColumnRenamed("terms", "anchor").join(parts, "id").withColumn("hits", F.array_intersect("anchor", "terms")).drop("terms")
    met = met.withColumn("fits", F.size("hits") >= F.when(F.col("whole"), near_complete(n)).otherwise(F.least(n, F.lit(2)))).where("fits or whole")
    mine = Window.partitionBy("query_id", "id")
    met = met.withColumn("some", F.max(~F.col("whole") & F.col("fits")).over(mine)).withColumn("own", F.max(F.when(F.col("whole"), F.col("hits"))).over(mine))
    taken = met.where("fits and whole <> some")
    sets = taken.select("query_id", "anchor", F.array_sort("own").alias("own")).groupBy("query_id", "anchor").agg(F.collect_set("own").alias("sets"))
    fit = sets.where((F.size(F.array_distinct(F.flatten("sets"))) >= near_complete(n)) & connected(F.col("sets"))).select("query_id")
    span = F.concat(F.lit("chars:"), F.col("start"), F.lit("-"), F.col("end"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("stamp"), span, "id")
    out = taken.join(fit, "query_id", "left_semi").join(records.select("id", "stamp"), "id")
    out = out.withColumn("place", F.row_number().over(order)).withColumn("count", F.count("*").over(Window.partitionBy("query_id")))
    return out.select("query_id", F.array_join("anchor", " ").alias("anchor"), "count", "place", "id", "start", "end", "text", "stamp")
