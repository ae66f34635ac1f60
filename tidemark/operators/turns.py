"""Windows of conversations that are cut where a speaker begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fold import folded

#: Code points of a window.
MOST = 6000
# How a line begins that opens a turn.
OPENINGS = ("user:", "human:", "assistant:", "system:", "tool:", "[user]", "[human]", "[assistant]", "[system]", "[tool]")


def openings(turns: DataFrame) -> DataFrame:
    """(conv_id, start, size, opening): what rows (conv_id, turn, role, text) say as "role: text" and a line end, cut before each line that opens a turn.

    start counts code points from the conversation's beginning; opening is the length of the mark that opens a turn there,
    else 0. A null text is empty, a null role writes no mark. Turns of one number stand in the order of a hash of what
    they say; turns that are repeated in full follow each other.
    """
    said = F.concat(F.coalesce(F.concat("role", F.lit(": ")), F.lit("")), F.coalesce("text", F.lit("")))
    mark = "(?i)(?:" + "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in OPENINGS) + ")"
    order = Window.partitionBy("conv_id").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", said.alias("said")).withColumn("tie", F.xxhash64("said"))
    rows = rows.withColumn("base", F.coalesce(F.sum(F.length("said") + 1).over(order), F.lit(0)))
    parts = rows.select("conv_id", "base", F.posexplode(F.split("said", f"\n(?={mark})", -1)).alias("pos", "part"))
    sized = parts.select("conv_id", "base", "pos", (F.length("part") + 1).cast("long").alias("size"), F.length(F.regexp_extract("part", f"^{mark}", 0)).cast("long").alias("opening"))
    inside = Window.partitionBy("conv_id", "base").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("conv_id", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"), "size", "opening")


def windows(turns: DataFrame, most: int = MOST) -> DataFrame:
    """(conv_id, window, start, end): consecutive windows of at most `most` code points that cover each conversation once.

    A window ends before the last opening of a turn that it holds in full and that lies in its second half; if there is
    none, after `most` code points. Only lengths go through the fold, whose state is a start, the last opening that may
    end the window, and the end of what was read. A conversation without turns has no window.
    """

    def step(state, row):
        start, cut, end, number = state or (0, None, 0, 0)
        out = []
        # What must be inside a window before its end is settled: this opening, or all that was read.
        reach = end if row is None else row["start"] + row["opening"]
        while reach > start + most:
            stop = start + most if cut is None else cut
            out.append({"window": number, "start": start, "end": stop})
            start, cut, number = stop, None, number + 1
        if row is None:
            return None, [*out, {"window": number, "start": start, "end": end}]
        if row["opening"] and row["start"] - start >= most // 2:
            cut = row["start"]
        return (start, cut, row["start"] + row["size"], number), out

    return folded(openings(turns), ["conv_id"], ["start"], step, "window long, start long, end long")
