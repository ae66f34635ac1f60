"""Confidence in patterns as a ladder that sightings climb and corrections go down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The steps, and what confidence and how many projects make a pattern global.
STEPS, PROMOTE, PROJECTS = (0.3, 0.5, 0.7, 0.9), 0.8, 2
#: Sightings (or blocks of them) that one row's map composes.
BLOCK = 4096


def _moved(to: Column, ups: Column) -> Column:
    """Places 0 (not yet seen) to 4 after one more sighting."""
    return F.when(to == 0, 1).when(ups, F.least(to + 1, F.lit(len(STEPS)))).otherwise(F.greatest(to - 1, F.lit(1)))


def climbed(sightings: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """Rows (by, seq, correction boolean), with `confidence` after each of them; seq is a whole number from 0, unique in a key.

    The first sighting of a key stands on the lowest step, whatever it is; each later one moves a step up, a correction
    (null: none) one down, within the ladder. A sighting maps five places to five, and such maps compose, so a key's
    sightings are composed by blocks of seq, blocks by blocks of blocks, up to one for each key; places then go down
    again. No row holds more than `block` maps, however many sightings a key has.
    """
    highest = sightings.agg(F.max("seq")).first()[0] or 0
    maps = F.array(*[F.lit(x) for x in range(len(STEPS) + 1)])
    one = F.transform(maps, lambda x: _moved(x, ~F.coalesce(F.col("correction"), F.lit(False))).cast("int"))
    levels = [sightings.select(*by, F.col("seq").cast("long").alias("at"), one.alias("map"))]
    while highest > 0:
        highest //= block
        listed = F.array_sort(F.collect_list(F.struct("at", "map")))
        grouped = levels[-1].groupBy(*by, F.expr(f"at div {block}").alias("up")).agg(listed.alias("x"))
        composed = F.aggregate("x", maps, lambda m, s: F.transform(m, lambda p: F.get(s["map"], p)))
        levels.append(grouped.select(*by, F.col("up").alias("at"), composed.alias("map")))
    places = levels[-1].select(*by, "at", F.lit(0).alias("place"))
    for level in reversed(levels[:-1]):
        # Each block's members in order, with the place that the block begins with handed from one to the next.
        blocks = level.groupBy(*by, F.expr(f"at div {block}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("x"))
        starts = places.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("at").alias("_at"), "place")
        on = [blocks["up"] == starts["_at"], *[blocks[c].eqNullSafe(starts[f"_{c}"]) for c in by]]
        begun = blocks.join(starts, on)
        first = F.struct(F.col("place").alias("place"), F.array().cast("array<int>").alias("seen"))
        handed = F.aggregate("x", first, lambda s, m: F.struct(F.get(m["map"], s["place"]).alias("place"), F.concat(s["seen"], F.array(s["place"])).alias("seen")))
        member = F.explode(F.arrays_zip(F.transform("x", lambda m: m["at"]).alias("at"), handed["seen"].alias("place")))
        places = begun.select(*by, member.alias("m")).select(*by, "m.at", "m.place")
    mine = sightings.withColumn("_seq", F.col("seq").cast("long"))
    last = places.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("at").alias("_at"), F.col("place").alias("_place"))
    joined = mine.join(last, [mine["_seq"] == last["_at"], *[mine[c].eqNullSafe(last[f"_{c}"]) for c in by]])
    step = _moved(last["_place"], ~F.coalesce(F.col("correction"), F.lit(False))).cast("int")
    return joined.select(*sightings.columns, F.get(F.array(*map(F.lit, STEPS)), step - 1).alias("confidence"))


def promoted(confident: DataFrame, signature: str = "signature") -> DataFrame:
    """(signature, seq, confidence): the first sighting that makes a pattern global, of rows of climbed with `projects`, the projects its events span."""
    fit = confident.where((F.col("confidence") >= PROMOTE) & (F.col("projects") >= PROJECTS))
    return fit.groupBy(signature).agg(F.min("seq").alias("seq"), F.min_by("confidence", "seq").alias("confidence"))
