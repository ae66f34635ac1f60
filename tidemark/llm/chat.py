"""Chat formatting: tool calls linked to their results, put in order, validated and written as canonical JSON.

DataFrame functions alone. Nothing is gathered by conversation: a row for each call or result carries its place.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: JSON types of a schema, with the names that schema_of_variant gives them; fixed values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(text: Column) -> Column:
    """JSON with keys sorted and no spaces; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """Faults of a JSON object of arguments as sorted, comma-separated words; empty if it satisfies its tool's schema.

    schemas: tool -> argument -> type, a type that ends in ? being optional. Faults: unknown_tool, not_an_object,
    missing:NAME, type:NAME, extra:NAME.
    """
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    found = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown_tool")))
    found = found.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("not_an_object")))
    for tool, schema in schemas.items():
        faults: list[Column] = []
        for key, kind in schema.items():
            has = F.array_contains(keys, key)
            fits = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")).rlike(f"^({TYPES[kind.rstrip('?')]})$")
            fault = F.when(has & ~F.coalesce(fits, F.lit(False)), F.lit(f"type:{key}"))
            faults.append(fault if kind.endswith("?") else fault.when(~has, F.lit(f"missing:{key}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, schema))), lambda k: F.concat(F.lit("extra:"), k))
        found = found.when(name == tool, F.concat(F.array_compact(F.array(*faults)), extra))
    return F.array_join(F.array_sort(found), ",")


def _once(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each (conv_id, call_id): the earliest turn's, then the smallest in the other columns; rows with null ids aren't among them."""
    first = rows.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *keep)).alias("x"), F.count("*").alias("repeats"))
    return first.select("conv_id", "call_id", "x.*", "repeats")


def _places(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, hops): sorted by them, then turn and id, every call follows what it depends on.

    A call's place is its own turn, or that of the latest thing it depends on, directly or not, if that is later; hops
    counts the longest chain of dependencies at that place. Only dependencies that stand at the same turn or later than what
    needs them change anything, so a long conversation in order takes one round. hops is null for the calls that run in a circle,
    or wait at its place for one; no number of rounds is given.
    """
    edges = cut(calls.select("conv_id", "call_id", F.explode("after").alias("on")).where("on is not null").distinct())
    # best: the latest call known to be needed. Its own best is taken over too, which doubles the reach along rising turns.
    now = cut(calls.select("conv_id", "call_id", F.struct(F.col("turn").alias("place"), F.col("call_id").alias("id")).alias("best")))
    while True:
        known = lambda name: now.select("conv_id", F.col("call_id").alias(name), F.col("best").alias("got"))
        ahead = edges.join(known("on"), ["conv_id", "on"]).select("conv_id", "call_id", "got")
        jumps = now.where("best.id <> call_id").select("conv_id", "call_id", F.col("best.id").alias("on")).join(known("on"), ["conv_id", "on"]).select("conv_id", "call_id", "got")
        ahead = ahead.union(jumps).groupBy("conv_id", "call_id").agg(F.max("got").alias("got"))
        late = cut(now.join(ahead, ["conv_id", "call_id"]).where("got.place > best.place").select("conv_id", "call_id", "got"))
        if late.isEmpty():
            break
        now = cut(now.join(late, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("got", "best").alias("best")))
    now = now.select("conv_id", "call_id", F.col("best.place").alias("place"))
    # Calls with dependencies at their own place are peeled: a round settles those whose dependencies there are settled.
    tight = edges.join(now, ["conv_id", "call_id"]).join(now.select("conv_id", F.col("call_id").alias("on"), F.col("place").alias("there")), ["conv_id", "on"])
    tight = cut(tight.where("place = there").select("conv_id", "call_id", "on"))
    hops, left, k = None, tight.count(), 0
    while left:
        k += 1
        waiting = tight.select("conv_id", "call_id").distinct()
        rest = cut(tight.join(waiting.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi"))
        still = rest.select("conv_id", "call_id").distinct()
        n = rest.count()
        found = still.select("conv_id", "call_id", F.lit(None).cast("int").alias("hops")) if n == left else waiting.join(still, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(k).alias("hops"))
        hops = cut(found if hops is None else hops.union(found))
        if n == left:
            break
        tight, left = rest, n
    if hops is None:
        return now.withColumn("hops", F.lit(0))
    hops = hops.withColumn("_peeled", F.lit(True))
    return now.join(hops, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "place", F.when(F.col("_peeled"), F.col("hops")).otherwise(0).alias("hops"))


def link_tools(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, str]], rounds: int | None = None) -> DataFrame:
    """One row for each tool call or orphan result: (conv_id, call_id, turn, status, errors, place, hops, repeats, message).

    calls: (conv_id, call_id, turn, name, arguments JSON, after array of call ids); results: (conv_id, call_id, turn,
    content). Calls and results are joined on the identifier by hash. status: linked, no_result, early_result (it stands before
    its call), orphan_result, or no_identifier for each call or result without conversation or identifier, which nothing can link. errors: see argument_errors. message: canonical JSON of the call and its result; arguments
    that aren't JSON appear as a string. Sorted by place, hops, turn and call_id a conversation is in topological order.
    Repeated identifiers keep the earliest call and result and are counted in repeats; an empty table gives an empty result. rounds no longer limits anything and is not used: places are
    handed on until nothing changes.
    """
    c = _once(calls.select("conv_id", "call_id", "turn", "name", "arguments", F.array_sort("after").alias("after")), ["name", "arguments", "after"])
    r = _once(results.select("conv_id", "call_id", "turn", "content"), ["content"]).select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("repeats").alias("result_repeats"))
    c = cut(c.withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), schemas)))
    # Both sides have one row for each identifier, so their hash tables are even.
    both = c.join(_places(c), ["conv_id", "call_id"]).join(r.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    nameless = "conv_id is null or call_id is null"
    lone = calls.where(nameless).select("conv_id", "call_id", "turn", "name", "arguments", F.lit(1).alias("repeats"), F.lit(0).alias("hops"), argument_errors(F.col("name"), F.col("arguments"), schemas).alias("errors"))
    both = both.unionByName(lone, allowMissingColumns=True)
    both = both.unionByName(results.where(nameless).select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(1).alias("result_repeats")), allowMissingColumns=True)
    status = F.when(F.expr(nameless), "no_identifier").when(F.col("repeats").isNull(), "orphan_result").when(F.col("result_repeats").isNull(), "no_result").when(F.col("result_turn") < F.col("turn"), "early_result").otherwise("linked")
    quote = lambda x: F.to_json(F.to_variant_object(F.struct(x.alias("v"))))
    value = lambda x: F.regexp_extract(quote(x), r'(?s)^\{"v":(.*)\}$', 1)
    arguments = F.coalesce(canonical(F.col("arguments")), value(F.col("arguments")), F.lit("null"))
    parts = [
        F.when(F.col("repeats").isNotNull(), F.concat(F.lit('"arguments":'), arguments)),
        F.when(F.col("result_repeats").isNotNull(), F.concat(F.lit('"content":'), F.coalesce(value(F.col("content")), F.lit("null")))),
        F.concat(F.lit('"id":'), F.coalesce(value(F.col("call_id")), F.lit("null"))),
        F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), value(F.col("name")))),
    ]
    message = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    turn = F.coalesce("turn", "result_turn")
    repeats = reduce(lambda a, b: a + b, [F.coalesce(F.col(x) - 1, F.lit(0)) for x in ("repeats", "result_repeats")])
    return both.select("conv_id", "call_id", turn.alias("turn"), status.alias("status"), F.coalesce("errors", F.lit("")).alias("errors"), F.coalesce("place", turn).alias("place"), F.when(F.col("repeats").isNull(), F.lit(0)).otherwise(F.col("hops")).alias("hops"), repeats.alias("repeats"), message.alias("message"))
