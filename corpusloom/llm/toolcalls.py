"""Tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results meet by identifier. A call comes after all calls it depends on: levels are peeled off, one join a
level, and a call's place in its conversation is counted over blocks, so that no conversation is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns whose calls are numbered in one window.
BLOCK = 512


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 without known dependencies, else one more than the highest of those; null in or behind a cycle.

    ``calls`` has call_id (unique) and depends (array of call_ids; unknown ones and repeats don't count).
    """
    edges = calls.select("call_id", F.explode(F.array_distinct("depends")).alias("before")).join(calls.select(F.col("call_id").alias("before")), "before", "left_semi")
    edges = stored(edges, "edges")
    open_ = stored(calls.select("call_id"), "calls")
    done, level = None, 0
    while True:
        ready = open_.join(edges.select("call_id"), "call_id", "left_anti")
        part = stored(ready.withColumn("level", F.lit(level)), "level")
        if not part.limit(1).count():
            break
        done = part if done is None else done.unionByName(part)
        open_ = stored(open_.join(part, "call_id", "left_anti"), "calls")
        edges = stored(edges.join(part.select(F.col("call_id").alias("before")), "before", "left_anti"), "edges")
        level += 1
    rest = open_.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def places(calls: DataFrame) -> DataFrame:
    """``calls`` with place: a call's number in its conversation by level (unknown last), turn and call_id, from 0."""
    block = calls.withColumns({"__level": F.coalesce("level", F.lit(2**31 - 1)), "__block": F.floor(F.coalesce("turn", F.lit(0)) / BLOCK)})
    own = ["conv_id", "__level", "__block"]
    inner = F.row_number().over(Window.partitionBy(*own).orderBy("turn", "call_id")) - 1
    before = Window.partitionBy("conv_id").orderBy("__level", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = block.groupBy(*own).count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"{c}_of") for c in own], "__start")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in own]
    joined = block.withColumn("__inner", inner).join(starts, same)
    return joined.withColumn("place", F.col("__inner") + F.col("__start")).drop("__level", "__block", "__inner", "__start", *[f"{c}_of" for c in own])


def argument_errors(arguments, rules):
    """Errors of a JSON object against ``rules`` (array of field, kind, required, low, high; null: no such tool), sorted.

    Kinds are string, integer, number, boolean, array and object; low and high bound a number, or a string's length.
    """
    given = F.from_json(arguments, "map<string,variant>")
    kind_of = {"STRING": ["string"], "BIGINT": ["integer", "number"], "DOUBLE": ["number"], "BOOLEAN": ["boolean"]}

    def fits(found, kind):
        ok = F.lit(False)
        for name, kinds in kind_of.items():
            ok = ok | ((found == name) & kind.isin(kinds))
        ok = ok | (found.startswith("DECIMAL") & (kind == "number"))
        return ok | (found.startswith("ARRAY") & (kind == "array")) | (found.startswith("OBJECT") & (kind == "object"))

    def check(rule):
        value = F.try_element_at(given, rule.field)
        found = F.schema_of_variant(value)
        plain = F.try_variant_get(value, "$", "string")
        size = F.when(rule.kind == "string", F.char_length(plain).cast("double")).otherwise(plain.try_cast("double"))
        return (
            F.when(value.isNull() | (found == "VOID"), F.when(rule.required, F.concat(F.lit("missing "), rule.field)))
            .when(~fits(found, rule.kind), F.concat(F.lit("kind of "), rule.field))
            .when((size < rule.low) | (size > rule.high), F.concat(F.lit("range of "), rule.field))
        )

    unknown = F.transform(F.array_except(F.map_keys(given), F.transform(rules, lambda r: r.field)), lambda f: F.concat(F.lit("unknown "), f))
    all_ = F.array_sort(F.array_compact(F.concat(F.transform(rules, check), unknown)))
    return F.when(given.isNull(), F.array(F.lit("no object"))).when(rules.isNull(), F.array(F.lit("no such tool"))).otherwise(all_)


def canonical(arguments):
    """JSON with sorted keys and no blanks; null if it can't be read."""
    return F.to_json(F.try_parse_json(arguments))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Linked calls, one row each: conv_id, call_id, turn, level, place, name, errors, linked, line.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends. ``results``: call_id, content. ``schemas``:
    name, field, kind, required, low, high. Calls without an id are left out; of calls that repeat an id the first by
    (conv_id, turn, name, arguments) counts, of results the least content. A call without a result has linked false and
    no "result"; results without a call are left out. ``line`` is canonical JSON: arguments (as text where they can't
    be read), call_id, depends (known ones, sorted), name, result. Empty tables give no rows.
    """
    first = F.min(F.struct("conv_id", "turn", "name", "arguments", F.coalesce("depends", F.array().cast("array<string>")).alias("depends"))).alias("c")
    calls = stored(calls.where("call_id IS NOT NULL").groupBy("call_id").agg(first).select("call_id", "c.*"), "calls")
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    rules = schemas.groupBy(F.col("name").alias("tool")).agg(F.array_sort(F.collect_list(F.struct("field", "kind", "required", "low", "high"))).alias("rules"))
    known = calls.select("call_id", F.explode("depends").alias("before")).distinct().join(calls.select(F.col("call_id").alias("before")), "before", "left_semi")
    known = known.groupBy("call_id").agg(F.array_sort(F.collect_list("before")).alias("depends"))
    ordered = places(calls.drop("depends").join(levels(calls), "call_id"))
    both = ordered.join(answers, "call_id", "left").join(known, "call_id", "left").join(rules, F.col("name") == F.col("tool"), "left")
    readable = canonical(F.col("arguments"))
    pieces = [
        F.concat(F.lit('"arguments":'), F.coalesce(readable, quoted(F.col("arguments")), F.lit("null"))),
        F.concat(F.lit('"call_id":'), quoted(F.col("call_id"))),
        F.concat(F.lit('"depends":['), F.array_join(F.transform(F.coalesce("depends", F.array().cast("array<string>")), quoted), ","), F.lit("]")),
        F.concat(F.lit('"name":'), F.coalesce(quoted(F.col("name")), F.lit("null"))),
        F.concat(F.lit('"result":'), quoted(F.col("content"))),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    return both.select("conv_id", "call_id", "turn", "level", "place", "name", argument_errors(F.col("arguments"), F.col("rules")).alias("errors"), F.coalesce("linked", F.lit(False)).alias("linked"), line.alias("line"))


def quoted(text):
    """A JSON string (null for null)."""
    inside = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2))
