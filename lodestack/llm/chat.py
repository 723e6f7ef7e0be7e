"""Chat formatting with tool-call linking, in DataFrame functions only.

Calls and results are linked by a hash join on (conversation, call id).  A call may name calls whose results
it uses; calls are ordered topologically by peeling: those that wait for nothing have depth 0, then the ones
that waited for them only, and so on.  A row is (conversation, depth, turn), so a conversation of any length
is never gathered in a task.  Arguments are parsed to variants, checked against the tool's schema field by
field, and printed as canonical JSON: keys sorted at every level, no white space.

Defined results: arguments that are null, empty or no JSON object are invalid and printed as null; an unknown tool is
invalid; a call without a result has result null and linked false; of several results of one call the earliest
(then smallest text) counts; a result before its call does not count; repeated calls of one id count once, the earliest; calls
in a cycle, or waiting for a call that does not exist or for such a one, have depth null and are invalid; null
ids link nothing; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Steps


@dataclass(frozen=True)
class Field:
    """A property of a tool's arguments: string, integer, number, boolean, array or object.

    Bounds are on a number's value, a string's length or an array's size.  `choices` lists the strings that are allowed, `items` is what
    each element of an array must be, `fields` what an object holds; further properties are allowed.
    """

    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()
    items: Field | None = None
    fields: dict[str, Field] | None = None


Schemas = dict[str, dict[str, Field]]
#: How the type of a variant's value begins, for each kind.
_SHAPES = {"string": r"STRING$", "integer": r"BIGINT$", "number": r"(BIGINT$|DOUBLE$|FLOAT$|DECIMAL)", "boolean": r"BOOLEAN$", "array": r"ARRAY<", "object": r"OBJECT<"}


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _holds(value: Column, field: Field) -> Column:
    """Whether a variant is of the field's kind and meets its bounds."""
    good = F.schema_of_variant(value).rlike("^" + _SHAPES[field.kind])
    parts = _get(value, "$", "array<variant>")
    if field.kind in ("integer", "number"):
        measure = _get(value, "$", "bigint" if field.kind == "integer" else "double")
    else:
        measure = F.size(parts) if field.kind == "array" else F.char_length(_get(value, "$", "string"))
    if field.least is not None:
        good = good & (measure >= field.least)
    if field.most is not None:
        good = good & (measure <= field.most)
    if field.choices:
        good = good & _get(value, "$", "string").isin(*field.choices)
    if field.items is not None:
        good = good & F.forall(parts, lambda v: _holds(v, field.items))
    if field.fields is not None:
        good = good & _properties(value, field.fields)
    return F.coalesce(good, F.lit(False))


def _properties(value: Column, fields: dict[str, Field]) -> Column:
    """Whether an object has the properties that it must, each as it must be."""
    out = F.lit(True)
    for name, field in sorted(fields.items()):
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        raw = _get(value, f"$['{quoted}']", "variant")
        out = out & F.when(raw.isNull(), F.lit(not field.required)).otherwise(_holds(raw, field))
    return out


def valid(arguments: Column, tool: Column, schemas: Schemas) -> Column:
    """Whether a variant is an object that meets its tool's schema (further properties are allowed)."""
    out = F.lit(False)
    for name, fields in sorted(schemas.items()):
        out = F.when(tool == name, _holds(arguments, Field("object", fields=fields))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def depths(calls: DataFrame, steps: Steps) -> DataFrame:
    """(conv_id, call_id, depth) of the calls that have one; `calls` has an array `uses` of call ids."""
    ids = calls.select("conv_id", "call_id")
    waits = steps.write(calls.select("conv_id", "call_id", F.explode("uses").alias("used")).distinct())
    done = steps.write(ids.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0)))
    level = 0
    last = done
    while waits.limit(1).count():
        level += 1
        # A wait for a call of the last level ends; who waits for nothing more is the next level.
        rest = steps.write(waits.join(last.select("conv_id", F.col("call_id").alias("used")), ["conv_id", "used"], "left_anti").select("conv_id", "call_id", "used"))
        free = waits.select("conv_id", "call_id").distinct().join(rest, ["conv_id", "call_id"], "left_anti")
        last = steps.write(free.withColumn("depth", F.lit(level)))
        if not last.limit(1).count():
            break
        steps.append(done, last)
        steps.drop(waits)
        waits = rest
    return steps.read(done)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a call: conv_id, turn, call_id, depth, valid, linked, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text), uses (array of call ids).
    results: conv_id, turn, call_id, content.
    """
    steps = Steps(calls.sparkSession, "chat")
    first = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id")
    single = steps.write(first.agg(F.min(F.struct("turn", "name", "arguments", "uses")).alias("c")).select("conv_id", "call_id", "c.*"))
    ordered = single.withColumn("uses", F.coalesce("uses", F.array().cast("array<string>")))
    order = depths(ordered, steps)
    answers = results.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", F.col("turn").alias("answer_turn"), "content")
    paired = single.select("conv_id", "call_id", "turn").join(answers, ["conv_id", "call_id"]).where("answer_turn > turn")
    best = paired.groupBy("conv_id", "call_id").agg(F.min(F.struct("answer_turn", "content")).alias("answer"))
    rows = single.join(order, ["conv_id", "call_id"], "left").join(best, ["conv_id", "call_id"], "left")
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    good = valid(parsed, F.col("name"), schemas) & F.col("depth").isNotNull()
    text = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    bare = lambda c: F.expr("null") if c is None else F.regexp_replace(F.regexp_replace(text(c), r"^\{\"v\":", ""), r"\}$", "")
    json = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.when(is_object, F.to_json(parsed)), F.lit("null")),
        F.lit(',"id":'),
        bare(F.col("call_id")),
        F.lit(',"name":'),
        bare(F.col("name")),
        F.lit(',"result":'),
        bare(F.col("answer.content")),
        F.lit("}"),
    )
    return rows.select("conv_id", "turn", "call_id", "depth", good.alias("valid"), F.col("answer").isNotNull().alias("linked"), json.alias("json"))
