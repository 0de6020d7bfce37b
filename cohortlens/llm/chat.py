"""Chat formatting: linking tool calls and their results.

Calls and results meet in a hash join on (conversation, call id), so a
conversation that holds a third of all rows spreads over its ids. A result never
comes before its call: its place is the later of the two turns, after the calls
of that turn, which orders the graph of calls and results without going through
a conversation row by row. Arguments are checked against the tool's schema, and
every row is written as canonical JSON: keys sorted at all depths, no spaces,
nulls of the envelope left out. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types a schema may ask for, and how the types of parsed values begin.
_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
          "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def argument_problem(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments (JSON text), or null.

    ``schemas``: for each tool, its arguments' types and whether they are
    required. Checked in this order: unknown tool, not a JSON object, arguments
    the tool does not have, missing ones, wrong types (each by name order; a JSON
    null counts as missing).
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    known = F.lit(False)
    out = F.lit(None).cast("string")
    for tool, args in sorted(schemas.items()):
        checks = []
        for arg, (kind, required) in sorted(args.items()):
            if not arg.isidentifier():
                raise ValueError(f"argument names are identifiers: {arg!r}")
            has = F.schema_of_variant(F.try_variant_get(value, f"$.{arg}", "variant"))
            absent = has.isNull() | (has == "VOID")
            right = F.lit(False)
            for k in _KINDS[kind]:
                right = right | has.startswith(k)
            if required:
                checks.append(F.when(absent, F.lit(f"missing {arg}")))
            checks.append(F.when(~absent & ~right, F.lit(f"wrong type {arg}")))
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(a) for a in args]).cast("array<string>")))
        mine = F.coalesce(F.when(F.size(extra) > 0, F.concat(F.lit("unknown argument "), F.element_at(extra, 1))), *checks,
                          F.lit(None).cast("string"))
        out = F.when(name == tool, F.when(is_object, mine).otherwise("not an object")).otherwise(out)
        known = known | name.eqNullSafe(tool)
    return F.when(known, out).otherwise("unknown tool")


def canonical_json(**fields: Column) -> Column:
    """An object of the given fields, keys sorted, nulls left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def link_tools(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each call and result, ordered in a conversation by
    (at_turn, step, call_id, json): conv_id, at_turn long, step int (0 call, 1
    result), kind, call_id, name, problem, json.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text). ``results``:
    conv_id, call_id, turn, content. Other columns are ignored; equal rows count
    once. Of different calls with one id in a conversation the first (by turn,
    name, arguments) takes the results, the others have the problem ``duplicate id``.
    Calls without result and results without call, and those whose ids are null,
    say so. Empty tables give no rows.
    """
    c = calls.select(F.col("conv_id"), F.col("call_id"), F.col("turn").cast("long").alias("turn"), "name", "arguments").distinct()
    r = results.select(F.col("conv_id"), F.col("call_id"), F.col("turn").cast("long").alias("turn"), "content").distinct()
    key = ["conv_id", "call_id"]
    first = c.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments")).alias("first"))
    answered = r.groupBy(*key).agg(F.lit(True).alias("answered"))
    linked = (c.join(first, key, "left").join(answered, key, "left")
              .withColumn("own", F.struct("turn", "name", "arguments").eqNullSafe(F.col("first"))))
    value = F.try_parse_json("arguments")
    wrong = argument_problem(F.col("name"), F.col("arguments"), schemas)
    problem = (F.when(F.col("call_id").isNull(), "no id").when(~F.col("own"), "duplicate id")
               .otherwise(F.coalesce(wrong, F.when(F.col("answered").isNull(), "no result"))))
    envelope = {"id": F.col("call_id"), "name": F.col("name"), "type": F.lit("tool_call")}
    calls_out = linked.select(
        "conv_id", F.col("turn").alias("at_turn"), F.lit(0).alias("step"), F.lit("call").alias("kind"), "call_id", "name",
        problem.alias("problem"),
        F.when(value.isNotNull(), canonical_json(arguments=value, **envelope))
        .otherwise(canonical_json(arguments=F.col("arguments"), **envelope)).alias("json"))
    results_out = r.join(first, key, "left").select(
        "conv_id", F.greatest("turn", F.col("first.turn")).alias("at_turn"), F.lit(1).alias("step"), F.lit("result").alias("kind"),
        "call_id", F.col("first.name").alias("name"), F.when(F.col("first").isNull(), "no call").alias("problem"),
        canonical_json(content=F.col("content"), id=F.col("call_id"), type=F.lit("tool_result")).alias("json"))
    return calls_out.unionByName(results_out)
