"""Tool-call linking for chat data, in DataFrame functions alone.

Results are joined to calls by identifier, calls are put in layers so that each comes after all that it depends on, arguments
are validated against the tools' parameters, and each call becomes one canonical JSON object (keys in order, no spaces).
(layer, turn, call_id) is a topological order of a conversation's calls; no conversation meets in one task for it.

Tables: calls (conv_id, turn, call_id, name, arguments, depends_on: array of call ids), results (conv_id, turn, call_id,
content), parameters (name, parameter, type, required, and allowed if there are any: an array of the values it may have, as strings; a
tool without parameters has one row with a null parameter). A dot in a parameter's name means a field of an object; an argument whose
own name has a dot is another one and unknown. Of rows that repeat a parameter the least by type, required and allowed counts.

Defined results: a null conv_id is a conversation of its own; a call with a null call_id is linked with nothing; of several calls of
one id the first (by turn, then arguments) is linked, the others have status ``repeated``; of several results the first counts;
results without a call come back with status ``orphan``; a dependency on no call of the conversation is a problem and
otherwise ignored; calls on or behind a cycle have a null layer and status ``cyclic``; null, empty or broken arguments and
unknown tools are problems; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.llm.scratch import cut

#: Rows of the parameters table up to which it is broadcast.
BROADCAST_PARAMETERS = 10_000
#: Edges up to which calls that depend on several others are jumped over.
FAN = 4
KEY = ["_conv", "call_id"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))


def layers(calls: DataFrame) -> DataFrame:
    """_conv, call_id, layer (longest way from a call without dependencies) of all calls that are on or behind no cycle.

    An edge says that a call lies at least ``w`` layers behind its parent; the parent of a call without dependencies is null, the ground.
    In each round an edge goes on to its parent's parents, with the weights added, if the parent has one of them, or both
    ends have at most ``FAN`` edges; of equal edges the heaviest stays. So ways of up to ``FAN`` calls side by side halve in
    each round, and a call has its layer when its only edge is to the ground. Wider tangles settle at least a layer a
    round. A round that settles nothing leaves cycles alone.
    """
    known = calls.select(*KEY)
    edges = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("parent"))
    edges = edges.join(known.withColumnRenamed("call_id", "parent"), ["_conv", "parent"], "left_semi").select(*KEY, "parent")
    ground = known.join(edges, KEY, "left_anti").select(*KEY, F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("w"))
    counted = lambda rows: cut(rows.withColumn("n", F.count("*").over(Window.partitionBy(*KEY))), "edges")
    edges, placed = counted(edges.withColumn("w", F.lit(1).cast("long")).unionByName(ground)), -1
    while True:
        done = edges.filter("n = 1 and parent is null")
        n = done.count()
        if n == placed:
            return done.select(*KEY, F.col("w").cast("int").alias("layer"))
        placed = n
        way = edges.filter(F.col("n") <= FAN).select(F.col("_conv").alias("conv"), F.col("call_id").alias("through"), F.col("parent").alias("next"), F.col("w").alias("more"), F.col("n").alias("fan"))
        moved = edges.join(way, (F.col("_conv") == F.col("conv")) & (F.col("parent") == F.col("through")) & ((F.col("fan") == 1) | (F.col("n") <= FAN)), "left")
        weight = F.least(F.col("w") + F.coalesce("more", F.lit(0)), F.lit(1 << 40))  # on a cycle it would grow for ever
        moved = moved.select(*KEY, F.when(F.col("more").isNull(), F.col("parent")).otherwise(F.col("next")).alias("parent"), weight.alias("w"))
        edges = counted(moved.groupBy(*KEY, "parent").agg(F.max("w").alias("w")))


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "STRING", "string").when(schema == "BIGINT", "integer").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null")
        .when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("number")
    )


def _fields(value: Column) -> Column:
    """The fields of an object as a map; null if it is none."""
    return F.try_variant_get(value, F.lit("$"), "map<string,variant>")


def _at(parsed: Column, path: Column) -> Column:
    """The value at a path, an array of keys."""
    return F.aggregate(path, parsed, lambda value, key: F.try_element_at(_fields(value), key))


def _problems(parsed: Column, tool: Column) -> Column:
    """What is wrong with the arguments, in order of code points. tool: its parameters by path."""
    say = lambda text, paths: F.transform(paths, lambda k: F.concat(F.lit(text), F.array_join(k, ".")))
    none = F.array().cast("array<array<string>>")
    inside = lambda path: F.transform(F.map_keys(_fields(_at(parsed, path))), lambda k: F.concat(path, F.array(k)))
    above = lambda k: F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0)))
    wanted = F.map_keys(tool)
    inner = F.array_distinct(F.filter(F.transform(wanted, above), lambda p: F.size(p) > 0))
    nested = F.flatten(F.transform(inner, lambda p: F.coalesce(inside(p), none)))
    given = F.concat(F.transform(F.map_keys(_fields(parsed)), lambda k: F.array(k)), F.coalesce(nested, none))
    rule = lambda k: F.element_at(tool, k)
    both = F.array_intersect(given, wanted)
    missing = F.filter(wanted, lambda k: rule(k)["required"] & ~F.array_contains(given, k) & ((F.size(k) == 1) | F.array_contains(given, above(k))))
    wrong = F.filter(both, lambda k: (rule(k)["type"] != _kind(_at(parsed, k))) & ~((rule(k)["type"] == "number") & (_kind(_at(parsed, k)) == "integer")))
    outside = F.filter(both, lambda k: ~F.array_contains(rule(k)["allowed"], _at(parsed, k).cast("string")))
    found = F.concat(say("missing ", missing), say("unknown ", F.array_except(given, wanted)), say("wrong type ", wrong), say("not allowed ", outside))
    return F.when(tool.isNull(), F.array(F.lit("unknown tool"))).when(_fields(parsed).isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(found))


def link_tool_calls(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, name, layer, result_turn, status, problems, json: one row per call and orphaned result.

    status: linked, pending (no result), repeated, cyclic, orphan.
    """
    nth = Window.partitionBy(*KEY).orderBy("turn", "arguments")
    calls = _keyed(calls).select("_conv", "conv_id", "turn", "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    calls = calls.filter("call_id is not null").withColumn("_nth", F.row_number().over(nth)).unionByName(calls.filter("call_id is null").withColumn("_nth", F.lit(1)))
    calls = cut(calls, "calls")
    first = calls.filter("_nth = 1 and call_id is not null")
    found = _keyed(results).filter("call_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("result"), F.first("conv_id").alias("conv_id"))
    orphans = found.join(first.select(*KEY), KEY, "left_anti")

    known = first.select("_conv", F.col("call_id").alias("dep"))
    absent = first.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("dep")).join(known, ["_conv", "dep"], "left_anti")
    absent = absent.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.concat(F.lit("unknown dependency "), "dep"))).alias("absent"))
    if "allowed" not in parameters.columns:
        parameters = parameters.withColumn("allowed", F.lit(None).cast("array<string>"))
    rules = parameters.groupBy("name", "parameter").agg(F.min(F.struct("type", "required", "allowed")).alias("rule"))
    entry = F.struct(F.split("parameter", "[.]", -1).alias("path"), "rule")
    tools = rules.groupBy("name").agg(F.map_from_entries(F.collect_list(F.when(F.col("parameter").isNotNull(), entry))).alias("tool"))
    tools = F.broadcast(tools) if parameters.count() <= BROADCAST_PARAMETERS else tools

    linked = first.join(layers(first), KEY, "left").join(found.select(*KEY, "result"), KEY, "left").join(absent, KEY, "left")
    others = calls.filter("_nth > 1 or call_id is null")
    for name in ("layer", "result", "absent"):
        others = others.withColumn(name, F.lit(None).cast(linked.schema[name].dataType))
    rows = linked.unionByName(others).join(tools, "name", "left")
    rows = rows.withColumn("parsed", F.try_parse_json("arguments"))
    status = F.when(F.col("_nth") > 1, "repeated").when(F.col("layer").isNull() & F.col("call_id").isNotNull(), "cyclic").when(F.col("result").isNull(), "pending").otherwise("linked")
    problems = F.concat(_problems(F.col("parsed"), F.col("tool")), F.coalesce("absent", F.array().cast("array<string>")))
    body = F.to_json(F.struct("parsed", "call_id", "conv_id", F.array_sort(F.array_distinct("depends_on")).alias("depends_on"), "name", F.col("result.content").alias("result"), "turn").alias("x"), {"ignoreNullFields": "false"})
    rows = rows.select("conv_id", "turn", "call_id", "name", "layer", F.col("result.turn").alias("result_turn"), status.alias("status"), problems.alias("problems"), F.regexp_replace(body, r'^\{"parsed":', '{"arguments":').alias("json"))
    orphans = orphans.select("conv_id", F.lit(None).cast(calls.schema["turn"].dataType).alias("turn"), "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("layer"),
        F.col("result.turn").alias("result_turn"), F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("problems"),
        F.to_json(F.struct("call_id", "conv_id", F.col("result.content").alias("result")), {"ignoreNullFields": "false"}).alias("json"))
    return rows.unionByName(orphans)


#: Parameters of the tools that ``calls_in`` derives.
TOOLS = [("search", "text", "string", True), ("search", "limit", "integer", True), ("lookup", "text", "string", True), ("lookup", "limit", "integer", False), ("lookup", "strict", "boolean", False), ("translate", "text", "string", True), ("translate", "lang", "string", True)]


def calls_in(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and parameters that chat turns stand for.

    A user's turn calls the tool that its number chooses, with the text as argument; its limit is a string instead of a
    number if the text's length is divisible by 7. The k-th such turn depends on the one numbered (k - 1) div 2. An
    assistant's turn is the result of the turn before it.
    """
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    turn = F.col("turn")
    k = F.floor(turn / 2)
    limit = F.when(F.length("text") % 7 == 0, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(turn.cast("string"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    arguments = F.concat(F.lit('{"text": '), quoted, F.lit(', "limit": '), limit, F.lit("}"))
    parent = F.floor((k - 1) / 2) * 2 + turn % 2
    calls = conversations.filter("role = 'user'").select("conv_id", "turn", name(turn).alias("call_id"), F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("translate")), (turn % 3 + 1).cast("int")).alias("name"),
        arguments.alias("arguments"), F.when(k >= 1, F.array(name(parent))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    rows = ", ".join(f"('{tool}', '{parameter}', '{kind}', {str(required).lower()})" for tool, parameter, kind, required in TOOLS)
    parameters = conversations.sparkSession.sql(f"select * from values {rows} as t(name, parameter, type, required)")
    return calls, results, parameters
