"""Chat formatting with tool-call linking, on DataFrame functions alone.

An assistant's message holds calls as `<tool_call>{"id", "name", "arguments", "after"}</tool_call>`, where `after`
lists calls whose results the call needs; a message of role `tool` holds `{"tool_call_id", "content"}`. Calls and
results are joined by conversation and identifier, calls are ordered topologically by `after`, arguments are checked
against schemas, and each message becomes one line of canonical JSON: sorted keys, no blanks outside strings.

A conversation is never gathered: every message is a row, and its place is (turn, level of its calls). A conversation
of any length, or a text that many share, is many rows under many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialise, table

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
CALL_SCHEMA = "id string, name string, arguments string, after array<string>"
RESULT_SCHEMA = "tool_call_id string, content string"
#: Schemas of tools: parameter to (type, required). Types are those of JSON.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}
# What a variant's type is called in JSON schemas.
VARIANT_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def argument_error(name: Column, arguments: Column, tools=None) -> Column:
    """What is wrong with a call's arguments: unknown tool, no object, or the first parameter missing, unknown or of another type; null if nothing."""
    tools = TOOLS if tools is None else tools
    parsed = F.try_parse_json(arguments)
    error = F.lit("unknown tool")
    for tool, parameters in sorted(tools.items()):
        faults = []
        for key, (kind, required) in sorted(parameters.items()):
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            missing = F.when(value.isNull(), f"missing: {key}") if required else F.lit(None).cast("string")
            wrong = F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(VARIANT_TYPES[kind]), f"type: {key}")
            faults.append(F.coalesce(missing, wrong))
        keys = F.json_object_keys(arguments)
        unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(parameters))) if parameters else F.array().cast("array<string>")))
        faults.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.get(unknown, 0))))
        error = F.when(name == tool, F.when(F.schema_of_variant(parsed).rlike("^OBJECT"), F.coalesce(*faults)).otherwise("no object")).otherwise(error)
    return error


def calls_of(messages: DataFrame) -> DataFrame:
    """The calls of assistant messages: conv, turn, message, place, id, name, arguments, after; malformed JSON gives a null id."""
    found = messages.where((F.col("role") == "assistant") & F.col("text").contains("<tool_call>"))
    exploded = found.select("conv", "turn", "message", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("place", "json"))
    return exploded.withColumn("c", F.from_json("json", CALL_SCHEMA)).select("conv", "turn", "message", "place", "c.id", "c.name", "c.arguments", F.array_distinct(F.coalesce("c.after", F.array().cast("array<string>"))).alias("after")).distinct()


def chain_ends(arcs: DataFrame) -> DataFrame:
    """(conv, id, end, steps) of each call that waits for exactly one other: the first call up its chain that waits for none
    or for several, and how many steps it is away. Pointers double each round; those that go round a cycle are left out.
    """
    single = materialise(arcs.groupBy("conv", "id").agg(F.min("before").alias("end"), F.count(F.lit(1)).alias("n")).where("n = 1").select("conv", "id", "end", F.lit(1).cast("long").alias("steps")))
    pointers, rounds = single, single.count().bit_length()
    for _ in range(rounds):
        further = pointers.select("conv", F.col("id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"))
        joined = pointers.join(further, ["conv", "end"], "left")
        pointers = materialise(joined.select("conv", "id", F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        if not pointers.where("moved").take(1):
            break
    return pointers.join(single.select("conv", F.col("id").alias("end")), ["conv", "end"], "left_anti").select("conv", "id", "end", "steps")


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of each identified call: 0 without known predecessors, else one more than the highest of them.

    Chains in which each call waits for one other take a logarithmic number of rounds. Calls that wait for several take a
    round for each such call on the longest path. Calls on a cycle, or behind one, get no level.
    """
    known = calls.where("id is not null").groupBy("conv", "id").agg(F.min_by("after", F.struct("turn", "place")).alias("after"))
    arcs = known.select("conv", "id", F.explode("after").alias("before")).join(known.select("conv", F.col("id").alias("before")), ["conv", "before"], "left_semi")
    arcs = materialise(arcs.select("conv", "id", "before"))
    levels = known.join(arcs, ["conv", "id"], "left_anti").select("conv", "id", F.lit(0).cast("long").alias("level"))
    if not arcs.take(1):
        return levels
    ends = materialise(chain_ends(arcs))
    several = arcs.groupBy("conv", "id").count().where("count > 1").select("conv", "id")
    # What each of them waits for, as the end of its chain and the steps from there.
    upward = arcs.join(several, ["conv", "id"], "left_semi").join(ends.select("conv", F.col("id").alias("before"), "end", "steps"), ["conv", "before"], "left")
    waiting = materialise(upward.select("conv", "id", F.coalesce("end", "before").alias("end"), F.coalesce("steps", F.lit(0)).alias("steps")))
    levels = materialise(levels)
    while waiting.take(1):
        placed = waiting.join(levels.select("conv", F.col("id").alias("end"), "level"), ["conv", "end"], "left")
        ready = placed.groupBy("conv", "id").agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count("level").alias("n"), F.count(F.lit(1)).alias("all")).where("n = all")
        ready = materialise(ready.select("conv", "id", (F.col("level") + 1).alias("level")))
        if not ready.take(1):
            break
        levels = levels.union(ready)
        waiting = materialise(waiting.join(ready, ["conv", "id"], "left_anti"))
    on_chains = ends.join(levels.select("conv", F.col("id").alias("end"), "level"), ["conv", "end"]).select("conv", "id", F.col("level") + F.col("steps"))
    return levels.union(on_chains)


def _canonical(json: Column) -> Column:
    """JSON text as a variant, whose objects have their keys in order; text that is no JSON as a string."""
    return F.coalesce(F.try_parse_json(json), F.variant_get(F.parse_json(F.to_json(F.array(json))), "$[0]", "variant"))


def format_messages(messages: DataFrame, tools=None) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_invalid, level and message (canonical JSON) of every row.

    The JSON has sorted keys and no blanks outside strings: content (without the text's call blocks), role, tool_calls if
    there are any, in topological order, and turn. A call has its arguments as an object with sorted keys, what is wrong
    with them, its id and name, and its result with the turn; the result's own message stays as it is.

    A call is linked if a result with its identifier stands at a later turn of its conversation; of several results
    the first counts, and a repeated identifier's calls share it. Rows with a null conv_id are one conversation; a null turn
    is neither earlier nor later. `level` is the highest of the message's calls, null without calls or on a cycle. A null
    text is written as null; rows with equal values stay separate; an empty table gives no rows. Other columns are ignored.
    """
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    messages = messages.select("conv_id", "turn", "role", "text").withColumns({"message": F.xxhash64("role", "text"), "conv": conv})
    has_calls = F.coalesce((F.col("role") == "assistant") & F.col("text").contains("<tool_call>"), F.lit(False))
    zero = F.lit(0).cast("long")

    def written(rows: DataFrame, content: Column, *calls: Column) -> DataFrame:
        json = F.to_json(F.struct(content.alias("content"), F.col("role"), *calls, F.col("turn")), {"ignoreNullFields": "false"})
        numbers = [F.coalesce(F.col(c), zero).alias(c) if c in rows.columns else zero.alias(c) for c in ("n_calls", "n_linked", "n_invalid")]
        level = F.col("level") if "level" in rows.columns else F.lit(None)
        return rows.select("conv_id", "turn", "role", *numbers, level.cast("int").alias("level"), json.alias("message"))

    plain = written(messages.where(~has_calls), F.col("text"))
    calls = materialise(calls_of(messages))
    if not calls.take(1):
        return plain.unionByName(written(messages.where(has_calls), F.col("text")))
    results = messages.where("role = 'tool'").select("conv", F.col("turn").alias("result_turn"), F.from_json("text", RESULT_SCHEMA).alias("r"))
    results = results.select("conv", "result_turn", F.col("r.tool_call_id").alias("id"), F.col("r.content").alias("result")).where("id is not null")
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min("turn").alias("call_turn"))
    matched = first.join(results, ["conv", "id"]).where("result_turn > call_turn").groupBy("conv", "id").agg(F.min(F.struct("result_turn", "result")).alias("first"))
    linked = calls.join(matched, ["conv", "id"], "left").join(call_levels(calls), ["conv", "id"], "left")
    checked = linked.withColumn("error", argument_error(F.col("name"), F.col("arguments"), tools))
    call = F.struct("arguments", "error", "id", "name", F.col("first.result").alias("result"), F.col("first.result_turn").alias("result_turn"))
    # A message's own calls: as many as its text holds.
    grouped = checked.groupBy("conv", "turn", "message").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 40)).alias("level"), "place", call.alias("call")))).alias("calls"),
        F.count(F.lit(1)).alias("n_calls"),
        F.count("first").alias("n_linked"),
        F.count("error").alias("n_invalid"),
        F.when(F.count("level") == F.count(F.lit(1)), F.max("level")).alias("level"),
    )
    own = messages.where(has_calls)
    same = (own["conv"] == grouped["conv"]) & (own["turn"].eqNullSafe(grouped["turn"])) & (own["message"] == grouped["message"])
    joined = own.join(grouped, same, "left").select(own["conv_id"], own["turn"], "role", "text", "calls", "n_calls", "n_linked", "n_invalid", "level")
    in_order = F.transform("calls", lambda c: c["call"].withField("arguments", _canonical(c["call"]["arguments"])))
    with_calls = F.col("calls").isNotNull()
    return plain.unionByName(written(joined.where(~with_calls), F.col("text"))).unionByName(written(joined.where(with_calls), F.regexp_replace("text", CALL, ""), in_order.alias("tool_calls")))


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """Every row of `conversations` as canonical JSON with its tool calls linked."""
    return format_messages(table(spark, sf_dir, "conversations"))
