"""Chat formatting by tool-call linking.

Calls and results meet in a hash join on the call's identifier; calls are ordered topologically along
the calls they come after; arguments are validated against a schema for each tool; each pair becomes
one canonical JSON text: keys in order, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, materialize, read

#: Schemas (a subset of JSON Schema) of the tools that the query knows.
SCHEMAS = {"reply": {"properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 4000}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}}
#: How JSON types show in the type of a variant.
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$", "null": "^VOID$"}


def faults(arguments: Column, schema: dict) -> list[Column]:
    """A column for each check of a schema: a message, or null where it holds. ``arguments``: a variant."""
    known, out = schema.get("properties", {}), []
    at = lambda name, kind: F.try_variant_get(arguments, f"$['{name}']", kind)
    kind_of = lambda name: F.schema_of_variant(at(name, "variant"))
    for name in sorted(schema.get("required", [])):
        out.append(F.when(at(name, "variant").isNull(), f"{name}: missing"))
    for name in sorted(known):
        rule, there = known[name], at(name, "variant").isNotNull()
        if "type" in rule:
            out.append(F.when(there & ~kind_of(name).rlike(KINDS[rule["type"]]), f"{name}: not {rule['type']}"))
        if "enum" in rule:
            out.append(F.when(there & ~at(name, "string").isin(*map(str, rule["enum"])), f"{name}: not in enum"))
        for key, value, sign, say in (("minLength", F.length(at(name, "string")), 1, "too short"), ("maxLength", F.length(at(name, "string")), -1, "too long"), ("minimum", at(name, "double"), 1, "too small"), ("maximum", at(name, "double"), -1, "too large")):
            if key in rule:
                fits = there & kind_of(name).rlike(KINDS["string"] if "Length" in key else KINDS["number"])
                out.append(F.when(fits & ((value < rule[key]) if sign > 0 else (value > rule[key])), f"{name}: {say}"))
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(arguments)), F.array(*[F.lit(k) for k in sorted(known)])))
        out.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(extra, ", "))))
    return out


def validate(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """The faults of a call's JSON arguments, in the order of the checks, joined by ``; `` (empty: valid)."""
    parsed = F.try_parse_json(arguments)
    result = F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool"))
    result = result.when(parsed.isNull() | ~F.schema_of_variant(parsed).rlike(KINDS["object"]), F.lit("arguments: not an object"))
    for tool in sorted(schemas):
        result = result.when(name == tool, F.array_join(F.array_compact(F.array(*faults(parsed, schemas[tool]))), "; "))
    return result


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, level) of distinct ``calls`` (call_id): the calls on the longest way that leads to it; null in and behind a cycle.

    ``edges`` (call_id, after): what each comes after; one that names no call doesn't count. Calls that come after
    exactly one other are chains: pointers double, so a chain of n calls takes log2(n) joins on unique identifiers.
    Calls that come after several are then placed, once all that is before them is, in as many rounds as
    there are such calls on one way. No conversation is gathered anywhere.
    """
    first = len(WRITTEN)
    calls = materialize(calls.filter("call_id IS NOT NULL").select("call_id"))
    known = calls.select(F.col("call_id").alias("after"))
    edges = materialize(edges.select("call_id", "after").distinct().join(known, "after", "left_semi").select("call_id", "after"))
    before = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("after").alias("after"))
    one = F.coalesce("n", F.lit(0)) == 1
    # of each call the nearest one up its chain that comes after none or several, and how far that is
    state = materialize(calls.join(before, "call_id", "left").select("call_id", F.when(one, F.col("after")).otherwise(F.col("call_id")).alias("top"), one.cast("long").alias("far"), F.coalesce("n", F.lit(0)).alias("n")))
    ends = materialize(state.filter("n <> 1").select(F.col("call_id").alias("top"), "n"))
    for _ in range(max(1, int(calls.count()).bit_length() + 1)):
        if state.join(ends, "top", "left_anti").isEmpty():
            break
        next_ = state.select(F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("far").alias("more"))
        state = materialize(state.join(next_, "top").select("call_id", F.col("next").alias("top"), (F.col("far") + F.col("more")).alias("far"), "n"))
    placed = materialize(ends.filter("n = 0").select("top", F.lit(0).cast("long").alias("level")))
    several = state.filter("n > 1").select("call_id")
    if not several.isEmpty():
        of = state.select(F.col("call_id").alias("after"), "top", "far")
        steps = materialize(edges.join(several, "call_id", "left_semi").join(of, "after").select("call_id", "top", (F.col("far") + 1).alias("far")))
        while True:
            open_ = steps.join(placed.select(F.col("top").alias("call_id")), "call_id", "left_anti")
            ready = open_.join(placed, "top", "left").groupBy("call_id").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
            new = materialize(ready.filter("open = 0").select(F.col("call_id").alias("top"), "level"))
            if new.isEmpty():
                break
            placed = materialize(placed.union(new))
    found = materialize(state.join(placed, "top", "left").select("call_id", (F.col("level") + F.col("far")).alias("level")))
    discard(calls.sparkSession, WRITTEN[first:-1])
    return found


def marked(rows: DataFrame, order: list[str], count: str) -> DataFrame:
    """Add ``key``, which names conversation and call_id on the row that stands for both, and is null on all others.

    Of rows with the same key that of least ``order`` stands and has their number as ``count``; others have 1.
    """
    key = F.when(F.col("call_id").isNotNull(), F.to_json(F.struct("conv_id", "call_id")))
    own = materialize(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("key", key))
    first = own.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(*order, "uid")).alias("c"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.select(F.col("c.uid").alias("stands"), "n"))
    key = F.when(F.col("stands").isNotNull(), F.col("key"))
    return own.join(first, F.col("uid") == F.col("stands"), "left").select(*rows.columns, key.alias("key"), F.coalesce("n", F.lit(1)).alias(count))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Links ``calls`` (conv_id, turn, call_id, name, arguments, after) and ``results`` (conv_id, turn, call_id, content).

    Identifiers hold within a conversation; rows of null conv_id are one conversation. Each call and each
    result is in exactly one row. status: ``linked``, ``pending`` (no result) or ``orphan`` (no call).
    after: a call's identifier, or a JSON array of several. level: place in the topological order of the conversation,
    see ``levels``, null for orphans and cycles. valid and errors: arguments against the tool's schema. message: the
    canonical JSON; content that is a JSON object or array stands in it as such, with its keys in order, any other as a string. Repeated identifiers: the
    call and the result of least turn, then text, link, with the numbers of all in n_calls and n_results;
    every other one, and each without identifier, is pending or orphan in a row of its own, without level.
    Empty tables give no rows.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")  # no other column can clash
    results = results.select("conv_id", "turn", "call_id", "content")
    calls = marked(calls, ["turn", "name", "arguments", "after"], "n_calls").withColumnRenamed("turn", "call_turn")
    results = marked(results, ["turn", "content"], "n_results")
    results = results.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("turn").alias("result_turn"), "content", F.col("key").alias("r_key"), "n_results")
    standing = calls.filter("key IS NOT NULL")
    several = F.when(F.startswith(F.ltrim("after"), F.lit("[")), F.from_json("after", "ARRAY<STRING>"))
    each = standing.filter("after IS NOT NULL").select("conv_id", F.col("key").alias("call_id"), F.explode(F.coalesce(several, F.array("after"))).alias("before"))
    order = levels(standing.select(F.col("key").alias("call_id")), each.filter("before IS NOT NULL").select("call_id", F.to_json(F.struct("conv_id", F.col("before").alias("call_id"))).alias("after")))
    placed = standing.join(order.withColumnRenamed("call_id", "o_key"), F.col("key") == F.col("o_key"), "left").drop("o_key")
    both = placed.join(results.filter("r_key IS NOT NULL"), F.col("key") == F.col("r_key"), "full")
    for others in (calls.filter("key IS NULL"), results.filter("r_key IS NULL")):
        both = both.unionByName(others, allowMissingColumns=True)
    errors = F.when(F.col("n_calls").isNotNull(), validate(F.col("name"), F.col("arguments"), schemas))
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    out = both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_id").alias("call_id"), "call_turn", "result_turn", "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"), (errors == "").alias("valid"), errors.alias("errors"),
        F.col("name"), arguments.alias("arguments"), "content",
    )
    inner = lambda key, c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias(key))), r"(?s)^\{(.*)\}$", 1)
    part = lambda key, c: F.when(F.col(c).isNotNull(), inner(key, c))
    call = F.when(F.col("n_calls") > 0, F.concat(F.lit('"call":{"arguments":'), "arguments", F.lit(","), F.concat_ws(",", part("id", "call_id"), part("name", "name")), F.lit("}")))
    value = F.try_parse_json("content")
    nested = F.schema_of_variant(value).rlike(f"{KINDS['object']}|{KINDS['array']}")
    content = F.when(F.coalesce(nested, F.lit(False)), F.concat(F.lit('"content":'), F.to_json(value))).otherwise(part("content", "content"))
    result = F.when(F.col("n_results") > 0, F.concat(F.lit('"result":{'), F.concat_ws(",", content, part("id", "call_id")), F.lit("}")))
    return out.withColumn("message", F.concat(F.lit("{"), F.concat_ws(",", call, result), F.lit("}"))).drop("name", "arguments", "content")


def explicit(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages that carry them as JSON.

    Assistant: ``{"tool_calls": [{"id", "name", "arguments": {...}, "after"}]}``, ``after`` being an identifier or a list of
    them; tool: ``{"tool_call_id", "content"}``. A tool's text of another form is the content of a result without
    identifier. Other texts hold none.
    """
    item = "STRUCT<id: STRING, name: STRING, arguments: STRING, after: STRING>"
    parsed = messages.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", f"STRUCT<tool_calls: ARRAY<{item}>>")["tool_calls"]).alias("c"))
    calls = parsed.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    results = messages.filter("role = 'tool'").withColumn("r", F.from_json("text", "STRUCT<tool_call_id: STRING, content: STRING>"))
    plain = F.col("r.tool_call_id").isNull() & F.col("r.content").isNull()
    return calls, results.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.when(plain, F.col("text")).otherwise(F.col("r.content")).alias("content"))


def of_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain dialogue: a user turn calls ``reply``, the assistant turn behind it is the result.

    A call's identifier is ``conversation/turn``; it comes after the user turn two before. System and
    other turns are neither, nor are messages that carry calls of their own.
    """
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = messages.filter("role = 'user'").select("conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), name(2).alias("after"))
    said = messages.filter("role = 'assistant'").filter(F.from_json("text", "STRUCT<tool_calls: ARRAY<STRING>>")["tool_calls"].isNull())
    return calls, said.select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))


def op9_toolcalls(spark, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    plain, said = of_turns(messages), explicit(messages)
    return link(plain[0].union(said[0]), plain[1].union(said[1])).select("conv_id", "call_id", "call_turn", "result_turn", "level", "status", "valid", "errors", "message")


OP9_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || '/' || turn AS id, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id || '/' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant'),
lv AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
       UNION ALL SELECT c.conv_id, c.turn, level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2),
e AS (SELECT c.*, level, concat_ws('; ', CASE WHEN text IS NULL THEN 'prompt: missing' END, CASE WHEN length(text) < 1 THEN 'prompt: too short' END,
      CASE WHEN length(text) > 4000 THEN 'prompt: too long' END, CASE WHEN c.turn < 0 THEN 'turn: too small' END) AS errors
      FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.turn = lv.turn)
SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.id, r.id) AS call_id, e.turn AS call_turn, r.turn AS result_turn, CAST(level AS BIGINT) AS level,
       CASE WHEN e.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'pending' ELSE 'linked' END AS status, errors = '' AS valid, errors,
       '{' || concat_ws(',', CASE WHEN e.id IS NOT NULL THEN '"call":{"arguments":' || CAST(json_object('prompt', e.text, 'turn', e.turn) AS VARCHAR) || ',"id":"' || e.id || '","name":"reply"}' END,
             CASE WHEN r.id IS NOT NULL THEN '"result":{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"id":"' || r.id || '"}' END) || '}' AS message
FROM e FULL JOIN r ON e.id = r.id
"""
