"""Chat formatting with tool calls, in DataFrame functions only.

Results are joined to the calls they answer by identifier, all messages get a place that puts
each result after its call and each call after the call it depends on, arguments are checked
against the tool's schema, and every message is written as canonical JSON: keys sorted at
every depth, no spaces.
"""

from pyspark.sql import functions as F

from cdclake.llm.common import checkpointed

# Types of a schema and the variant types that satisfy them. Numbers beyond 64 bits and those
# with decimal places are decimals, those with an exponent or over 38 digits doubles.
ACCEPTS = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"],
           "number": ["BIGINT", "DECIMAL", "DOUBLE"], "array": ["ARRAY"], "object": ["OBJECT"]}


def canonical(json):
    """The same JSON value with sorted keys and no spaces; NULL for text that is no JSON."""
    return F.to_json(F.try_parse_json(json))


def problems(name, arguments, schemas):
    """Array of what is wrong with a call's arguments, sorted; empty for a valid call.

    `schemas` is {tool: {"properties": {parameter: type}, "required": [parameter]}}; a
    parameter that it does not list is a problem, and so are arguments that are no object.
    An integer is a number without decimal places (1.0 has none) or exponent, of any length.
    """
    parsed = F.try_parse_json(arguments)
    kind = F.regexp_extract(F.schema_of_variant(parsed), "^[A-Z]+", 0)
    found = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        tests = []
        for parameter, wanted in sorted(schema["properties"].items()):
            path = f"$['{parameter}']"
            typed = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
            own = F.regexp_extract(typed, "^[A-Z]+", 0)
            missing = own.isNull() | (own == "VOID")
            fits = own.isin(ACCEPTS[wanted])
            if wanted == "integer":
                whole = F.get_json_object(arguments, path).rlike("^-?[0-9]+$")
                fits = (fits | typed.rlike("^DECIMAL[(][0-9]+,0[)]$")
                        | ((own == "DOUBLE") & F.coalesce(whole, F.lit(False))))
            if parameter in schema["required"]:
                tests.append(F.when(missing, F.lit(f"{parameter}: missing")))
            tests.append(F.when(~missing & ~fits, F.lit(f"{parameter}: not {wanted}")))
        keys = F.json_object_keys(F.to_json(parsed))
        extra = F.transform(F.array_except(keys, F.lit(list(schema["properties"]))),
                            lambda k: F.concat(k, F.lit(": unknown")))
        listed = F.array_sort(F.concat(
            F.filter(F.array(*tests), lambda t: t.isNotNull()), F.coalesce(
                extra, F.array().cast("array<string>"))))
        found = F.when(name == tool, listed).otherwise(found)
    return F.when(F.coalesce(kind, F.lit("")) != "OBJECT", F.array(F.lit("not an object"))) \
        .otherwise(found)


def depths(calls):
    """(conv_id, call_id, depth) of calls with `after`, the call each depends on or NULL:
    the number of calls before it, -1 for calls on or behind a cycle.

    Each round doubles the distance looked back, so the rounds grow with the logarithm of
    the longest chain. A call that depends on one that is not there depends on none.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after"))
    linked = calls.where("after IS NOT NULL").select("conv_id", "call_id", "after").join(
        known, ["conv_id", "after"])
    now = checkpointed(linked.select("conv_id", "call_id", F.col("after").alias("to"),
                                     F.lit(1).cast("long").alias("steps")))
    left, rounds = now.count(), 0
    limit = left.bit_length() + 1                  # a longer chain would be a cycle
    while left and rounds < limit:
        far = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("further"),
                         F.col("steps").alias("more"))
        now = checkpointed(now.join(far, ["conv_id", "to"], "left").select(
            "conv_id", "call_id", F.when(F.col("to").isNotNull(), F.col("further")).alias("to"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        left, rounds = now.where("to IS NOT NULL").count(), rounds + 1
    found = now.select("conv_id", "call_id", F.when(
        F.col("to").isNull(), F.col("steps")).otherwise(-1).alias("depth"))
    return calls.select("conv_id", "call_id").join(found, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", F.coalesce("depth", F.lit(0)).alias("depth"))


def link(messages, calls, results, schemas):
    """One row per message, call and result: conv_id, depth, turn, step, kind, call_id,
    status and message.

    Sorted by (depth, turn, step) the rows of a conversation are in order: a call follows
    the call it depends on and its results follow it, whenever they came. Plain messages
    have depth 0 and no status. A call is `ok`, `invalid` (its arguments break the schema),
    `unanswered`, `cycle` or `duplicate` (a second one under its identifier in the
    conversation; the earliest counts, of equal turns the smallest name and arguments). A
    result is `ok` or `orphan` without its call; several results of a call all stay. A NULL
    role, text or content is written as null; a NULL conversation or identifier links
    nothing. Repeated plain messages stay. Other columns play no part.

    messages: conv_id, turn, role, text; calls: conv_id, turn, call_id, name, arguments,
    after; results: conv_id, turn, call_id, content.
    """
    def quoted(value):
        text = F.to_json(F.array(value))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    def row(name, json):
        return F.concat(F.lit(f'"{name}":'), F.coalesce(json, F.lit("null")))

    def message(*parts):
        return F.concat(F.lit("{"), *[x for i, p in enumerate(parts)
                                      for x in ([F.lit(",")] if i else []) + [p]], F.lit("}"))

    named = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    fields = F.struct("turn", "name", "arguments", "after")
    first = (named.groupBy("conv_id", "call_id").agg(
        F.min(fields).alias("c"), F.count("*").alias("n")).select("conv_id", "call_id", "c.*", "n"))
    first = checkpointed(first)
    placed = first.join(depths(first), ["conv_id", "call_id"])
    answers = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    judged = (placed.join(answers, ["conv_id", "call_id"], "left")
              .withColumn("wrong", problems(F.col("name"), F.col("arguments"), schemas)))
    status = (F.when(F.col("depth") < 0, "cycle").when(F.size("wrong") > 0, "invalid")
              .when(F.col("answers").isNull(), "unanswered").otherwise("ok"))

    def call_message(arguments):
        written = F.coalesce(canonical(arguments), quoted(arguments))
        return message(row("arguments", written), row("id", quoted(F.col("call_id"))),
                       row("name", quoted(F.col("name"))), row("role", F.lit('"assistant"')))

    once = judged.select("conv_id", "depth", "turn", F.lit(1).alias("step"),
                         F.lit("call").alias("kind"), "call_id", status.alias("status"),
                         call_message(F.col("arguments")).alias("message"))
    again = (named.select("conv_id", "call_id", fields.alias("c")).groupBy(
        "conv_id", "call_id", "c").agg(F.count("*").alias("n"))
        .join(first.select("conv_id", "call_id", fields.alias("f")), ["conv_id", "call_id"])
        .withColumn("n", F.col("n") - F.col("c").eqNullSafe(F.col("f")).cast("int"))
        .where("n > 0").select("conv_id", "call_id", "c.*", F.explode(
            F.expr("array_repeat(1, cast(n as int))")).alias("one"))
        .select("conv_id", F.lit(0).cast("long").alias("depth"), "turn", F.lit(1).alias("step"),
                F.lit("call").alias("kind"), "call_id", F.lit("duplicate").alias("status"),
                call_message(F.col("arguments")).alias("message")))
    unnamed = calls.where("conv_id IS NULL OR call_id IS NULL").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "turn", F.lit(1).alias("step"),
        F.lit("call").alias("kind"), "call_id", F.lit("unanswered").alias("status"),
        call_message(F.col("arguments")).alias("message"))
    known = placed.select("conv_id", "call_id", "depth", F.col("turn").alias("called"))
    answered = (results.select("conv_id", "turn", "call_id", "content")
                .join(known, ["conv_id", "call_id"], "left")
                .select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"),
                        F.coalesce("called", "turn").alias("turn"), F.lit(2).alias("step"),
                        F.lit("result").alias("kind"), "call_id",
                        F.when(F.col("depth").isNull(), "orphan").otherwise("ok").alias("status"),
                        message(row("content", quoted(F.col("content"))), row("id", quoted(
                            F.col("call_id"))), row("role", F.lit('"tool"'))).alias("message")))
    plain = messages.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "turn", F.lit(0).alias("step"),
        F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("status"),
        message(row("content", quoted(F.col("text"))), row("role", quoted(F.col("role")))).alias(
            "message"))
    return (plain.unionByName(once).unionByName(again).unionByName(unnamed)
            .unionByName(answered))


# The tool that the query over prose conversations calls: a user's turn asks it, and the
# assistant's turn after it is the result.
SCHEMAS = {"ask": {"properties": {"question": "string", "turn": "integer"},
                   "required": ["question", "turn"]}}


def question_calls(talks):
    """Calls and results in conversations without any: each user turn asks the tool, after
    the question two turns before; one of several lines is handed over as a list, which
    breaks the schema. Each assistant turn answers the turn before it."""
    number = F.col("turn").cast("long")
    asked = talks.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    lines = F.split("text", "\n", -1)
    calls = asked.select(
        "conv_id", number.alias("turn"), F.concat_ws("-", "conv_id", number).alias("call_id"),
        F.lit("ask").alias("name"),
        F.when(F.size(lines) > 1, F.to_json(F.struct(number.alias("turn"), lines.alias(
            "question")))).otherwise(F.to_json(F.struct(
                number.alias("turn"), F.col("text").alias("question")))).alias("arguments"),
        F.concat_ws("-", "conv_id", number - 2).alias("after"))
    results = talks.where("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", number.alias("turn"),
        F.concat_ws("-", "conv_id", number - 1).alias("call_id"), F.col("text").alias("content"))
    rest = talks.where("role IS NULL OR role NOT IN ('user', 'assistant') OR conv_id IS NULL "
                       "OR turn IS NULL").select("conv_id", number.alias("turn"), "role", "text")
    return rest, calls, results


# What `link` gives for `question_calls`, over DuckDB's view of the conversations, whose
# turns are unique.
SQL = """
WITH calls AS (SELECT conv_id, turn, text, concat(conv_id, '-', turn) AS call_id,
  turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM conversations WHERE role = 'user'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1
  AS depth FROM calls),
answers AS (SELECT conv_id, turn, text, concat(conv_id, '-', turn - 1) AS call_id
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, depth, turn, 1 AS step, 'call' AS kind, call_id,
  CASE WHEN text IS NULL OR contains(text, chr(10)) THEN 'invalid'
    WHEN call_id NOT IN (SELECT call_id FROM answers) THEN 'unanswered' ELSE 'ok' END AS status,
  concat('{"arguments":{"question":', CASE WHEN contains(text, chr(10))
    THEN to_json(string_split(text, chr(10)))::VARCHAR ELSE to_json(text)::VARCHAR END,
    ',"turn":', turn, '},"id":"', call_id, '","name":"ask","role":"assistant"}') AS message
FROM placed
UNION ALL SELECT a.conv_id, coalesce(p.depth, 0), coalesce(p.turn, a.turn), 2, 'result', a.call_id,
  CASE WHEN p.turn IS NULL THEN 'orphan' ELSE 'ok' END,
  concat('{"content":', coalesce(to_json(a.text)::VARCHAR, 'null'), ',"id":"', a.call_id,
    '","role":"tool"}')
FROM answers a LEFT JOIN placed p USING (conv_id, call_id)
UNION ALL SELECT conv_id, 0, turn, 0, 'message', NULL, NULL,
  concat('{"content":', coalesce(to_json(text)::VARCHAR, 'null'), ',"role":',
    coalesce(to_json(role)::VARCHAR, 'null'), '}')
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""
