"""Chat formatting with linked tool calls [native].

An assistant's turn may be a JSON object with tool_calls ([{id, name, arguments}]) and content; a turn of the role
`tool` is one with tool_call_id and content. Calls and results are hash-joined by (conversation, identifier), put
into topological order (a result never comes before its call; otherwise turns keep their order), arguments are
validated against the tools' schemas, and everything is serialised as canonical JSON (keys sorted, no spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut

#: Turns of a conversation that one output row holds at most; longer conversations have several parts.
PART_TURNS = 64
#: Messages that a piece of a part begins with at most: a part with more goes on in further pieces, in order.
PART_MESSAGES = 1024

#: tool: {argument: (type, required)}; types are string, number, boolean, object and array.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_CALLS = "struct<content string, tool_calls array<struct<id string, name string, arguments string>>, tool_call_id string>"
_KINDS = {"string": "STRING", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call, as sorted words; empty if nothing is."""
    v = F.try_parse_json(arguments)
    found = [F.when(name.isNull() | ~F.coalesce(name.isin(*schemas) if schemas else F.lit(False), F.lit(False)), F.lit("unknown tool")), F.when(v.isNull() | ~F.schema_of_variant(v).rlike("^OBJECT"), F.lit("arguments are no object"))]
    for tool, fields in schemas.items():
        here = name == tool
        for field, (kind, required) in fields.items():
            got = F.variant_get(v, f"$['{field}']", "variant")
            absent = got.isNull() | (F.schema_of_variant(got) == "VOID")
            if required:
                found.append(F.when(here & absent, F.lit(f"missing {field}")))
            found.append(F.when(here & ~absent & ~F.schema_of_variant(got).rlike(f"^{_KINDS[kind]}$"), F.lit(f"{field} is no {kind}")))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def messages(turns: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, rows, at (its place: struct), message (canonical JSON), calls, invalid, unlinked.

    Rows that repeat all of conv_id, turn, role and text are one message; rows counts them. A null conv_id makes every message a conversation
    of its own (own is then a number for it); a null turn comes first; a null role is "user", a null text is empty.
    Calls of one identifier: the first by turn counts; results of one call: the first by turn is linked, the others and
    those without a call are unlinked. A text that is no JSON object is plain content.
    """
    schemas = schemas or {}
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("rows"))
    t = t.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0)))
    t = t.withColumns({"uid": F.xxhash64("turn", "role", "text"), "turn": F.coalesce("turn", F.lit(-(1 << 62)))})
    structured = F.ltrim("text").startswith("{") & F.col("role").isin("assistant", "tool")
    t = t.withColumn("j", F.when(structured, F.from_json("text", _CALLS)))
    is_call = (F.col("role") == "assistant") & (F.size("j.tool_calls") > 0)
    is_result = (F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull()
    calls = t.where(is_call).select("conv_id", "own", "turn", "uid", F.posexplode("j.tool_calls").alias("n", "c"))
    calls = calls.select("conv_id", "own", "turn", "uid", "n", "c.id", "c.name", "c.arguments")
    first = Window.partitionBy("conv_id", "own", "id").orderBy("turn", "uid", "n")
    key = ["conv_id", "own", "id"]
    known = calls.where("id IS NOT NULL").withColumn("k", F.row_number().over(first)).where("k = 1").select(*key, F.col("turn").alias("call_turn"), F.col("uid").alias("call_uid"))
    results = t.where(is_result).select("conv_id", "own", "turn", "uid", F.col("j.tool_call_id").alias("id"))
    match = results.alias("r").join(known.alias("c"), F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r.own") == F.col("c.own")) & (F.col("r.id") == F.col("c.id")), "left")
    match = match.select("r.conv_id", "r.own", "r.turn", "r.uid", "r.id", "call_turn", "call_uid")
    match = match.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "own", "id").orderBy("turn", "uid")))
    match = match.select("conv_id", "own", "turn", "uid", "id", F.when(F.col("k") == 1, F.col("call_turn")).alias("call_turn"), F.when(F.col("k") == 1, F.col("call_uid")).alias("call_uid"))
    wrong = problems(F.col("c.name"), F.col("c.arguments"), schemas)
    answered = match.where("call_turn IS NOT NULL").select("conv_id", "own", F.col("id").alias("aid"))
    said = calls.alias("q").join(answered.alias("a"), F.col("q.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("q.own") == F.col("a.own")) & (F.col("q.id") == F.col("a.aid")), "left")
    said = said.select("q.conv_id", "q.own", "q.turn", "q.uid", "q.n", F.struct(F.coalesce(canonical(F.col("q.arguments")), F.to_json(F.array(F.col("q.arguments"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("q.arguments")))) - 2)).alias("arguments"), F.col("q.id").alias("id"), F.col("q.name").alias("name")).alias("c"), F.col("a.aid").isNotNull().alias("answered"))
    said = said.select("conv_id", "own", "turn", "uid", F.struct("n", F.concat(F.lit('{"arguments":'), F.coalesce(F.col("c.arguments"), F.lit("null")), F.lit(',"id":'), _text(F.col("c.id")), F.lit(',"name":'), _text(F.col("c.name")), F.lit("}")).alias("s"), wrong.alias("wrong"), "answered").alias("c"))
    said = said.groupBy("conv_id", "own", "turn", "uid").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    m = t.alias("t").join(said.alias("s"), _same("t", "s"), "left").join(match.alias("m"), _same("t", "m"), "left")
    body = F.when(is_call | is_result, F.coalesce("j.content", F.lit(""))).otherwise(F.col("t.text"))
    listed = F.transform("cs", lambda c: c["s"])
    message = F.concat(
        F.lit('{"content":'), _text(body), F.lit(',"role":'), _text(F.col("role")),
        F.when(is_result, F.concat(F.lit(',"tool_call_id":'), _text(F.col("j.tool_call_id")))).otherwise(F.lit("")),
        F.when(F.col("cs").isNotNull(), F.concat(F.lit(',"tool_calls":['), F.array_join(listed, ","), F.lit("]"))).otherwise(F.lit("")), F.lit("}"),
    )
    later = F.col("call_turn") > F.col("t.turn")
    at = F.struct(F.when(later, F.col("call_turn")).otherwise(F.col("t.turn")).alias("turn"), F.when(later, 1).otherwise(0).alias("after"), F.col("t.turn").alias("own_turn"), F.col("t.uid").alias("uid"))
    invalid = F.size(F.filter("cs", lambda c: F.size(c["wrong"]) > 0))
    return m.select(
        "t.conv_id", F.col("t.own").alias("own"), F.col("t.turn").alias("turn"), F.col("role"), "rows", at.alias("at"), message.alias("message"),
        F.coalesce(F.size("cs"), F.lit(0)).alias("calls"), F.when(F.col("cs").isNull(), 0).otherwise(invalid).alias("invalid"),
        (F.when(is_result & F.col("call_turn").isNull(), 1).otherwise(0) + F.when(F.col("cs").isNull(), 0).otherwise(F.size(F.filter("cs", lambda c: ~c["answered"])))).alias("unlinked"),
    )


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.own") == F.col(f"{b}.own")) & (F.col(f"{a}.turn") == F.col(f"{b}.turn")) & (F.col(f"{a}.uid") == F.col(f"{b}.uid"))


def _text(c: Column) -> Column:
    """A JSON string (or null)."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(2), F.length(whole) - 2))


def _pieces(m: DataFrame, part_messages: int) -> DataFrame:
    """m with piece: the messages of a part in order, dealt into runs; a run ends when it has part_messages or more.

    Messages at one place of the order (a crowd at one turn) are first split by ranges of their uid, which is next in
    that order, so that neither a window nor a row ever has to hold a whole crowd.
    """
    key, place = ["conv_id", "own", "part"], ["turn", "after", "own_turn"]
    flat = m.select("*", *[F.col(f"at.{c}").alias(f"p_{c}") for c in place])
    place = [f"p_{c}" for c in place]
    crowds = flat.groupBy(*key, *place).count().where(F.col("count") > part_messages).select(*[F.col(c).alias(f"x_{c}") for c in (*key, *place)], F.ceil(F.col("count") / part_messages).alias("ranges"))
    crowds = cut(crowds)

    def alike(names: list[str], prefix: str) -> Column:
        found = F.lit(True)
        for c in names:
            found = found & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        return found

    flat = flat.join(crowds, alike([*key, *place], "x_"), "left").withColumn("range", F.least(F.floor((F.col("at.uid") / F.lit(2.0**64) + 0.5) * F.coalesce("ranges", F.lit(1))), F.coalesce("ranges", F.lit(1)) - 1))
    flat = cut(flat.drop("ranges", *crowds.columns))
    run = [*place, "range"]
    sums = flat.groupBy(*key, *run).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*key).orderBy(*run).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / part_messages)).select(*[F.col(c).alias(f"s_{c}") for c in (*key, *run)], "piece")
    return flat.join(sums, alike([*key, *run], "s_")).drop("range", *place, *[f"s_{c}" for c in (*key, *run)])


def format_chats(turns: DataFrame, schemas: Schemas | None = None, part_turns: int = PART_TURNS, part_messages: int = PART_MESSAGES) -> DataFrame:
    """One row per piece of a conversation: conv_id, part, piece, n_messages, n_rows, n_calls, n_invalid, n_unlinked, chat (a JSON array).

    A part holds part_turns turns, so that no conversation has to fit into one row. Within a part the messages, in order,
    are dealt into pieces of about part_messages: joined by part and piece, the chats are the conversation. n_rows counts
    rows that repeat a message too. An empty table gives none. Other columns are ignored, whatever their names.
    """
    m = messages(turns, schemas).withColumn("part", F.when(F.col("at.turn") < 0, F.lit(0)).otherwise(F.expr(f"at.turn div {part_turns}")))
    m = cut(m)
    key = ["conv_id", "own", "part"]
    if m.groupBy(*key).count().where(F.col("count") > part_messages).isEmpty():
        m = m.withColumn("piece", F.lit(0).cast("long"))  # what the runs would give
    else:
        m = _pieces(m, part_messages)
    rows = m.groupBy(*key, "piece").agg(
        F.count("*").alias("n_messages"), F.sum("rows").alias("n_rows"), F.sum("calls").cast("long").alias("n_calls"), F.sum("invalid").cast("long").alias("n_invalid"), F.sum("unlinked").cast("long").alias("n_unlinked"), F.array_sort(F.collect_list(F.struct("at", "message"))).alias("all"),
    )
    chat = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["message"]), ","), F.lit("]"))
    return rows.select("conv_id", "part", "piece", "n_messages", "n_rows", "n_calls", "n_invalid", "n_unlinked", chat.alias("chat"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The tables' turns hold no tool calls, and no two messages share a turn.
SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, turn // 64 AS part, CAST(0 AS BIGINT) AS piece, count(*) AS n_messages, CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_unlinked,
       '[' || string_agg('{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}', ',' ORDER BY turn) || ']' AS chat
FROM t GROUP BY conv_id, turn // 64
"""
