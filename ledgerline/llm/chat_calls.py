"""Chats with tool calls derived from the conversations: what format_chats links, orders and validates, on all of their rows.

The given turns hold no calls, so an assistant's turn makes some of its own, by (conv_id + turn) mod 8: none; answered; answered before it
is made; not answered; without a required argument; of an unknown tool and answered twice; with an argument of the wrong type and an answer
to another call; two calls of which one has no object of arguments. Turns lie SPREAD apart, with the answers between them.
Identifiers recur in every conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.chat import Schemas, format_chats

TOOLS: Schemas = {"measure": {"chars": ("number", True), "unit": ("string", False)}}
#: Turns between two of the given ones; a conversation of over 5 of those has several parts.
SPREAD = 12


def turns_with_calls(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the given turns and of the answers to their calls; a row of conversations makes one to three."""
    kind = F.when(F.col("role") == "assistant", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))).otherwise(0)
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("kind", kind)
    n, turn = F.length("text").cast("string"), F.col("turn").cast("string")

    def call(prefix: str, arguments: Column, name: str = "measure") -> Column:
        return F.struct(F.concat(F.lit(prefix), turn).alias("id"), F.lit(name).alias("name"), arguments.alias("arguments"))

    good = F.concat(F.lit('{"unit": "chars", "chars": '), n, F.lit("}"))
    first = F.when(F.col("kind") == 4, call("c", F.lit('{"unit": "chars"}'))).when(F.col("kind") == 5, call("c", good, "lookup")).when(F.col("kind") == 6, call("c", F.concat(F.lit('{"chars": "'), n, F.lit('"}')))).otherwise(call("c", good))
    calls = F.when(F.col("kind") == 7, F.array(first, call("d", F.lit("none")))).otherwise(F.array(first))
    said = F.when(F.col("kind") == 0, F.col("text")).otherwise(F.to_json(F.struct(F.col("text").alias("content"), calls.alias("tool_calls"))))

    def answer(after: int, prefix: str) -> Column:
        text = F.to_json(F.struct(F.concat(F.lit("chars: "), n).alias("content"), F.concat(F.lit(prefix), turn).alias("tool_call_id")))
        return F.struct((F.col("turn") * SPREAD + after).alias("turn"), F.lit("tool").alias("role"), text.alias("text"))

    own = F.struct((F.col("turn") * SPREAD).alias("turn"), F.col("role").alias("role"), said.alias("text"))
    rows = (
        F.when(F.col("kind").isin(1, 4), F.array(own, answer(1, "c"))).when(F.col("kind") == 2, F.array(own, answer(-5, "c"))).when(F.col("kind") == 5, F.array(own, answer(1, "c"), answer(2, "c")))
        .when(F.col("kind") == 6, F.array(own, answer(1, "e"))).when(F.col("kind") == 7, F.array(own, answer(1, "d"), answer(2, "c"))).otherwise(F.array(own))
    )
    return c.select("conv_id", F.inline(rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(turns_with_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)


#: The tables' assistants say no JSON objects, and no two messages share a turn.
SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, count(*) AS n, CASE WHEN role = 'assistant' THEN (conv_id + turn) % 8 ELSE 0 END AS kind FROM conversations GROUP BY ALL),
good AS (SELECT *, '{"arguments":{"chars":' || length(text) || ',"unit":"chars"},"id":"c' || turn || '","name":"' AS g FROM t),
said AS (SELECT conv_id, n, turn * 12 AS place, 0 AS after_, turn * 12 AS own, CASE WHEN kind = 0 THEN 0 WHEN kind = 7 THEN 2 ELSE 1 END AS calls, CASE WHEN kind IN (4, 5, 6, 7) THEN 1 ELSE 0 END AS invalid, CASE WHEN kind IN (3, 6) THEN 1 ELSE 0 END AS unlinked,
  '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || CASE WHEN kind = 0 THEN '' ELSE ',"tool_calls":[' || CASE kind WHEN 4 THEN '{"arguments":{"unit":"chars"},"id":"c' || turn || '","name":"measure"}'
    WHEN 5 THEN g || 'lookup"}' WHEN 6 THEN '{"arguments":{"chars":"' || length(text) || '"},"id":"c' || turn || '","name":"measure"}' WHEN 7 THEN g || 'measure"},{"arguments":"none","id":"d' || turn || '","name":"measure"}' ELSE g || 'measure"}' END || ']' END || '}' AS message FROM good),
answers AS (SELECT t.*, a.* FROM t JOIN (VALUES (1, 1, 'c', 0), (4, 1, 'c', 0), (2, -5, 'c', 0), (5, 1, 'c', 0), (5, 2, 'c', 1), (6, 1, 'e', 1), (7, 1, 'd', 0), (7, 2, 'c', 0)) a(k, later, prefix, unlinked) ON a.k = t.kind),
told AS (SELECT conv_id, n, CASE WHEN later < 0 THEN turn * 12 ELSE turn * 12 + later END AS place, CASE WHEN later < 0 THEN 1 ELSE 0 END AS after_, turn * 12 + later AS own, 0 AS calls, 0 AS invalid, unlinked,
  '{"content":"chars: ' || length(text) || '","role":"tool","tool_call_id":"' || prefix || turn || '"}' AS message FROM answers)
SELECT conv_id, place // 64 AS part, CAST(0 AS BIGINT) AS piece, count(*) AS n_messages, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(calls) AS BIGINT) AS n_calls, CAST(sum(invalid) AS BIGINT) AS n_invalid, CAST(sum(unlinked) AS BIGINT) AS n_unlinked,
       '[' || string_agg(message, ',' ORDER BY place, after_, own) || ']' AS chat
FROM (FROM said UNION ALL FROM told) GROUP BY conv_id, place // 64
"""
