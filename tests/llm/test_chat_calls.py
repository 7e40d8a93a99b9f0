"""Chats whose calls come from the conversations: linking, order and validation against SQL and by hand."""

import json

from ledgerline.llm import chat_calls


def test_derived_calls_are_linked_and_validated(spark, tmp_path):
    import duckdb

    rows = [(c, t, ("system", "user", "assistant")[0 if t == 0 else 1 + t % 2], f'say "{c}"\n\\ é🙂 {t}' * (1 + t % 3)) for c in range(9) for t in range(0 if c % 2 else 1, 8)]
    rows += [rows[5], (20, 0, None, "no role"), (20, 1, "assistant", None), (20, 2, "assistant", ""), (21, 0, "user", '{"tool_calls":[{"id":"c0"}]}'), (22, 0, "assistant", "alone"), (22, 150, "assistant", "far away")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found = chat_calls.query(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: r[:3]
    assert sorted(map(tuple, found), key=key) == sorted(con.sql(chat_calls.SQL).fetchall(), key=key)
    assert sum(r.n_calls for r in found) > sum(r.n_invalid for r in found) > 0 and sum(r.n_unlinked for r in found) > 0 and max(r.part for r in found) > 0
    assert sum(r.n_rows for r in found) > sum(r.n_messages for r in found) > len(rows)


def test_each_kind_of_call_by_hand(spark):
    turns = spark.createDataFrame([(k, 0, "assistant", "abc") for k in range(8)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_calls.format_chats(chat_calls.turns_with_calls(turns), chat_calls.TOOLS).collect()}
    assert [(got[k].n_messages, got[k].n_calls, got[k].n_invalid, got[k].n_unlinked) for k in range(8)] == [(1, 0, 0, 0), (2, 1, 0, 0), (2, 1, 0, 0), (1, 1, 0, 1), (2, 1, 1, 0), (3, 1, 1, 1), (2, 1, 1, 2), (3, 2, 1, 0)]
    assert [m["role"] for m in json.loads(got[2].chat)] == ["assistant", "tool"]  # the answer, given before, follows its call
    assert [c["arguments"] for c in json.loads(got[7].chat)[0]["tool_calls"]] == [{"chars": 3, "unit": "chars"}, "none"]
