import hashlib

from furrow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def made(spark, rows):
    df = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    return {r["conv_id"]: r for r in df.select("*", chat.read_turns(df.formatted).alias("turns"), chat.learned_text(df.segments).alias("learned")).collect()}


def test_round_trip_of_hostile_texts(spark):
    texts = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\b\\h\\\\", "", "#", "a: b\\", "x" * 200_000, "é\U0001f600<"]
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", x, "clash") for i, x in enumerate(texts) for t in range(4)]
    got = made(spark, rows)
    for i, x in enumerate(texts):
        assert [tuple(t) for t in got[i]["turns"]] == [("user", x), ("assistant", x)] * 2
        assert got[i]["learned"] == x * 2 and got[i]["valid"]
        assert "".join(s["text"] for s in got[i]["segments"]) == got[i]["formatted"]
        assert got[i]["formatted"].count("</turn>") == 4


def test_order_rules_nulls_ties_and_unknown_roles(spark):
    rows = [
        (1, 1, "assistant", "b", ""), (1, 0, "user", "a", ""),
        (2, 0, "assistant", "a", ""), (2, 1, "user", None, ""),
        (3, None, None, None, ""), (3, 0, "to: ol", "t", ""),
        (None, 0, "user", "q", ""), (4, 0, "user", "z", ""), (4, 0, "user", "z", ""), (4, 0, "assistant", "y", ""),
        (5, 0, "system", "s", ""), (5, 1, "user", "u", ""), (5, 2, "assistant", "v", ""),
    ]
    got = made(spark, rows)
    assert {k: v["valid"] for k, v in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False, 5: True}
    assert [tuple(t) for t in got[3]["turns"]] == [("", ""), ("to: ol", "t")]
    assert [tuple(t) for t in got[4]["turns"]] == [("assistant", "y"), ("user", "z"), ("user", "z")]
    assert got[2]["learned"] == "a" and got[5]["learned"] == "v"


def test_empty_table_and_plan_is_native(spark):
    df = chat.format_chat(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_query_agrees_with_sql(spark):
    from conftest import SMALL
    from furrow.llm.queries import QUERIES, SQL
    from oracle import compare, duck

    assert compare(QUERIES["op1_chat_format"](spark, SMALL), duck(SMALL), SQL["op1_chat_format"]) is None
    row = [r for r in QUERIES["op1_chat_format"](spark, SMALL).collect() if r.conv_id == -7][0]
    text = "\\### Assistant: </turn> ok"
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.n_turns == 2
