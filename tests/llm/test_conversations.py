from datetime import datetime, timedelta

from brindle.llm import conversations as c

MESSAGES = "id string, conversation_id string, role string, content string, create_time timestamp_ntz, deleted int, depth int"


def frames(spark, talks):
    rows, n = [], 0
    for name, turns in talks.items():
        for role, content in turns:
            n += 1
            rows.append((f"{n:05}", name, role, content, datetime(2026, 1, 1) + timedelta(seconds=n // 3), 0, 9))
    return spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([(k, 0) for k in talks] + [("none", 0), ("gone", 1), ("none", 0), (None, 0)], "conversation_id string, deleted int")


def test_reasons(spark):
    u, a = ("user", "q?"), ("assistant", "a.")
    talks = {
        "good": [u, a, (" Human\n", "x"), ("BOT", "y")], "blank": [("user", " ?"), ("ai", None)], "first": [a, u, a], "double": [u, a, a], "unknown": [u, ("tool", "x"), a], "null": [(None, "x")],
        "open": [u, a, u], "two": [u, u, a], "void": [u, ("assistant", "…")], "system": [("system", "s"), u, a],
    }
    messages, conversations = frames(spark, talks)
    found = {tuple(r) for r in c.found(messages, conversations).collect()}
    assert found == {("blank", "empty"), ("none", "empty"), ("first", "broken"), ("double", "broken"), ("unknown", "broken"), ("null", "broken"), ("open", "missing_reply"), ("two", "missing_reply"), ("void", "missing_reply")}
    rebuilt = sorted((r.conversation_id, r.turn, r.role) for r in c.rebuilt(messages.union(messages), conversations).collect())
    assert rebuilt == [("good", i, r) for i, r in enumerate(["user", "assistant", "user", "assistant"])] + [("system", 0, "user"), ("system", 1, "assistant")]
    assert {r.reason for r in c.found(messages.where("false"), conversations).collect()} == {"empty"}
    assert c.found(messages, conversations.where("false")).count() == 0


def test_hot_conversation(spark):
    messages, conversations = frames(spark, {"hot": [("user", "q"), ("assistant", "a")] * 150, "x": [("user", "q"), ("assistant", "a")]})
    rows = c.rebuilt(messages, conversations).where("conversation_id = 'hot'").collect()
    assert sorted(r.turn for r in rows) == list(range(300))


def test_given_parents(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "zz"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "x")], "id string, parent_id string")
    placed, circling = c.positions(df)
    assert {(r.id, r.root, r.depth, r.orphan) for r in placed.collect()} == {("a", "a", 0, False), ("b", "a", 1, False), ("c", "a", 2, False), ("d", "d", 0, True), ("e", "d", 1, True)}
    assert sorted(r.code for r in circling.collect()) == ["x", "y", "z"]
