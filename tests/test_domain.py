import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.operators import analytics, conversation, ingest, intents, retrieval, state, tracing
from brindle.sources import files, vectors
from brindle.streaming import streams


def test_deduplicate_and_rerank(spark):
    rows = [("q", "a", "a1", "INTENT_DIRECTED", 0, 0.5), ("q", "b", "b1", "INTENT_DIRECTED", 1, 0.9), ("q", "c", "c1", "VECTOR_GLOBAL", 0, 0.95), ("q", "a", "a2", "VECTOR_GLOBAL", 1, 0.8)]
    df = spark.createDataFrame(rows, "request string, key string, id string, channel string, position int, score double")
    one = retrieval.deduplicate(df)
    assert [(r.key, r.id, r.score) for r in one.orderBy("slot").collect()] == [("a", "a2", 0.8), ("b", "b1", 0.9), ("c", "c1", 0.95)]
    assert [r.key for r in retrieval.rerank_noop(one, 2).orderBy("slot").collect()] == ["a", "b"]
    model = one.withColumn("model_score", F.when(F.col("key") == "c", 1.0))
    assert [r.key for r in retrieval.rerank(model, 2).orderBy("rank").collect()] == ["c", "a"]
    assert [r.key for r in retrieval.rerank(model, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    assert retrieval.rerank(model, 0).count() == 3


def test_gates(spark):
    df = spark.createDataFrame([("a", 0.3), ("b", 0.5), ("c", 0.7), ("d", None)], "request string, score double")
    got = {r.request: (r.directed_on, r.global_on) for r in retrieval.gates(df).collect()}
    assert got == {"a": (False, True), "b": (True, True), "c": (True, False), "d": (False, True)}


def caps(spark, *rows):
    df = spark.createDataFrame([("s", *r) for r in rows], "session string, question string, item string, score double")
    return sorted((r.question, r.item) for r in intents.cap(df).collect())


def test_cap(spark):
    assert caps(spark, ("q0", "a", 0.9), ("q0", "b", 0.8), ("q0", "c", 0.7), ("q1", "d", 0.6)) == [("q0", "a"), ("q0", "b"), ("q1", "d")]
    assert len(caps(spark, *[(f"q{i}", "x", 0.5) for i in range(4)])) == 4
    assert caps(spark, ("q", "a", 0.3)) == []


@pytest.mark.parametrize(("first", "second", "found"), [(0.5, 0.4, True), (0.9, 0.72, False)])
def test_ambiguity_ratio(spark, first, second, found):
    rows = [("q", "which", "a", "OA 系统", "s1", "One", first), ("q", "which", "b", "oa-系统", "s2", "Two", second)]
    df = spark.createDataFrame(rows, "question string, text string, item string, name string, system string, system_name string, score double")
    assert [r.systems for r in intents.ambiguous(df).collect()] == (["s1,s2"] if found else [])
    assert intents.ambiguous(df.withColumn("text", F.lit("in ONE please"))).count() == 0


def test_kinds(spark):
    df = spark.createDataFrame([("q", 2, "t", 0.9), ("q", 2, " ", 0.9), ("q", None, None, 0.4), ("r", 1, None, 0.9)], "question string, kind int, tool_id string, score double")
    assert sorted(r.use for r in intents.by_kind(df).collect()) == ["knowledge", "tool"]
    assert {r.question: r.system_only for r in intents.system_only(df).collect()} == {"q": False, "r": True}


def test_history(spark):
    rows = [("c", str(i), role, datetime(2026, 1, 1, 0, i)) for i, role in enumerate(["assistant", "assistant", "user", "assistant"])]
    df = spark.createDataFrame(rows, "conversation_id string, id string, role string, create_time timestamp_ntz")
    assert [r.role for r in conversation.history(df, 2).orderBy("seq").collect()] == ["user", "assistant"]


def test_feedback(spark):
    rows = [(1, "m", "u", 1, None, 10, datetime(2026, 1, 1)), (2, "m ", "u", -1, None, 5, datetime(2026, 1, 2))]
    df = spark.createDataFrame(rows, "delivery_id bigint, message_id string, user_id string, vote int, reason string, submit_time bigint, received_at timestamp_ntz")
    assert [r.vote for r in conversation.latest_votes(df).collect()] == [1]


def test_performance(spark):
    df = spark.createDataFrame([("SUCCESS", i) for i in range(1, 21)] + [("RUNNING", None), ("SUCCESS", 0)], "status string, duration_ms bigint")
    row = analytics.performance(df).first()
    assert (row.p95_ms, row.avg_ms, row.success_rate) == (19, 11, 100.0)
    empty = analytics.performance(df.where("false")).first()
    assert (empty.p95_ms, empty.avg_ms, empty.success_rate) == (0, 0, 0.0)
    assert spark.range(1).select(analytics.change(F.lit(5), F.lit(0))).first()[0] is None
    assert analytics.spine(spark, datetime(2026, 1, 8, 5), 168, "day").count() == 8
    assert analytics.spine(spark, datetime(2026, 1, 8, 5, 9), 24, "hour").count() == 24


def test_state(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id int, x string, n int")
    assert sorted(map(tuple, state.patch(rows, spark.createDataFrame([(1, None, 7)], "id int, x string, n int"), "id").collect())) == [(1, "a", 7), (2, "b", 5)]
    assert sorted(r.id for r in state.upsert(rows, spark.createDataFrame([(2, "z", 1), (3, "c", 1)], rows.schema), "id").collect()) == [1, 2, 3]
    numbered = state.number(spark.createDataFrame([("g", 4, "a"), ("g", None, "c"), ("g", None, "b"), ("h", None, "d")], "g string, i int, k string"), "g", "i", ["k"])
    assert sorted((r.k, r.i) for r in numbered.collect()) == [("a", 4), ("b", 5), ("c", 6), ("d", 0)]
    assert spark.range(1).select(state.removed(F.lit(1), F.lit(3))).first()[0] == 0


def test_depths(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "node string, parent_node string")
    assert {r.node: r.depth for r in tracing.depths(df).collect()} == {"a": 0, "b": 1, "c": 2}


def test_pipeline_order():
    step = ingest.Step
    assert [s.id for s in ingest.order([step("b", "chunker"), step("a", "parser", "b")])] == ["a", "b"]
    for bad in ([step("a", "x"), step("a", "x")], [step("a", "x", "z")], [step("a", "x", "b"), step("b", "x", "a")]):
        with pytest.raises(ValueError):
            ingest.order(bad)


def test_whole_pipeline(spark, duck):
    """Against plain Python, document by document."""
    from collections import Counter
    from re import findall

    from brindle.operators.chunking import fixed
    from brindle.plans import keeping
    from tests.conftest import DATA

    def top(text, most):
        return [w for w, _ in sorted(Counter(findall("[a-z]{3,}", text.lower())).items(), key=lambda x: (-x[1], x[0]))[:most]]

    done = ingest.run(spark.read.parquet(f"{DATA}/documents.parquet"), keeping.WHOLE).collect()
    assert {r.logs[1].outcome for r in done if len(r.logs) > 1} == {"success", "skipped"}
    for r in done:
        if r.status == "failed":
            assert r.indexed is None and r.logs[-1].outcome == "failed"
            continue
        text = r.raw_text if r.lang not in ("en", "de", "fr", "es") else " ".join(top(r.raw_text, 5)) + "\n" + r.raw_text
        want = fixed(text, 512, 128)
        assert [(x.chunk_index, x.content) for x in r.indexed] == list(enumerate(want))
        fields = [{"chunk_index": str(i), "doc_id": str(r.doc_id), "keywords": ",".join(top(c, 3))} | {k: r[k] for k in ("kb_id", "lang") if r[k] is not None} for i, c in enumerate(want)]
        assert [json.loads(x.metadata) for x in r.indexed] == fields
        assert [x.node for x in r.logs] == ["read", "enhance", "cut", "enrich", "write"] and r.logs[-1].message == f"{len(want)} chunks"
    logged = {(r.doc_id, r.step): r for r in keeping.pipeline_node_log(spark, DATA).collect()}
    assert len(logged) == sum(len(r.logs) for r in done) and len({r.made for r in logged.values()}) > 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x<script>no</script></p><p>y &amp; z</p>")
    (tmp_path / "b.md").write_text("# t  \n\n\n\nq")
    (tmp_path / "c.bin").write_bytes(b"\0" * 100)
    got = {r.name: (r.parser, r.text) for r in files.parsed(files.files(spark, str(tmp_path), 90)).collect()}
    assert got == {"a.html": ("html", "x\n\ny & z"), "b.md": ("markdown", "# t\n\nq")}
    assert spark.range(1).select(files.document_token(F.lit("https://x/docx/Ab1?y"))).first()[0] == "Ab1"


def test_vector_store(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.createDataFrame([("1", "x", '{"doc_id": "d"}', [1.0, 2.0], "c"), ("2", "y", None, [1.0, 2.0], "e")], "id string, content string, metadata string, embedding array<float>, collection_name string")
    vectors.append(vectors.prepared(df, 2), path)
    assert vectors.read(spark, path, "c").count() == 1
    assert [r.id for r in vectors.without_document(df, "d").collect()] == ["2"]
    assert sorted(r.content for r in vectors.replaced(df, df.where("id = '1'").withColumn("content", F.lit("new"))).collect()) == ["new", "y"]
    with pytest.raises(Exception, match="wrong vector length"):
        vectors.prepared(df, 3).collect()


def test_breaker(spark):
    assert [x[1] for x in streams.breaker([(0, False), (0, False), (10_000, True), (31_000, True)])] == [True, True, False, True]
    calls = spark.createDataFrame([("m", t, i, ok) for i, (t, ok) in enumerate([(0, False), (0, False), (10_000, True), (31_000, False), (40_000, True), (70_000, True)])] + [("n", 5, 9, True)], "model string, at_ms bigint, call_id int, ok boolean")
    got = [(r.call_id, r.allowed, r.state) for r in streams.breaker_states(calls, "model").orderBy("call_id").collect()]
    assert got == [(0, True, "CLOSED"), (1, True, "OPEN"), (2, False, "OPEN"), (3, True, "OPEN"), (4, False, "OPEN"), (5, True, "CLOSED"), (9, True, "CLOSED")]


def test_streams(spark, tmp_path):
    schema = "message_id string, user_id string, vote int, submit_time bigint, at timestamp"
    at = datetime(2026, 1, 1)
    spark.createDataFrame([("m", "u", 1, 10, at), ("m", "u", -1, 5, at), ("n", "u", None, 1, at)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    streams.to_memory(streams.latest_vote_stream(stream.select("message_id", "user_id", "vote", "submit_time")), "votes", "update")
    assert {(r.message_id, r.vote) for r in spark.table("votes").collect()} == {("m", 1), ("n", None)}
    streams.to_memory(streams.distinct_stream(stream, ["message_id"], "at", "1 hour"), "events")
    assert spark.table("events").count() == 2
    streams.to_memory(streams.trend_stream(stream, "at", "1 hour", "0 seconds"), "hours", "update")
    assert [r.n for r in spark.table("hours").collect()] == [3]
