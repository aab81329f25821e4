import random

from pyspark.sql import functions as F

from brindle.operators import delivery, hierarchy, ordering

ROWS = "id string, intent_code string, parent_code string, level int, update_time timestamp_ntz, deleted int"


def brute(links):
    out = {}
    for code in links:
        path = [code]
        while True:
            parent = links[path[-1]]
            if parent is None or parent not in links:
                out[code] = ("tree" if parent is None else "orphan", path[-1], len(path) - 1)
                break
            if parent in path:
                i = path.index(parent)
                out[code] = ("below_cycle" if i else "on_cycle", min(path[i:]), i)
                break
            path.append(parent)
    return out


def nodes(spark, links):
    return spark.createDataFrame([(c, p) for c, p in links.items()], "code string, parent string")


def test_random_graphs(spark):
    rng = random.Random(3)
    for n in (1, 2, 17, 60):
        names = [f"n{i}" for i in range(n)]
        links = {c: rng.choice([None, "gone", *names, *names]) for c in names}
        got = {r.code: (r.kind, r.root, r.depth) for r in hierarchy.hierarchy(nodes(spark, links)).collect()}
        assert got == brute(links)


def test_chain_paths_and_descendants(spark):
    links = {f"c{i:02}": f"c{i - 1:02}" if i else None for i in range(20)}
    tree = hierarchy.hierarchy(nodes(spark, links)).cache()
    assert {r.code: len(r.path) for r in tree.collect()} == {c: i + 1 for i, c in enumerate(links)}
    rows = hierarchy.descendants(tree).collect()
    assert len(rows) == 190 and {r.distance for r in rows if r.ancestor == "c00"} == set(range(1, 20))


def test_empty(spark):
    assert hierarchy.hierarchy(nodes(spark, {"x": None}).where("false")).count() == 0


def test_states(spark):
    rows = spark.sql("""SELECT * FROM VALUES
      ('1', 'a', NULL, 0, TIMESTAMP_NTZ '2026-01-01', 0), ('1', 'a', 'b', 0, TIMESTAMP_NTZ '2026-01-02', 0), ('2', 'b', ' ', 0, TIMESTAMP_NTZ '2026-01-01', 0),
      ('3', 'c', ' A ', 2, TIMESTAMP_NTZ '2026-01-01', 0), ('3', 'c', ' A ', 2, TIMESTAMP_NTZ '2026-01-01', 0), ('4', 'd', 'e', 1, TIMESTAMP_NTZ '2026-01-01', 0),
      ('5', 'e', NULL, 0, TIMESTAMP_NTZ '2026-01-03', 1), ('6', NULL, 'a', 0, TIMESTAMP_NTZ '2026-01-03', 0)
      AS t(id, intent_code, parent_code, level, update_time, deleted)""")
    found = {tuple(r) for r in hierarchy.findings(hierarchy.hierarchy(hierarchy.live_nodes(rows), False)).collect()}
    assert found == {("a", "level", "b", 1), ("d", "orphan", "d", 0)}


EVENTS = "delivery_id bigint, message_id string, user_id string, submit_time bigint, received_at timestamp_ntz, _kept int"


def test_deliveries(spark):
    from datetime import datetime as d

    rows = [(1, "m", "u", 5, d(2026, 1, 2), 0), (2, " m ", "u\t", 5, d(2026, 1, 1), 0), (3, "m", "u", 5, d(2026, 1, 1), 0), (4, "m", "u", 6, None, 0), (5, None, "u", 5, None, 0), (6, None, "u", 5, d(2026, 1, 1), 0)]
    df = spark.createDataFrame(rows, EVENTS)
    key = delivery.FEEDBACK_KEY
    assert sorted(r.delivery_id for r in delivery.surplus_deliveries(df, key).collect()) == [1, 3, 5]
    assert sorted(r.delivery_id for r in delivery.distinct_events(df, key).collect()) == [2, 4, 6]
    assert [r.delivery_id for r in delivery.new_events(df, df.where("delivery_id in (1, 5)"), key).collect()] == [4]
    assert delivery.new_events(df.where("false"), df, key).count() == 0


def test_previous_rows_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", f"k{i % 50}", None]), rng.randrange(20), i, f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v string").repartition(7)
    got = {r.i: r.prev_v for r in ordering.with_previous(df, "k", ["t", "i"], ["v"]).collect()}
    want, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(k)
        last[k] = v
    assert got == want
    assert ordering.with_previous(df.where("false"), "k", ["t", "i"], ["v"]).count() == 0
    only = ordering.with_previous(df, "k", ["t", "i"], ["v"], only=F.col("prev_v").isNull())
    assert {r.i for r in only.collect()} == {i for i, p in want.items() if p is None}
