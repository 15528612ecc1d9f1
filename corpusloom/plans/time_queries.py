"""Joins by time: events before shipments, events within orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import intervals, segments
from corpusloom.plans.corpus_queries import table

#: Events span a month of 2024, orders and shipments the years from 1995: event times are stretched by this factor and begin with 1995.
_STRETCH = 83


def _events(spark, sf):
    """Events with their time as microseconds since 1995 on the clock of the orders."""
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) * {_STRETCH}").alias("at"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def _since(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1995-01-01 00:00:00', {column})")


def asof_shipments(spark, sf):
    """Each shipment with the latest event of its supplier, taken as a user, before it."""
    shipped = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("user_id"), _since("l_shipdate").alias("shipped"))
    found = segments.asof_join(shipped, _events(spark, sf), ["user_id"], "shipped", "at", ties=("event_id",))
    return found.select("l_orderkey", "l_linenumber", "match.event_id", "match.event_type", (F.col("shipped") - F.col("match.at")).alias("lag_us"))


def asof_sessions(spark, sf):
    """Each event with the latest purchase of its user up to it, itself included."""
    events = _events(spark, sf)
    bought = events.where("event_type = 'purchase'").select("user_id", "at", "event_id", "cents")
    found = segments.asof_join(events.select("event_id", "user_id", "at"), bought, ["user_id"], "at", "at", ties=("event_id",), same_time=True)
    return found.select("event_id", F.col("match.event_id").alias("purchase_id"), "match.cents")


def _orders(spark, sf):
    """Orders from their date to the day on which their last item is shipped."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    joined = table(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", F.col("o_custkey").alias("user_id"), _since("o_orderdate").alias("opened"), _since("last").alias("closed"))


def events_within_orders(spark, sf):
    """Events of each customer, taken as a user, while an order is open."""
    pairs = intervals.interval_join(_events(spark, sf), _orders(spark, sf), "at", "opened", "closed", ["user_id"])
    return pairs.select("interval.o_orderkey", "point.event_id", (F.col("point.at") - F.col("interval.opened")).alias("since_us"))


def events_within_shipments(spark, sf):
    """For each item, the events of its supplier, taken as a user, between order and shipment; items without any do not occur."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("user_id"), _since("o_orderdate").alias("opened"), _since("l_shipdate").alias("closed"))
    pairs = intervals.interval_join(_events(spark, sf), items, "at", "opened", "closed", ["user_id"])
    return pairs.groupBy("interval.l_orderkey", "interval.l_linenumber").agg(F.count("*").alias("n"), F.sum("point.cents").alias("cents"))


_AT = f"date_diff('microsecond', TIMESTAMP '2024-01-01', ts) * {_STRETCH}"
_E = f"e AS (SELECT event_id, user_id, event_type, {_AT} AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def _us(column: str) -> str:
    return f"date_diff('microsecond', TIMESTAMP '1995-01-01', {column})"


QUERIES = {
    "asof_shipments": (
        asof_shipments,
        f"""WITH {_E}, u AS (SELECT user_id, us, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM e GROUP BY user_id, us),
        s AS (SELECT l_orderkey, l_linenumber, l_suppkey, {_us('l_shipdate')} AS shipped FROM lineitem)
        SELECT l_orderkey, l_linenumber, event_id, event_type, shipped - us AS lag_us FROM s ASOF LEFT JOIN u ON user_id = l_suppkey AND shipped > us""",
    ),
    "asof_sessions": (
        asof_sessions,
        f"""WITH {_E}, u AS (SELECT user_id, us, max(event_id) AS purchase_id, arg_max(cents, event_id) AS cents FROM e WHERE event_type = 'purchase' GROUP BY user_id, us)
        SELECT event_id, purchase_id, u.cents FROM e ASOF LEFT JOIN u ON u.user_id = e.user_id AND e.us >= u.us""",
    ),
    "events_within_orders": (
        events_within_orders,
        f"""WITH {_E}, o AS (SELECT o_orderkey, o_custkey, {_us('o_orderdate')} AS opened, {_us('max(l_shipdate)')} AS closed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)
        SELECT o_orderkey, event_id, us - opened AS since_us FROM e JOIN o ON user_id = o_custkey AND us >= opened AND us < closed""",
    ),
    "events_within_shipments": (
        events_within_shipments,
        f"""WITH {_E} SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e JOIN lineitem ON user_id = l_suppkey JOIN orders ON o_orderkey = l_orderkey
        WHERE us >= {_us('o_orderdate')} AND us < {_us('l_shipdate')} GROUP BY l_orderkey, l_linenumber""",
    ),
}
