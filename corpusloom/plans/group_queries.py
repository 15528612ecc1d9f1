"""Cubes, rankings, frames, multisets, sketches and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import grouping, segments, sketches
from corpusloom.plans.corpus_queries import table
from corpusloom.sources import files

_DIMS = ["region", "nation", "segment"]


def _sales(spark, sf):
    """Line items with where they went; revenue in hundredths of cents, which add up exactly."""
    revenue = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "nation", "region", F.col("c_mktsegment").alias("segment"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", revenue.alias("revenue")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*_DIMS, "revenue")


def _totals(out):
    return out.select(*_DIMS, F.col("grouping_id").cast("long").alias("grouping_id"), "n", F.col("total").alias("revenue"), F.col("least").alias("least_item"), F.col("most").alias("largest_item"))


def revenue_cube(spark, sf):
    return _totals(grouping.grouping_sets(_sales(spark, sf), _DIMS, "revenue", grouping.cube_sets(_DIMS)))


def revenue_rollup(spark, sf):
    return _totals(grouping.grouping_sets(_sales(spark, sf), _DIMS, "revenue", grouping.rollup_sets(_DIMS)))


def revenue_sets(spark, sf):
    return _totals(grouping.grouping_sets(_sales(spark, sf), _DIMS, "revenue", [("region", "segment"), ("nation",), ()]))


def ranked_items(spark, sf):
    """All line items ranked by price, over the whole table."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))
    out = segments.ranked(rows, [], "price", ("l_orderkey", "l_linenumber"), tiles=7)
    return out.select("l_orderkey", "l_linenumber", "row_number", "rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"), F.col("ntile").cast("long").alias("ntile"))


def ranked_by_flag(spark, sf):
    """Line items ranked by quantity, with many ties, within each of a few return flags."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    out = segments.ranked(rows, ["l_returnflag"], "l_quantity", ("l_orderkey", "l_linenumber"), tiles=10)
    return out.select("l_orderkey", "l_linenumber", "row_number", "rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"), F.col("ntile").cast("long").alias("ntile"))


_DAY = 86_400


def weekly_frames(spark, sf):
    """Items and quantity that each supplier shipped in the seven days up to each of its days of shipment."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)").alias("t"), F.col("l_quantity").cast("long").alias("quantity"))
    return segments.range_frames(rows, ["l_suppkey"], "t", "quantity", 6 * _DAY)


def monthly_frames(spark, sf):
    """The same over all suppliers together, in the 30 days up to each day."""
    rows = table(spark, sf, "lineitem").select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)").alias("t"), F.col("l_quantity").cast("long").alias("quantity"))
    return segments.range_frames(rows, [], "t", "quantity", 29 * _DAY)


_COLUMNS = ("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")


def _month(spark, sf, month):
    return table(spark, sf, "lineitem").where(F.date_format("l_shipdate", "yyyy-MM") == month).select(*_COLUMNS)


def items_of_both_months(spark, sf):
    return grouping.intersect_counts(_month(spark, sf, "1996-03"), _month(spark, sf, "1996-04"))


def items_of_one_month(spark, sf):
    """The rows themselves, as often as the later month lacks them."""
    return grouping.repeated(grouping.except_counts(_month(spark, sf, "1996-03"), _month(spark, sf, "1996-04")))


def sketched_words(spark, sf):
    """Words of each source: states are kept by source and language and merged by source; whether all estimates lie within their bounds."""
    words = sketches.words(table(spark, sf, "documents"), ["source", "lang"])
    states = files.written(sketches.sketch(words, ["source", "lang"], item="word"))
    found = sketches.estimates(sketches.merge(states, ["source"]), top=5)
    exact = files.written(words.groupBy("source", "word").agg(F.count("*").alias("c")))
    sizes = exact.groupBy("source").agg(F.count("*").alias("distinct"), F.sum("c").alias("n"))
    close = F.abs(F.col("n_distinct") - F.col("distinct")) <= 5 * sketches.distinct_error() * F.col("distinct") + 1
    listed = found.select("source", F.explode("heaviest").alias("h")).select("source", F.col("h.item").alias("word"), F.col("h.count").alias("about"))
    slack = F.col("n") / (0.75 * sketches.COUNTERS)
    kept = listed.join(exact, ["source", "word"]).join(sizes.select("source", "n"), "source").groupBy("source").agg(F.min(F.abs(F.col("about") - F.col("c")) <= slack).alias("heavy_ok"), F.max("c").alias("most"))
    return found.join(sizes, "source").join(kept, "source").select("source", F.col("rows").alias("n_words"), F.col("distinct").alias("n_distinct"), F.col("most").alias("most_frequent"), close.alias("distinct_ok"), "heavy_ok")


def sketched_values(spark, sf):
    """Quartiles of the values of each type of event: states are kept by type and day and merged by type; whether their ranks lie within bounds."""
    events = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    states = files.written(sketches.sketch(events, ["event_type", "day"], number="value"))
    found = sketches.estimates(sketches.merge(states, ["event_type"]))
    at = found.select("event_type", F.posexplode("at_ranks").alias("k", "about"))
    ranked = events.join(at, "event_type").groupBy("event_type", "k").agg((F.sum((F.col("value") <= F.col("about")).cast("long")) / F.count("value")).alias("upto"), (F.sum((F.col("value") < F.col("about")).cast("long")) / F.count("value")).alias("below"))
    asked = (F.col("k") + 1) * 0.25
    good = ranked.groupBy("event_type").agg(F.min((F.col("below") <= asked + 0.03) & (F.col("upto") >= asked - 0.03)).alias("quartiles_ok"))
    return found.join(good, "event_type").select("event_type", F.col("rows").alias("n"), "quartiles_ok")


def _dialogues(spark, sf):
    tables.register(spark)
    table(spark, sf, "conversations").createOrReplaceTempView("_turns")


def dialogue_states(spark, sf):
    _dialogues(spark, sf)
    return spark.sql("SELECT * FROM dialogue_state(TABLE(SELECT conv_id, turn, role, text FROM _turns) PARTITION BY conv_id ORDER BY turn)")


def dialogue_summaries(spark, sf):
    _dialogues(spark, sf)
    return spark.sql("SELECT conv_id, turns, chars, longest FROM dialogue_summary(TABLE(SELECT conv_id, turn, role, text FROM _turns) PARTITION BY conv_id ORDER BY turn)")


_SALES = """WITH s AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _grouped(sets: str) -> str:
    return f"{_SALES} SELECT region, nation, segment, grouping_id(region, nation, segment) AS grouping_id, count(*) AS n, CAST(sum(revenue) AS BIGINT) AS revenue, min(revenue) AS least_item, max(revenue) AS largest_item FROM s GROUP BY {sets}"


def _ranking(source: str, part: str, tiles: int) -> str:
    w, t = f"({part} ORDER BY v)", f"({part} ORDER BY v, l_orderkey, l_linenumber)"
    return f"SELECT l_orderkey, l_linenumber, row_number() OVER {t} AS row_number, rank() OVER {w} AS rank, round(percent_rank() OVER {w}, 9) AS percent_rank, round(cume_dist() OVER {w}, 9) AS cume_dist, ntile({tiles}) OVER {t} AS ntile FROM ({source})"


_MONTHS = [f"SELECT {', '.join(_COLUMNS)} FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '{m}'" for m in ("1996-03", "1996-04")]
_WORDS = r"SELECT source, unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')) AS word FROM documents"

QUERIES = {
    "revenue_cube": (revenue_cube, _grouped("CUBE (region, nation, segment)")),
    "revenue_rollup": (revenue_rollup, _grouped("ROLLUP (region, nation, segment)")),
    "revenue_sets": (revenue_sets, _grouped("GROUPING SETS ((region, segment), (nation), ())")),
    "ranked_items": (ranked_items, _ranking("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem", "", 7)),
    "ranked_by_flag": (ranked_by_flag, _ranking("SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity AS v FROM lineitem", "PARTITION BY l_returnflag", 10)),
    "weekly_frames": (
        weekly_frames,
        "SELECT DISTINCT l_suppkey, epoch_us(l_shipdate) // 1000000 AS time, count(*) OVER w AS n, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS total FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)",
    ),
    "monthly_frames": (
        monthly_frames,
        "SELECT DISTINCT epoch_us(l_shipdate) // 1000000 AS time, count(*) OVER w AS n, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS total FROM lineitem WINDOW w AS (ORDER BY l_shipdate RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)",
    ),
    "items_of_both_months": (items_of_both_months, f"SELECT {', '.join(_COLUMNS)}, count(*) AS copies FROM ({_MONTHS[0]} INTERSECT ALL {_MONTHS[1]}) GROUP BY ALL"),
    "items_of_one_month": (items_of_one_month, f"{_MONTHS[0]} EXCEPT ALL {_MONTHS[1]}"),
    "sketched_words": (
        sketched_words,
        f"SELECT source, CAST(sum(c) AS BIGINT) AS n_words, count(*) AS n_distinct, max(c) AS most_frequent, true AS distinct_ok, true AS heavy_ok FROM (SELECT source, word, count(*) AS c FROM ({_WORDS}) WHERE word <> '' GROUP BY ALL) GROUP BY source",
    ),
    "sketched_values": (sketched_values, "SELECT event_type, count(*) AS n, true AS quartiles_ok FROM events GROUP BY event_type"),
    "dialogue_states": (
        dialogue_states,
        """SELECT conv_id, turn, row_number() OVER w - 1 AS place, CAST(coalesce(sum(length(t)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before, row_number() OVER (PARTITION BY conv_id, r, run ORDER BY turn) AS same_role_run, lag(turn) OVER (PARTITION BY conv_id, r ORDER BY turn) AS last_of_role
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, r ORDER BY turn) AS run FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations)) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    ),
    "dialogue_summaries": (dialogue_summaries, "SELECT conv_id, count(*) AS turns, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, max(length(coalesce(text, ''))) AS longest FROM conversations GROUP BY conv_id"),
}
