"""Points within intervals, as an equi-join on time bins at several levels.

An interval is filed at the first level in use whose bins are wide enough for it, so it touches two bins at most, however long it is.
Every third power of two is a level, so a point looks into one bin at each of 22 levels at most, and most intervals touch one bin.  Bins that hold very many points or intervals
are dealt over parts on either side, so that no task gets a whole one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import files

#: Rows of a bin, on one side, from which it is dealt over parts.
FULL_BIN = 1_000_000
#: Bins that are dealt over parts, at most; beyond it fuller ones are.
MOST_DEALT = 20_000
#: Powers of two between two levels.
STEP = 3
#: Groups of bins that are counted first; only bins of groups with as many rows as a full bin are counted one by one.
GROUPS = 1 << 14


def _bin(place: Column, level: Column) -> Column:
    """``floor(place / 2^level)``."""
    return F.call_function("shiftright", place, level.cast("int"))


def _level(first: Column, last: Column) -> Column:
    """The level of [first, last): a multiple of :data:`STEP`, 63 at most, with 2^level > last - 1 - first."""
    return F.least(F.ceil(F.length(F.bin(last - first - 1)) / STEP).cast("int") * STEP, F.lit(63))


def _valid(intervals: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    return intervals.dropna(subset=[*keys, start, end]).where(F.col(start).cast("long") < F.col(end).cast("long"))


def filed(intervals: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """``keys, level, bin, start, end, interval``: one or two rows for each interval [start, end) of long numbers that is not empty."""
    first, last = F.col(start).cast("long"), F.col(end).cast("long")
    own = _valid(intervals, start, end, keys)
    rows = own.select(*[own[k].alias(f"_key_{i}") for i, k in enumerate(keys)], _level(first, last).alias("_level"), first.alias("_start"), last.alias("_end"), F.struct(*intervals.columns).alias("interval"))
    bins = F.array_distinct(F.array(_bin(F.col("_start"), F.col("_level")), _bin(F.col("_end") - 1, F.col("_level"))))
    return rows.withColumn("_bin", F.explode(bins))


def _full_bins(own: DataFrame, cut: DataFrame, where: Sequence[str], full: int) -> DataFrame | None:
    """``np, ni``: points and intervals of those bins with both that may be full, None if no bin can be.

    Bins are counted in groups, which takes a few rows a task; a group with fewer rows than a full bin has none.
    """
    group = F.pmod(F.xxhash64(*where), F.lit(GROUPS)).cast("int").alias("_group")
    n, none = F.count("*"), F.lit(0).cast("long")
    both = lambda by: own.groupBy(*by).agg(n.alias("np"), none.alias("ni")).unionAll(cut.groupBy(*by).agg(none.alias("np"), n.alias("ni")))
    sums = both([group]).groupBy("_group").agg(F.sum("np").alias("np"), F.sum("ni").alias("ni"))
    heavy = [r._group for r in sums.where((F.col("np") > full) | (F.col("ni") > full)).select("_group").collect()]  # GROUPS numbers at most
    if not heavy:
        return None
    own, cut = (x.where(group.isin(heavy)) if len(heavy) < GROUPS else x for x in (own, cut))
    return files.written(both(where).groupBy(*where).agg(F.sum("np").alias("np"), F.sum("ni").alias("ni")).where("np > 0 and ni > 0"))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = (), full: int = FULL_BIN) -> DataFrame:
    """``point, interval``, both structs: every pair of a row of ``points`` and one of ``intervals`` with the same keys and start <= at < end.

    Times are whole numbers.  Rows with a null key or time, and intervals that end before they begin or at once, have no pairs.
    Repeated rows pair each.  Long intervals cost no more than short ones.
    """
    intervals = files.written(_valid(intervals, start, end, keys))
    cut = filed(intervals, start, end, keys)
    used = intervals.select(_level(F.col(start).cast("long"), F.col(end).cast("long")).alias("_level"))
    levels = sorted(r._level for r in used.distinct().collect())  # 22 at most
    key = [f"_key_{i}" for i in range(len(keys))]
    there = points.dropna(subset=[*keys, at])
    own = there.select(*[there[k].cast(intervals.schema[j].dataType).alias(c) for k, j, c in zip(keys, keys, key)], F.col(at).cast("long").alias("_at"), F.struct(*points.columns).alias("point"), F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("_level"))
    own = own.withColumn("_bin", _bin(F.col("_at"), F.col("_level")))
    where = [*key, "_level", "_bin"]
    dealt, counts = None, _full_bins(own, cut, where, full)
    if counts is not None:
        total = counts.agg(F.sum("np"), F.sum("ni")).first()
        # At most MOST_DEALT bins can hold more than that share of all their points or intervals together.
        points_most, intervals_most = (max(full, (x or 0) // (MOST_DEALT // 2)) for x in total)
        parts = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
        dealt = counts.where((F.col("np") > points_most) | (F.col("ni") > intervals_most)).select(*where, parts("np", points_most).alias("_pp"), parts("ni", intervals_most).alias("_ip"))
    if dealt is None or dealt.isEmpty():
        joined = own.join(cut, where)
    else:
        few = F.broadcast(dealt)
        one = F.lit(1)
        part = lambda x, n: F.pmod(F.xxhash64(*x), F.coalesce(n, one)).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))
        left = own.join(few, where, "left").withColumn("_a", part(["_at", "point"], F.col("_pp"))).withColumn("_b", copies(F.col("_ip")))
        right = cut.join(few, where, "left").withColumn("_b", part(["_start", "_end", "interval"], F.col("_ip"))).withColumn("_a", copies(F.col("_pp")))
        joined = left.drop("_pp", "_ip").join(right.drop("_pp", "_ip"), [*where, "_a", "_b"])
    return joined.where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))).select("point", "interval")
