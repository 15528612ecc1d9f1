"""Running totals and positions over a whole table without a single-task window.

Rows are dealt into ranges of their order key, a window runs inside each range, and what comes
before a range is added from a table with one row per range.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges at least.
RANGES = 64


def shuffle_key(seed: int, *ids: str) -> Column:
    """A repeatable random order: 52 bits of SHA-256 of the seed and the ids, as a long; the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *ids: str) -> Column:
    """A repeatable number in [0, 1) for each row."""
    return shuffle_key(seed, *ids) / float(1 << 52)


def ranges_of(df: DataFrame) -> int:
    """As many ranges as a shuffle of the session has partitions."""
    return max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_ranges(df: DataFrame, key: str, ranges: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_range`` and ``_part``, which in this order never fall as ``key`` and then the first of ``ties`` grow.

    Null keys come last.  Where one key fills several ranges, its rows are dealt over as many parts by
    the quantiles of the first tie, if that is a number or text; of text, seven bytes behind what all ties of the
    key begin with.  Without a tie a key's rows are of one part.
    """
    bounds = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    distinct = sorted(set(bounds))
    cuts = F.array(*[F.lit(b) for b in distinct]) if bounds else F.array().cast("array<bigint>")
    dealt = df.withColumn("_range", F.when(F.col(key).isNull(), F.lit(ranges)).otherwise(F.size(F.filter(cuts, lambda b: b < F.col(key)))))
    part = F.lit(0)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    text = bool(ties) and kinds[ties[0]] == "string"
    if ties and (text or kinds[ties[0]] in ("byte", "short", "integer", "long", "float", "double", "date", "timestamp")) and (hot := [b for b in distinct if bounds.count(b) > 1]):
        # Quantiles of the tie within each key that fills ranges: at most as many numbers as ranges.
        own_rows = dealt.where(F.col(key).isin(hot)).groupBy(F.col(key))
        skipped = F.lit(0)
        if text:
            for r in own_rows.agg(F.min(ties[0]), F.max(ties[0])).collect():
                skipped = F.when(F.col(key) == r[0], F.lit(len(os.path.commonprefix([(x or "").encode() for x in r[1:]])))).otherwise(skipped)
        tie = F.conv(F.rpad(F.hex(F.substring(F.col(ties[0]).cast("binary"), skipped + 1, F.lit(7))), 14, "0"), 16, 10).cast("long") if text else F.col(ties[0])
        spread = {r[0]: r[1] for r in own_rows.agg(F.percentile_approx(tie, [k / ranges for k in range(1, ranges)], 20 * ranges)).collect()}
        for b in hot:
            own = sorted(set((spread.get(b) or [])[:: max(1, ranges // bounds.count(b))]))
            steps = F.size(F.filter(F.array(*[F.lit(x) for x in own]), lambda x: x < tie)) if own else F.lit(0)
            # Smaller keys of the same range come before all parts, so these count from 1.
            part = F.when(F.col(key) == b, F.when(F.col(ties[0]).isNull(), 1).otherwise(1 + steps)).otherwise(part)
    return dealt.withColumn("_part", part)


def running(df: DataFrame, key: str, value: Column | None = None, ties: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``pos``, its place from 0 in the order of ``key`` and ``ties``, and ``before``, the sum of ``value`` over all earlier rows."""
    dealt = with_ranges(df, key, ranges or ranges_of(df), ties).withColumn("_value", value if value is not None else F.lit(0))
    sums = dealt.groupBy("_range", "_part").agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))  # one row a range and part
    upto = W.orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_range", "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_sum_before"))
    inside = W.partitionBy("_range", "_part").orderBy(F.col(key).asc_nulls_last(), *ties)
    placed = dealt.withColumns({"_row": F.row_number().over(inside), "_upto": F.sum("_value").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))})
    joined = placed.join(F.broadcast(offsets), ["_range", "_part"])  # at most twice as many rows as ranges
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_rows_before") + F.col("_row") - 1).alias("pos"), (F.col("_sum_before") + F.col("_upto") - F.col("_value")).alias("before"))
