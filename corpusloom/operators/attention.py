"""Multi-head attention over sequences of vectors, one row a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V


def split_heads(v: Column, heads: int, width: int) -> Column:
    """``heads`` arrays of ``width / heads`` numbers."""
    size = width // heads
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(v, h * size + 1, F.lit(size)))


def multi_head(rows: DataFrame, sequence: str, place: str, query: str, key: str, value: str, width: int, heads: int, causal: bool = True, turned: bool = False) -> DataFrame:
    """``sequence, place, attended``: the heads' weighted sums of values, one head after the other.

    Products are scaled by the root of a head's width; the largest of a row is taken off before the exponential.  With ``causal`` a place sees
    itself and earlier ones; with ``turned`` queries and keys are turned by their places first.  A row meets the rows of its own
    sequence only.  Sequences are as long as a context; nothing is held for a whole one but its weighted sums.
    """
    size = width // heads
    if size * heads != width:
        raise ValueError(f"{width} numbers cannot be dealt to {heads} heads")

    def part(name: str, turn: bool = False) -> Column:
        x = F.get(split_heads(F.col(name), heads, width), F.col("_head"))
        return V.rotate(x, F.col(place), size) if turn else x

    split = rows.withColumn("_head", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    asked = split.select(sequence, place, "_head", part(query, turned).alias("_q"))
    held = split.select(sequence, "_head", F.col(place).alias("_other"), part(key, turned).alias("_k"), part(value).alias("_w"))
    pairs = asked.join(held, [sequence, "_head"])
    if causal:
        pairs = pairs.where(F.col("_other") <= F.col(place))
    scored = pairs.select(sequence, "_head", place, (V.dot(F.col("_q"), F.col("_k")) / float(size) ** 0.5).alias("_s"), "_w")
    # Sums are kept against the largest score so far of each task, so that they can be added up in parts.
    tops = scored.groupBy(sequence, "_head", place).agg(F.max("_s").alias("_top"))
    raised = scored.join(tops, [sequence, "_head", place]).withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    summed = raised.select(sequence, "_head", place, "_e", F.posexplode("_w").alias("_j", "_x")).groupBy(sequence, "_head", place, "_j").agg((F.sum(F.col("_e") * F.col("_x")) / F.sum("_e")).alias("_y"))
    ordered = summed.groupBy(sequence, place).agg(F.array_sort(F.collect_list(F.struct("_head", "_j", "_y"))).alias("_all"))  # as many numbers as a vector has
    return ordered.select(sequence, place, F.transform("_all", lambda t: t["_y"]).alias("attended"))
