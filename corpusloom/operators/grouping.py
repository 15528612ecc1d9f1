"""Grouping sets from stored partial aggregates, and multisets of rows by their counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import files


def grouping_id(dims: Sequence[str], group: Sequence[str]) -> int:
    """A bit for each dimension, the first the highest, set where the dimension is summed up."""
    return sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in group)


def cube_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(dims), -1, -1) for c in combinations(dims, k)]


def rollup_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(dims[:k]) for k in range(len(dims), -1, -1)]


def partials(rows: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """``n, total, least, most`` of each group of all dimensions: states that can be merged.  Rows are combined before they are dealt out."""
    v = F.col(value)
    return rows.groupBy(*dims).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.count("*").alias("rows"))


def merged(states: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Partial states of fewer dimensions from those of more, or of several stored tables from their union."""
    return states.groupBy(*dims).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("rows").alias("rows"))


def grouping_sets(rows: DataFrame, dims: Sequence[str], value: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``dims, grouping_id, rows, n, total, least, most`` of every set of dimensions; a dimension that is summed up is null.

    The rows are read once, for the states of all dimensions together.  Each coarser set is merged from the smallest finer set that
    is there already, so what is dealt out shrinks from set to set.  Nulls in a dimension are a group of their own, told from
    summed-up ones by ``grouping_id``.  Whole numbers are added exactly.  A set without dimensions has one row, also for no rows at all.
    """
    finest = files.written(partials(rows, dims, value))
    known: list[tuple[frozenset[str], DataFrame, int]] = [(frozenset(dims), finest, finest.count())]
    out = None
    for group in sorted({tuple(s) for s in sets}, key=lambda g: (-len(g), g)):
        base = min((k for k in known if k[0] >= set(group)), key=lambda k: k[2])
        if base[0] == set(group):
            states = base[1]
        else:
            states = files.written(merged(base[1], group))
            known.append((frozenset(group), states, states.count()))
        shown = [F.col(d) if d in group else F.lit(None).cast(rows.schema[d].dataType).alias(d) for d in dims]
        part = states.select(*shown, F.lit(grouping_id(dims, group)).alias("grouping_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "n")], "total", "least", "most")
        out = part if out is None else out.unionAll(part)
    return out


def _counted(left: DataFrame, right: DataFrame, times: Column) -> DataFrame:
    tagged = left.select("*", F.lit(1).alias("_left"), F.lit(0).alias("_right")).unionAll(right.select(*left.columns, F.lit(0).alias("_left"), F.lit(1).alias("_right")))
    sums = tagged.groupBy(*left.columns).agg(F.sum("_left").alias("_l"), F.sum("_right").alias("_r"))
    return sums.withColumn("copies", times).where("copies > 0").drop("_l", "_r")


def intersect_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both tables hold, with ``copies``, as often as the rarer of them does (INTERSECT ALL); nulls are equal.

    Rows are counted before they are dealt out and never repeated, so a row that fills half of either table is one row from each task.
    """
    return _counted(left, right, F.least("_l", "_r"))


def except_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` with ``copies``, how much more often it holds them than ``right`` does (EXCEPT ALL)."""
    return _counted(left, right, F.col("_l") - F.col("_r"))


def repeated(counts: DataFrame, most: int = 1 << 16) -> DataFrame:
    """The rows of a counted table, each as often as ``copies`` says; very frequent ones are dealt over tasks in blocks of ``most``."""
    whole = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / most))
    blocks = counts.withColumn("_block", F.explode(whole)).withColumn("_times", F.least(F.lit(most), F.col("copies") - F.col("_block") * most).cast("int"))
    columns = [c for c in counts.columns if c != "copies"]
    return blocks.repartition(F.xxhash64(*columns, "_block")).withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(*columns)
