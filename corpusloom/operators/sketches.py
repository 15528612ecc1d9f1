"""Sketches kept by group and merged later: distinct values, heavy values and quantiles in bounded space.

States are binary columns of a table, one row a group (say source and day), and add up: the state of a union is the merge of its parts' states,
so a new day is sketched alone and old rows are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Registers of a distinct count are 2 to this power; its relative standard error is 1.04 / sqrt(registers).
DISTINCT_BITS = 12
#: Size of a quantile state; a rank is off by at most about 1.65 % of the rows.
QUANTILE_SIZE = 200
#: Counters of heavy values: a value's count is off by at most rows / (0.75 x counters).
COUNTERS = 1024


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    return 1.04 / 2 ** (bits / 2)


def sketch(rows: DataFrame, by: Sequence[str], item: str | None = None, number: str | None = None) -> DataFrame:
    """``by, rows`` and the states ``distinct`` and ``heavy`` of ``item``, ``quantiles`` of ``number``.

    Tasks sketch their own rows, and states are what is dealt out, so a group of any size costs a task its state.  Nulls are not counted
    in the states.
    """
    states = [F.count("*").alias("rows")]
    if item is not None:
        states += [F.hll_sketch_agg(item, DISTINCT_BITS).alias("distinct"), F.call_function("approx_top_k_accumulate", F.col(item), F.lit(COUNTERS)).alias("heavy")]
    if number is not None:
        states.append(F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(QUANTILE_SIZE)).alias("quantiles"))
    return rows.groupBy(*by).agg(*states)


def merge(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored states of finer groups merged into those of ``by``."""
    found = [F.sum("rows").alias("rows")]
    if "distinct" in states.columns:
        found += [F.hll_union_agg("distinct").alias("distinct"), F.call_function("approx_top_k_combine", F.col("heavy"), F.lit(COUNTERS)).alias("heavy")]
    if "quantiles" in states.columns:
        found.append(F.kll_merge_agg_double("quantiles").alias("quantiles"))
    return states.groupBy(*by).agg(*found)


def estimates(states: DataFrame, top: int = 10, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``n_distinct``; ``heaviest``, an array of (item, count); and ``at_ranks``, the values at ``ranks``, in place of the states."""
    out = states
    if "distinct" in states.columns:
        out = out.withColumns({"n_distinct": F.hll_sketch_estimate("distinct"), "heaviest": F.call_function("approx_top_k_estimate", F.col("heavy"), F.lit(top))})
    if "quantiles" in states.columns:
        out = out.withColumn("at_ranks", F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(float(r)) for r in ranks])))
    return out.drop("distinct", "heavy", "quantiles")


def words(docs: DataFrame, by: Sequence[str], text_col: str = "text") -> DataFrame:
    """``by, word``: a row for each run of other than ASCII white space, whole texts."""
    parts = F.split(F.coalesce(F.col(text_col).cast(ST.StringType()), F.lit("")), r"[\x20\x09-\x0D]+")
    return docs.select(*by, F.explode(parts).alias("word")).where("word <> ''")
