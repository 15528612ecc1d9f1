"""Series: exponential moving averages, running means, checkpoints, regression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.functions.stats import t_quantile, t_upper
from corpusloom.operators import segments

BETA = 0.99


def final_ema(rows: DataFrame, key: str, order: tuple[str, ...], value: str, beta: float = BETA) -> DataFrame:
    """``key, n, ema``: the average after each key's last value, the first value being its seed; null values are passed over."""
    steps = ema(rows, key, order, value, beta)
    return steps.groupBy(key).agg(F.count("*").alias("n"), F.max_by("ema", F.struct(*order)).alias("ema"))


def ema(rows: DataFrame, key: str, order: tuple[str, ...], value: str, beta: float = BETA, seeds: dict | DataFrame | None = None) -> DataFrame:
    """Every step of the average as column ``ema``; ``seeds`` resumes keys from an earlier average.

    The steps are maps s -> beta s + (1 - beta) x, composed range by range (:mod:`corpusloom.operators.segments`), so
    a key of any length is spread over tasks.  Seeds for many keys are a table of the key and ``ema`` and are joined to the rows.
    """
    columns = [*dict.fromkeys([key, *order, value])]
    dealt = rows.select(*columns).withColumn(value, F.col(value).cast("double"))
    composed = segments.scan(dealt, [key], order, segments.affine(value, beta))
    if seeds is None or (isinstance(seeds, dict) and not seeds):
        start = F.col("first")
    else:
        table = seeds if isinstance(seeds, DataFrame) else rows.sparkSession.createDataFrame(list(seeds.items()), ST.StructType([rows.schema[key], ST.StructField("ema", ST.DoubleType())]))
        composed = composed.join(table.select(key, F.col("ema").alias("_seed")), key, "left")
        start = F.coalesce("_seed", "first")
    return composed.select(*columns, (F.col("decay") * start + F.col("shift")).alias("ema"))


def running_mean(rows: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Mean of a key's values up to each row, as ``mean``, with the row's ``step`` from 1; whole numbers are added exactly."""
    exact = isinstance(rows.schema[value].dataType, ST.IntegralType)
    marked = rows.withColumns({"_one": F.lit(1), "_there": F.col(value).isNotNull().cast("long")})
    counted = segments.scan(marked, [key], order, segments.sums({"step": "_one", "_n": "_there", **({"_sum": value} if exact else {})}))
    if not exact:
        counted = segments.scan(counted.withColumn("_x", F.col(value).cast("double")), [key], order, segments.double_sums({"_sum": "_x"}))
    return counted.withColumn("mean", F.try_divide("_sum", "_n")).select(*[F.col(f"`{c}`") for c in rows.columns], "step", "mean")


def checkpoints(rows: DataFrame, step: str, every: int) -> DataFrame:
    return rows.where((F.col(step) % every == 0) & (F.col(step) > 0))


def regression(rows: DataFrame, x: str, y: str, scale: float = 1.0) -> DataFrame:
    """Least-squares line of ``y`` on ``x / scale``: one row with fit, error of the slope, t and both forms of S.

    ``s_reported`` is sqrt(se^2 df / (n - 1)), which is not the residual standard error ``s``.
    """
    a, b = F.col(x).cast("double") / scale, F.col(y).cast("double")
    sums = rows.select(a.alias("x"), b.alias("y")).agg(
        F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
    )
    df = F.col("n") - 2
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / df
    fit = sums.withColumns({"df": df, "r": F.signum("slope") * F.sqrt("r_squared"), "s": F.sqrt(residual), "stderr": F.sqrt(residual / F.col("sxx"))})
    return fit.withColumns({"t": F.col("slope") / F.col("stderr"), "s_reported": F.sqrt(F.col("stderr") * F.col("stderr") * F.col("df") / (F.col("n") - 1))}).drop("sxx", "syy", "sxy")


def slope_test(fit: DataFrame, level: float = 0.95) -> DataFrame:
    """``fit`` with the one-sided p value of a positive slope and the confidence interval; one row, so Python may serve."""
    @F.pandas_udf("p double, t_crit double")
    def test(t: pd.Series, df: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(t_upper(a, b), t_quantile(0.5 + level / 2, b)) for a, b in zip(t, df)], columns=["p", "t_crit"])

    tested = fit.withColumn("test", test(F.col("t"), F.col("df").cast("double")))
    half = F.col("test.t_crit") * F.col("stderr")
    return tested.withColumns({"p": F.col("test.p"), "t_crit": F.col("test.t_crit"), "ci_low": F.col("slope") - half, "ci_high": F.col("slope") + half}).drop("test")


def projection_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The same line by projection on the constant and on what of ``x`` is orthogonal to it, in two passes."""
    points = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    centre = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).first()  # one row
    mx, my = F.lit(centre.mx), F.lit(centre.my)
    part = F.col("x") - mx
    return points.agg((F.sum(F.col("y") * part) / F.sum(part * part)).alias("slope")).select("slope", (my - F.col("slope") * mx).alias("intercept"))


def residuals(rows: DataFrame, fit: DataFrame, x: str, y: str) -> DataFrame:
    """``rows`` with ``fitted`` and ``residual`` of a one-row ``fit``."""
    line = fit.select("slope", "intercept").first()
    return rows.withColumn("fitted", F.lit(line.slope) * F.col(x) + F.lit(line.intercept)).withColumn("residual", F.col(y) - F.col("fitted"))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """``bin, n``: equal bins from the least to the largest value, the last including its upper edge; empty bins too."""
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if ends.low is None or ends.low == ends.high:
        place = F.lit(0)
    else:
        place = F.least(F.floor((F.col(value) - ends.low) / ((ends.high - ends.low) / bins)), F.lit(bins - 1)).cast("int")
    all_bins = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def interpolate(points: DataFrame, targets: DataFrame, x: str, y: str, at: str) -> DataFrame:
    """``targets`` with ``value``: piecewise linear through the points (a few), extended beyond both ends."""
    order = W.orderBy(x)
    ends = points.select(F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1"), F.row_number().over(order).alias("k")).where("x1 is not null")
    last = points.count() - 1
    inside = ((F.col("k") == 1) | (F.col(at) >= F.col("x0"))) & ((F.col("k") == last) | (F.col(at) < F.col("x1")))
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return targets.join(F.broadcast(ends), inside).withColumn("value", F.col("y0") + slope * (F.col(at) - F.col("x0"))).drop("x0", "x1", "y0", "y1", "k")


def latest_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def clipped_together(rows: DataFrame, gradient: str, most: float, epsilon: float = 1e-6) -> DataFrame:
    """Vectors of all rows scaled down by one factor, so that their common norm is at most ``most``; one number reaches the driver."""
    square = rows.agg(F.sum(F.aggregate(gradient, F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    factor = min(1.0, most / (square**0.5 + epsilon))
    return rows.withColumn(gradient, F.transform(gradient, lambda x: x * factor))
