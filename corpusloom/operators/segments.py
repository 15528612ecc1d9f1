"""Associative scans along each key's rows, however many a key has.

Rows are dealt into ranges of (key, order), so one key may fill many ranges.  Each task scans its range
on its own; what a key brings along from earlier ranges is folded from a table of one row a range and
joined to the rows of a range's first key.  No task holds a whole key, and no row moves twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.session import ship
from corpusloom.sources import files


#: Rows of one range of :func:`range_frames`, about.
FRAME_ROWS = 500_000


@dataclass(frozen=True)
class Scan:
    """What is scanned.

    ``state`` names the state's columns and their types.  ``local(batch, starts, before)`` returns their values after each
    row of a sorted batch; ``starts`` marks the first row of a key, and ``before`` is the state, in
    arrays of one row, that the first row goes on from (None where it starts a key).  ``join`` folds the states of
    two neighbouring runs of a key, and ``apply`` does so in columns for all rows of the later run.
    """

    state: dict[str, ST.DataType]
    local: Callable[[pa.RecordBatch, np.ndarray, list[pa.Array] | None], list[pa.Array]]
    join: Callable[[Sequence[Any], Sequence[Any]], Sequence[Any]]
    apply: Callable[[list[Column], list[Column]], list[Column]]


def _starts(batch: pa.RecordBatch, places: list[int], last: list | None) -> np.ndarray:
    """Whether each row's key differs from that of the row before it; nulls are one key."""
    import pyarrow.compute as pc

    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    for k in places:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, n - 1)
        out[1:] |= pc.coalesce(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False).astype(bool)
    out[0] = last is None or [batch.column(k)[0].as_py() for k in places] != last
    return out


def runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of each stretch of rows of one key in a batch, that which goes on from an earlier batch too."""
    cuts = np.flatnonzero(starts)
    edges = [0, *cuts[cuts > 0].tolist(), len(starts)]
    return zip(edges, edges[1:])


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], what: Scan, ranges: int | None = None, keep: Callable[[DataFrame], DataFrame] = files.written) -> DataFrame:
    """``rows`` with the columns of ``what.state``: the scan over the rows of the same keys up to each, in ``order``.

    Nulls come first, and null keys are one key.  Rows that tie in keys and order are in no fixed order; name a column
    that tells them apart where that matters.  ``keep`` writes the scanned ranges (to the shared folder), so that
    their bounds are fixed.  The driver gets one row a range.  An empty table stays empty.
    """
    ship(rows.sparkSession)
    prefix = "_scan"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix = "_" + prefix
    part, row, lead, carried = (f"{prefix}_{x}" for x in ("part", "row", "lead", "carried"))
    own = [f"{prefix}_own_{k}" for k in range(len(what.state))]
    places = [rows.columns.index(c) for c in keys]
    local = what.local

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        task, last, state, seen, keys_seen = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = _starts(batch, places, last)
            values = local(batch, starts, None if starts[0] else state)
            nth = keys_seen + np.cumsum(starts)
            extra = [pa.array(np.full(n, task, dtype=np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(nth == 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra, *values], names=[*batch.schema.names, part, row, lead, *own])
            last, state = [batch.column(k)[n - 1].as_py() for k in places], [v.slice(n - 1) for v in values]
            seen, keys_seen = seen + n, int(nth[-1])

    states = [ST.StructField(c, t) for c, t in zip(own, what.state.values())]
    schema = ST.StructType([*rows.schema.fields, ST.StructField(part, ST.IntegerType()), ST.StructField(row, ST.LongType()), ST.StructField(lead, ST.BooleanType()), *states])
    by = [F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order)]
    count = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = keep(rows.repartitionByRange(count, *by).sortWithinPartitions(*by).mapInArrow(run, schema))

    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    ends = table.groupBy(part).agg(F.min_by(key, row).alias("first"), F.max_by(key, row).alias("last"), F.max_by(F.struct(*own), row).alias("state")).orderBy(part).collect()
    brought, state, before = [], None, None
    for r in ends:
        goes_on = before is not None and r.first == before
        if goes_on:
            brought.append((r[part], *state))
        state = tuple(what.join(state, r.state)) if goes_on and r.first == r.last else tuple(r.state)
        before = r.last
    result = [F.col(f"`{c}`") for c in rows.columns]
    if not brought:
        return table.select(*result, *[F.col(c).alias(name) for c, name in zip(own, what.state)])
    earlier = [f"{carried}_{k}" for k in range(len(own))]
    few = rows.sparkSession.createDataFrame(brought, ST.StructType([ST.StructField(part, ST.IntegerType()), *[ST.StructField(c, t) for c, t in zip(earlier, what.state.values())]]))
    joined = table.join(F.broadcast(few.withColumn(carried, F.lit(True))), part, "left")  # at most one row a range
    later = what.apply([F.col(c) for c in earlier], [F.col(c) for c in own])
    there = F.col(lead) & F.col(carried).isNotNull()
    return joined.select(*result, *[F.when(there, new).otherwise(F.col(c)).alias(name) for new, c, name in zip(later, own, what.state)])


def sums(columns: dict[str, str]) -> Scan:
    """Running sums of ``columns`` (result name: column); integers are added exactly, nulls count as nothing."""

    def local(batch: pa.RecordBatch, starts: np.ndarray, before: list[pa.Array] | None) -> list[pa.Array]:
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        for k, c in enumerate(columns.values()):
            x = batch.column(batch.schema.names.index(c))
            x = pc.fill_null(x.cast(pa.float64() if pa.types.is_floating(x.type) else pa.int64()), 0).to_numpy(zero_copy_only=False)
            total = np.empty_like(x)
            for a, b in runs(starts):
                np.cumsum(x[a:b], out=total[a:b])
                if a == 0 and before is not None:
                    total[a:b] += before[k][0].as_py()
            out.append(pa.array(total))
        return out

    return Scan({c: ST.LongType() for c in columns}, local, lambda a, b: [x + y for x, y in zip(a, b)], lambda a, b: [x + y for x, y in zip(a, b)])


def double_sums(columns: dict[str, str]) -> Scan:
    """:func:`sums` of fractional columns."""
    whole = sums(columns)
    return Scan({c: ST.DoubleType() for c in columns}, whole.local, whole.join, whole.apply)


def affine(value: str, beta: float) -> Scan:
    """Composed steps s -> beta s + (1 - beta) x of a moving average, nulls leaving s as it is.

    The state is the map s -> decay s + shift of all steps so far, and the first value, from which an
    average without an earlier one starts.
    """

    def local(batch: pa.RecordBatch, starts: np.ndarray, before: list[pa.Array] | None) -> list[pa.Array]:
        import pyarrow as pa

        a, b, first = (1.0, 0.0, None) if before is None else (x[0].as_py() for x in before)
        decay, shift, seed = [], [], []
        for x, new in zip(batch.column(batch.schema.names.index(value)).to_pylist(), starts.tolist()):
            if new:
                a, b, first = 1.0, 0.0, None
            if x is not None:
                a, b, first = a * beta, beta * b + (1 - beta) * x, x if first is None else first
            decay.append(a)
            shift.append(b)
            seed.append(first)
        return [pa.array(c, pa.float64()) for c in (decay, shift, seed)]

    def join(left: Sequence[Any], right: Sequence[Any]) -> Sequence[Any]:
        return right[0] * left[0], right[0] * left[1] + right[1], right[2] if left[2] is None else left[2]

    def apply(left: list[Column], right: list[Column]) -> list[Column]:
        return [right[0] * left[0], right[0] * left[1] + right[1], F.coalesce(left[2], right[2])]

    return Scan({"decay": ST.DoubleType(), "shift": ST.DoubleType(), "first": ST.DoubleType()}, local, join, apply)


def latest(column: str, kind: ST.DataType) -> Scan:
    """The latest value of ``column`` that is not null, as ``latest``."""

    def local(batch: pa.RecordBatch, starts: np.ndarray, before: list[pa.Array] | None) -> list[pa.Array]:
        import pyarrow as pa

        x = batch.column(batch.schema.names.index(column))
        places = np.arange(1, len(x) + 1)
        found = np.maximum.accumulate(np.where(x.is_valid().to_numpy(zero_copy_only=False), places, 0))
        begin = np.maximum.accumulate(np.where(starts, places, 0))  # 0: goes on from an earlier batch
        taken = np.where(found >= np.maximum(begin, 1), found, 0)
        none = (taken == 0) & ((begin > 0) | (before is None))
        held = pa.concat_arrays([before[0] if before is not None else pa.nulls(1, x.type), x])
        return [held.take(pa.array(taken, mask=none))]

    return Scan({"latest": kind}, local, lambda a, b: a if b[0] is None else b, lambda a, b: [F.coalesce(b[0], a[0])])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, ties: Sequence[str] = (), same_time: bool = False, name: str = "match", ranges: int | None = None, keep: Callable[[DataFrame], DataFrame] = files.written) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` before it that has its keys, as a struct ``name`` (null: none).

    ``same_time`` lets a row of the same time serve too.  Of rows of ``right`` at one time that with the largest
    ``ties`` (columns of ``right``; nulls smallest) is the latest.  Rows of ``left`` with a null key or time match nothing, nor do
    such rows of ``right``.  Both sides go through one range shuffle; every row of ``left`` comes out once.
    """
    sides = {"left": 1 if same_time else 0, "right": 0 if same_time else 1}
    by = [f"_key_{i}" for i in range(len(keys))]
    tie = [f"_tie_{i}" for i in range(len(ties))]
    usable = right.dropna(subset=[*keys, right_time])
    rows = {
        "left": left.select(*[left[k].alias(c) for k, c in zip(keys, by)], left[left_time].alias("_time"), F.lit(sides["left"]).alias("_side"), *[F.lit(None).cast(right.schema[t].dataType).alias(c) for t, c in zip(ties, tie)], F.struct(*left.columns).alias("_left"), F.lit(None).cast(ST.StructType(right.schema.fields)).alias("_right")),
        "right": usable.select(*[usable[k].cast(left.schema[k].dataType).alias(c) for k, c in zip(keys, by)], usable[right_time].cast(left.schema[left_time].dataType).alias("_time"), F.lit(sides["right"]).alias("_side"), *[usable[t].alias(c) for t, c in zip(ties, tie)], F.lit(None).cast(ST.StructType(left.schema.fields)).alias("_left"), F.struct(*right.columns).alias("_right")),
    }
    both = rows["left"].unionAll(rows["right"])
    found = scan(both, by, ["_time", "_side", *tie], latest("_right", both.schema["_right"].dataType), ranges, keep)
    return found.where(F.col("_side") == sides["left"]).select("_left.*", F.col("latest").alias(name))


def ranks(value: str, kind: ST.DataType) -> Scan:
    """``place`` from 1 in the order of ``value``, and ``tie``, the place among the rows of equal value (nulls are equal)."""

    def local(batch: pa.RecordBatch, starts: np.ndarray, before: list[pa.Array] | None) -> list[pa.Array]:
        import pyarrow as pa
        import pyarrow.compute as pc

        at = batch.schema.names.index(value)
        x, n = batch.column(at), batch.num_rows
        place, new = np.empty(n, dtype=np.int64), starts | _starts(batch, [at], None)
        whole = np.zeros(n, dtype=bool)  # all rows of the run so far have this value
        if not starts[0]:
            new[0] = not pc.fill_null(pc.equal(x.slice(0, 1), before[3]), bool(x[0].as_py() is None and before[3][0].as_py() is None))[0].as_py()
        held = 0 if starts[0] else before[0][0].as_py()
        for a, b in runs(starts):
            place[a:b] = np.arange(1, b - a + 1) + (held if a == 0 else 0)
        begun = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        tie = np.arange(n) - begun + 1
        on = begun < 0  # goes on with the value of the batch before
        tie[on] = np.arange(1, int(on.sum()) + 1) + (before[1][0].as_py() if on.any() else 0)
        values = np.cumsum(new) - (np.cumsum(new) - new)[np.maximum.accumulate(np.where(starts, np.arange(n), 0))]
        whole = np.where(np.maximum.accumulate(starts), values == 1, (values == 0) & bool(before[2][0].as_py() if before else False))
        return [pa.array(place), pa.array(tie), pa.array(whole), x]

    def join(left: Sequence[Any], right: Sequence[Any]) -> Sequence[Any]:
        on = right[2] and left[3] == right[3]
        return left[0] + right[0], right[1] + (left[1] if on else 0), left[2] and on, right[3]

    def apply(left: list[Column], right: list[Column]) -> list[Column]:
        on = right[2] & left[3].eqNullSafe(right[3])
        return [left[0] + right[0], right[1] + F.when(on, left[1]).otherwise(0), left[2] & on, right[3]]

    return Scan({"place": ST.LongType(), "tie": ST.LongType(), "whole": ST.BooleanType(), "_value": kind}, local, join, apply)


def ranked(rows: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = (), tiles: int = 4, ranges: int | None = None, keep: Callable[[DataFrame], DataFrame] = files.written) -> DataFrame:
    """``rows`` with ``row_number, rank, percent_rank, cume_dist`` and ``ntile`` in the order of ``value`` (nulls first) within ``keys``, which may be none.

    ``ties`` orders rows of equal value where they are numbered.  No window runs over a key: positions come from ranges of (keys, value,
    ties), and the sizes of keys and of ties from counts.
    """
    placed = scan(rows, keys, [value, *ties], ranks(value, rows.schema[value].dataType), ranges, keep)
    by = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    counted = rows.groupBy(*by, F.col(f"`{value}`").alias("_v")).agg(F.count("*").alias("_same"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    if keys:
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        placed = placed.join(sizes, same).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        placed = placed.withColumn("_n", F.lit(sizes.first()._n))  # one number
        same = []
    joined = placed.join(counted, [*same, F.col(f"`{value}`").eqNullSafe(F.col("_v"))])
    rank, size, rest = F.col("place") - F.col("tie") + 1, F.floor(F.col("_n") / tiles), F.col("_n") % tiles
    first = F.col("place") - 1
    tile = F.when(first < rest * (size + 1), F.floor(first / (size + 1))).otherwise(rest + F.floor((first - rest * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.col("place").alias("row_number"), rank.alias("rank"), F.when(F.col("_n") > 1, (rank - 1) / (F.col("_n") - 1)).otherwise(0.0).alias("percent_rank"),
        ((rank - 1 + F.col("_same")) / F.col("_n")).alias("cume_dist"), tile.cast("int").alias("ntile"),
    )


def range_frames(rows: DataFrame, keys: Sequence[str], time: str, value: str, width: int, ranges: int | None = None, keep: Callable[[DataFrame], DataFrame] = files.written) -> DataFrame:
    """``keys, time, n, total``: count and sum of whole-number ``value`` over the rows of the key from ``time - width`` to ``time``, both included.

    The frame of RANGE BETWEEN width PRECEDING AND CURRENT ROW, which all rows of one time share: one row for each distinct key and time.  Rows of one
    time are combined first.  Running sums of these, and those of the latest time before the frame, found by an as-of join, make up
    the frame, however wide it is.  Rows with a null key or time are left out; null values are not counted.
    """
    own = rows.dropna(subset=[*keys, time])
    # Parts and ranges grow in number with the rows, not in size.
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-own.count() // FRAME_ROWS))
    dealt = own.select(*keys, F.col(time).cast("long").alias("time"), F.col(value).alias("_value")).repartition(parts, *keys, "time")
    times = keep(dealt.groupBy(*keys, "time").agg(F.count("_value").alias("one"), F.coalesce(F.sum("_value"), F.lit(0)).cast("long").alias("sum")))
    ranges = ranges or max(least, -(-2 * times.count() // FRAME_ROWS))  # the join has two rows for each time
    running = keep(scan(times, keys, ["time"], sums({"n": "one", "total": "sum"}), ranges, keep))
    frames = running.select(*keys, "time", "n", "total", (F.col("time") - F.lit(width)).alias("from"))
    earlier = running.select(*keys, "time", F.col("n").alias("n0"), F.col("total").alias("total0"))
    found = asof_join(frames, earlier, keys, "from", "time", ranges=ranges, keep=keep)
    return found.select(*keys, "time", (F.col("n") - F.coalesce("match.n0", F.lit(0))).alias("n"), (F.col("total") - F.coalesce("match.total0", F.lit(0))).alias("total"))
