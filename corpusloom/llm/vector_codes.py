"""Product codes of integer vectors by Lloyd's rounds, with Elkan's bounds.

Vectors are cut into parts, and each part position has a codebook of its own.  For every part a row carries the
assigned entry, an upper bound on the distance to it, and a lower bound on the distance to each entry.  When entries move,
bounds are shifted by the length of the movement.  An entry is passed over only where the bounds or the
triangle inequality show that it is strictly farther; all others are measured in integers, ties going to the lower index, so
the result is that of the plain rounds.  Bounds are kept as 32-bit floats, upper ones rounded up and lower ones down.

A round is one pass over a table in the shared folder, which the pass before wrote.  Each task adds its sums of parts
by entry as one more row, and their totals, some thousand numbers, are all that the driver gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusloom.llm import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of one Arrow batch; a row is a vector and its bounds.
BATCH = 4096
#: Labels whose sums are small enough, at some 40 bytes each, to be sent to every task.
FEW_LABELS = 100_000

Codebooks = list[np.ndarray]  # for each part position, its entries as rows


def _to_integers(vectors: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of floor(SCALE x)."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"all vectors must have the {width} components of the first")
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    # Squared distances over a whole vector must fit 63 bits.
    if len(scaled) and np.abs(scaled).max() >= np.sqrt(2.0**61 / max(width, 1)):
        raise ValueError("a component is too large for distances of 64 bits")
    return scaled.astype(np.int64).reshape(-1, width)


def _root(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square root as a 32-bit float that is not below, or not above, the exact one; never below 0."""
    near = np.sqrt(squared.astype(np.float64)).astype(np.float32)
    return np.nextafter(near, np.float32(np.inf)) if up else np.maximum(np.nextafter(near, np.float32(-np.inf)), np.float32(0))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def half_gaps(entries: np.ndarray) -> np.ndarray:
    """(entries, entries): half the distance between entries, rounded down."""
    return _root(_apart(entries[:, None], entries[None]), up=False) / np.float32(2)


def assign(x: np.ndarray, entries: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Assign each row of ``x`` to the nearest entry, in place, tightening the bounds; returns how many distances were measured.

    ``at`` (rows), ``upper`` (rows) and ``lower`` (rows, entries) must hold for these entries.
    """
    gaps = half_gaps(entries)
    others = ~np.eye(len(entries), dtype=bool)
    open_rows = np.flatnonzero((others[at] & ~(upper[:, None] < lower) & ~(upper[:, None] < gaps[at])).any(axis=1))
    if not len(open_rows):
        return 0
    own = at[open_rows]
    best = _apart(x[open_rows], entries[own])
    tight = _root(best, up=True)
    near = others[own] & ~(tight[:, None] < lower[open_rows]) & ~(tight[:, None] < gaps[own])
    rows, tried = np.nonzero(near)
    measured = _apart(x[open_rows[rows]], entries[tried])
    lower[open_rows, own] = _root(best, up=False)
    lower[open_rows[rows], tried] = _root(measured, up=False)
    squared = np.full(near.shape, np.iinfo(np.int64).max)
    squared[rows, tried] = measured
    squared[np.arange(len(own)), own] = best
    winner = squared.argmin(axis=1)  # the first of equals
    at[open_rows] = winner
    upper[open_rows] = _root(squared[np.arange(len(own)), winner], up=True)
    return len(open_rows) + len(rows)


def shift(moved: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after entries moved by ``moved`` (not below the exact lengths)."""
    up = np.nextafter(upper + moved[at], np.float32(np.inf))
    down = np.maximum(np.nextafter(lower - moved, np.float32(-np.inf)), np.float32(0))
    return up, down


def next_entries(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); unused entries stay."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], entries)


def _pass(state: DataFrame, before: Codebooks | None, now: Codebooks) -> DataFrame:
    """One assignment: the new state, and a row of sums for each task."""
    parts, k = len(now), len(now[0])
    moved = None if before is None else [_root(_apart(a, b), up=True) * (a != b).any(axis=1) for a, b in zip(before, now)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        width = now[0].shape[1]
        sums, counts = np.zeros((parts, k, width), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        names = ["vec_id", "label", "vector", "codes", "bounds", "sums"]
        label = None
        for batch in batches:
            label = batch.column(1).type
            if not (n := batch.num_rows):
                continue
            x = batch.column(2).flatten().to_numpy().reshape(n, parts, width)
            if moved is None:
                at, bounds = np.zeros((n, parts), dtype=np.int32), np.zeros((n, parts, k + 1), dtype=np.float32)
                bounds[:, :, 0] = np.inf
            else:
                at = batch.column(3).flatten().to_numpy().reshape(n, parts).copy()
                bounds = batch.column(4).flatten().to_numpy().reshape(n, parts, k + 1).copy()
            for p in range(parts):
                own, upper, lower = at[:, p].copy(), bounds[:, p, 0].copy(), bounds[:, p, 1:].copy()
                if moved is not None:
                    upper, lower = shift(moved[p], own, upper, lower)
                assign(x[:, p], now[p], own, upper, lower)
                at[:, p], bounds[:, p, 0], bounds[:, p, 1:] = own, upper, lower
                np.add.at(sums[p], own, x[:, p])
                counts[p] += np.bincount(own, minlength=k)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (v.size // n)), pa.array(v.ravel())) for v in (at, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists, pa.nulls(n, pa.list_(pa.int64()))], names=names)
        if label is not None:
            flat = np.concatenate([sums.ravel(), counts.ravel()])
            empty = [pa.nulls(1, t) for t in (pa.int64(), label, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([flat.tolist()], pa.list_(pa.int64()))], names=names)

    ints, floats = ST.ArrayType(ST.LongType()), ST.ArrayType(ST.FloatType())
    schema = ST.StructType([ST.StructField("vec_id", ST.LongType()), ST.StructField("label", state.schema["label"].dataType), ST.StructField("vector", ints), ST.StructField("codes", ST.ArrayType(ST.IntegerType())), ST.StructField("bounds", floats), ST.StructField("sums", ints)])
    return scratch.materialize(state.mapInArrow(run, schema), "vector-round")


def _totals(table: DataFrame, now: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over all tasks, added up by place before they reach the driver."""
    parts, (k, width) = len(now), now[0].shape
    flat = np.zeros(parts * k * (width + 1), dtype=np.int64)
    for place, total in table.where("sums is not null").select(F.posexplode("sums").alias("place", "x")).groupBy("place").agg(F.sum("x")).collect():
        flat[place] = total
    return flat[: parts * k * width].reshape(parts, k, width), flat[parts * k * width :].reshape(parts, k)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col).cast("array<double>"), bad))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, codes, error`` of every usable row, and the final codebooks.

    Codebooks start as the parts of the first rows by id (null ids last, equal ids by their vectors); with fewer rows
    than entries they are shorter.  Rows that repeat are coded each.  An empty table gives no rows and empty codebooks.
    Vectors of different lengths, or of one that cannot be cut into equal parts, are an error, as are components so large
    that squared distances need more than 63 bits.
    """
    spark = vectors.sparkSession
    scratch.prepare(spark)
    # Where a vector goes through Python it is 64-bit from the start: a 32-bit float is exact in it.
    rows = usable(vectors, vector_col).select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    ids = [r.vec_id for r in rows.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    low = rows.where(F.col("vec_id") <= ids[-1]) if len(ids) == ENTRIES and ids[-1] is not None else rows  # else few tasks hold such rows, or all rows do
    first = low.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    width = len(first[0].vector) if first else 0
    if any(len(r.vector) != width for r in first):
        raise ValueError(f"all vectors must have the {width} components of the first")
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    start = np.floor(np.array([r.vector for r in first], dtype=np.float64).reshape(len(first), width) * SCALE)
    now = [c.astype(np.int64) for c in np.split(start, PARTS, axis=1)]
    label = rows.schema["label"].dataType
    if not first:
        return spark.createDataFrame([], ST.StructType([ST.StructField("vec_id", ST.LongType()), ST.StructField("label", label), ST.StructField("codes", ST.ArrayType(ST.IntegerType())), ST.StructField("error", ST.LongType())])), now

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            n, x = batch.num_rows, _to_integers(batch.column(2), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel()))], names=["vec_id", "label", "vector"])

    whole = rows.mapInArrow(integers, ST.StructType([rows.schema["vec_id"], ST.StructField("label", label), ST.StructField("vector", ST.ArrayType(ST.LongType()))]))
    with scratch.short_rows(spark, BATCH):
        state, before, old = whole, None, []
        for _ in range(ROUNDS):
            known = scratch.made(spark)
            table = _pass(state, before, now)
            scratch.release(spark, old)
            old = [p for p in scratch.made(spark) if p not in known]
            before, now = now, [next_entries(e, s, c) for e, s, c in zip(now, *_totals(table, now))]
            state = table.where("sums is null").drop("sums")
        last = _pass(state, before, now).where("sums is null")
        coded = scratch.materialize(last.mapInArrow(_errors(now), ST.StructType([rows.schema["vec_id"], ST.StructField("label", label), ST.StructField("codes", ST.ArrayType(ST.IntegerType())), ST.StructField("error", ST.LongType())])), "vector-codes")
        scratch.release(spark, [p for p in scratch.made(spark) if "vector-round" in p])
    return coded, now


def _errors(now: Codebooks):
    parts, width = len(now), now[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).flatten().to_numpy().reshape(n, parts, width)
            at = batch.column(3).flatten().to_numpy().reshape(n, parts)
            error = sum(_apart(x[:, p], now[p][at[:, p]]) for p in range(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return run


def codebooks_text(books: Codebooks) -> str:
    """All entries' components in decimal by part, entry and place, joined by commas."""
    return ",".join(str(int(x)) for book in books for x in book.ravel())


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over equal labels; nulls are one label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error")
    sums = scratch.materialize(sums, "label-errors")
    few = sums.count() <= FEW_LABELS
    return coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def code_digest(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of what :func:`compress` returns."""
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return with_label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(codebooks_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
