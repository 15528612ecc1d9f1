"""Scans and joins along keys that fill many ranges, against plain loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import segments, telemetry


def _rows(n=3000, seed=5):
    """One key holds three quarters of the rows; null keys, null values, ties of the order."""
    rng = random.Random(seed)
    return [(None if rng.random() < 0.02 else 7 if rng.random() < 0.75 else rng.randrange(40), rng.randrange(900), i, None if rng.random() < 0.1 else rng.randrange(100)) for i in range(n)]


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_moving_average_of_a_hot_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k long, t long, i long, v long")
    expected = {}
    for own in _by_key(rows).values():
        s = None
        for _, _, i, v in own:
            s = s if v is None else v if s is None else 0.9 * s + (1 - 0.9) * v
            expected[i] = s
    got = {r.i: r.ema for r in telemetry.ema(df, "k", ("t", "i"), "v", 0.9).collect()}
    assert got.keys() == expected.keys() and all((got[i] is None) == (s is None) and (s is None or got[i] == pytest.approx(s)) for i, s in expected.items())
    last = {k: expected[own[-1][2]] for k, own in _by_key(rows).items()}
    assert {r.k: r.ema for r in telemetry.final_ema(df, "k", ("t", "i"), "v", 0.9).collect()} == {k: pytest.approx(s) for k, s in last.items()}


def test_running_mean_of_a_hot_key(spark):
    rows = _rows()
    for kind in ("long", "double"):
        df = spark.createDataFrame(rows, "k long, t long, i long, v long").withColumn("v", F.col("v").cast(kind))
        got = {r.i: (r.step, r.mean) for r in telemetry.running_mean(df, "k", ("t", "i"), "v").collect()}
        for own in _by_key(rows).values():
            seen = []
            for step, (_, _, i, v) in enumerate(own, 1):
                seen += [] if v is None else [v]
                assert got[i] == (step, pytest.approx(sum(seen) / len(seen)) if seen else None)


@pytest.mark.parametrize("same_time", [False, True])
def test_asof_join(spark, same_time):
    rng = random.Random(3)
    key = lambda: None if rng.random() < 0.03 else 1 if rng.random() < 0.7 else rng.randrange(30)
    time = lambda: None if rng.random() < 0.03 else rng.randrange(200)
    left = [(i, key(), time()) for i in range(1500)]
    right = [(j, key(), time(), None if j % 9 == 0 else f"p{j}") for j in range(800)]
    found = segments.asof_join(spark.createDataFrame(left, "i long, k long, t long"), spark.createDataFrame(right, "j long, k long, t long, what string"), ["k"], "t", "t", ties=("j",), same_time=same_time)
    index = {}
    for j, k, t, what in right:
        if k is not None and t is not None:
            index.setdefault(k, []).append((t, j, what))
    for own in index.values():
        own.sort(key=lambda r: r[:2])
    expected = {}
    for i, k, t in left:
        own = index.get(k, []) if t is not None else []
        at = (bisect.bisect_right if same_time else bisect.bisect_left)([r[0] for r in own], t) if own else 0
        expected[i] = own[at - 1][1:] if at else None
    assert {r.i: None if r.match is None else (r.match.j, r.match.what) for r in found.collect()} == expected


def test_rows_of_one_key_are_dealt_evenly(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.lit(1).alias("one"))
    tables = []

    def keep(table):
        tables.append(segments.files.written(table))
        return tables[-1]

    assert segments.scan(df, ["k"], ["t"], segments.sums({"n": "one"}), ranges=16, keep=keep).agg(F.max("n"), F.sum("n")).first() == (20_000, 20_000 * 20_001 // 2)
    sizes = sorted(r["count"] for r in tables[0].groupBy("_scan_part").count().collect())
    assert len(sizes) == 16 and sizes[-1] < 3 * sizes[8]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, t long, v double")
    assert telemetry.ema(df, "k", ("t",), "v").count() == 0
    assert segments.asof_join(df, df, ["k"], "t", "t").count() == 0


def test_frames_have_more_ranges_for_more_rows(spark, monkeypatch):
    """No range holds many more rows than asked for, and the frames are those of a loop."""
    monkeypatch.setattr(segments, "FRAME_ROWS", 50)
    rows = [(k % 3, k * 7 % 400, k) for k in range(600)]
    sizes, scan = [], segments.scan
    monkeypatch.setattr(segments, "scan", lambda table, keys, order, what, ranges=None, keep=None: sizes.append((table.count(), ranges)) or scan(table, keys, order, what, ranges))
    got = {(r.k, r.time): (r.n, r.total) for r in segments.range_frames(spark.createDataFrame(rows, "k long, t long, v long"), ["k"], "t", "v", 30).collect()}
    frame = lambda k, t: [v for a, b, v in rows if a == k and t - 30 <= b <= t]
    assert got == {(k, t): (len(frame(k, t)), sum(frame(k, t))) for k, t, _ in rows}
    assert len(sizes) == 2 and all(n / ranges <= 50 for n, ranges in sizes)
