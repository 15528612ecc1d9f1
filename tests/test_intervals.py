"""Points within intervals against a loop over both."""

import random

import pytest

from corpusloom.operators import intervals


def _case(seed):
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.03 else 1 if rng.random() < 0.6 else rng.randrange(5)
    points = [(i, key(), None if rng.random() < 0.03 else rng.randrange(-300, 300)) for i in range(500)] + [(900, 1, 7)] * 5
    cuts = []
    for j in range(300):
        a = rng.randrange(-320, 320)
        cuts.append((j, key(), a, a + rng.choice([-3, 0, 1, 1, 2, 3, 8, 16, 17, 63, 64, 65, 500, 10**15])))
    return points, cuts + [(950, 1, 7, 8)] * 4 + [(951, 1, None, 5), (952, 1, 5, None), (953, 1, -(2**62), 2**62 - 1)]


@pytest.mark.parametrize("full", [1_000_000, 20])
@pytest.mark.parametrize("keys", [["k"], []])
def test_all_pairs(spark, full, keys, monkeypatch):
    monkeypatch.setattr(intervals, "MOST_DEALT", 10_000)
    points, cuts = _case(len(keys))
    got = intervals.interval_join(spark.createDataFrame(points, "i long, k long, t long"), spark.createDataFrame(cuts, "j long, k long, a long, b long"), "t", "a", "b", keys, full)
    expected = [(i, j) for i, k, t in points for j, m, a, b in cuts if (not keys or (k is not None and k == m)) and None not in (t, a, b) and a <= t < b]
    assert sorted((r.point.i, r.interval.j) for r in got.collect()) == sorted(expected)


def test_long_intervals_are_filed_twice_at_most(spark):
    cuts = spark.createDataFrame([(j, -(10**j), 10**j + j) for j in range(18)], "j long, a long, b long")
    assert intervals.filed(cuts, "a", "b", []).groupBy("interval.j").count().where("count > 2").count() == 0


def test_few_levels_and_no_count_of_single_bins(spark, monkeypatch):
    cuts = spark.createDataFrame([(j, 0, 2**j + 1) for j in range(62)], "j long, a long, b long")
    filed = intervals.filed(cuts, "a", "b", []).localCheckpoint()
    assert filed.select("_level").distinct().count() <= 22 and filed.where("shiftright(_end - 1 - _start, _level) > 0").isEmpty()
    where = ["_level", "_bin"]
    assert intervals._full_bins(filed, filed, where, 1_000_000) is None
    monkeypatch.setattr(intervals, "GROUPS", 4)
    exact = {(r._level, r._bin): r["count"] for r in filed.groupBy(*where).count().collect()}
    got = {(r._level, r._bin): r.np for r in intervals._full_bins(filed, filed, where, 1).collect()}
    assert got == exact


def test_empty(spark):
    df = spark.createDataFrame([], "k long, t long, a long, b long")
    some = spark.createDataFrame([(1, 2, 1, 3)], "k long, t long, a long, b long")
    for points, cuts in ((df, some), (some, df), (df, df)):
        assert intervals.interval_join(points, cuts, "t", "a", "b", ["k"]).count() == 0
