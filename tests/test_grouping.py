"""Grouping sets, multisets, rankings, frames, sketches and table functions against plain loops."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import grouping, segments, sketches


def _rows(n=1500, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["x", "x", "x", "y", None]), rng.choice([1, 2, None]), rng.choice(["p", "q"]), None if rng.random() < 0.1 else rng.randrange(-50, 50)) for _ in range(n)]


def test_cube(spark):
    rows, dims = _rows(), ["a", "b", "c"]
    out = grouping.grouping_sets(spark.createDataFrame(rows, "a string, b int, c string, v long"), dims, "v", grouping.cube_sets(dims))
    expected = {}
    for group in itertools.product([True, False], repeat=3):
        for r in rows:
            key = (*[x if g else None for x, g in zip(r, group)], sum((not g) << (2 - k) for k, g in enumerate(group)))
            expected.setdefault(key, []).append(r[3])
    got = {(r.a, r.b, r.c, r.grouping_id): (r.rows, r.n, r.total, r.least, r.most) for r in out.collect()}
    assert got == {k: (len(v), len(x := [i for i in v if i is not None]), sum(x), min(x), max(x)) for k, v in expected.items()}


def test_sets_of_no_rows(spark):
    out = grouping.grouping_sets(spark.createDataFrame([], "a string, v long"), ["a"], "v", grouping.rollup_sets(["a"])).collect()
    assert [(r.a, r.grouping_id, r.rows, r.n, r.total) for r in out] == [(None, 1, 0, 0, None)]


def test_multisets(spark):
    rng = random.Random(2)
    left = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(3)) for _ in range(900)]
    right = [(rng.choice(["hot", None, "c"]), rng.randrange(3)) for _ in range(700)]
    a, b = collections.Counter(left), collections.Counter(right)
    frames = [spark.createDataFrame(x, "k string, i int") for x in (left, right)]
    assert {(r.k, r.i): r.copies for r in grouping.intersect_counts(*frames).collect()} == dict(a & b)
    less = grouping.except_counts(*frames)
    assert {(r.k, r.i): r.copies for r in less.collect()} == dict(a - b)
    assert collections.Counter(map(tuple, grouping.repeated(less, most=7).collect())) == a - b
    assert grouping.intersect_counts(frames[0], frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks(spark, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.1 else rng.choice([5, 5, 5, 6, 7, rng.randrange(100)]), i) for i in range(900)]
    got = {r.i: (r.row_number, r.rank, r.percent_rank, r.cume_dist, r.ntile) for r in segments.ranked(spark.createDataFrame(rows, "k int, v int, i int"), keys, "v", ("i",), tiles=7, ranges=9).collect()}
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0] if keys else 0].append(r)
    expected = {}
    for own in groups.values():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        n, size, rest = len(own), len(own) // 7, len(own) % 7
        tiles = [t + 1 for t in range(7) for _ in range(size + (t < rest))]
        values = [r[1] for r in own]
        for p, r in enumerate(own):
            first = values.index(r[1])
            expected[r[2]] = (p + 1, first + 1, pytest.approx(first / (n - 1)), pytest.approx((first + values.count(r[1])) / n), tiles[p])
    assert got == expected


def test_ranks_of_one_value_only(spark):
    out = segments.ranked(spark.range(500).select("id", F.lit(None).cast("int").alias("v")), [], "v", ("id",), tiles=1000, ranges=6)
    assert sorted((r.id, r.row_number, r.rank, r.ntile) for r in out.collect()) == [(i, i + 1, 1, i + 1) for i in range(500)]
    assert segments.ranked(spark.createDataFrame([(1, 2)], "id int, v int"), ["id"], "v").first().percent_rank == 0.0


def test_range_frames(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.05 else rng.randrange(120), None if rng.random() < 0.1 else rng.randrange(50)) for _ in range(1200)]
    got = {(r.k, r.time): (r.n, r.total) for r in segments.range_frames(spark.createDataFrame(rows, "k int, t long, v long"), ["k"], "t", "v", 10, ranges=7).collect()}
    times = {(k, t) for k, t, _ in rows if k is not None and t is not None}
    inside = {(k, t): [v for m, s, v in rows if m == k and s is not None and t - 10 <= s <= t and v is not None] for k, t in times}
    assert got == {key: (len(v), sum(v)) for key, v in inside.items()}


def test_merged_sketches_keep_their_bounds(spark):
    rng = random.Random(4)
    rows = [(d, rng.choice(["hot"] * 30 + ["warm"] * 5 + [f"w{rng.randrange(4000)}"]), rng.gauss(0, 1)) for d in range(6) for _ in range(3000)] + [(7, None, None)]
    df = spark.createDataFrame(rows, "day int, word string, x double")
    states = sketches.sketch(df, ["day"], item="word", number="x")
    out = sketches.estimates(sketches.merge(states, []), top=2).first()
    words = collections.Counter(w for _, w, _ in rows if w is not None)
    assert out.rows == len(rows) and abs(out.n_distinct - len(words)) <= 5 * sketches.distinct_error() * len(words)
    assert [(h["item"], abs(h["count"] - words[h["item"]]) <= len(rows) / (0.75 * sketches.COUNTERS)) for h in out.heaviest] == [("hot", True), ("warm", True)]
    ordered = sorted(x for *_, x in rows if x is not None)
    assert all(abs(sum(v < a for v in ordered) / len(ordered) - q) < 0.03 for a, q in zip(out.at_ranks, (0.25, 0.5, 0.75)))


def test_dialogue_functions(spark):
    tables.register(spark)
    rows = [(1, 0, "user", "ab"), (1, 1, "user", "c"), (1, 2, "assistant", None), (1, 3, "user", "d"), (2, 0, None, ""), (None, 5, "user", "x")] + [(3, t, "user", "hot") for t in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).createOrReplaceTempView("_t")
    state = {(r.conv_id, r.turn): (r.place, r.chars_before, r.same_role_run, r.last_of_role) for r in spark.sql("SELECT * FROM dialogue_state(TABLE(_t) PARTITION BY conv_id ORDER BY turn)").collect()}
    assert [state[1, t] for t in range(4)] == [(0, 0, 1, None), (1, 2, 2, 0), (2, 3, 1, None), (3, 3, 1, 1)] and state[2, 0] == (0, 0, 1, None) and state[None, 5] == (0, 0, 1, None)
    assert state[3, 299] == (299, 897, 300, 298) and len(state) == len(rows)
    found = {r.conv_id: (r.turns, r.chars, r.longest, r.roles) for r in spark.sql("SELECT * FROM dialogue_summary(TABLE(_t) PARTITION BY conv_id ORDER BY turn)").collect()}
    assert found == {1: (4, 4, 2, "uau"), 2: (1, 0, 0, "-"), None: (1, 1, 1, "u"), 3: (300, 900, 3, "u")}
