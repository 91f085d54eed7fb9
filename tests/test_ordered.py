"""Scans by blocks against plain Python, with blocks of few rows, gaps and nulls."""

import random

from tideline.operators import grids, ordered, profile


def rows_of(seed, many=400):
    rng = random.Random(seed)
    places = sorted(rng.sample(range(-200, 3000), many))
    return [(k % 3 * "a" + "b", p, rng.choice([None, *range(6)]), rng.randrange(9)) for k, p in enumerate(places)]


def test_previous_and_running_count(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "k string, p long, v int, w int").repartition(5)
    want_before, want_count, last, count = {}, {}, {}, {}
    for k, p, v, w in rows:
        want_before[p] = last.get(k, (None, None))
        last[k] = (v, w)
        count[k] = count.get(k, 0) + (w > 4)
        want_count[p] = count[k]
    for size in (1, 7, 500, 1 << 16):
        got = ordered.previous(df, ["k"], "p", ["v", "w"], size)
        assert got.columns == ["k", "p", "v", "w", "before_v", "before_w"]
        assert {r.p: (r.before_v, r.before_w) for r in got.collect()} == want_before
        assert {r.p: r.n for r in ordered.running_count(df, ["k"], "p", df["w"] > 4, "n", size).collect()} == want_count


def test_no_window_over_a_whole_column(spark):
    """Every window over rows of the table is one of blocks; the windows over a whole key see a row for each block."""
    c = profile.cells(spark.range(50).selectExpr("id", "id % 7 as x"), "id", ["x"])
    for df in (profile.time_units(c), profile.regularity(c, "ms"), profile.counters(c), grids.episodes(spark.range(50).selectExpr("'r' as run", "id", "id % 7 as x"), ["run"], "id", "x")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x]
        assert windows and all("block_" in x for x in windows)


def test_episodes(spark):
    df = spark.createDataFrame([("r", k, k % 7) for k in range(100)], "run string, id long, x long")
    assert {(r.id, r.episode) for r in grids.episodes(df, ["run"], "id", "x").collect()} == {(k, k // 7) for k in range(100)}
