"""Rows that come too late, and rules of all relation types, by hand."""

import datetime as dt


from tideline.operators import health
from tideline.streaming import live


def test_a_late_episode_leaves_the_newer_state(spark, tmp_path):
    schema = "event_type string, episode long, event_id long, ts timestamp, z double"
    start, files = dt.datetime(2024, 1, 1), f"{tmp_path}/landed"
    batches = [[("k", 2, i, start + dt.timedelta(hours=30, minutes=i), 2.0) for i in range(10)], [("k", 1, 100, start, -9.0), ("new", 1, 101, start, 1.0)], [("k", 2, 200, start + dt.timedelta(hours=40), 2.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(files)
    got = {r.event_type: r for r in live.cusum_states(stream, 0.5).collect()}
    assert (got["k"].up, got["k"].down, got["k"].n) == (16.5, 0.0, 12) and (got["new"].up, got["new"].n) == (0.5, 1)


def test_relation_rules(spark):
    x, y = [1.0, 2.0, 3.0, 10.0, None, 6.0], [1.5, 2.0, 1.0, 3.0, 10.0, None]
    g = spark.createDataFrame([("r", n, t // 3, t, v) for n, values in (("x", x), ("y", y)) for t, v in enumerate(values)], "run_id string, sensor string, episode int, t long, v double")
    rules = [("equals", 0, 1.0), ("equals", 0, 0.4), ("tracks", 1, 0.9), ("leads", 1, 0.9), ("leads", 2, 1.0)]
    frame = spark.createDataFrame([(k, "x", "y", *rule) for k, rule in enumerate(rules)] + [(9, "gone", "y", "equals", 0, 1.0)], "rule_id long, sensor string, other string, relation string, lag int, tolerance double")

    def count(kind, lag, tolerance):
        pairs = [(x[t - lag] if kind == "leads" else x[t], y[t] if kind == "leads" else y[t - lag]) for t in range(lag, 6)]
        return sum(a is not None and b is not None and abs(a - b) > tolerance for a, b in pairs)

    assert {r.rule_id: r.violations for r in health.relation_violations(g, frame).collect()} == {k: count(*rule) for k, rule in enumerate(rules)} | {9: 0}


def test_rules_of_every_type_in_a_window(spark):
    x = [1.0, 2.0, 2.0, 2.0, None, 9.0, 9.0, 1.0, 4.0, 5.0, 5.0, 5.0]
    y = [0.0, 2.5, 2.0, 4.0, 1.0, 9.0, None, 1.0, 4.0, 7.0, 5.0, 0.0]
    rows = [("r", n, t // 6, t, v) for n, values in (("x", x), ("y", y)) for t, v in enumerate(values) if not (n == "y" and 6 <= t < 9)]
    g = spark.createDataFrame(rows, "run_id string, sensor string, episode int, t long, v double").repartition(3)
    y[6:9] = [None] * 3  # not in the grid
    schema = "rule_id long, type string, sensor string, other string, relation string, lag int, low double, high double, size long, aggregate string"
    given = {
        1: ("range", "x", None, None, None, 2.0, 5.0, None, None),
        2: ("range", "x", None, None, None, None, 5.0, None, None),
        3: ("rate", "x", None, None, None, None, 2.5, None, None),
        4: ("flatline", "x", None, None, None, None, 2.0, None, None),
        5: ("relation", "x", "y", "equals", 0, None, 0.4, None, None),
        6: ("relation", "x", "y", "tracks", 2, None, 1.0, None, None),
        7: ("relation", "x", "y", "leads", 2, None, 1.0, None, None),
        8: ("missing", "y", None, None, None, None, 0.5, 3, None),
        9: ("missing", "y", None, None, None, None, 0.2, 100, None),
        10: ("aggregate", "x", None, None, None, None, 4.0, 3, "median"),
        11: ("aggregate", "y", None, None, None, 1.0, None, 3, "min"),
        12: ("missing", "gone", None, None, None, None, 0.0, 3, None),
    }
    low, high = 1, 11
    window = range(low, high)
    far = lambda pairs, limit: sum(a is not None and b is not None and abs(a - b) > limit for a, b in pairs)
    blocks = lambda z, n: [z[k : k + n] for k in range(low, high - n + 1, n)]
    held = lambda z: sorted(v for v in z if v is not None)
    want = {
        1: sum(x[t] is not None and not 2 <= x[t] <= 5 for t in window),
        2: sum(x[t] is not None and x[t] > 5 for t in window),
        3: far([(x[t], x[t - 1]) for t in window if t > low], 2.5),
        4: 1,  # the three values of 2; the last run is cut to two by the window
        5: far([(x[t], y[t]) for t in window], 0.4),
        6: far([(x[t], y[t - 2]) for t in window if t >= 2], 1.0),
        7: far([(x[t - 2], y[t]) for t in window if t >= 2], 1.0),
        8: sum(b.count(None) / 3 > 0.5 for b in blocks(y, 3)),
        9: int(y[low:high].count(None) / 10 > 0.2),
        10: sum(bool(held(b)) and (held(b)[len(held(b)) // 2] + held(b)[(len(held(b)) - 1) // 2]) / 2 > 4.0 for b in blocks(x, 3)),
        11: sum(bool(held(b)) and min(held(b)) < 1.0 for b in blocks(y, 3)),
        12: 0,
    }
    rules = spark.createDataFrame([(k, *r) for k, r in given.items()], schema)
    assert {r.rule_id: r.violations for r in health.violations_in_window(g, rules, (low, high)).collect()} == want


def test_rules_read_as_sentences(spark):
    schema = "type string, sensor string, other string, relation string, lag int, low double, high double, size long, aggregate string"
    rows = [
        ("range", "x", None, None, None, 1.0, 38412.7, None, None, "x must stay between 1 and 38400"),
        ("range", "x", None, None, None, None, -0.012345, None, None, "x must stay below -0.0123"),
        ("range", "x", None, None, None, 100.0, None, None, None, "x must stay above 100"),
        ("range", "x", None, None, None, None, None, None, None, "x must stay above 0"),
        ("flatline", "x", None, None, None, None, 12.0, None, None, "x must not stay flat for more than 12 samples"),
        ("rate", "x", None, None, None, None, 0.5, None, None, "x must not change faster than 0.5 per sample"),
        ("relation", "x", "y", "leads", None, None, 2.0, None, None, "x must lead y by 0 samples within 2"),
        ("relation", "x", "y", "tracks", 3, None, 2.25, None, None, "x must track y within 2.25"),
        ("relation", "x", "y", "equals", None, None, 1e-3, None, None, "x must equal y within 0.001"),
        ("missing", "x", None, None, None, None, 0.05, 64, None, "x must not be missing more than 5% in 64 samples"),
        ("aggregate", "x", None, None, None, 10.0, 20.0, 8, "std", "std of x over 8 samples must stay between 10 and 20"),
        ("other", "x", None, None, None, None, None, None, None, None),
    ]
    got = health.in_words(spark.createDataFrame([r[:-1] for r in rows], schema)).collect()
    assert [r.text for r in got] == [r[-1] for r in rows]
    huge = spark.createDataFrame([("rate", "x", None, None, None, None, 1e30, None, None)], schema)
    assert health.in_words(huge).head().text == "x must not change faster than 1.0E30 per sample"
