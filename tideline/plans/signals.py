"""Queries of fingerprints, signal types and baselines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators import packed as pk
from tideline.operators import signals as s
from tideline.plans.fixtures import grid, with_grid
from tideline.plans.kernels import ACF, HELD, NOISE, RUNS, held
from tideline.plans.registry import query

FINGER = (
    NOISE
    + HELD.replace("held AS", "held AS", 1)
    + RUNS
    + """, q AS (
  SELECT run_id, sensor, count(*) AS n, avg(CAST(v IS NULL AS INT)) AS missing_rate, count(DISTINCT v) AS n_distinct, quantile_cont(v, 0.01) AS p1, median(v) AS p50, quantile_cont(v, 0.99) AS p99 FROM grid GROUP BY ALL
), r AS (SELECT run_id, sensor, sum(CASE WHEN length >= 3 THEN length ELSE 0 END) / CAST(sum(length) AS DOUBLE) AS flat_share FROM runs GROUP BY ALL
), m AS (SELECT run_id, sensor, CASE WHEN count(*) FILTER (WHERE d <> 0) > 0 THEN abs(sum(sign(d))) / CAST(count(*) FILTER (WHERE d <> 0) AS DOUBLE) ELSE 0 END AS monotonic_share FROM diffs GROUP BY ALL)"""
)
TYPE = "CASE WHEN n_distinct <= 1 THEN 'constant' WHEN n_distinct = 2 THEN 'binary' WHEN n_distinct <= 8 AND flat_share > 0.9 THEN 'state' WHEN monotonic_share > 0.98 THEN 'counter' WHEN flat_share > 0.6 THEN 'step' WHEN acf_time > 20 THEN 'slow' ELSE 'fast' END"


@query("sensor_fingerprint", with_grid(FINGER + " SELECT run_id, sensor, n, missing_rate, n_distinct, p1, p50, p99, noise, flat_share, monotonic_share FROM q JOIN noise USING (run_id, sensor) JOIN r USING (run_id, sensor) JOIN m USING (run_id, sensor)"), "missing_rate p1 p50 p99 noise flat_share monotonic_share")
def sensor_fingerprint(spark, d):
    g = grid(spark, d)
    return s.fingerprint(g, held(g))


@query("sensor_flat_share", with_grid(FINGER + " SELECT * FROM r"), "flat_share")
def sensor_flat_share(spark, d):
    return s.flat_share(held(grid(spark, d)))


@query("sensor_monotonic_share", with_grid(FINGER + " SELECT * FROM m"), "monotonic_share")
def sensor_monotonic_share(spark, d):
    return s.monotonic_share(grid(spark, d))


@query(
    "signal_type",
    with_grid(FINGER + ACF + f", a AS (SELECT run_id, sensor, coalesce(min(lag) FILTER (WHERE acf < exp(-1)), max(lag)) AS acf_time FROM acf GROUP BY ALL) SELECT run_id, sensor, {TYPE} AS signal FROM q JOIN r USING (run_id, sensor) JOIN m USING (run_id, sensor) JOIN a USING (run_id, sensor)"),
)
def signal_type(spark, d):
    g = grid(spark, d)
    return s.signal_type(s.fingerprint(g, held(g)), k.acf_time(k.autocorrelation(g, 40)))


CHANGES = """, injected AS (SELECT run_id, sensor, episode, t, CASE WHEN t >= 250 AND sensor LIKE 'quantity%' THEN v + 10 ELSE v END AS v FROM grid
), sides AS (SELECT run_id, sensor, median(v) FILTER (WHERE t >= 230 AND t < 250) AS before, median(v) FILTER (WHERE t >= 250 AND t < 270) AS after FROM injected GROUP BY ALL)"""


@query("baseline_changes")
def baseline_changes(spark, d):
    g = grid(spark, d)
    moved = g.withColumn("v", F.when((F.col("t") >= 250) & F.col("sensor").like("quantity%"), F.col("v") + 10).otherwise(F.col("v")))
    return s.changes(moved, k.change_points(moved))


@query("baseline_change_groups")
def baseline_change_groups(spark, d):
    g = grid(spark, d)
    moved = g.withColumn("v", F.when((F.col("t") >= 250) & F.col("sensor").like("quantity%"), F.col("v") + 10).otherwise(F.col("v")))
    return s.change_groups(s.changes(moved, k.change_points(moved)), n=360, n_sensors=20)


@query(
    "baseline_select",
    with_grid(
        """, ends AS (SELECT run_id, min(t) AS lo, max(t) + 1 AS hi FROM grid GROUP BY run_id
        ), starts AS (SELECT run_id, episode, min(t) AS start FROM grid GROUP BY ALL
        ), c AS (SELECT run_id, lo, hi, CAST(floor(lo + 0.6 * (hi - lo)) AS BIGINT) AS wanted FROM ends
        ), s AS (SELECT c.run_id, lo, hi, wanted, max(start) AS snap FROM c LEFT JOIN starts s ON s.run_id = c.run_id AND s.start <= wanted AND wanted - s.start <= 0.05 * (hi - lo) AND s.start > lo GROUP BY ALL)
        SELECT run_id, lo AS "from", coalesce(snap, wanted) AS "to" FROM s"""
    ),
)
def baseline_select(spark, d):
    return s.select_baseline(grid(spark, d), None)


@query("baseline_override", "SELECT 'lineitem' AS run_id, unnest([0, 52]) AS \"from\", unnest([200, 300]) AS \"to\" FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def baseline_override(spark, d):
    g = grid(spark, d)
    chosen = s.select_baseline(g, None)
    wanted = g.select("run_id").distinct().select("run_id", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(200).alias("b")), F.struct(F.lit(-9).alias("a"), F.lit(300).alias("b")))).alias("o")).select("run_id", "o.*")
    return s.override_baseline(chosen, wanted, 52, 410).select("run_id", F.when(F.col("to") == 200, 0).otherwise(F.col("from")).cast("int").alias("from"), F.col("to").cast("int").alias("to"))


@query("baseline_bound_by_health")
def baseline_bound_by_health(spark, d):
    g = grid(spark, d)
    dying = g.withColumn("v", F.when((F.col("sensor") == "price") & (F.col("t") >= 300), 1.0).otherwise(F.col("v")))
    return s.bound_by_health(dying, 330, 64)


@query("fingerprint_full")
def fingerprint_full(spark, d):
    """All statistics of a series in one row: shares, quantiles, spread, histogram, hold, step, noise, autocorrelation time and period."""
    return pk.fingerprints(pk.pack(grid(spark, d)))
