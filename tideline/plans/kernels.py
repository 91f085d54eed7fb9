"""Queries of the statistical kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators import trends
from tideline.plans.fixtures import grid, with_grid
from tideline.plans.registry import query

PROBS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
NOISE = """, diffs AS (
  SELECT *, v - lag(v) OVER (PARTITION BY run_id, sensor, episode ORDER BY t) AS d FROM grid
), mids AS (SELECT run_id, sensor, median(d) AS m FROM diffs GROUP BY ALL
), noise AS (
  SELECT run_id, sensor, coalesce(median(abs(d - m)), 0) * 1.4826 / sqrt(2) AS noise FROM diffs JOIN mids USING (run_id, sensor) GROUP BY ALL
)"""
RUNS = """, marks AS (
  SELECT *, CASE WHEN v IS NULL OR lag(v) OVER w IS NULL OR v <> lag(v) OVER w THEN 1 ELSE 0 END AS change
  FROM held WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
), islands AS (SELECT *, sum(change) OVER (PARTITION BY run_id, sensor, episode ORDER BY t) AS island FROM marks
), runs AS (
  SELECT run_id, sensor, episode, island, count(*) AS length, min(t) AS start FROM islands WHERE v IS NOT NULL GROUP BY ALL
)"""
HELD = ", held AS (SELECT run_id, sensor, episode, t, CASE WHEN v IS NULL THEN NULL ELSE round(v / CASE WHEN sensor LIKE 'rows%' THEN 4 WHEN sensor LIKE 'price%' THEN 4000 WHEN sensor LIKE 'quantity%' THEN 4 ELSE 0.01 END) END AS v FROM grid)"
RANKS = """, ranks AS (
  SELECT run_id, sensor, episode, t, v, rank() OVER (PARTITION BY run_id, sensor ORDER BY v) + (count(*) OVER (PARTITION BY run_id, sensor, v) - 1) / 2.0 AS rank
  FROM grid WHERE v IS NOT NULL
)"""
ACF = """, centred AS (SELECT run_id, sensor, episode, t, v - avg(v) OVER (PARTITION BY run_id, sensor) AS v FROM grid
), whole AS (SELECT run_id, sensor, sum(v * v) AS den FROM centred GROUP BY ALL
), acf AS (
  SELECT a.run_id, a.sensor, CAST(l.lag AS INTEGER) AS lag, CASE WHEN max(den) > 0 THEN coalesce(sum(a.v * b.v), 0) / max(den) ELSE 0 END AS acf
  FROM centred a CROSS JOIN range(1, 41) l(lag) JOIN centred b ON b.run_id = a.run_id AND b.sensor = a.sensor AND b.episode = a.episode AND b.t = a.t + l.lag
  JOIN whole w ON w.run_id = a.run_id AND w.sensor = a.sensor GROUP BY ALL
)"""
STANDARD = """, centers AS (SELECT run_id, sensor, median(v) AS center FROM grid GROUP BY ALL
), spreads AS (SELECT run_id, sensor, median(abs(v - center)) * 1.4826 AS mad, any_value(center) AS center FROM grid JOIN centers USING (run_id, sensor) GROUP BY ALL
), std AS (
  SELECT run_id, sensor, episode, t, (v - center) / CASE WHEN mad > 0 THEN mad ELSE 1 END AS v FROM grid JOIN spreads USING (run_id, sensor)
)"""


def held(g):
    """The grid on a coarse scale, so that runs of equal values occur."""
    unit = F.when(F.col("sensor").like("rows%"), 4.0).when(F.col("sensor").like("price%"), 4000.0).when(F.col("sensor").like("quantity%"), 4.0).otherwise(0.01)
    return g.withColumn("v", F.round(F.col("v") / unit))


@query("stat_quantiles", with_grid(" SELECT run_id, sensor, " + ", ".join(f"coalesce(quantile_cont(v, {p}), 0) AS {n}" for n, p in PROBS.items()) + " FROM grid GROUP BY run_id, sensor"), " ".join(PROBS))
def stat_quantiles(spark, d):
    return k.quantiles(grid(spark, d), PROBS)


@query("stat_bucket_means", with_grid(" SELECT run_id, sensor, t // 8 AS bucket, avg(v) AS v FROM grid GROUP BY ALL"), "v")
def stat_bucket_means(spark, d):
    return k.bucket_means(grid(spark, d), 8)


@query(
    "series_downsample_4096",
    with_grid(
        """, sized AS (SELECT *, min(t) OVER w AS lo, greatest(1, CAST(ceil((max(t) OVER w - min(t) OVER w + 1) / 64.0) AS BIGINT)) AS size FROM grid WINDOW w AS (PARTITION BY run_id, sensor))
        SELECT run_id, sensor, (t - lo) // size AS bucket, avg(v) AS v FROM sized GROUP BY ALL"""
    ),
    "v",
)
def series_downsample(spark, d):
    return k.downsample(grid(spark, d), 64)


@query(
    "stat_mad",
    with_grid(", c AS (SELECT run_id, sensor, median(v) AS m FROM grid GROUP BY ALL) SELECT run_id, sensor, coalesce(median(abs(v - m)), 0) * 1.4826 AS mad FROM grid JOIN c USING (run_id, sensor) GROUP BY ALL"),
    "mad",
)
def stat_mad(spark, d):
    return k.mad(grid(spark, d))


@query("stat_diff", with_grid(" SELECT run_id, sensor, episode, t, v - lag(v) OVER (PARTITION BY run_id, sensor, episode ORDER BY t) AS d FROM grid"), "d")
def stat_diff(spark, d):
    return k.diff(grid(spark, d)).select("run_id", "sensor", "episode", "t", "d")


@query("stat_noise_level", with_grid(NOISE + " SELECT * FROM noise"), "noise")
def stat_noise_level(spark, d):
    return k.noise_level(grid(spark, d))


@query(
    "stat_step_size",
    with_grid(
        """, gaps AS (SELECT run_id, sensor, v, v - lag(v) OVER (PARTITION BY run_id, sensor ORDER BY v) AS gap FROM (SELECT DISTINCT run_id, sensor, v FROM grid WHERE v IS NOT NULL))
        SELECT run_id, sensor, coalesce(min(gap) FILTER (WHERE gap > 1e-9 * abs(v)), 0) AS step FROM gaps GROUP BY ALL"""
    ),
    "step",
)
def stat_step_size(spark, d):
    return k.step_size(grid(spark, d))


@query("stat_run_lengths", with_grid(HELD + RUNS + " SELECT run_id, sensor, max(length) AS longest, quantile_cont(length, 0.99) AS p99_run, count(*) AS n_runs FROM runs GROUP BY ALL"), "p99_run")
def stat_run_lengths(spark, d):
    return k.run_stats(held(grid(spark, d)))


@query(
    "stat_hold",
    with_grid(
        HELD
        + RUNS
        + """, by_length AS (SELECT run_id, sensor, length, count(*) * length AS covered, min(start) AS start FROM runs GROUP BY run_id, sensor, length
        ), placed AS (SELECT *, sum(covered) OVER (PARTITION BY run_id, sensor) AS total, row_number() OVER (PARTITION BY run_id, sensor ORDER BY covered DESC, start) AS place FROM by_length)
        SELECT run_id, sensor, CAST(CASE WHEN covered > 0.8 * total THEN length ELSE 1 END AS BIGINT) AS hold FROM placed WHERE place = 1"""
    ),
)
def stat_hold(spark, d):
    return k.hold(held(grid(spark, d))).withColumn("hold", F.col("hold").cast("long"))


@query("stat_compress_hold", with_grid(" SELECT run_id, sensor, t // 3 AS block, arg_min(v, t) AS v FROM grid WHERE v IS NOT NULL GROUP BY ALL"), "v")
def stat_compress_hold(spark, d):
    return k.compress_hold(grid(spark, d), 3)


#: The value at place ``{p}`` of the sorted list ``x``, between two neighbours in the arithmetic of ``percentile``: a last digit of an edge decides on values that lie on it.
PLACED = "CASE WHEN x[{lower}] = x[{higher}] THEN x[{lower}] ELSE (ceil({{p}}) - {{p}}) * x[{lower}] + ({{p}} - floor({{p}})) * x[{higher}] END".format(lower="CAST(floor({p}) AS BIGINT) + 1", higher="CAST(ceil({p}) AS BIGINT) + 1")


@query(
    "stat_histogram",
    with_grid(
        f""", own AS (SELECT run_id, sensor, list(v ORDER BY v) FILTER (WHERE v IS NOT NULL) AS x, (count(v) - 1) * CAST(0.01 AS DOUBLE) AS p1, (count(v) - 1) * CAST(0.99 AS DOUBLE) AS p99 FROM grid GROUP BY ALL
        ), edges AS (SELECT run_id, sensor, {PLACED.format(p='p1')} AS lo, {PLACED.format(p='p99')} AS hi FROM own
        ), binned AS (
          SELECT run_id, sensor, CASE WHEN v < lo THEN 0 WHEN v > hi THEN 19 WHEN hi <= lo THEN 9 ELSE least(18, 1 + CAST(floor((v - lo) / (hi - lo) * 18) AS INTEGER)) END AS bin
          FROM grid JOIN edges USING (run_id, sensor) WHERE v IS NOT NULL
        ), counted AS (SELECT run_id, sensor, bin, count(*) AS n FROM binned GROUP BY ALL)
        SELECT e.run_id, e.sensor, CAST(b.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n FROM edges e CROSS JOIN range(20) b(bin) LEFT JOIN counted c ON c.run_id = e.run_id AND c.sensor = e.sensor AND c.bin = b.bin"""
    ),
)
def stat_histogram(spark, d):
    return k.histogram(grid(spark, d))


@query("stat_autocorrelation", with_grid(ACF + " SELECT * FROM acf"), "acf")
def stat_autocorrelation(spark, d):
    return k.autocorrelation(grid(spark, d), 40)


@query("stat_acf_time", with_grid(ACF + " SELECT run_id, sensor, coalesce(min(lag) FILTER (WHERE acf < exp(-1)), max(lag)) AS acf_time FROM acf GROUP BY ALL"))
def stat_acf_time(spark, d):
    return k.acf_time(k.autocorrelation(grid(spark, d), 40))


@query(
    "stat_dominant_period",
    with_grid(
        ACF
        + """, near AS (SELECT *, lag(acf) OVER w AS before, lead(acf) OVER w AS after, min(lag) FILTER (WHERE acf < 0) OVER (PARTITION BY run_id, sensor) AS first_negative FROM acf WINDOW w AS (PARTITION BY run_id, sensor ORDER BY lag)
        ), peaks AS (SELECT *, row_number() OVER (PARTITION BY run_id, sensor ORDER BY acf DESC, lag) AS place FROM near WHERE lag > first_negative AND acf > before AND acf >= after AND acf >= 0.05)
        SELECT a.run_id, a.sensor, coalesce(p.lag, 0) AS period FROM (SELECT DISTINCT run_id, sensor FROM acf) a LEFT JOIN peaks p ON p.run_id = a.run_id AND p.sensor = a.sensor AND p.place = 1"""
    ),
)
def stat_dominant_period(spark, d):
    return k.dominant_period(k.autocorrelation(grid(spark, d), 40), 0.05)


@query("stat_avg_rank", with_grid(HELD.replace("held AS", "h AS") + RANKS.replace("FROM grid", "FROM h") + " SELECT * FROM ranks"), "v rank")
def stat_avg_rank(spark, d):
    return k.average_ranks(held(grid(spark, d)))


@query(
    "stat_spearman",
    with_grid(
        RANKS
        + """ SELECT a.run_id, a.sensor AS a, b.sensor AS b, CASE WHEN stddev_pop(a.rank) > 1e-12 AND stddev_pop(b.rank) > 1e-12 THEN corr(a.rank, b.rank) ELSE 0 END AS rho, count(*) AS n
        FROM ranks a JOIN ranks b ON b.run_id = a.run_id AND b.t = a.t AND a.sensor < b.sensor GROUP BY ALL"""
    ),
    "rho",
)
def stat_spearman(spark, d):
    return k.spearman(grid(spark, d))


@query(
    "stat_cross_correlation",
    with_grid(
        """, lags AS (
          SELECT a.run_id, a.sensor AS a, b.sensor AS b, CAST(l.lag AS INTEGER) AS lag, CASE WHEN stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12 THEN corr(a.v, b.v) ELSE 0 END AS rho
          FROM grid a CROSS JOIN range(-6, 7) l(lag) JOIN grid b ON b.run_id = a.run_id AND b.episode = a.episode AND b.t = a.t + l.lag
          WHERE a.sensor IN ('rows', 'price') AND b.sensor LIKE 'quantity%' AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, a, b ORDER BY round(abs(rho), 9) DESC, abs(lag), lag) AS place FROM lags)
        SELECT run_id, a, b, lag, rho FROM placed WHERE place = 1"""
    ),
    "rho",
)
def stat_cross_correlation(spark, d):
    g = grid(spark, d)
    sensors = g.select("run_id", "sensor").distinct()
    left, right = sensors.where("sensor in ('rows', 'price')").withColumnRenamed("sensor", "a"), sensors.where("sensor like 'quantity%'").withColumnRenamed("sensor", "b")
    return k.cross_correlation(g, left.join(right, "run_id"), 6)


@query(
    "stat_cusum",
    with_grid(
        STANDARD
        + """, sums AS (
          SELECT *, sum(coalesce(v - 0.5, 0)) OVER w AS pu, sum(coalesce(-v - 0.5, 0)) OVER w AS pd FROM std WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
        ), states AS (SELECT *, pu - least(0, min(pu) OVER w) AS su, pd - least(0, min(pd) OVER w) AS sd FROM sums WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
        ), marks AS (
          SELECT *, coalesce(max(CASE WHEN su <= 0 THEN t END) OVER w, min(t) OVER w) AS zu, coalesce(max(CASE WHEN sd <= 0 THEN t END) OVER w, min(t) OVER w) AS zd, coalesce(lag(greatest(su, sd)) OVER w, 0) AS before
          FROM states WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
        ) SELECT run_id, sensor, episode, min(t) AS alarm, arg_min(CASE WHEN su >= sd THEN zu ELSE zd END, t) AS onset FROM marks WHERE greatest(su, sd) > 4 AND before <= 4 GROUP BY ALL"""
    ),
)
def stat_cusum(spark, d):
    return k.cusum(k.standardised(grid(spark, d)), 0.5, 4.0)


@query(
    "stat_theil_sen",
    with_grid(
        """, s AS (SELECT a.run_id, a.sensor, median((b.v - a.v) / (b.t - a.t)) AS slope FROM grid a JOIN grid b ON b.run_id = a.run_id AND b.sensor = a.sensor AND b.t > a.t WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL)
        SELECT run_id, sensor, slope, median(v - slope * t) AS intercept FROM grid JOIN s USING (run_id, sensor) GROUP BY ALL"""
    ),
    "slope intercept",
)
def stat_theil_sen(spark, d):
    return trends.theil_sen(grid(spark, d))


@query(
    "stat_mann_kendall",
    with_grid(
        """, s AS (SELECT a.run_id, a.sensor, CAST(sum(sign(b.v - a.v)) AS DOUBLE) AS s FROM grid a JOIN grid b ON b.run_id = a.run_id AND b.sensor = a.sensor AND b.t > a.t WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL
        ), ties AS (SELECT run_id, sensor, v, count(*) AS k FROM grid WHERE v IS NOT NULL GROUP BY ALL
        ), n AS (SELECT run_id, sensor, sum(k) AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM ties GROUP BY ALL
        ), z AS (SELECT run_id, sensor, s, CAST((n * (n - 1) * (2 * n + 5) - tied) AS DOUBLE) / 18 AS var FROM s JOIN n USING (run_id, sensor)
        ), zz AS (SELECT *, CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(var) ELSE 0 END AS z FROM z), u AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS u FROM zz)
        SELECT run_id, sensor, s, var, z, (0.254829592 * u - 0.284496736 * u * u + 1.421413741 * u * u * u - 1.453152027 * u * u * u * u + 1.061405429 * u * u * u * u * u) * exp(-x * x) AS p FROM u"""
    ),
    "s var z p",
)
def stat_mann_kendall(spark, d):
    return trends.mann_kendall(grid(spark, d))


@query(
    "stat_wasserstein",
    with_grid(
        """, sides AS (SELECT run_id, sensor, quantile_cont(v, (SELECT ps FROM probs)) FILTER (WHERE t < 214) AS a, quantile_cont(v, (SELECT ps FROM probs)) FILTER (WHERE t >= 214) AS b FROM grid WHERE sensor NOT LIKE 'rows%' GROUP BY ALL)
        SELECT run_id, sensor, list_avg(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS distance FROM sides"""
    ).replace("(SELECT ps FROM probs)", "[" + ", ".join(f"{(x + 0.5) / 200}" for x in range(200)) + "]"),
    "distance",
)
def stat_wasserstein(spark, d):
    return k.window_distance(grid(spark, d).where("sensor not like 'rows%'"), 214)


@query("stat_rolling_median", with_grid(" SELECT run_id, sensor, episode, t, median(v) OVER (PARTITION BY run_id, sensor, episode ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS median FROM grid"), "median")
def stat_rolling_median(spark, d):
    return k.rolling_median(grid(spark, d)).select("run_id", "sensor", "episode", "t", "median")


@query(
    "stat_hampel",
    with_grid(
        """, near AS (SELECT *, list(v) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY run_id, sensor, episode ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM grid
        ), mid AS (SELECT *, list_median(near) AS median FROM near), spread AS (SELECT *, 1.4826 * list_median(list_transform(near, lambda x: abs(x - median))) AS spread FROM mid)
        SELECT run_id, sensor, episode, t, median, spread, coalesce(len(near) >= 3 AND v IS NOT NULL AND abs(v - median) > 3 * spread, false) AS spike FROM spread"""
    ),
    "median spread",
)
def stat_hampel(spark, d):
    return k.hampel(grid(spark, d), 3.0).select("run_id", "sensor", "episode", "t", "median", "spread", "spike")


@query(
    "stat_block_medians",
    with_grid(
        """, e AS (SELECT run_id, sensor, min(t) AS lo, max(t) AS hi FROM grid GROUP BY ALL)
        SELECT run_id, sensor, least((t - lo) // 16, greatest(1, (hi - lo + 1) // 16) - 1) AS block, avg(t) AS center, median(v) AS median FROM grid JOIN e USING (run_id, sensor) GROUP BY ALL"""
    ),
    "center median",
)
def stat_block_medians(spark, d):
    return k.block_medians(grid(spark, d), 16)


@query(
    "stat_best_split",
    with_grid(
        """, s AS (
          SELECT run_id, sensor, CAST(episode AS VARCHAR) AS segment, t, v - avg(v) OVER (PARTITION BY run_id, sensor, episode) AS c FROM grid WHERE v IS NOT NULL
        ), s2 AS (SELECT *, count(*) OVER u AS n1, sum(c) OVER u AS s1, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY run_id, sensor, segment), u AS (PARTITION BY run_id, sensor, segment ORDER BY t)
        ), c AS (SELECT run_id, sensor, segment, t + 1 AS cut_t, s1 * s1 * n / (n1 * (n - n1)) AS gain FROM s2 WHERE n1 >= 12 AND n - n1 >= 12
        ), p AS (SELECT *, row_number() OVER (PARTITION BY run_id, sensor, segment ORDER BY CAST(format('{:.8e}', gain) AS DOUBLE) DESC, cut_t) AS place FROM c)
        SELECT run_id, sensor, segment, cut_t, CAST(format('{:.6e}', gain) AS DOUBLE) AS gain FROM p WHERE place = 1"""
    ),
    "gain",
)
def stat_best_split(spark, d):
    g = grid(spark, d).where("v is not null").withColumn("segment", F.col("episode").cast("string"))
    return k.best_splits(g, 12).withColumn("gain", k.round_sig(F.col("gain"), 7))


@query("stat_change_points")
def stat_change_points(spark, d):
    return k.change_points(grid(spark, d))


@query("stat_huber_fit")
def stat_huber_fit(spark, d):
    g = grid(spark, d)
    driver = g.where("sensor = 'rows'").select("run_id", "t", F.col("v").alias("x"))
    return k.huber_fit(g.where("sensor <> 'rows'").withColumnRenamed("v", "y").join(driver, ["run_id", "t"]).select("run_id", "sensor", "y", "x"), ["x"])


@query("stat_regression", with_grid(" SELECT g.run_id, g.sensor, regr_slope(g.v, r.v) AS slope, regr_intercept(g.v, r.v) AS intercept FROM grid g JOIN grid r ON r.run_id = g.run_id AND r.t = g.t AND r.sensor = 'rows' WHERE g.sensor <> 'rows' GROUP BY ALL"), "slope intercept")
def stat_regression(spark, d):
    g = grid(spark, d)
    driver = g.where("sensor = 'rows'").select("run_id", "t", F.col("v").alias("x"))
    return g.where("sensor <> 'rows'").join(driver, ["run_id", "t"]).groupBy("run_id", "sensor").agg(F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("intercept"))


@query("round_sig", with_grid(" SELECT run_id, sensor, t, CAST(format('{:.2e}', v) AS DOUBLE) AS v FROM grid WHERE v IS NOT NULL AND sensor LIKE 'price%'"), "v")
def round_sig(spark, d):
    return grid(spark, d).where("v is not null and sensor like 'price%'").select("run_id", "sensor", "t", k.round_sig(F.col("v")).alias("v"))


def _mids(count: int) -> str:
    return "[" + ", ".join(f"{(x + 0.5) / count}" for x in range(count)) + "]"


@query(
    "rolling_w1_distance",
    with_grid(
        f""", ref AS (SELECT run_id, sensor, quantile_cont(v, {_mids(50)}) AS a FROM grid WHERE t < 214 GROUP BY ALL
        ), w AS (SELECT run_id, sensor, t // 10 + o.k AS "window", quantile_cont(v, {_mids(50)}) AS b, count(*) AS n FROM grid CROSS JOIN range(4) o(k) WHERE v IS NOT NULL GROUP BY ALL)
        SELECT run_id, sensor, "window", n, list_avg(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS distance FROM w JOIN ref USING (run_id, sensor) WHERE n >= 20"""
    ),
    "distance",
)
def rolling_w1_distance(spark, d):
    return k.rolling_distance(grid(spark, d), 40, 214)


FAULTS = {
    "bias": "v + scale * 8",
    "ramp": "v + scale * 8 * (t - 214) / 100",
    "gain": "v * 1.8",
    "step": "v + CASE WHEN t >= 234 THEN scale * 8 ELSE 0 END",
    "dead": "first_v",
    "spikes": "v + CASE WHEN t % 17 = 0 THEN scale * 40 ELSE 0 END",
    "noise": "v + scale * 8 * ((t * 7919) % 201 - 100) / 100",
}


@query(
    "inject_fault",
    with_grid(
        NOISE
        + ", f AS (SELECT g.*, n.noise AS scale, first_value(v IGNORE NULLS) OVER (PARTITION BY run_id, sensor ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_v FROM grid g JOIN noise n USING (run_id, sensor)) "
        + " UNION ALL ".join(f"SELECT '{name}' AS fault, run_id, sensor, t, CASE WHEN t >= 214 THEN {sql} ELSE v END AS v FROM f" for name, sql in FAULTS.items())
    ),
    "v",
)
def inject_fault(spark, d):
    g = grid(spark, d)
    scale = k.noise_level(g).withColumnRenamed("noise", "scale")
    out = None
    for name in FAULTS:
        part = k.inject_fault(g, name, 214, 8.0, scale).select(F.lit(name).alias("fault"), "run_id", "sensor", "t", "v")
        out = part if out is None else out.unionByName(part)
    return out
