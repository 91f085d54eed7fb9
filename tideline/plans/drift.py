"""Queries of drift detection; ``price[A]`` drifts from week 300 on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import drift as x
from tideline.operators import kernels as k
from tideline.operators import packed as pk
from tideline.plans.fixtures import grid, with_grid
from tideline.plans.registry import query
from tideline.session import durable

END = 240
RAMP = """, g2 AS (SELECT run_id, sensor, episode, t, CASE WHEN sensor = 'price[A]' AND t >= 300 THEN v + (t - 300) * 150.0 ELSE v END AS v FROM grid)"""
PEERS = [("price", "price[A]", 0), ("price", "price[N]", 0), ("price[A]", "price", 0), ("price[A]", "price[R]", 0), ("price[N]", "price", 0), ("price[R]", "price", 1), ("quantity", "rows", 2), ("quantity", "price", 0)]
PEER_SQL = "(SELECT 'lineitem' AS run_id, * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in PEERS) + ") p(sensor, peer, lag))"
MASKS = [("price", 100, 130), ("price", 200, 205), ("rows", 150, 400)]


def ramp(spark, d):
    g = grid(spark, d).select("run_id", "sensor", "episode", "t", "v")
    return g.withColumn("v", F.when((F.col("sensor") == "price[A]") & (F.col("t") >= 300), F.col("v") + (F.col("t") - 300) * 150.0).otherwise(F.col("v")))


def peers(g):
    return g.select("run_id").distinct().select("run_id", F.inline(F.array(*[F.struct(F.lit(a).alias("sensor"), F.lit(b).alias("peer"), F.lit(c).alias("lag")) for a, b, c in PEERS])))


def aligned(spark, d):
    g = ramp(spark, d)
    return x.align_peers(g, peers(g))


def deviations(spark, d):
    a = durable(aligned(spark, d))
    return durable(x.deviations(a, durable(x.fit_models(a, END))))


def decided(spark, d):
    dev = deviations(spark, d)
    alarms = k.cusum(dev.where(F.col("t") >= END).withColumn("v", F.col("deviation")), 0.5, 20.0)
    return durable(x.decide(x.block_stats(dev, END, 16, 4), alarms, 3.0))


@query("apply_masks", with_grid(" SELECT g.run_id, g.sensor, g.t, CASE WHEN EXISTS (SELECT 1 FROM (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in MASKS) + ") m(sensor, a, b) WHERE m.sensor = g.sensor AND g.t >= m.a AND g.t < m.b) THEN NULL ELSE v END AS v FROM grid g"), "v")
def apply_masks(spark, d):
    g = grid(spark, d)
    masks = g.select("run_id").distinct().select("run_id", F.inline(F.array(*[F.struct(F.lit(a).alias("sensor"), F.lit(b).alias("from"), F.lit(c).alias("to")) for a, b, c in MASKS])))
    return x.apply_masks(g, masks).select("run_id", "sensor", "t", "v")


@query("align_peers", with_grid(RAMP + f" SELECT g.run_id, g.sensor, g.episode, g.t, g.v, p.peer, o.v AS u FROM g2 g JOIN {PEER_SQL} p USING (run_id, sensor) LEFT JOIN g2 o ON o.run_id = g.run_id AND o.sensor = p.peer AND o.episode = g.episode AND o.t = g.t - p.lag"), "v u")
def align_peers(spark, d):
    return aligned(spark, d)


@query("peer_model_fit")
def peer_model_fit(spark, d):
    return x.fit_models(aligned(spark, d), END)


COEF = [("price", "", 5.0, 10.0), ("price", "price[A]", 0.5, 10.0), ("price", "price[N]", 0.5, 10.0), ("quantity", "", 1.0, 2.0), ("quantity", "rows", 0.01, 2.0), ("quantity", "price", 0.0004, 2.0)]


@query(
    "peer_deviation",
    with_grid(
        RAMP
        + f""", a AS (SELECT g.run_id, g.sensor, g.episode, g.t, g.v, p.peer, o.v AS u FROM g2 g JOIN {PEER_SQL} p USING (run_id, sensor) LEFT JOIN g2 o ON o.run_id = g.run_id AND o.sensor = p.peer AND o.episode = g.episode AND o.t = g.t - p.lag
        ), m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c}, {s})" for a, b, c, s in COEF)}) m(sensor, peer, coef, sigma)
        ), s AS (SELECT run_id, a.sensor, episode, t, v, sum(coef * u) AS part, count(u) AS seen, count(*) AS wanted FROM a JOIN m ON m.sensor = a.sensor AND m.peer = a.peer GROUP BY ALL
        ), e AS (SELECT s.*, CASE WHEN seen = wanted THEN part + coef END AS expected, sigma FROM s JOIN m ON m.sensor = s.sensor AND m.peer = '') SELECT run_id, sensor, episode, t, v, expected, (v - expected) / sigma AS deviation FROM e"""
    ),
    "v expected deviation",
)
def peer_deviation(spark, d):
    a = aligned(spark, d)
    model = a.select("run_id").distinct().select("run_id", F.inline(F.array(*[F.struct(F.lit(s).alias("sensor"), F.lit(p).alias("peer"), F.lit(c).alias("coef"), F.lit(g).alias("sigma")) for s, p, c, g in COEF])))
    return x.deviations(a, model)


STD = """, base AS (SELECT run_id, sensor, median(v) AS m FROM g2 WHERE t < 240 GROUP BY ALL), spread AS (SELECT run_id, sensor, median(abs(v - m)) * 1.4826 AS s, any_value(m) AS m FROM g2 JOIN base USING (run_id, sensor) WHERE t < 240 GROUP BY ALL
), dev AS (SELECT run_id, sensor, episode, t, (v - m) / s AS deviation FROM g2 JOIN spread USING (run_id, sensor))"""


def own_deviation(spark, d):
    g = ramp(spark, d)
    base = g.where(F.col("t") < END)
    middle = base.groupBy("run_id", "sensor").agg(F.expr("percentile(v, 0.5)").alias("m"))
    spread = k.mad(base).withColumnRenamed("mad", "s")
    return g.join(middle, ["run_id", "sensor"]).join(spread, ["run_id", "sensor"]).select("run_id", "sensor", "episode", "t", ((F.col("v") - F.col("m")) / F.col("s")).alias("deviation"))


BLOCKS = STD + """, late AS (SELECT * FROM dev WHERE t >= 240), e AS (SELECT run_id, sensor, min(t) AS lo, max(t) AS hi FROM late GROUP BY ALL
), fine AS (SELECT run_id, sensor, max(abs(m)) AS max_deviation FROM (SELECT run_id, sensor, least((t - lo) // 4, greatest(1, (hi - lo + 1) // 4) - 1) AS b, median(deviation) AS m FROM late JOIN e USING (run_id, sensor) GROUP BY ALL) GROUP BY ALL
), b AS (SELECT run_id, sensor, least((t - lo) // 16, greatest(1, (hi - lo + 1) // 16) - 1) AS t, median(deviation) AS v FROM late JOIN e USING (run_id, sensor) GROUP BY ALL
), prs AS (SELECT x.run_id, x.sensor, (y.v - x.v) / (y.t - x.t) AS slope, sign(y.v - x.v) AS s FROM b x JOIN b y ON y.run_id = x.run_id AND y.sensor = x.sensor AND y.t > x.t WHERE x.v IS NOT NULL AND y.v IS NOT NULL
), sl AS (SELECT run_id, sensor, median(slope) AS slope, CAST(sum(s) AS DOUBLE) AS s FROM prs GROUP BY ALL
), tie AS (SELECT run_id, sensor, sum(k) AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT run_id, sensor, v, count(*) AS k FROM b WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL
), zz AS (SELECT run_id, sensor, slope, (s - sign(s)) / sqrt(CAST(n * (n - 1) * (2 * n + 5) - tied AS DOUBLE) / 18) AS z FROM sl JOIN tie USING (run_id, sensor)
), u AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS u FROM zz
), stats AS (SELECT run_id, sensor, max_deviation, slope, z, (0.254829592 * u - 0.284496736 * u * u + 1.421413741 * u * u * u - 1.453152027 * u * u * u * u + 1.061405429 * u * u * u * u * u) * exp(-x * x) AS p FROM u JOIN fine USING (run_id, sensor))"""
ALARMS = """, sums AS (SELECT *, sum(coalesce(deviation - 0.5, 0)) OVER w AS pu, sum(coalesce(-deviation - 0.5, 0)) OVER w AS pd FROM late WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
), st AS (SELECT *, pu - least(0, min(pu) OVER w) AS su, pd - least(0, min(pd) OVER w) AS sd FROM sums WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
), mk AS (SELECT *, coalesce(max(CASE WHEN su <= 0 THEN t END) OVER w, min(t) OVER w) AS zu, coalesce(max(CASE WHEN sd <= 0 THEN t END) OVER w, min(t) OVER w) AS zd, coalesce(lag(greatest(su, sd)) OVER w, 0) AS before FROM st WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
), al AS (SELECT run_id, sensor, min(t) AS alarm, arg_min(CASE WHEN su >= sd THEN zu ELSE zd END, t) AS onset FROM mk WHERE greatest(su, sd) > 20 AND before <= 20 GROUP BY ALL
), decided AS (SELECT s.*, alarm, onset, max_deviation >= 3 AND (coalesce(p, 1) < 0.01 OR alarm IS NOT NULL) AS drifting FROM stats s LEFT JOIN al USING (run_id, sensor))"""


def own_decided(spark, d):
    dev = own_deviation(spark, d)
    alarms = k.cusum(dev.where(F.col("t") >= END).withColumn("v", F.col("deviation")), 0.5, 20.0)
    return x.decide(x.block_stats(dev, END, 16, 4), alarms, 3.0)


@query("drift_block_stats", with_grid(RAMP + BLOCKS + " SELECT * FROM stats"), "max_deviation slope z p")
def drift_block_stats(spark, d):
    return x.block_stats(own_deviation(spark, d), END, 16, 4)


@query("drift_decision", with_grid(RAMP + BLOCKS + ALARMS + " SELECT * FROM decided"), "max_deviation slope z p")
def drift_decision(spark, d):
    return own_decided(spark, d)


@query(
    "drift_path_choice",
    with_grid(
        RAMP + BLOCKS + ALARMS + """, paths AS (SELECT run_id, sensor, 3 AS path, drifting, max_deviation FROM decided UNION ALL SELECT run_id, sensor, 1, max_deviation > 8, max_deviation FROM decided WHERE sensor LIKE 'p%' UNION ALL SELECT run_id, sensor, 2, max_deviation > 4, max_deviation FROM decided
        ), c AS (SELECT *, row_number() OVER (PARTITION BY run_id, sensor ORDER BY drifting DESC, path) AS place FROM paths) SELECT run_id, sensor, path, drifting, max_deviation FROM c WHERE place = 1"""
    ),
    "max_deviation",
)
def drift_path_choice(spark, d):
    own = own_decided(spark, d).select("run_id", "sensor", "drifting", "max_deviation")
    rows = F.array(F.struct(F.lit(3).alias("path"), F.col("drifting").alias("hit")), F.when(F.col("sensor").like("p%"), F.struct(F.lit(1).alias("path"), (F.col("max_deviation") > 8).alias("hit"))), F.struct(F.lit(2).alias("path"), (F.col("max_deviation") > 4).alias("hit")))
    paths = own.select("run_id", "sensor", "max_deviation", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("run_id", "sensor", "r.path", F.col("r.hit").alias("drifting"), "max_deviation")
    return x.choose_path(paths)


@query(
    "drift_in_range",
    with_grid(
        RAMP + BLOCKS + ALARMS + """, q AS (SELECT run_id, sensor, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM g2 WHERE t < 240 GROUP BY ALL
        ), m AS (SELECT g.run_id, g.sensor, median(v) AS median FROM g2 g JOIN decided USING (run_id, sensor) WHERE t <= alarm AND t > alarm - 16 GROUP BY ALL) SELECT run_id, sensor, median, median BETWEEN p1 AND p99 AS in_range FROM m JOIN q USING (run_id, sensor)"""
    ),
    "median",
)
def drift_in_range(spark, d):
    g = ramp(spark, d)
    return x.in_range(g, own_decided(spark, d), k.quantiles(g.where(F.col("t") < END), {"p1": 0.01, "p99": 0.99}), 16)


def moved(spark, d):
    """The series, week 240 as 0, and each with its deviation from what its peers tell, as rows."""
    own = ramp(spark, d).withColumn("t", F.col("t") - END)
    packed = durable(pk.pack(own))
    return packed, peers(packed), durable(pk.deviations(packed, peers(packed)))


def judged(spark, d):
    """Decisions, refits without each drifting sensor, and who is responsible."""
    packed, links, dev = moved(spark, d)
    found = pk.block_trends(dev.where("model is not null"), 0.5, 20.0, 16, 4)
    found = durable(found.withColumns({"drifting": (F.col("max_deviation") >= 3) & ((F.col("p") < 0.01) | F.col("alarm").isNotNull()), "alarm": F.col("alarm") + END, "onset": F.col("onset") + END}))
    refit = pk.refits(packed, links, found.where("drifting").select("run_id", "sensor"), 1.5)
    return found, refit, x.responsible(links, refit)


@query("drift_responsible")
def drift_responsible(spark, d):
    return judged(spark, d)[2]


@query("drift_victims")
def drift_victims(spark, d):
    return x.victims(*judged(spark, d))


@query("drift_report")
def drift_report(spark, d):
    found, _, blame = judged(spark, d)
    return x.report(found, blame)


@query("calibrate_drift")
def calibrate_drift(spark, d):
    """Alarms of every slack and limit on clean and drifting segments of the baseline, and the choice."""
    return pk.choose_drift(pk.drift_sweep(moved(spark, d)[2], 358, 16, 4, 3.0))
