"""Queries of relations and roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import relations as r
from tideline.operators import signals as s
from tideline.plans.fixtures import grid, with_grid
from tideline.plans.kernels import RANKS, held
from tideline.plans.registry import query
from tideline.plans.signals import FINGER
from tideline.session import durable

LEAST = 0.1
#: A delayed copy of ``rows`` and a nearly equal one of ``price`` are planted.
PLANT = """, planted AS (
  SELECT run_id, sensor, episode, t, v FROM grid
  UNION ALL SELECT run_id, 'rows_late', episode, t, lag(v, 3) OVER (PARTITION BY episode ORDER BY t) FROM grid WHERE sensor = 'rows'
  UNION ALL SELECT run_id, 'price_twin', episode, t, v + (t % 5) FROM grid WHERE sensor = 'price'
)"""
PR = RANKS.replace("FROM grid", "FROM planted")
PAIRS = (
    PLANT
    + PR
    + f""", pairs AS (SELECT a.run_id, a.sensor AS a, b.sensor AS b, count(*) AS n, CASE WHEN stddev_pop(a.rank) > 1e-9 AND stddev_pop(b.rank) > 1e-9 THEN corr(a.rank, b.rank) ELSE 0 END AS rho
  FROM ranks a JOIN ranks b ON b.run_id = a.run_id AND b.t = a.t AND a.sensor < b.sensor GROUP BY ALL HAVING abs(corr(a.rank, b.rank)) >= {LEAST})"""
)
EDGES = (
    PLANT
    + """, want AS (SELECT 'rows' AS a, 'rows_late' AS b UNION ALL SELECT 'price', 'price_twin' UNION ALL SELECT 'quantity', 'rows'
), lags AS (
  SELECT x.run_id, w.a, w.b, CAST(l.lag AS INTEGER) AS lag, CASE WHEN stddev_pop(x.v) > 1e-12 AND stddev_pop(y.v) > 1e-12 THEN corr(x.v, y.v) ELSE 0 END AS rho
  FROM want w JOIN planted x ON x.sensor = w.a CROSS JOIN range(-6, 7) l(lag) JOIN planted y ON y.sensor = w.b AND y.episode = x.episode AND y.t = x.t + l.lag WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY ALL
), best AS (SELECT *, row_number() OVER (PARTITION BY run_id, a, b ORDER BY round(abs(rho), 9) DESC, abs(lag), lag) AS place, max(rho) FILTER (WHERE lag = 0) OVER (PARTITION BY run_id, a, b) AS at_zero FROM lags
), edges AS (SELECT run_id, CASE WHEN lag > 0 THEN a ELSE b END AS source, CASE WHEN lag > 0 THEN b ELSE a END AS target, abs(lag) AS lag, rho, at_zero FROM best WHERE place = 1 AND abs(rho) > abs(at_zero) + 0.02)"""
)
GROUPS = """, strong AS (SELECT a, b FROM pairs WHERE abs(rho) >= 0.95 UNION ALL SELECT b, a FROM pairs WHERE abs(rho) >= 0.95
), reach AS (SELECT a AS sensor, a AS other FROM strong UNION SELECT r.sensor, s.b FROM reach r JOIN strong s ON s.a = r.other
), groups AS (SELECT 'lineitem' AS run_id, sensor, min(other) AS label FROM reach GROUP BY sensor)"""


def planted(spark, d):
    from pyspark.sql import Window

    g = grid(spark, d).select("run_id", "sensor", "episode", "t", "v")
    late = g.where("sensor = 'rows'").withColumns({"sensor": F.lit("rows_late"), "v": F.lag("v", 3).over(Window.partitionBy("episode").orderBy("t"))})
    twin = g.where("sensor = 'price'").withColumns({"sensor": F.lit("price_twin"), "v": F.col("v") + F.col("t") % 5})
    return g.unionByName(late).unionByName(twin)


def wanted(g):
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("rows", "rows_late"), ("price", "price_twin"), ("quantity", "rows"))])
    return g.select("run_id").distinct().select("run_id", F.inline(pairs))


def edges(spark, d):
    g = planted(spark, d)
    return r.lag_edges(g, wanted(g), 6)


@query("relation_pairs", with_grid(PAIRS + " SELECT * FROM pairs"), "rho")
def relation_pairs(spark, d):
    return r.rank_pairs(planted(spark, d), LEAST)


@query("relation_lag_edges", with_grid(EDGES + " SELECT * FROM edges"), "rho at_zero")
def relation_lag_edges(spark, d):
    return edges(spark, d)


@query("redundancy_groups", with_grid(PAIRS + GROUPS + " SELECT * FROM groups").replace("WITH ", "WITH RECURSIVE ", 1))
def redundancy_groups(spark, d):
    return r.redundancy_groups(r.rank_pairs(planted(spark, d), LEAST), 0.95)


@query("flow_order")
def flow_order(spark, d):
    ring = edges(spark, d).select("run_id", "source", "target", "rho")
    more = ring.select("run_id", F.inline(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(w).alias("rho")) for a, b, w in (("rows_late", "price", 0.9), ("price", "tax", 0.8), ("tax", "rows_late", 0.3))]))).distinct()
    return r.flow_order(ring.unionByName(more))


@query(
    "peers_top5",
    with_grid(
        PAIRS
        + """, both_ways AS (SELECT run_id, a AS sensor, b AS peer, rho FROM pairs UNION ALL SELECT run_id, b, a, rho FROM pairs
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, sensor ORDER BY round(abs(rho), 9) DESC, peer) AS place FROM both_ways WHERE peer NOT LIKE 'discount%') SELECT run_id, sensor, peer, rho, place FROM placed WHERE place <= 5"""
    ),
    "rho",
)
def peers_top5(spark, d):
    g = planted(spark, d)
    return r.peers(r.rank_pairs(g, LEAST), g.where("sensor like 'discount%'").select("run_id", "sensor").distinct())


BASE_END = 240
SCORES = (
    (EDGES + FINGER.replace("FROM grid", "FROM planted") + PAIRS.replace(PLANT, "") + GROUPS)
    + f""", bq AS (SELECT run_id, sensor, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS spread, median(v) AS med FROM planted WHERE t < {BASE_END} GROUP BY ALL
), bm AS (SELECT run_id, sensor, spread, 1.4826 * median(abs(v - med)) AS mad FROM planted JOIN bq USING (run_id, sensor) WHERE t < {BASE_END} GROUP BY ALL
), bs AS (SELECT run_id, sensor, coalesce(min(gap) FILTER (WHERE gap > 1e-9 * abs(v)), 0) AS step FROM (SELECT *, v - lag(v) OVER (PARTITION BY run_id, sensor ORDER BY v) AS gap FROM (SELECT DISTINCT run_id, sensor, v FROM planted WHERE v IS NOT NULL AND t < {BASE_END})) GROUP BY ALL
), f AS (SELECT q.*, flat_share, monotonic_share, flat_share / (1 + greatest(0, n_distinct - 2) / 8) AS step_like, CASE WHEN mad > 0 THEN spread / mad WHEN step > 0 THEN spread / step ELSE 0 END AS rpm
  FROM q JOIN r USING (run_id, sensor) JOIN m USING (run_id, sensor) JOIN bm USING (run_id, sensor) JOIN bs USING (run_id, sensor)
), i AS (SELECT e.target AS sensor, count(*) AS n_in, max(step_like * e.rho * e.rho) AS tracks, max(step_like * abs(e.rho)) AS follows FROM edges e JOIN f ON f.sensor = e.source GROUP BY e.target
), o AS (SELECT e.source AS sensor, count(*) AS n_out, max(abs(e.rho) * coalesce(tracks, 0)) AS leads, max(abs(e.rho)) AS tracked, bool_or(abs(e.at_zero) >= 0.5) AS led FROM edges e LEFT JOIN i ON i.sensor = e.target GROUP BY e.source
), ways AS (SELECT a, b, rho FROM pairs UNION ALL SELECT b, a, rho FROM pairs
), flat AS (SELECT * FROM ways WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.source = a AND e.target = b) OR (e.source = b AND e.target = a))
), act AS (SELECT * FROM (SELECT flat.a, flat.b, abs(flat.rho) AS score, row_number() OVER (PARTITION BY flat.a ORDER BY round(abs(flat.rho), 9) DESC, flat.b) AS place
  FROM flat JOIN f x ON x.sensor = flat.a JOIN f y ON y.sensor = flat.b JOIN o ON o.sensor = flat.a WHERE o.led AND abs(flat.rho) >= 0.95 AND y.rpm < x.rpm) WHERE place = 1
), con AS (SELECT b AS sensor, max(score) AS score FROM act GROUP BY b
), agr AS (SELECT ways.a AS sensor, max(abs(ways.rho) * sqrt(CASE WHEN greatest(x.rpm, y.rpm) > 0 THEN least(x.rpm, y.rpm) / greatest(x.rpm, y.rpm) ELSE 1 END)) AS score
  FROM ways JOIN groups ga ON ga.sensor = ways.a JOIN groups gb ON gb.sensor = ways.b AND gb.label = ga.label JOIN f x ON x.sensor = ways.a JOIN f y ON y.sensor = ways.b GROUP BY ways.a
), y AS (SELECT f.*, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(tracks, 0) AS tracks, coalesce(follows, 0) AS follows, coalesce(leads, 0) AS leads, coalesce(tracked, 0) AS tracked, coalesce(con.score, 0) AS rc, coalesce(act.score, 0) AS ra, coalesce(agr.score, 0) AS agrees
  FROM f LEFT JOIN i USING (sensor) LEFT JOIN o USING (sensor) LEFT JOIN con USING (sensor) LEFT JOIN act ON act.a = f.sensor LEFT JOIN agr ON agr.sensor = f.sensor
), scores AS (SELECT run_id, sensor, missing_rate, {{}} FROM y)"""
)
SCORES = SCORES.format(
    ", ".join(
        f"CAST(CASE WHEN n_distinct <= 1 THEN 0 ELSE {formula} END AS DOUBLE) AS {role}"
        for role, formula in {
            "setpoint": "step_like * tracked",
            "controlled": "greatest(tracks * (1 - leads), rc)",
            "actuator": "greatest(leads * (0.6 + 0.4 * follows) * (1 - step_like), ra)",
            "redundant": "agrees",
            "upstream": "CASE WHEN n_in + n_out > 0 THEN n_out / (n_in + n_out) * least(1, n_out / 3) * (1 - step_like) ELSE 0 END",
            "downstream": "CASE WHEN n_in + n_out > 0 THEN n_in / (n_in + n_out) * least(1, n_in / 3) * (1 - tracks) ELSE 0 END",
            "counter": "least(1, greatest(0, (monotonic_share - 0.5) / 0.5))",
            "state": "CASE WHEN n_distinct = 2 THEN 1 WHEN n_distinct <= 8 THEN step_like ELSE 0 END * (1 - tracked)",
        }.items()
    )
)
ROLES = """, long AS (UNPIVOT scores ON setpoint, controlled, actuator, redundant, upstream, downstream, counter, state INTO NAME role VALUE score
), placed AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM long WINDOW w AS (PARTITION BY run_id, sensor ORDER BY round(score, 9) DESC, list_position(['setpoint', 'controlled', 'actuator', 'redundant', 'upstream', 'downstream', 'counter', 'state'], role))
), roles AS (SELECT run_id, sensor, CASE WHEN score >= 0.3 THEN role ELSE 'unknown' END AS role, least(1, greatest(0, (score - nxt) * (1 - missing_rate))) AS confidence FROM placed WHERE place = 1)"""


def scores(spark, d):
    g = durable(planted(spark, d))
    pairs = durable(r.rank_pairs(g, LEAST))
    return r.role_scores(s.fingerprint(g, held(g)), r.range_per_mad(g.where(F.col("t") < BASE_END)), durable(r.lag_edges(g, wanted(g), 6)), pairs, r.redundancy_groups(pairs, 0.95))


@query("role_scores", with_grid(SCORES + " SELECT * FROM scores").replace("WITH ", "WITH RECURSIVE ", 1), "missing_rate setpoint controlled actuator redundant upstream downstream counter state")
def role_scores(spark, d):
    return scores(spark, d)


@query("role_assign", with_grid(SCORES + ROLES + " SELECT * FROM roles").replace("WITH ", "WITH RECURSIVE ", 1), "confidence")
def role_assign(spark, d):
    return r.assign_roles(scores(spark, d))


@query("role_override", with_grid(SCORES + ROLES + " SELECT run_id, sensor, CASE WHEN sensor LIKE 'tax%' THEN 'actuator' ELSE role END AS role, CASE WHEN sensor LIKE 'tax%' THEN 1 ELSE confidence END AS confidence FROM roles").replace("WITH ", "WITH RECURSIVE ", 1), "confidence")
def role_override(spark, d):
    roles = r.assign_roles(scores(spark, d))
    return r.override_roles(roles, grid(spark, d).where("sensor like 'tax%'").select("run_id", "sensor", F.lit("actuator").alias("role")).distinct())


@query("evidence_of_sensor", with_grid(PAIRS + " SELECT 'correlation' AS kind, a || ',' || b AS sensors, rho FROM pairs WHERE a = 'price' OR b = 'price'"), "rho")
def evidence_of_sensor(spark, d):
    evidence = r.rank_pairs(planted(spark, d), LEAST).select(F.lit("correlation").alias("kind"), F.array("a", "b").alias("sensors"), "rho")
    return evidence.where(F.array_contains("sensors", "price")).withColumn("sensors", F.array_join("sensors", ","))
