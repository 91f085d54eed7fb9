"""Queries of fault separation over the drifting grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import faults as f
from tideline.plans import registry
from tideline.plans.drift import ALARMS, BLOCKS, RAMP, own_decided, own_deviation, peer_deviation
from tideline.plans.fixtures import grid, with_grid
from tideline.plans.registry import query
from tideline.session import durable

N, N_SENSORS, REACH = 358, 20, 5
#: Learned relations and roles, a few per run: a, b, lag of b behind a, rho at lag 0, rho at the lag.
RELATIONS = [("price", "price[A]", 2, 0.5, 0.8), ("rows", "quantity", 3, 0.4, 0.7), ("price[A]", "discount", -4, 0.3, 0.6), ("rows[A]", "rows", 0, 0.9, 0.9), ("quantity[A]", "price[N]", 5, 0.2, 0.5), ("discount[A]", "tax[A]", 1, 0.5, 0.505), ("tax[A]", "price[A]", 6, 0.1, 0.3), ("price", "discount", 3, 0.2, 0.5), ("price", "quantity[N]", 3, 0.2, 0.6), ("price[A]", "quantity[N]", 1, 0.2, 0.6), ("price[A]", "rows[N]", 1, 0.2, 0.6), ("price[A]", "discount[N]", 2, 0.2, 0.6)]
ROLES = [("price[A]", "actuator"), ("price", "actuator"), ("quantity[N]", "controlled"), ("discount", "controlled"), ("discount[N]", "controlled"), ("rows", "actuator")]
REL_SQL = ", rel AS (SELECT 'lineitem' AS run_id, * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {lag}, {r}, {q})" for a, b, lag, r, q in RELATIONS) + ") v(a, b, lag, rho, rho_at_lag)), lead_to AS (SELECT run_id, CASE WHEN lag > 0 THEN a ELSE b END AS source, CASE WHEN lag > 0 THEN b ELSE a END AS target FROM rel WHERE lag <> 0 AND abs(rho_at_lag) > abs(rho) + 0.02)"
ROLE_SQL = ", roles AS (SELECT 'lineitem' AS run_id, * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ROLES) + ") v(sensor, role))"
MOVING = RAMP + BLOCKS + ALARMS + """, mv AS (SELECT run_id, sensor, split_part(sensor, '[', 1) AS family, max_deviation >= 1.45 AS drifting, coalesce(onset, 240) AS onset, CASE WHEN sensor LIKE '%[N]' OR sensor LIKE '%[R]' THEN split_part(sensor, '[', 1) || '[A]' END AS cause FROM decided
), marked AS (SELECT m.run_id, m.sensor, m.family, m.onset, o.sensor AS victim_of FROM mv m LEFT JOIN mv o ON o.run_id = m.run_id AND o.sensor = m.cause AND o.drifting WHERE m.drifting
), srcs AS (SELECT d.run_id, d.sensor, bool_and(NOT o.drifting OR coalesce(c.victim_of = d.sensor, false)) AS source FROM marked d JOIN mv o ON o.run_id = d.run_id AND o.family = d.family AND o.sensor <> d.sensor LEFT JOIN marked c ON c.run_id = o.run_id AND c.sensor = o.sensor WHERE d.victim_of IS NULL GROUP BY ALL
), found AS (SELECT marked.*, victim_of IS NULL AS driver, coalesce(source, false) AS source FROM marked LEFT JOIN srcs USING (run_id, sensor))"""
GROUPED = f""", dr AS (SELECT * FROM found WHERE driver), nb AS (SELECT a, b FROM rel UNION SELECT b, a FROM rel), rd AS (SELECT a, b FROM nb UNION SELECT x.a, y.b FROM nb x JOIN nb y ON y.a = x.b
), near AS (SELECT x.sensor AS a, y.sensor AS b FROM dr x JOIN dr y ON y.sensor <> x.sensor AND abs(x.onset - y.onset) <= greatest({2 * REACH}, {N} * 0.01)), ln AS (SELECT near.a, near.b FROM near JOIN rd USING (a, b)
), r1 AS (SELECT sensor AS a, sensor AS b FROM dr UNION SELECT r1.a, ln.b FROM r1 JOIN ln ON ln.a = r1.b), g1 AS (SELECT a AS sensor, min(b) AS label FROM r1 GROUP BY a
), wide AS (SELECT sensor FROM g1 WHERE label IN (SELECT label FROM g1 GROUP BY label HAVING count(*) >= {max(3, -(-N_SENSORS // 10))})), l2 AS (SELECT * FROM ln UNION SELECT near.a, near.b FROM near JOIN wide ON wide.sensor = near.a UNION SELECT near.b, near.a FROM near JOIN wide ON wide.sensor = near.a
), r2 AS (SELECT sensor AS a, sensor AS b FROM dr UNION SELECT r2.a, l2.b FROM r2 JOIN l2 ON l2.a = r2.b), g2l AS (SELECT a AS sensor, min(b) AS label FROM r2 GROUP BY a
), mx AS (SELECT dr.*, label, bool_or(source) OVER (PARTITION BY label) AND bool_or(NOT source) OVER (PARTITION BY label) AND source AS apart FROM dr JOIN g2l USING (sensor)
), gr AS (SELECT run_id, label, apart, string_agg(sensor, ',' ORDER BY sensor) AS drivers, min(onset) AS onset FROM mx GROUP BY ALL)"""


def moving(spark, d):
    cause = F.when(F.col("sensor").like("%[N]") | F.col("sensor").like("%[R]"), F.concat(F.split("sensor", r"\[")[0], F.lit("[A]")))
    return durable(own_decided(spark, d).select("run_id", "sensor", F.split("sensor", r"\[")[0].alias("family"), (F.col("max_deviation") >= 1.45).alias("drifting"), F.coalesce("onset", F.lit(240)).cast("long").alias("onset"), cause.alias("victim_of")))


def rows(g, values, names):
    return g.select("run_id").distinct().select("run_id", F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v)]) for v in values])))


def relations(g):
    return rows(g, RELATIONS, ("a", "b", "lag", "rho", "rho_at_lag"))


@query("drivers_and_sources", with_grid(MOVING + " SELECT run_id, sensor, victim_of, driver, source FROM found"))
def drivers_and_sources(spark, d):
    return f.drivers(moving(spark, d)).select("run_id", "sensor", "victim_of", "driver", "source")


@query("driver_groups", with_grid(MOVING + REL_SQL + GROUPED + f" SELECT run_id, drivers, onset, coalesce(lead(onset) OVER (PARTITION BY run_id ORDER BY onset, drivers), {N}) AS until FROM gr").replace("WITH ", "WITH RECURSIVE ", 1))
def driver_groups(spark, d):
    m = moving(spark, d)
    return f.driver_groups(f.drivers(m).where("driver").withColumn("reach", F.lit(REACH)), relations(m), N, N_SENSORS).drop("members")


@query("control_loop", with_grid(MOVING + REL_SQL + ROLE_SQL + """, held AS (SELECT f.run_id, f.sensor AS actuator, min(e.target) AS controlled FROM found f JOIN roles r ON r.sensor = f.sensor AND r.role = 'actuator' JOIN lead_to e ON e.source = f.sensor JOIN roles c ON c.sensor = e.target AND c.role = 'controlled' JOIN mv ON mv.sensor = e.target AND NOT mv.drifting WHERE f.driver GROUP BY ALL
), led AS (SELECT DISTINCT h.run_id, actuator, e.target FROM held h JOIN lead_to e ON e.source IN (h.actuator, h.controlled) WHERE e.target NOT IN (h.actuator, h.controlled))
SELECT h.run_id, h.actuator, h.controlled, count(led.target) AS downstream, count(mv.sensor) AS shifted FROM held h LEFT JOIN led USING (run_id, actuator) LEFT JOIN mv ON mv.sensor = led.target AND mv.drifting GROUP BY ALL"""))
def control_loop(spark, d):
    m = moving(spark, d)
    return f.control_loops(f.drivers(m), m, rows(m, ROLES, ("sensor", "role")), relations(m))


@query("onset_agreement", with_grid(MOVING + REL_SQL + " SELECT e.run_id, count(*) AS edges, count(*) FILTER (WHERE y.onset >= x.onset) AS agree FROM lead_to e JOIN found x ON x.sensor = e.source JOIN found y ON y.sensor = e.target GROUP BY e.run_id"))
def onset_agreement(spark, d):
    m = moving(spark, d)
    return f.onset_agreement(m.where("drifting"), relations(m))


@query("level_dependence", f"WITH p AS ({registry._oracles['peer_deviation']}), k AS (SELECT run_id, sensor, t, rank() OVER (PARTITION BY run_id, sensor ORDER BY deviation) + (count(*) OVER (PARTITION BY run_id, sensor, deviation) - 1) / 2.0 AS u, rank() OVER (PARTITION BY run_id, sensor ORDER BY expected) + (count(*) OVER (PARTITION BY run_id, sensor, expected) - 1) / 2.0 AS w FROM p WHERE t >= 300 AND deviation IS NOT NULL AND expected IS NOT NULL) SELECT run_id, sensor, corr(u, w) AS rho, count(*) AS n FROM k GROUP BY ALL", "rho")
def level_dependence(spark, d):
    return f.level_dependence(registry.rounded(peer_deviation(spark, d)), 300)


@query("process_kind")
def process_kind(spark, d):
    return f.process_kind(durable(own_deviation(spark, d)), 300, N, 10)


LABEL_SQL = "CASE fault " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in f.LABELS.items()) + " END"


@query(
    "fault_labels",
    with_grid(f", h AS (SELECT run_id, sensor, CASE WHEN avg(CAST(v IS NULL AS INT)) > 0.01 THEN 'dropout' WHEN max(v) - min(v) < 0.05 THEN 'stuck' WHEN sensor LIKE 'rows%' THEN 'timebase' WHEN sensor LIKE 'price%' THEN 'noisy' ELSE 'resolution' END AS health FROM grid GROUP BY run_id, sensor), c AS (SELECT *, CASE WHEN health IN ('timebase', 'resolution') THEN 'data-' ELSE 'sensor-' END || health AS fault FROM h) SELECT *, split_part(fault, '-', 1) AS family, {LABEL_SQL} AS label FROM c"),
)
def fault_labels(spark, d):
    s = F.col("sensor")
    kinds = grid(spark, d).groupBy("run_id", "sensor").agg(F.avg(F.col("v").isNull().cast("int")).alias("gone"), (F.max("v") - F.min("v")).alias("span"))
    health = F.when(F.col("gone") > 0.01, "dropout").when(F.col("span") < 0.05, "stuck").when(s.like("rows%"), "timebase").when(s.like("price%"), "noisy").otherwise("resolution")
    found = kinds.select("run_id", "sensor", health.alias("health")).withColumn("fault", f.fault_of_health(F.col("health")))
    return found.withColumns({"family": f.family_of(F.col("fault")), "label": f.label_of(F.col("fault"))})


SCALE = """, x AS (SELECT *, t >= 300 AS late FROM grid), dd AS (SELECT *, v - lag(v) OVER (PARTITION BY run_id, sensor, episode, late ORDER BY t) AS d FROM x
), sm AS (SELECT run_id, sensor, late, median(v) AS level, median(d) AS md, count(v) AS n FROM dd GROUP BY ALL), sn AS (SELECT run_id, sensor, late, any_value(level) AS level, any_value(n) AS n, coalesce(median(abs(d - md)), 0) AS noise FROM dd JOIN sm USING (run_id, sensor, late) GROUP BY ALL
), sq AS (SELECT b.run_id, b.sensor, CASE WHEN b.n >= 10 AND a.n >= 10 AND sign(b.level) = sign(a.level) AND b.level <> 0 THEN a.level / b.level ELSE 1 END AS level_ratio, CASE WHEN b.n >= 10 AND a.n >= 10 AND b.noise > 0 THEN a.noise / b.noise ELSE 1 END AS spread_ratio FROM sn b JOIN sn a ON a.run_id = b.run_id AND a.sensor = b.sensor AND a.late AND NOT b.late
), scaled AS (SELECT *, abs(ln(level_ratio)) > 0.05 AND sign(ln(level_ratio)) = sign(ln(spread_ratio)) AND abs(ln(spread_ratio)) > 0.5 * abs(ln(level_ratio)) AS gain FROM sq)"""


@query("scale_change", with_grid(SCALE + " SELECT * FROM scaled"), "level_ratio spread_ratio")
def scale_change(spark, d):
    return f.scale_change(grid(spark, d), 300)


@query(
    "fault_verdict",
    with_grid(
        MOVING + SCALE + """, fam AS (SELECT m.run_id, m.family, count(*) AS n_drivers, bool_and(m.source) AS all_sources, min(m.onset) AS onset, bool_or(gain) AS gain FROM found m JOIN scaled USING (run_id, sensor) WHERE driver GROUP BY ALL
        ), sh AS (SELECT run_id, count(*) / 20.0 AS share, min(onset) AS shared_at FROM found WHERE onset <= (SELECT min(onset) FROM found) + 1 GROUP BY ALL)
        SELECT run_id, family, CASE WHEN share >= 0.8 AND abs(onset - shared_at) <= 10 THEN 'data-logging' WHEN all_sources OR (n_drivers = 1 AND family NOT IN ('discount', 'quantity')) THEN CASE WHEN family = 'tax' THEN 'sensor-drift' WHEN gain THEN 'sensor-drift-gain' ELSE 'sensor-drift-bias' END
        WHEN n_drivers = 1 AND family = 'discount' THEN 'sensor-drift' WHEN family = 'quantity' THEN 'sensor-drift-hidden' ELSE 'process-step' END AS fault FROM fam JOIN sh USING (run_id)"""
    ),
)
def fault_verdict(spark, d):
    found = durable(f.drivers(moving(spark, d)))
    first = F.broadcast(found.groupBy("run_id").agg(F.min("onset").alias("shared_at")))  # one row per run
    shared = found.join(first, "run_id").where("onset <= shared_at + 1").groupBy("run_id", "shared_at").agg((F.count("*") / N_SENSORS).alias("shared_share"))
    cases = found.where("driver").join(f.scale_change(grid(spark, d), 300), ["run_id", "sensor"]).groupBy("run_id", "family").agg(F.count("*").alias("n_drivers"), F.bool_and("source").alias("all_sources"), F.min("onset").alias("onset"), F.bool_or("gain").alias("gain"))
    family = F.col("family")
    known = {"slack": F.lit(10), "modelled": family != "tax", "redundant": family == "discount", "in_loop": family == "quantity", "shifted": F.lit(1), "kind": F.lit("process-step")}
    return f.verdict(cases.join(shared, "run_id").withColumns(known)).select("run_id", "family", "fault")
