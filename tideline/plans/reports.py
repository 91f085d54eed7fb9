"""Queries of tools, reports, faults and the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import reports as r
from tideline.plans import registry
from tideline.plans.drift import ALARMS, BLOCKS, RAMP, own_decided
from tideline.plans.fixtures import grid, table, with_grid
from tideline.plans.health import health_gate
from tideline.plans.kernels import RANKS
from tideline.plans.registry import query

MIDS = "[" + ", ".join(f"{(x + 0.5) / 200}" for x in range(200)) + "]"
WINDOWS = {"a": "t >= 160 AND t < 220", "b": "t >= 300 AND t < 380"}
OF_WINDOWS = ", ".join(f"count(v) FILTER (WHERE {w}) AS n_{n}, median(v) FILTER (WHERE {w}) AS median_{n}, quantile_cont(v, 0.01) FILTER (WHERE {w}) AS p1_{n}, quantile_cont(v, 0.99) FILTER (WHERE {w}) AS p99_{n}, quantile_cont(v, {MIDS}) FILTER (WHERE {w}) AS q_{n}" for n, w in WINDOWS.items())
OF_BINS = ", ".join(f"median(abs(v - median_{n})) FILTER (WHERE {w}) * 1.4826 AS mad_{n}, concat_ws(' ', {', '.join(f'count(*) FILTER (WHERE bin = {j} AND {w})' for j in range(20))}) AS bins_{n}" for n, w in WINDOWS.items())


@query(
    "tool_compare_windows",
    with_grid(
        f""", s AS (SELECT run_id, sensor, {OF_WINDOWS} FROM grid WHERE sensor NOT LIKE 'rows%' GROUP BY ALL
        ), e AS (SELECT *, least(p1_a, p1_b) AS lo, greatest(p99_a, p99_b) AS hi, list_avg(list_transform(list_zip(q_a, q_b), lambda z: abs(z[1] - z[2]))) AS distance FROM s
        ), m AS (SELECT g.run_id, g.sensor, g.t, g.v, e.median_a, e.median_b, CASE WHEN v < lo THEN 0 WHEN v > hi THEN 19 WHEN hi > lo THEN least(19, 1 + floor((v - lo) / ((hi - lo) / 18))) ELSE 9 END AS bin FROM grid g JOIN e USING (run_id, sensor) WHERE v IS NOT NULL
        ), x AS (SELECT run_id, sensor, {OF_BINS} FROM m GROUP BY ALL)
        SELECT run_id, sensor, n_a, n_b, median_a, median_b, mad_a, mad_b, bins_a, bins_b, lo, hi, distance FROM e JOIN x USING (run_id, sensor)"""
    ),
    "median_a median_b mad_a mad_b lo hi distance",
)
def tool_compare_windows(spark, d):
    told = r.compare_windows(grid(spark, d).where("sensor not like 'rows%'"), (160, 220), (300, 380))
    return told.withColumns({c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))) for c in ("bins_a", "bins_b")})


@query(
    "tool_test_relation",
    with_grid(
        ", part AS (SELECT * FROM grid WHERE t >= 160 AND t < 300)"
        + RANKS.replace("FROM grid", "FROM part")
        + """, rho AS (SELECT a.run_id, a.sensor AS a, b.sensor AS b, CASE WHEN stddev_pop(a.rank) > 1e-12 AND stddev_pop(b.rank) > 1e-12 THEN corr(a.rank, b.rank) ELSE 0 END AS rho, count(*) AS n FROM ranks a JOIN ranks b ON b.run_id = a.run_id AND b.t = a.t WHERE a.sensor = 'price' AND b.sensor LIKE 'price[%' GROUP BY ALL
        ), lags AS (SELECT a.run_id, a.sensor AS a, b.sensor AS b, CAST(l.lag AS INTEGER) AS lag, CASE WHEN stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12 THEN corr(a.v, b.v) ELSE 0 END AS rho_at_lag
          FROM part a CROSS JOIN range(-64, 65) l(lag) JOIN part b ON b.run_id = a.run_id AND b.episode = a.episode AND b.t = a.t + l.lag WHERE a.sensor = 'price' AND b.sensor LIKE 'price[%' AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL
        ), best AS (SELECT * FROM lags QUALIFY row_number() OVER (PARTITION BY run_id, a, b ORDER BY round(abs(rho_at_lag), 9) DESC, abs(lag), lag) = 1)
        SELECT run_id, a, b, rho, n, lag, rho_at_lag FROM rho LEFT JOIN best USING (run_id, a, b)"""
    ),
    "rho rho_at_lag",
)
def tool_test_relation(spark, d):
    """Each split of the price against the price, in a window of 140 weeks."""
    g = grid(spark, d)
    pairs = g.where("sensor like 'price[%'").select("run_id", F.lit("price").alias("a"), F.col("sensor").alias("b")).distinct()
    return r.relation_in_window(g, pairs, (160, 300))


@query(
    "run_diff",
    """WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
    SELECT * FROM (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, o.n AS "old", n.n AS "new", CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed' WHEN o.n IS DISTINCT FROM n.n THEN 'changed' END AS change
    FROM o FULL JOIN n ON n.user_id = o.user_id AND n.event_type = o.event_type) WHERE change IS NOT NULL""",
)
def run_diff(spark, d):
    e = table(spark, d, "events")
    count = lambda x: x.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return r.run_diff(count(e.where("ts < TIMESTAMP'2024-01-16'")), count(e.where("ts >= TIMESTAMP'2024-01-16'")), ["user_id", "event_type"], "n")


@query("effective_overrides", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL", "value")
def effective_overrides(spark, d):
    return r.effective(table(spark, d, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq")), ["user_id", "event_type"])


@query("supersession_chain", "SELECT event_id AS id, max(event_id) OVER (PARTITION BY user_id) AS head FROM events")
def supersession_chain(spark, d):
    from pyspark.sql import Window

    links = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("supersedes"))
    return r.chains(links)


@query(
    "supersession_ancestors",
    """WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM events)
    SELECT a.event_id AS id, b.event_id AS ancestor, a.place - b.place AS depth FROM e a JOIN e b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.place < a.place""",
)
def supersession_ancestors(spark, d):
    """Events of a user and type, each of which supersedes the one before: all ancestors of each."""
    from pyspark.sql import Window

    own = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return r.ancestors(table(spark, d, "events").select(F.col("event_id").alias("id"), F.lag("event_id").over(own).alias("supersedes")))


@query(
    "report_lanes",
    with_grid(
        """, s AS (SELECT *, min(t) OVER w AS lo, greatest(1, CAST(ceil((max(t) OVER w - min(t) OVER w + 1) / 240.0) AS BIGINT)) AS size FROM grid WINDOW w AS (PARTITION BY run_id, sensor)
        ), b AS (SELECT run_id, sensor, coalesce(quantile_cont(v, 0.01), 0) AS p1, coalesce(quantile_cont(v, 0.99), 0) AS p99 FROM grid WHERE t < 240 GROUP BY ALL)
        SELECT s.run_id, s.sensor, (t - lo) // size AS bucket, avg(v) AS v, any_value(p1) AS p1, any_value(p99) AS p99 FROM s JOIN b ON b.run_id = s.run_id AND b.sensor = s.sensor WHERE s.sensor NOT LIKE 'rows%' GROUP BY ALL"""
    ),
    "v p1 p99",
)
def report_lanes(spark, d):
    return r.lanes(grid(spark, d).where("sensor not like 'rows%'"), 240)


@query("report_drift_order", with_grid(RAMP + BLOCKS + ALARMS + " SELECT run_id, sensor, max_deviation, CAST(row_number() OVER (ORDER BY round(max_deviation, 9) DESC, sensor) AS INTEGER) AS place FROM decided WHERE drifting"), "max_deviation")
def report_drift_order(spark, d):
    from pyspark.sql import Window

    return own_decided(spark, d).where("drifting").select("run_id", "sensor", "max_deviation", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(F.round("max_deviation", 9)), "sensor")).alias("place"))


@query(
    "sensor_alerts",
    f"SELECT run_id, sensor, 'health' AS kind, health AS verdict FROM ({registry._oracles['health_gate']}) WHERE health <> 'healthy' UNION ALL SELECT run_id, sensor, 'drift', 'drifting' FROM ({with_grid(RAMP + BLOCKS + ALARMS + ' SELECT run_id, sensor FROM decided WHERE drifting')})",
)
def sensor_alerts(spark, d):
    return r.alerts(health_gate(spark, d), own_decided(spark, d))


@query("faceted_search", "SELECT doc_id, source, lang FROM documents WHERE (contains(lower(lang), 'en') OR contains(lower(lang), 'fr')) AND (contains(lower(text), 'idiot') OR contains(lower(text), 'license'))")
def faceted_search(spark, d):
    return r.faceted(table(spark, d, "documents"), [[("lang", "en"), ("lang", "fr")], [("text", "idiot"), ("text", "license")]]).select("doc_id", "source", "lang")


@query("egress_totals", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS sent, sum(length(props))::BIGINT AS raw_bytes, sum(CASE WHEN value > 50 THEN length(props) ELSE 0 END)::BIGINT AS sent_bytes FROM events GROUP BY event_type")
def egress_totals(spark, d):
    sent, size = F.col("value") > 50, F.length("props")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(sent).alias("sent"), F.sum(size).alias("raw_bytes"), F.sum(F.when(sent, size).otherwise(0)).alias("sent_bytes"))


@query("newest_off_run", "SELECT user_id, max(event_id) AS newest FROM events GROUP BY user_id HAVING bool_and(event_type <> 'purchase' OR value < 90) ORDER BY newest DESC LIMIT 1")
def newest_off_run(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("newest"), F.bool_and((F.col("event_type") != "purchase") | (F.col("value") < 90)).alias("off"))
    return e.where("off").orderBy(F.desc("newest")).limit(1).select("user_id", "newest")


@query("assign_ids", "SELECT user_id, event_id, 'ev' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR), 6, '0') AS id FROM events")
def assign_ids(spark, d):
    return r.assign_ids(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ev").select("user_id", "event_id", "id")


def log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", "event_id").alias("text"))


@query("log_chain_build")
def log_chain_build(spark, d):
    return r.build_chain(log(spark, d))


@query("log_chain_verify", "SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS n, min(event_id) FILTER (WHERE event_id % 977 = 5) AS first_bad FROM events GROUP BY user_id")
def log_chain_verify(spark, d):
    forged = r.build_chain(log(spark, d)).withColumn("text", F.when(F.col("seq") % 977 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return r.verify_chain(forged)


@query(
    "log_export",
    """SELECT event_id, event_id || ',' || event_type || ',' || CASE WHEN regexp_matches(props, '[",\r\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE coalesce(props, '') END AS csv,
    CAST(json_object('event_id', event_id, 'event_type', event_type, 'props', props) AS VARCHAR) AS json FROM events""",
)
def log_export(spark, d):
    return r.log_lines(table(spark, d, "events"), ["event_id", "event_type", "props"], "event_id")


@query(
    "shared_changepoint",
    with_grid(
        """, p AS (SELECT run_id, sensor, t AS cut_t FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sensor ORDER BY abs(v) DESC, t) AS place FROM grid WHERE sensor NOT LIKE 'rows%' AND v IS NOT NULL) WHERE place = 1), c AS (SELECT a.run_id, a.cut_t AS at_t, count(DISTINCT b.sensor) AS sensors FROM (SELECT DISTINCT run_id, cut_t FROM p) a JOIN p b ON b.run_id = a.run_id AND abs(a.cut_t - b.cut_t) <= 3 GROUP BY ALL)
        SELECT run_id, arg_max(at_t, sensors * 100000 - at_t) AS at_t, max(sensors) AS sensors FROM c GROUP BY run_id"""
    ),
)
def shared_changepoint(spark, d):
    points = grid(spark, d).where("sensor not like 'rows%' and v is not null").groupBy("run_id", "sensor").agg(F.max_by("t", F.struct(F.abs("v"), -F.col("t"))).alias("cut_t"))
    return r.shared_change(points, 3)


RANKED = RAMP + BLOCKS + ALARMS + """, d2 AS (SELECT *, max_deviation >= 2 AS far, sensor LIKE '%[%' AS victim FROM decided), rk AS (SELECT run_id, sensor, victim, max_deviation / sum(max_deviation) OVER (PARTITION BY run_id) AS contribution FROM d2 WHERE far)"""


def ranked(spark, d):
    return own_decided(spark, d).withColumns({"drifting": F.col("max_deviation") >= 2, "victim": F.contains("sensor", F.lit("["))})


@query("fault_ranking", with_grid(RANKED + " SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY victim, round(contribution, 9) DESC, sensor) AS INTEGER) AS place FROM rk"), "contribution")
def fault_ranking(spark, d):
    return r.ranking(ranked(spark, d))
