"""Queries of the health gate and of rules; one sensor of each kind has a planted fault after the baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import health as h
from tideline.operators import kernels as k
from tideline.operators import packed as pk
from tideline.plans.fixtures import grid, table, with_grid
from tideline.plans.registry import query
from tideline.session import durable

END, SIZE = 240, 32

PLANTED = """, sick AS (
  SELECT run_id, sensor, episode, t, CASE WHEN t < 300 THEN v WHEN sensor = 'price' THEN 53000 WHEN sensor = 'rows' THEN v + (t * 37 % 19 - 9) * 8
    WHEN sensor = 'quantity' AND t % 3 = 0 THEN NULL WHEN sensor = 'discount' AND t % 9 = 0 THEN v + 5 WHEN sensor = 'tax' THEN round(v, 3) ELSE v END AS v FROM (SELECT * REPLACE (CASE WHEN sensor = 'tax' THEN round(v, 4) ELSE v END AS v) FROM grid)
), parts AS (SELECT *, CASE WHEN t < 240 THEN 0 ELSE 1 END AS part FROM sick
), ends AS (SELECT *, min(t) OVER w AS lo, max(t) OVER w AS hi FROM parts WINDOW w AS (PARTITION BY run_id, sensor, episode, part)
), blocks AS (SELECT run_id, sensor, episode, t, v, part, lo + least((t - lo) // 32, greatest(1, (hi - lo + 1) // 32) - 1) * 32 AS block FROM ends
)"""
STATS = (
    PLANTED
    + """, d AS (SELECT *, v - lag(v) OVER w AS d, list(v) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY run_id, sensor, episode ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near
  FROM blocks WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
), d2 AS (SELECT *, list_median(near) AS med FROM d), d3 AS (SELECT *, coalesce(len(near) >= 3 AND v IS NOT NULL AND abs(v - med) > 3 * 1.4826 * list_median(list_transform(near, lambda x: abs(x - med))), false) AS spike FROM d2
), mid AS (SELECT run_id, sensor, part, block, median(d) AS mid_d, median(v) AS level, avg(CAST(v IS NULL AS INT)) AS missing, avg(CAST(spike AS INT)) AS spikes, count(*) AS n FROM d3 GROUP BY ALL
), nz AS (SELECT run_id, sensor, part, block, coalesce(median(abs(d - mid_d)), 0) * 1.4826 / sqrt(2) AS noise FROM d3 JOIN mid USING (run_id, sensor, part, block) GROUP BY ALL
), mass AS (SELECT run_id, sensor, part, block, max(m) AS most, count(*) AS levels FROM (SELECT run_id, sensor, part, block, v, count(*) AS m FROM blocks WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL
), ch AS (SELECT *, CASE WHEN v IS NULL OR lag(v) OVER w IS NULL OR v <> lag(v) OVER w THEN 1 ELSE 0 END AS change FROM blocks WINDOW w AS (PARTITION BY run_id, sensor, part, block ORDER BY t)
), il AS (SELECT *, sum(change) OVER (PARTITION BY run_id, sensor, part, block ORDER BY t) AS island FROM ch
), lg AS (SELECT run_id, sensor, part, block, max(run) AS longest FROM (SELECT run_id, sensor, part, block, island, count(*) AS run FROM il WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL
), gp AS (SELECT run_id, sensor, part, block, min(gap) FILTER (WHERE gap > 1e-9 * abs(v)) AS step FROM (SELECT *, v - lag(v) OVER (PARTITION BY run_id, sensor, part, block ORDER BY v) AS gap FROM (SELECT DISTINCT run_id, sensor, part, block, v FROM blocks WHERE v IS NOT NULL)) GROUP BY ALL
), stats AS (
  SELECT run_id, sensor, part, block, n, missing, noise, spikes, level, coalesce(longest, 0) AS longest, coalesce(most / n, 0) AS edge_mass, coalesce(levels, 0) AS levels, coalesce(step, 0) AS step
  FROM mid LEFT JOIN gp USING (run_id, sensor, part, block) JOIN nz USING (run_id, sensor, part, block) LEFT JOIN mass USING (run_id, sensor, part, block) LEFT JOIN lg USING (run_id, sensor, part, block)
)"""
)
REFERENCE = (
    STATS
    + """, base AS (SELECT run_id, sensor, max(missing) AS ref_missing, quantile_cont(longest, 0.99) AS ref_run, median(noise) AS ref_noise, max(spikes) AS ref_spikes, max(edge_mass) AS ref_mass, min(step) FILTER (WHERE step > 0) AS lo_step, max(step) AS hi_step FROM stats WHERE part = 0 GROUP BY ALL
), inside AS (SELECT run_id, sensor, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, count(DISTINCT v) AS "distinct", count(DISTINCT v) > 1 AND count(DISTINCT v) < count(v) / 2 AS coarse FROM blocks WHERE part = 0 GROUP BY ALL
), ref AS (SELECT * EXCLUDE (lo_step, hi_step, coarse), CASE WHEN coarse THEN lo_step END AS least_step, CASE WHEN coarse THEN hi_step END AS most_step FROM base JOIN inside USING (run_id, sensor))"""
)
FACTOR = "coalesce(CASE WHEN step = 0 THEN 1 WHEN step > most_step THEN step / most_step WHEN step < least_step THEN least_step / step END, 1)"
CHECKS = {
    "dropout": ("missing", "3 * greatest(0.01, ref_missing)", "missing > 3 * greatest(0.01, ref_missing)"),
    "dead": ("CAST(longest AS DOUBLE)", "3 * ref_run", "longest > 3 * ref_run"),
    "stuck": ("noise", "0.2 * ref_noise", "noise < 0.2 * ref_noise"),
    "spikes": ("spikes", "greatest(0.02, 3 * ref_spikes)", "spikes > greatest(0.02, 3 * ref_spikes)"),
    "saturated": ("edge_mass", "greatest(0.3, 3 * ref_mass)", '"distinct" >= 20 AND edge_mass > greatest(0.3, 3 * ref_mass)'),
    "noisy": ("noise", "3 * ref_noise", "noise > 3 * ref_noise AND level BETWEEN p1 AND p99"),
    "resolution": (FACTOR, "4", f"{FACTOR} > 4"),
}
CHECKED = (
    REFERENCE
    + ", checks AS ("
    + " UNION ALL ".join(
        f"SELECT run_id, sensor, part, block, {i} AS \"order\", '{n}' AS \"check\", CAST({s} AS DOUBLE) AS statistic, CAST({t} AS DOUBLE) AS threshold, coalesce({f}, false) AS failed FROM stats JOIN ref USING (run_id, sensor)" for i, (n, (s, t, f)) in enumerate(CHECKS.items())
    )
    + ")"
)
SUPPRESSED = (
    CHECKED
    + """, shared AS (SELECT *, sum(CAST(failed AS INT)) OVER w >= greatest(3, 0.1 * count(*) OVER w) AND "check" = 'noisy' AS many FROM checks WINDOW w AS (PARTITION BY run_id, block, "check")
), final AS (SELECT run_id, sensor, part, block, "order", "check", statistic, threshold, failed AND NOT many AS failed, many AND failed AS plant_wide FROM shared)"""
)


def sick(spark, d):
    g = grid(spark, d)
    late, s, t = F.col("t") >= 300, F.col("sensor"), F.col("t")
    g = g.withColumn("v", F.when(s == "tax", F.round("v", 4)).otherwise(F.col("v")))
    v = (
        F.when(~late, F.col("v"))
        .when(s == "price", 53000.0)
        .when(s == "rows", F.col("v") + (t * 37 % 19 - 9) * 8)
        .when((s == "quantity") & (t % 3 == 0), None)
        .when((s == "discount") & (t % 9 == 0), F.col("v") + 5)
        .when(s == "tax", F.round("v", 3))
        .otherwise(F.col("v"))
    )
    return h.with_blocks(g.withColumn("v", v), SIZE, END)


def checks(spark, d):
    blocks = sick(spark, d)
    stats = h.block_stats(blocks)
    return h.checked(stats, h.reference(blocks, stats))


@query("health_blocks", with_grid(PLANTED + " SELECT run_id, sensor, t, part, block FROM blocks"))
def health_blocks(spark, d):
    return sick(spark, d).select("run_id", "sensor", "t", "part", "block")


@query("health_block_stats", with_grid(STATS + " SELECT * FROM stats"), "missing noise spikes level edge_mass step")
def health_block_stats(spark, d):
    return h.block_stats(sick(spark, d))


@query("health_reference", with_grid(REFERENCE + " SELECT * FROM ref"), "ref_missing ref_run ref_noise ref_spikes ref_mass p1 p99 least_step most_step")
def health_reference(spark, d):
    blocks = sick(spark, d)
    return h.reference(blocks, h.block_stats(blocks))


def _register(name: str) -> None:
    @query(f"health_{name}", with_grid(CHECKED + f" SELECT run_id, sensor, block, statistic, threshold, failed FROM checks WHERE \"check\" = '{name}'"), "statistic threshold")
    def one(spark, d):
        return checks(spark, d).where(F.col("check") == name).select("run_id", "sensor", "block", "statistic", "threshold", "failed")


for _name in CHECKS:
    _register(_name)


@query("health_plant_wide", with_grid(SUPPRESSED + " SELECT run_id, sensor, block, \"check\", failed, plant_wide FROM final WHERE \"check\" = 'noisy'"))
def health_plant_wide(spark, d):
    return h.suppressed(checks(spark, d)).where("check = 'noisy'").select("run_id", "sensor", "block", "check", "failed", "plant_wide")


@query(
    "health_gate",
    with_grid(
        SUPPRESSED
        + """, each AS (SELECT run_id, sensor, "order", "check" AS health, min(block) AS from_block, count(DISTINCT block) AS n_blocks, max(abs(log2((statistic + 1e-9) / (threshold + 1e-9)))) AS margin FROM final WHERE part = 1 AND failed GROUP BY ALL
        ), bad AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY run_id, sensor ORDER BY "order") = 1)
        SELECT s.run_id, s.sensor, coalesce(health, 'healthy') AS health, from_block, coalesce(n_blocks, 0) AS n_blocks, coalesce(least(1, margin), 1) AS confidence FROM (SELECT DISTINCT run_id, sensor FROM final WHERE part = 1) s LEFT JOIN bad USING (run_id, sensor)"""
    ),
    "confidence",
)
def health_gate(spark, d):
    return h.gate(h.suppressed(checks(spark, d)))


@query(
    "health_timebase",
    """WITH e AS (SELECT event_id, event_id % 2 AS part, event_id // 2 AS row, CASE WHEN event_id % 2 = 0 THEN event_id * 1000 ELSE event_id * 1000 + (event_id % 7) * 300 END AS ms FROM events
    ), s AS (SELECT part, ms - lag(ms) OVER (PARTITION BY part ORDER BY row) AS step FROM e)
    SELECT part, min(CASE WHEN step <= 0 THEN 0 ELSE least(step / 2000, 2000 / step) END) AS regularity, min(CASE WHEN step <= 0 THEN 0 ELSE least(step / 2000, 2000 / step) END) < 0.5 AS failed FROM s WHERE step IS NOT NULL GROUP BY part""",
    "regularity",
)
def health_timebase(spark, d):
    e = F.col("event_id")
    times = table(spark, d, "events").select((e % 2).alias("part"), F.expr("event_id div 2").alias("row"), F.when(e % 2 == 0, e * 1000).otherwise(e * 1000 + (e % 7) * 300).alias("ms"))
    return h.time_regularity(times, 2000.0)


@query(
    "mask_windows",
    with_grid(
        """, f AS (SELECT run_id, sensor, t, CASE WHEN t - lag(t) OVER w = 1 THEN 0 ELSE 1 END AS s FROM grid WHERE v > 52000 WINDOW w AS (PARTITION BY run_id, sensor ORDER BY t)
        ), i AS (SELECT *, sum(s) OVER (PARTITION BY run_id, sensor ORDER BY t) AS island FROM f) SELECT run_id, sensor, min(t) AS "from", max(t) + 1 AS "to", count(*) AS n FROM i GROUP BY run_id, sensor, island"""
    ),
)
def mask_windows(spark, d):
    return h.merged_windows(grid(spark, d).withColumn("flag", F.coalesce(F.col("v") > 52000, F.lit(False))))


def health_choices(spark, d):
    own = grid(spark, d).select("run_id", "sensor", "episode", (F.col("t") - END).alias("t"), "v")
    return pk.choose_health(durable(pk.health_sweep(pk.pack(own), SIZE)))


@query("calibrate_health")
def calibrate_health(spark, d):
    """False alarms of every candidate of each limit over the baseline's segments, and the choice."""
    return health_choices(spark, d)[0]


@query("calibrate_health_detection")
def calibrate_health_detection(spark, d):
    """Which planted faults the chosen limits find, and in which block."""
    return health_choices(spark, d)[1]


# -- rules


def rules(spark, columns: str, rows: list[tuple]):
    return spark.createDataFrame(rows, columns)


def _values(rows: list[tuple], names: str) -> str:
    shown = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {shown}) r({names})"


RANGE = [(1, "price", 48000.0, 58000.0), (2, "quantity", 24.0, 27.0), (3, "rows", 0.0, 1e9)]
FLAT = [(1, "rows", 1), (2, "rows[A]", 2), (3, "price", 3)]
RATE = [(1, "rows", 20.0), (2, "price", 5000.0)]
RELATION = [(1, "quantity", "quantity[A]", "equals", 0, 1.0), (2, "price", "quantity", "tracks", 1, 52000.0), (3, "price[A]", "price", "leads", 2, 2000.0), (4, "price", "price[A]", "tracks", 2, 2000.0), (5, "no such", "price", "equals", 0, 1.0)]
AGGREGATE = [(1, "price", "mean", 50000.0, 55000.0), (2, "price", "median", 52000.0, 54000.0), (3, "quantity", "std", 0.0, 1.0), (4, "rows", "min", 100.0, 900.0), (5, "rows", "max", 0.0, 200.0), (6, "tax", "missing", 0.0, 0.05)]


@query("rule_range", with_grid(f" SELECT CAST(rule_id AS BIGINT) AS rule_id, count(g.t) FILTER (WHERE v < low OR v > high) AS violations FROM {_values(RANGE, 'rule_id, sensor, low, high')} LEFT JOIN grid g USING (sensor) GROUP BY rule_id"))
def rule_range(spark, d):
    return h.range_violations(grid(spark, d), rules(spark, "rule_id long, sensor string, low double, high double", RANGE))


@query(
    "rule_flatline",
    with_grid(
        f""", f AS (SELECT run_id, sensor, 0 AS episode, t, round(v / 4) AS v FROM grid), c AS (SELECT *, CASE WHEN v IS NULL OR lag(v) OVER w IS NULL OR v <> lag(v) OVER w THEN 1 ELSE 0 END AS change FROM f WINDOW w AS (PARTITION BY run_id, sensor ORDER BY t)
        ), i AS (SELECT *, sum(change) OVER (PARTITION BY run_id, sensor ORDER BY t) AS island FROM c), runs AS (SELECT sensor, island, count(*) AS length FROM i WHERE v IS NOT NULL GROUP BY ALL)
        SELECT CAST(rule_id AS BIGINT) AS rule_id, count(length) FILTER (WHERE length > longest) AS violations FROM {_values(FLAT, 'rule_id, sensor, longest')} LEFT JOIN runs USING (sensor) GROUP BY rule_id"""
    ),
)
def rule_flatline(spark, d):
    return h.flatline_violations(grid(spark, d).withColumn("v", F.round(F.col("v") / 4)), rules(spark, "rule_id long, sensor string, longest long", FLAT))


@query(
    "rule_rate",
    with_grid(f", f AS (SELECT sensor, v - lag(v) OVER (PARTITION BY run_id, sensor, episode ORDER BY t) AS d FROM grid) SELECT CAST(rule_id AS BIGINT) AS rule_id, count(d) FILTER (WHERE abs(d) > most) AS violations FROM {_values(RATE, 'rule_id, sensor, most')} LEFT JOIN f USING (sensor) GROUP BY rule_id"),
)
def rule_rate(spark, d):
    return h.rate_violations(grid(spark, d), rules(spark, "rule_id long, sensor string, most double", RATE))


@query(
    "rule_relation",
    with_grid(f" SELECT CAST(rule_id AS BIGINT) AS rule_id, count(*) FILTER (WHERE abs(g.v - o.v) > tolerance) AS violations FROM {_values(RELATION, 'rule_id, sensor, other, relation, lag, tolerance')} LEFT JOIN grid g ON g.sensor = r.sensor LEFT JOIN grid o ON o.sensor = r.other AND o.t = CASE WHEN relation = 'leads' THEN g.t + r.lag ELSE g.t - r.lag END GROUP BY rule_id"),
)
def rule_relation(spark, d):
    return h.relation_violations(grid(spark, d), rules(spark, "rule_id long, sensor string, other string, relation string, lag int, tolerance double", RELATION))


AGG_SQL = f""", b AS (SELECT sensor, t // 16 AS block, count(*) AS n, avg(CAST(v IS NULL AS INT)) AS missing, avg(v) AS mean, median(v) AS median, min(v) AS min, max(v) AS max, stddev_pop(v) AS std FROM grid GROUP BY ALL
), v AS (SELECT rule_id, "aggregate", low, high, CASE "aggregate" WHEN 'missing' THEN missing WHEN 'mean' THEN mean WHEN 'median' THEN median WHEN 'min' THEN min WHEN 'max' THEN max ELSE std END AS value FROM b JOIN {_values(AGGREGATE, 'rule_id, sensor, "aggregate", low, high')} USING (sensor) WHERE n = 16)
SELECT CAST(rule_id AS BIGINT) AS rule_id, "aggregate", count(*) AS blocks, count(*) FILTER (WHERE value < low OR value > high) AS violations FROM v"""


@query("rule_aggregate", with_grid(AGG_SQL + " WHERE \"aggregate\" <> 'missing' GROUP BY ALL"))
def rule_aggregate(spark, d):
    return h.block_violations(grid(spark, d), rules(spark, "rule_id long, sensor string, aggregate string, low double, high double", AGGREGATE), 16).where("aggregate <> 'missing'")


@query("rule_missing", with_grid(AGG_SQL + " WHERE \"aggregate\" = 'missing' GROUP BY ALL"))
def rule_missing(spark, d):
    return h.block_violations(grid(spark, d), rules(spark, "rule_id long, sensor string, aggregate string, low double, high double", AGGREGATE), 16).where("aggregate = 'missing'")


IN_WINDOW = [
    (1, "range", "price", None, None, None, 38000.0, 38800.0, None, None),
    (2, "range", "price[N]", None, None, None, None, 38300.0, None, None),
    (3, "rate", "quantity", None, None, None, None, 0.4, None, None),
    (4, "flatline", "discount", None, None, None, None, 1.0, None, None),
    (5, "relation", "price", "price[N]", "equals", 0, None, 300.0, None, None),
    (6, "relation", "price", "price[R]", "tracks", 2, None, 500.0, None, None),
    (7, "relation", "price", "price[A]", "leads", 1, None, 500.0, None, None),
    (8, "missing", "tax", None, None, None, None, 0.01, 12, None),
    (9, "aggregate", "quantity", None, None, None, 25.4, 25.6, 16, "mean"),
    (10, "aggregate", "quantity", None, None, None, None, 25.8, 7, "max"),
    (11, "aggregate", "quantity[A]", None, None, None, 0.2, None, 500, "std"),
    (12, "range", "gone", None, None, None, 0.0, 1.0, None, None),
]
IN_WINDOW_SCHEMA = "rule_id long, type string, sensor string, other string, relation string, lag int, low double, high double, size long, aggregate string"
_literal = lambda x: "NULL" if x is None else repr(x)
IN_WINDOW_SQL = ", rules(rule_id, type, sensor, other, relation, lag, low, high, size, aggregate) AS (VALUES " + ", ".join(f"({', '.join(map(_literal, r))})" for r in IN_WINDOW) + ")"


@query(
    "tool_check_rules",
    with_grid(
        IN_WINDOW_SQL
        + """, w AS (SELECT * FROM grid WHERE t >= 180 AND t < 330
        ), p AS (SELECT *, abs(v - lag(v) OVER o) AS step, CASE WHEN v IS NULL OR lag(v) OVER o IS NULL OR v <> lag(v) OVER o THEN 1 ELSE 0 END AS change FROM w WINDOW o AS (PARTITION BY run_id, sensor ORDER BY t)
        ), i AS (SELECT *, sum(change) OVER (PARTITION BY run_id, sensor ORDER BY t) AS island FROM p), runs AS (SELECT run_id, sensor, count(*) AS length FROM i WHERE v IS NOT NULL GROUP BY run_id, sensor, island
        ), b AS (SELECT rule_id, any_value(type) AS type, any_value(low) AS low, any_value(high) AS high, 1 - count(v) / any_value(least(size, 150)) AS missing, CASE any_value(aggregate) WHEN 'mean' THEN avg(v) WHEN 'max' THEN max(v) WHEN 'std' THEN stddev_pop(v) END AS value
          FROM w JOIN rules r USING (sensor) WHERE r.type IN ('missing', 'aggregate') AND ((t - 180) // least(size, 150) + 1) * least(size, 150) <= 150 GROUP BY run_id, rule_id, (t - 180) // least(size, 150)
        ), bad AS (
          SELECT rule_id FROM p JOIN rules USING (sensor) WHERE type = 'range' AND (coalesce(v < low, false) OR coalesce(v > high, false)) OR type = 'rate' AND step > high
          UNION ALL SELECT rule_id FROM runs JOIN rules USING (sensor) WHERE type = 'flatline' AND length > high
          UNION ALL SELECT rule_id FROM rules r JOIN grid x ON x.sensor = r.sensor JOIN grid y ON y.sensor = r.other AND y.run_id = x.run_id AND CASE WHEN relation = 'leads' THEN x.t = y.t - r.lag ELSE y.t = x.t - r.lag END
            WHERE type = 'relation' AND CASE WHEN relation = 'leads' THEN y.t ELSE x.t END BETWEEN 180 AND 329 AND abs(x.v - y.v) > high
          UNION ALL SELECT rule_id FROM b WHERE CASE WHEN type = 'missing' THEN missing > high ELSE coalesce(value < low, false) OR coalesce(value > high, false) END
        ) SELECT CAST(rule_id AS BIGINT) AS rule_id, any_value(type) AS type, any_value(sensor) AS sensor, (SELECT count(*) FROM bad WHERE bad.rule_id = rules.rule_id) AS violations FROM rules GROUP BY rule_id"""
    ),
)
def tool_check_rules(spark, d):
    """Rules of every type in one window of 150 weeks."""
    return h.violations_in_window(grid(spark, d), rules(spark, IN_WINDOW_SCHEMA, IN_WINDOW), (180, 330))


def _short(x: str) -> str:
    return f"regexp_replace(CAST(CAST(CAST(format('{{:.2e}}', {x}) AS DOUBLE) AS DECIMAL(38,12)) AS VARCHAR), '\\.?0+$', '')"


@query(
    "rules_in_words",
    with_grid(
        f""", q AS (SELECT run_id, sensor, coalesce(quantile_cont(v, 0.01), 0) AS p1, coalesce(quantile_cont(v, 0.99), 0) AS p99 FROM grid WHERE t < 240 GROUP BY ALL), s AS (SELECT *, {_short('p1')} AS a, {_short('p99')} AS b, {_short('100 * p99')} AS c FROM q)
        SELECT sensor, unnest(['both', 'high', 'low', 'flatline', 'rate', 'leads', 'tracks', 'equals', 'missing', 'aggregate']) AS kind, unnest([sensor || ' must stay between ' || a || ' and ' || b, sensor || ' must stay below ' || b, sensor || ' must stay above ' || a,
          sensor || ' must not stay flat for more than ' || CAST(trunc(p99) AS BIGINT) || ' samples', sensor || ' must not change faster than ' || b || ' per sample', sensor || ' must lead price by 2 samples within ' || b, sensor || ' must track price within ' || b,
          sensor || ' must equal price within ' || b, sensor || ' must not be missing more than ' || c || '% in 16 samples', 'mean of ' || sensor || ' over 16 samples must stay between ' || a || ' and ' || b]) AS text FROM s"""
    ),
)
def rules_in_words(spark, d):
    """Rules of every type with each sensor's baseline quantiles as limits."""
    base = k.quantiles(grid(spark, d).where("t < 240"), {"p1": 0.01, "p99": 0.99})
    kinds = [("both", "range", None), ("high", "range", None), ("low", "range", None), ("flatline", "flatline", None), ("rate", "rate", None)] + [(x, "relation", x) for x in ("leads", "tracks", "equals")] + [("missing", "missing", None), ("aggregate", "aggregate", None)]
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(t).alias("type"), F.lit(r).cast("string").alias("relation")) for n, t, r in kinds])
    rows = base.select("sensor", F.inline(each), "p1", "p99").select("sensor", "kind", "type", "relation", F.lit("price").alias("other"), F.lit(2).alias("lag"), F.when(F.col("kind") != "high", F.col("p1")).alias("low"), F.when(F.col("kind") != "low", F.col("p99")).alias("high"), F.lit(16).alias("size"), F.lit("mean").alias("aggregate"))
    return h.in_words(rows).select("sensor", "kind", "text")


PROPOSED = """, b AS (SELECT * FROM grid WHERE t < 240), e AS (SELECT run_id, sensor, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, median(v) AS m, avg(CAST(v IS NULL AS INT)) AS missing FROM b GROUP BY ALL
), s AS (SELECT run_id, sensor, median(abs(v - m)) * 1.4826 AS mad FROM b JOIN e USING (run_id, sensor) GROUP BY ALL
), c AS (SELECT *, CASE WHEN v IS NULL OR lag(v) OVER w IS NULL OR v <> lag(v) OVER w THEN 1 ELSE 0 END AS change FROM b WINDOW w AS (PARTITION BY run_id, sensor, episode ORDER BY t)
), i AS (SELECT *, sum(change) OVER (PARTITION BY run_id, sensor, episode ORDER BY t) AS island FROM c), r AS (SELECT run_id, sensor, quantile_cont(length, 0.99) AS p99_run FROM (SELECT run_id, sensor, episode, island, count(*) AS length FROM i WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL
), rules AS (SELECT run_id, sensor, unnest(['range', 'flatline', 'missing']) AS type, unnest([p1 - 3 * mad, NULL, NULL]) AS low, unnest([p99 + 3 * mad, 3 * coalesce(p99_run, 1), greatest(0.05, 3 * missing)]) AS high FROM e JOIN s USING (run_id, sensor) LEFT JOIN r USING (run_id, sensor))"""


@query("propose_rules", with_grid(PROPOSED + " SELECT * FROM rules"), "low high")
def propose_rules(spark, d):
    return h.propose_rules(grid(spark, d), 240)


@query(
    "rule_restate",
    with_grid(
        PROPOSED
        + """ SELECT sensor, type, CASE type WHEN 'range' THEN sensor || ' stays between ' || CAST(CAST(round(low, 2) AS DECIMAL(20,2)) AS VARCHAR) || ' and ' || CAST(CAST(round(high, 2) AS DECIMAL(20,2)) AS VARCHAR)
        WHEN 'flatline' THEN sensor || ' does not repeat a value more than ' || CAST(CAST(floor(high) AS BIGINT) AS VARCHAR) || ' times'
        ELSE sensor || ' misses at most ' || CAST(CAST(round(high * 100, 1) AS DECIMAL(20,1)) AS VARCHAR) || '% of a block' END AS text FROM rules"""
    ),
)
def rule_restate(spark, d):
    return h.restate(h.propose_rules(grid(spark, d), 240)).select("sensor", "type", "text")


@query("report_quality", with_grid(CHECKED + " SELECT \"check\", count(*) AS blocks, count(*) FILTER (WHERE failed) AS failed, count(DISTINCT sensor) FILTER (WHERE failed) AS sensors FROM checks WHERE part = 1 GROUP BY ALL"))
def report_quality(spark, d):
    after = checks(spark, d).where("part = 1")
    return after.groupBy("check").agg(F.count("*").alias("blocks"), F.count_if("failed").alias("failed"), F.count_distinct(F.when(F.col("failed"), F.col("sensor"))).alias("sensors"))


@query(
    "health_incidents",
    with_grid(SUPPRESSED + ", f AS (SELECT run_id, sensor, arg_min(\"check\", \"order\" * 100000 + block) AS health, min(block) AS onset FROM final WHERE part = 1 AND failed GROUP BY ALL) SELECT run_id, health, onset // 64 AS place, count(*) AS n_sensors, string_agg(sensor, ',' ORDER BY sensor) AS sensors FROM f GROUP BY run_id, health, onset // 64"),
)
def health_incidents(spark, d):
    """Failed sensors with the same verdict and nearby onsets are one incident."""
    bad = h.gate(h.suppressed(checks(spark, d))).where("health <> 'healthy'")
    by = bad.groupBy("run_id", "health", F.expr("from_block div 64").alias("place"))
    return by.agg(F.count("*").alias("n_sensors"), F.array_join(F.sort_array(F.collect_set("sensor")), ",").alias("sensors"))
