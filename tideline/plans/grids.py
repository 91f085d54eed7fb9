"""Queries of grid construction, over ``events``, ``orders``, ``conversations`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import grids as g
from tideline.functions.cleaning import clean_number
from tideline.plans.fixtures import grid, table, with_grid
from tideline.plans.registry import query

WEEK = 10080
REC = """rec AS (
  SELECT epoch_us(o_orderdate) // 1000 // 604800000 AS bucket, o_orderkey AS id, o_orderpriority AS level, CASE WHEN o_orderkey % 20 = 3 THEN '' WHEN o_orderkey % 97 = 5 THEN 'x' || o_orderkey ELSE 'A-' || o_orderkey END AS code,
         CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS amount, format('{:.2f}', o_totalprice) AS amount_text, o_orderkey // CASE WHEN o_orderkey % 50 = 0 THEN 100 ELSE 1 END AS loose_id FROM orders
)"""


def records(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        g.time_bucket(F.unix_millis("o_orderdate"), WEEK).alias("bucket"),
        key.alias("id"),
        F.col("o_orderpriority").alias("level"),
        F.when(key % 20 == 3, "").when(key % 97 == 5, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit("A-"), key)).alias("code"),
        (F.round(F.col("o_totalprice") * 100).cast("long") / 100.0).alias("amount"),
        F.format_string("%.2f", "o_totalprice").alias("amount_text"),
        F.expr("o_orderkey div CASE WHEN o_orderkey % 50 = 0 THEN 100 ELSE 1 END").alias("loose_id"),
    )


@query(
    "grid_bucket_mean",
    """WITH s AS (SELECT min(event_id) AS first, CAST(pow(2, greatest(0, ceil(log2(count(*) / 512.0)))) AS BIGINT) AS size FROM events)
    SELECT (event_id - first) // size AS t, avg(CAST(round(value * 100) AS BIGINT)) AS cents, avg(user_id) AS user_id, min(event_id) AS first_row FROM events, s GROUP BY ALL""",
    "cents user_id",
)
def grid_bucket_mean(spark, d):
    return g.bucket_rows(table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")), "event_id", ["cents", "user_id"], 512)


CONV = """conv AS (SELECT conv_id * 1000 + turn AS row, turn, length(text) AS v FROM conversations
), marked AS (SELECT *, CASE WHEN turn <= lag(turn) OVER (ORDER BY row) THEN 1 ELSE 0 END AS s FROM conv
), eps AS (SELECT row, turn, v, CAST(sum(s) OVER (ORDER BY row) AS BIGINT) AS episode FROM marked)"""


def conversation_rows(spark, d):
    c = table(spark, d, "conversations").select(F.lit("talk").alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "turn", F.length("text").alias("v"))
    return g.episodes(c, ["run_id"], "row", "turn")


@query("episode_split", f"WITH {CONV} SELECT row, turn, v, episode FROM eps")
def episode_split(spark, d):
    return conversation_rows(spark, d).drop("run_id")


@query("episode_merge_short", f"WITH {CONV}, m AS (SELECT median(n) AS m FROM (SELECT episode, count(*) AS n FROM eps GROUP BY episode)) SELECT row, turn, v, CASE WHEN m < 64 THEN 0 ELSE episode END AS episode FROM eps, m")
def episode_merge_short(spark, d):
    return g.merge_short(conversation_rows(spark, d), ["run_id"], 64).drop("run_id")


@query(
    "quarantine_constant",
    """WITH c AS (
      SELECT event_id % 4 AS episode, unnest(['value', 'event_type', 'episode_no', 'user_id']) AS col, unnest([value, NULL, CAST(event_id % 4 AS DOUBLE), CAST(user_id AS DOUBLE)]) AS number FROM events
    ), s AS (SELECT col, episode, min(number) AS lo, max(number) AS hi, count(number) AS k, count(*) AS n FROM c GROUP BY ALL
    ), w AS (SELECT col, bool_or(lo < hi) AS moves, sum(k) / sum(n) AS share FROM s GROUP BY col)
    SELECT col, CASE WHEN share < 0.9 THEN 'not numeric' ELSE 'constant' END AS reason FROM w WHERE share < 0.9 OR NOT coalesce(moves, false)""",
)
def quarantine_constant(spark, d):
    e = table(spark, d, "events").withColumn("episode", F.col("event_id") % 4).withColumn("episode_no", F.col("event_id") % 4)
    items = F.array(*[F.struct(F.lit(c).alias("col"), clean_number(F.col(c).cast("string")).alias("number")) for c in ("value", "event_type", "episode_no", "user_id")])
    return g.quarantine(e.select("episode", F.inline(items)))


@query("sensor_alias", with_grid(", s AS (SELECT DISTINCT sensor FROM grid) SELECT sensor, idx, 'S' || lpad(CAST(row_number() OVER (ORDER BY idx) AS VARCHAR), 2, '0') AS alias FROM (SELECT sensor, row_number() OVER (ORDER BY sensor) AS idx FROM s)"))
def sensor_alias(spark, d):
    from pyspark.sql import Window

    sensors = grid(spark, d).select("sensor").distinct()
    return g.aliases(sensors.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("sensor"))))


@query(
    "choose_time_bucket",
    """WITH b AS (SELECT m.minutes, epoch_us(ts) // 1000 // (m.minutes * 60000) AS bucket, count(*) AS n FROM events CROSS JOIN (SELECT unnest([1, 5, 15, 60, 120, 240, 360, 720, 1440, 10080]) AS minutes) m GROUP BY ALL
    ), i AS (SELECT *, min(bucket) OVER (PARTITION BY minutes) AS lo, max(bucket) OVER (PARTITION BY minutes) AS hi FROM b
    ), m AS (SELECT minutes, median(n) AS median_rows FROM i WHERE bucket > lo AND bucket < hi GROUP BY minutes)
    SELECT minutes, median_rows, minutes = coalesce(min(minutes) FILTER (WHERE median_rows >= 100) OVER (), max(minutes) OVER ()) AS chosen FROM m""",
    "median_rows",
)
def choose_time_bucket(spark, d):
    return g.bucket_choices(table(spark, d, "events").select(F.unix_millis("ts").alias("ms")), "ms")


@query(
    "dense_time_buckets",
    """WITH b AS (SELECT epoch_us(ts) // 1000 // 900000 AS bucket, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM b)
    SELECT e.bucket, coalesce(b.n, 0) AS n FROM e LEFT JOIN b USING (bucket)""",
)
def dense_time_buckets(spark, d):
    counts = table(spark, d, "events").groupBy(g.time_bucket(F.unix_millis("ts"), 15).alias("bucket")).agg(F.count("*").alias("n"))
    return g.dense(counts, ["n"])


@query("metric_rows_count", f"WITH {REC} SELECT bucket, count(*) AS n FROM rec GROUP BY bucket")
def metric_rows_count(spark, d):
    return records(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


@query("metric_null_rate", f"WITH {REC} SELECT bucket, avg(CAST(coalesce(code, '') = '' AS INT)) AS null_rate FROM rec GROUP BY bucket", "null_rate")
def metric_null_rate(spark, d):
    return records(spark, d).groupBy("bucket").agg(g.null_rate(F.col("code")).alias("null_rate"))


@query(
    "metric_format_violation",
    rf"""WITH {REC}, s AS (SELECT bucket, regexp_replace(regexp_replace(regexp_replace(code, '\p{{L}}+', 'A', 'g'), '\p{{N}}+', '9', 'g'), '\s+', ' ', 'g') AS shape FROM rec WHERE code <> ''
    ), m AS (SELECT shape AS major FROM s GROUP BY shape ORDER BY count(*) DESC, shape LIMIT 1) SELECT bucket, avg(CAST(shape <> major AS INT)) AS violations FROM s, m GROUP BY bucket""",
    "violations",
)
def metric_format_violation(spark, d):
    return g.format_violations(records(spark, d), "code")


@query("metric_median_p95", f"WITH {REC} SELECT bucket, quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.95) AS p95 FROM rec GROUP BY bucket", "median p95")
def metric_median_p95(spark, d):
    return records(spark, d).groupBy("bucket").agg(F.expr("percentile(amount, 0.5)").alias("median"), F.expr("percentile(amount, 0.95)").alias("p95"))


@query(
    "metric_rounding",
    rf"WITH {REC} SELECT bucket, avg(CAST(amount = floor(amount) AS INT)) AS round_share, avg(CAST(regexp_matches(amount_text, '0[^0-9]*$') AS INT)) AS zero_share FROM rec GROUP BY bucket",
    "round_share zero_share",
)
def metric_rounding(spark, d):
    return records(spark, d).groupBy("bucket").agg(g.round_share(F.col("amount")).alias("round_share"), g.zero_digit_share(F.col("amount_text")).alias("zero_share"))


@query(
    "metric_level_share",
    f"""WITH {REC}, top AS (SELECT level FROM rec GROUP BY level ORDER BY count(*) DESC, level LIMIT 3
    ), n AS (SELECT bucket, CASE WHEN t.level IS NULL THEN '(other)' ELSE r.level END AS level, count(*) AS n FROM rec r LEFT JOIN top t ON t.level = r.level GROUP BY ALL)
    SELECT bucket, level, n / sum(n) OVER (PARTITION BY bucket) AS share FROM n""",
    "share",
)
def metric_level_share(spark, d):
    return g.level_shares(records(spark, d), "level", 3)


@query("metric_id_duplicates", f"WITH {REC} SELECT bucket, count(DISTINCT loose_id) AS n_distinct, 1 - count(DISTINCT loose_id) / count(loose_id) AS duplicate_rate FROM rec GROUP BY bucket", "duplicate_rate")
def metric_id_duplicates(spark, d):
    return records(spark, d).groupBy("bucket").agg(F.count_distinct("loose_id").alias("n_distinct"), g.duplicate_rate(F.col("loose_id")).alias("duplicate_rate"))


@query("metric_split_by_level", f"WITH {REC} SELECT bucket, coalesce(level, '(all)') AS level, count(*) AS n, median(amount) AS median FROM rec GROUP BY GROUPING SETS ((bucket, level), (bucket))", "median")
def metric_split_by_level(spark, d):
    return g.split_metrics(records(spark, d), "level", "amount")


@query(
    "derived_fields",
    """WITH w AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS net, CAST(round(l_tax * 100) AS BIGINT) AS tax, l_quantity AS qty FROM lineitem), x AS (SELECT net, tax, net + tax AS gross, qty, 2.5 * qty AS weight FROM w
    ), f AS (SELECT unnest(['gross', 'qty']) AS field, unnest(['gross = net + tax', 'qty = 0.4 x weight']) AS formula, unnest([bool_and(gross = net + tax), bool_and(abs(qty - 0.4 * weight) < 1e-6)]) AS holds FROM x)
    SELECT field, formula FROM f WHERE holds""",
)
def derived_fields(spark, d):
    cents = table(spark, d, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("net"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"), F.col("l_quantity").alias("qty"))
    return g.derived_fields(cents.withColumns({"gross": F.col("net") + F.col("tax"), "weight": 2.5 * F.col("qty")}), ["net", "tax", "gross", "qty", "weight"])


@query(
    "metric_topk_variance",
    with_grid(
        """, s AS (SELECT sensor AS metric, var_pop(v) / greatest(avg(v) * avg(v), 1e-12) AS spread FROM grid GROUP BY sensor
        ), p AS (SELECT metric, spread, row_number() OVER (ORDER BY round(spread, 9) DESC, metric) AS place FROM s WHERE spread > 0 AND metric <> 'rows') SELECT * FROM p WHERE place <= 12"""
    ),
    "spread",
)
def metric_topk_variance(spark, d):
    return g.top_variance(grid(spark, d).select(F.col("sensor").alias("metric"), "v"), 12)


@query(
    "sibling_families",
    with_grid(
        r""", s AS (SELECT DISTINCT sensor, regexp_extract(sensor, '^(.*)\[[^\]]*\]$', 1) AS family FROM grid)
        SELECT family, string_agg(sensor, ',' ORDER BY sensor) AS members, count(*) AS n FROM s WHERE family <> '' GROUP BY family HAVING count(*) >= 2"""
    ),
)
def sibling_families(spark, d):
    return g.families(grid(spark, d).select("sensor").distinct())
