"""Queries of cleaning, profiling and layout detection, over the ``events`` and ``orders`` tables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import cleaning
from tideline.operators import profile as p
from tideline.plans.fixtures import table
from tideline.plans.registry import query

EVENTS = ["event_id", "ts", "user_id", "event_type", "value"]
CELLS = """cells AS (
  SELECT event_id AS row, unnest([0, 1, 2, 3, 4]) AS idx, unnest(['event_id', 'ts', 'user_id', 'event_type', 'value']) AS col,
         unnest([CAST(event_id AS VARCHAR), CAST(epoch_us(ts) // 1000 AS VARCHAR), CAST(user_id AS VARCHAR), event_type, format('{:.2f}', value)]) AS cell FROM events
), numbers AS (SELECT *, CASE WHEN regexp_matches(cell, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(cell AS DOUBLE) END AS number FROM cells
), ranked AS (
  SELECT idx, col, cell, count(*) AS n, row_number() OVER (PARTITION BY idx, col ORDER BY count(*) DESC, cell) AS place FROM cells WHERE cell <> '' GROUP BY idx, col, cell
), shaped AS (SELECT idx, col, cell, regexp_replace(regexp_replace(regexp_replace(cell, '\\p{L}+', 'A', 'g'), '\\p{N}+', '9', 'g'), '\\s+', ' ', 'g') AS pattern FROM cells WHERE cell <> ''
), major AS (SELECT idx, col, pattern FROM (SELECT idx, col, pattern, row_number() OVER (PARTITION BY idx, col ORDER BY count(*) DESC, pattern) AS p FROM shaped GROUP BY idx, col, pattern) WHERE p = 1
), profiles AS (
  SELECT idx, col, count(*) AS n, count(*) FILTER (WHERE cell <> '') AS filled, count(DISTINCT cell) FILTER (WHERE cell <> '') AS n_distinct,
         count(number) / CAST(count(*) FILTER (WHERE cell <> '') AS DOUBLE) AS numeric_share FROM numbers GROUP BY idx, col
), levels AS (SELECT idx, col, string_agg(cell, '|' ORDER BY place) AS levels FROM ranked WHERE place <= 12 GROUP BY idx, col
), steps AS (SELECT *, number - lag(number) OVER (PARTITION BY idx, col ORDER BY row) AS delta FROM numbers
), units AS (
  SELECT idx, col, CASE WHEN avg(CAST(coalesce(number BETWEEN 3e8 AND 4e9, false) AS INT)) >= 0.9 AND avg(CAST(delta >= 0 AS INT)) >= 0.95 THEN 's'
                        WHEN avg(CAST(coalesce(number BETWEEN 3e11 AND 4e12, false) AS INT)) >= 0.9 AND avg(CAST(delta >= 0 AS INT)) >= 0.95 THEN 'ms' ELSE 'none' END AS unit
  FROM steps GROUP BY idx, col
), counters AS (
  SELECT idx, col, avg(CAST(delta = 1 AS INT)) AS ones, avg(CAST(delta = 1 AS INT)) >= 0.9 AND avg(CAST(delta = 1 OR (delta < 0 AND number <= 1) AS INT)) >= 0.99 AS is_counter
  FROM steps WHERE delta IS NOT NULL GROUP BY idx, col
), middle AS (SELECT idx, col, median(delta) AS median_step FROM steps WHERE col = 'ts' GROUP BY idx, col
), regular AS (
  SELECT idx, col, median_step, avg(CAST(abs(delta - median_step) <= 0.5 * median_step AS INT)) >= 0.8 AS regular FROM steps JOIN middle USING (idx, col) GROUP BY idx, col, median_step
), kinds AS (
  SELECT p.idx, p.col, CASE WHEN filled = 0 THEN 'empty' WHEN unit <> 'none' THEN 'timestamp' WHEN is_counter THEN 'counter'
    WHEN numeric_share >= 0.9 AND whole AND n_distinct <= 12 AND filled >= 50 THEN 'category' WHEN numeric_share >= 0.9 AND whole AND n_distinct / filled > 0.9 THEN 'id'
    WHEN numeric_share >= 0.9 THEN 'number' WHEN n_distinct / filled <= 0.2 THEN 'category' WHEN n_distinct / filled > 0.9 THEN 'id' ELSE 'text' END AS kind
  FROM profiles p JOIN units USING (idx, col) LEFT JOIN counters USING (idx, col) JOIN (SELECT idx, col, bool_and(coalesce(number % 1 = 0, false)) AS whole FROM numbers WHERE cell <> '' GROUP BY idx, col) USING (idx, col)
)"""


def cells(spark, d):
    events = table(spark, d, "events").select("event_id", F.unix_millis("ts").alias("ts"), "user_id", "event_type", F.format_string("%.2f", "value").alias("value"))
    return p.cells(events, "event_id", EVENTS)


@query(
    "clean_number",
    """WITH raw AS (
      SELECT o_orderkey, o_totalprice, o_orderkey % 5 AS style, CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS whole, CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS cents FROM orders
    ) SELECT o_orderkey, CASE WHEN style = 4 THEN NULL ELSE (whole * 100 + cents) / 100.0 END AS number FROM raw""",
    "number",
)
def clean_number(spark, d):
    orders = table(spark, d, "orders").withColumn("hundredths", F.round(F.col("o_totalprice") * 100).cast("long"))
    whole, cents = F.expr("hundredths div 100"), F.lpad((F.col("hundredths") % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    style = F.col("o_orderkey") % 5
    cell = (
        F.when(style == 0, F.concat(grouped, F.lit("."), cents))
        .when(style == 1, F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), cents))
        .when(style == 2, F.concat(F.replace(grouped, F.lit(","), F.lit("'")), F.lit("."), cents))
        .when(style == 3, F.concat(whole.cast("string"), F.lit(","), cents))
        .otherwise("n/a")
    )
    return orders.select("o_orderkey", cleaning.clean_number(cell).alias("number"))


@query(
    "clean_time",
    "SELECT event_id, CAST(CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN epoch_us(ts) // 1000000 * 1000 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS BIGINT) AS ms FROM events",
)
def clean_time(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", (F.col("event_id") % 4).alias("style"))
    iso, s, ms = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_seconds("ts").cast("string"), F.unix_millis("ts").cast("string")
    value = F.when(F.col("style") == 0, cleaning.clean_time(iso, "iso")).when(F.col("style") == 1, cleaning.clean_time(s, "s")).when(F.col("style") == 2, cleaning.clean_time(ms, "ms"))
    return events.select("event_id", value.otherwise(cleaning.clean_time(F.lit("soon"), "iso")).cast("long").alias("ms"))


@query("cell_shape", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\p{L}+', 'A', 'g'), '\p{N}+', '9', 'g'), '\s+', ' ', 'g') AS shape FROM documents")
def cell_shape(spark, d):
    return table(spark, d, "documents").select("doc_id", cleaning.shape(F.col("text")).alias("shape"))


@query("rank_by_count", f"WITH {CELLS} SELECT idx, col, cell, n, place FROM ranked WHERE place <= 50")
def rank_by_count(spark, d):
    return p.ranked_values(cells(spark, d)).where("place <= 50")


@query("profile_columns", f"WITH {CELLS} SELECT idx, col, n, filled, n_distinct, levels, pattern, numeric_share FROM profiles LEFT JOIN levels USING (idx, col) LEFT JOIN major USING (idx, col)", "numeric_share")
def profile_columns(spark, d):
    return p.profiles(cells(spark, d))


@query("detect_time_unit", f"WITH {CELLS} SELECT * FROM units")
def detect_time_unit(spark, d):
    return p.time_units(cells(spark, d))


@query("time_regularity", f"WITH {CELLS} SELECT * FROM regular", "median_step")
def time_regularity(spark, d):
    return p.regularity(cells(spark, d).where("col = 'ts'"), "ms")


@query("detect_counter", f"WITH {CELLS} SELECT * FROM counters", "ones")
def detect_counter(spark, d):
    return p.counters(cells(spark, d))


@query("column_kind", f"WITH {CELLS} SELECT * FROM kinds")
def column_kind(spark, d):
    return p.kinds(cells(spark, d))


@query(
    "detect_layout",
    f"""WITH {CELLS} SELECT min(col) FILTER (WHERE kind = 'timestamp') AS time_column, min(col) FILTER (WHERE kind = 'counter') AS counter_column,
    CASE WHEN bool_or(kind = 'timestamp') AND NOT coalesce(bool_or(regular), true) THEN 'records' ELSE 'stream' END AS layout FROM kinds LEFT JOIN regular USING (idx, col)""",
)
def detect_layout(spark, d):
    c = cells(spark, d)
    return p.layout(p.kinds(c), p.regularity(c.where("col = 'ts'"), "ms"))
