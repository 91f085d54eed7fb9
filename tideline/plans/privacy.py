"""Queries of the guards, over the grid, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import privacy as p
from tideline.plans.fixtures import grid, table, with_grid
from tideline.plans.registry import query

#: Three significant digits of a number ``{x}``, as ``three_digits`` of the operators has them: halves away from zero; ``format`` would take a half to the even digit.
THREE = "round({x}, 2 - CAST(split_part(format('{{:.17e}}', {x}), 'e', 2) AS INTEGER))"
INDEX = f""", r AS (SELECT run_id, sensor, t, {THREE.format(x='v')} AS r FROM grid WHERE v IS NOT NULL
), c AS (SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY run_id, sensor ORDER BY t) AS before FROM r) WHERE before IS NULL OR before <> r
), x AS (SELECT r AS a, lead(r, 1) OVER w AS b, lead(r, 2) OVER w AS c FROM c WINDOW w AS (PARTITION BY run_id, sensor ORDER BY t)), idx AS (SELECT DISTINCT a, b, c FROM x WHERE c IS NOT NULL)"""
#: The same of the counts of rows only, which the payloads of ``leak_scan`` are made of.
COUNTS = INDEX.replace("v IS NOT NULL", "v IS NOT NULL AND sensor LIKE 'rows%'", 1)


@query("leak_index", with_grid(INDEX + " SELECT * FROM idx"), "a b c")
def leak_index(spark, d):
    """The triples of all sensors."""
    return p.leak_index(grid(spark, d))


@query(
    "leak_scan",
    with_grid(
        COUNTS
        + f""", seq AS (SELECT sensor, episode, t, v, t // 6 AS payload FROM grid WHERE sensor IN ('rows', 'rows[A]')
        ), n AS (SELECT sensor || ':' || payload AS payload_id, CASE WHEN payload % 2 = 0 THEN t ELSE -t END AS pos, {THREE.format(x='v')} AS r FROM seq
        ), c2 AS (SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY payload_id ORDER BY pos) AS before FROM n) WHERE before IS NULL OR before <> r
        ), tr AS (SELECT payload_id, r AS a, lead(r, 1) OVER w AS b, lead(r, 2) OVER w AS c FROM c2 WINDOW w AS (PARTITION BY payload_id ORDER BY pos))
        SELECT p.payload_id, count(i.a) AS hits FROM (SELECT DISTINCT payload_id FROM n) p LEFT JOIN (SELECT * FROM tr WHERE c IS NOT NULL) tr USING (payload_id) LEFT JOIN idx i ON i.a = tr.a AND i.b = tr.b AND i.c = tr.c GROUP BY p.payload_id"""
    ),
)
def leak_scan(spark, d):
    seq = grid(spark, d).where("sensor in ('rows', 'rows[A]')").withColumn("payload", F.expr("t div 6"))
    pos = F.when(F.col("payload") % 2 == 0, F.col("t")).otherwise(-F.col("t"))
    ordered = seq.groupBy(F.concat_ws(":", "sensor", "payload").alias("payload_id")).agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), "v"))).alias("x"))
    payloads = ordered.select("payload_id", F.concat(F.lit("the values were "), F.array_join(F.transform("x", lambda e: e["v"].cast("long").cast("string")), ", then ")).alias("text"))
    return p.leak_scan(payloads, p.leak_index(grid(spark, d).where("sensor like 'rows%'")))


NAMES = ("license", "password", "token", "clown", "MIT License", "the Apache License")


@query(
    "name_scan",
    r"WITH b AS (SELECT doc_id, regexp_replace(text, '\bev-[0-9a-f]{8}-[0-9]{5}\b|\bS[0-9]{2,4}\b', ' ', 'g') AS bare FROM documents), n AS (SELECT unnest(["
    + ", ".join(f"'{n}'" for n in NAMES)
    + r"]) AS name) SELECT doc_id, name, CAST(len(regexp_extract_all(bare, '(?i)\b' || name || '\b')) AS BIGINT) AS n FROM b, n WHERE regexp_matches(bare, '(?i)\b' || name || '\b')",
)
def name_scan(spark, d):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return p.name_scan(table(spark, d, "documents"), names)


@query(
    "text_guard",
    r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents)
    SELECT doc_id, CASE WHEN length(text) > 8000 THEN 'too long' WHEN len(list_filter(words, lambda x: regexp_matches(x, '[0-9]'))) / greatest(len(words), 1) > 0.3 THEN 'too many numbers' ELSE 'ok' END AS guard FROM w""",
)
def text_guard(spark, d):
    return table(spark, d, "documents").select("doc_id", p.text_guard(F.col("text")).alias("guard"))


@query("round_payload", "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice ELSE CAST(format('{:.2e}', o_totalprice) AS DOUBLE) END AS price FROM orders", "price")
def round_payload(spark, d):
    return table(spark, d, "orders").select("o_orderkey", p.round_values(F.array("o_totalprice"))[0].alias("price"))


@query(
    "payload_guards",
    """WITH u AS (SELECT user_id, count(*) AS n, count(*) % 30 AS k FROM events GROUP BY user_id)
    SELECT user_id AS payload_id, CASE WHEN user_id % 11 = 0 THEN 'schema' WHEN n < 60 THEN 'sample floor' WHEN k > 20 THEN 'array' WHEN user_id % 3 = 0 AND k > 0 THEN 'rounding' ELSE 'pass' END AS guard FROM u""",
)
def payload_guards(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    value = F.when(F.col("user_id") % 3 == 0, F.lit(1.23456)).otherwise(F.lit(1.23))
    body = F.when(F.col("user_id") % 11 == 0, F.lit("{}")).otherwise(F.to_json(F.struct("n", F.array_repeat(value, (F.col("n") % 30).cast("int")).alias("values"))))
    return p.payload_guards(u.select(F.col("user_id").alias("payload_id"), body.alias("body")), least_n=60)
