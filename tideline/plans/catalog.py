"""Queries of the catalog: customers stand for columns, orders for checks, links and claims, conversations for sources, events for meetings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import catalog as c
from tideline.plans.fixtures import table
from tideline.plans.registry import query

SENSORS = """sensors AS (
  SELECT c_custkey AS column_id, c_name AS name, 'S' || c_custkey AS alias, lower(c_mktsegment) AS role, (c_custkey % 10) / 10 AS role_confidence, CASE WHEN c_acctbal > 5000 THEN 'gauge' ELSE 'counter' END AS signal_type,
         CASE WHEN c_custkey % 3 > 0 THEN 'flow of ' || c_nationkey END AS hypothesis, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 7) / 10 END AS hypothesis_confidence FROM customer
), judged AS (SELECT o_custkey AS column_id, count(*) AS checks, count(*) FILTER (WHERE o_orderstatus = 'F') AS agreeing FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL
), refreshed AS (
  SELECT column_id, name, alias, role, signal_type, hypothesis, coalesce(checks, 0) AS checks, coalesce(agreeing, 0) AS agreeing, least(coalesce(hypothesis_confidence * coalesce(0.5 + 0.5 * agreeing / checks, 1), 1), role_confidence) AS confidence,
         name || ' (' || alias || ') ' || coalesce('is ' || hypothesis, 'has the role ' || role) || ' and a ' || signal_type || ' signal' AS description FROM sensors LEFT JOIN judged USING (column_id)
)"""
CLAIMS = """claims AS (SELECT o_orderkey // 2 AS claim_id, CASE WHEN o_orderkey % 4 = 0 THEN 'confirmed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS speaker FROM orders WHERE o_orderkey % 2 = 0
), links AS (SELECT o_orderkey // 2 AS claim_id, o_custkey AS column_id, (o_orderkey % 13) / 13 AS score, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS confirmed FROM orders
), counts AS (
  SELECT column_id, count(DISTINCT claim_id) FILTER (WHERE confirmed IS DISTINCT FROM false) AS claims, count(DISTINCT claim_id) FILTER (WHERE confirmed AND status = 'confirmed') AS confirmed_claims FROM links LEFT JOIN claims USING (claim_id) GROUP BY ALL
)"""


def sensors(spark, d):
    key, guessed = F.col("c_custkey"), F.col("c_custkey") % 3 > 0
    return table(spark, d, "customer").select(
        key.alias("column_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("S"), key).alias("alias"),
        F.lower("c_mktsegment").alias("role"),
        ((key % 10) / 10).alias("role_confidence"),
        F.when(F.col("c_acctbal") > 5000, "gauge").otherwise("counter").alias("signal_type"),
        F.when(guessed, F.concat(F.lit("flow of "), "c_nationkey")).alias("hypothesis"),
        F.when(guessed, (key % 7) / 10).alias("hypothesis_confidence"),
    )


def refreshed(spark, d):
    """Every fourth column is stored with an old description, the next with one of a role without a hypothesis."""
    rows, orders = sensors(spark, d), table(spark, d, "orders")
    checks = orders.select(F.col("o_custkey").alias("column_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("agrees")).join(rows.select("column_id", "name"), "column_id")
    plain = F.concat("name", F.lit(" ("), "alias", F.lit(") has the role "), "role", F.lit(" and a "), "signal_type", F.lit(" signal"))
    stored = rows.where("column_id % 4 < 2").select("name", F.when(F.col("column_id") % 4 == 0, "old").otherwise(plain).alias("description"))
    return c.refreshed(rows, checks.select("name", "agrees"), stored).join(rows.select("name", "column_id"), "name")


def said(spark, d):
    key, orders = F.col("o_orderkey"), table(spark, d, "orders")
    claim = F.expr("o_orderkey div 2").alias("claim_id")
    claims = orders.where(key % 2 == 0).select(claim, F.when(key % 4 == 0, "confirmed").otherwise("open").alias("status"), F.when(key % 5 > 0, F.col("o_orderpriority")).alias("speaker"))
    confirmed = F.when(key % 6 == 0, True).when(key % 6 == 1, False)
    return orders.select(claim, F.col("o_custkey").alias("column_id"), ((key % 13) / 13).alias("score"), confirmed.alias("confirmed")), claims


@query(
    "catalog_columns",
    f"""WITH {SENSORS} SELECT column_id, name, alias, role, signal_type, hypothesis, confidence, checks, agreeing, description,
    NOT (column_id % 4 = 1 AND hypothesis IS NULL) AS changed FROM refreshed""",
    "confidence",
)
def catalog_columns(spark, d):
    """The whole refresh: weighted confidence, description, and whether it is to be embedded again."""
    return refreshed(spark, d)


@query("catalog_column_counts", f"WITH {CLAIMS} SELECT c_custkey AS column_id, coalesce(claims, 0) AS claims, coalesce(confirmed_claims, 0) AS confirmed_claims FROM customer LEFT JOIN counts ON column_id = c_custkey")
def catalog_column_counts(spark, d):
    return c.claim_counts(sensors(spark, d).select("column_id"), *said(spark, d))


@query(
    "open_question_list",
    f"""WITH {SENSORS}, {CLAIMS}, first AS (SELECT column_id, arg_min(speaker, row(-score, claim_id, speaker)) AS contact FROM links JOIN claims USING (claim_id) WHERE confirmed IS DISTINCT FROM false AND speaker IS NOT NULL GROUP BY ALL)
    SELECT column_id, confidence, contact, coalesce(claims, 0) AS hypothesis_claims, 'What does the column ' || name || ' measure, in which unit, and how often is it logged?' || coalesce(' Our current guess is "' || hypothesis || '".' || CASE WHEN checks > agreeing THEN ' ' || (checks - agreeing) || ' of ' || checks || ' other models gave a different name.' ELSE '' END, '') AS question
    FROM refreshed LEFT JOIN counts USING (column_id) LEFT JOIN first USING (column_id) WHERE confidence < 0.5 AND coalesce(confirmed_claims, 0) = 0""",
    "confidence",
)
def open_question_list(spark, d):
    return c.open_questions(refreshed(spark, d), *said(spark, d))


@query(
    "source_list",
    """WITH s AS (SELECT conv_id AS source_id, CASE WHEN conv_id % 2 = 0 THEN 'meeting' ELSE 'mail' END AS kind, CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'ready' END AS status, count(*) AS occurred_at, count(*) AS segments, count(DISTINCT turn // 3) AS chunks,
      count(DISTINCT turn // 3) FILTER (WHERE turn // 3 % 2 = 0) AS embedded_chunks, count(*) FILTER (WHERE length(text) % 3 = 0) AS claims FROM conversations GROUP BY conv_id
    ), f AS (SELECT conv_id AS source_id, string_agg(role || ': ' || substr(text, 1, 240), ' | ' ORDER BY turn) AS excerpt FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 6) GROUP BY ALL)
    SELECT source_id, kind, status, occurred_at, segments, chunks, embedded_chunks, claims, excerpt FROM s JOIN f USING (source_id) WHERE kind = 'meeting' AND status = 'ready' AND occurred_at >= 2 AND occurred_at <= 8""",
)
def source_list(spark, d):
    """Meetings that are ready; their numbers of turns stand for times."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text")
    key = F.col("source_id")
    sources = rows.groupBy("source_id").agg(F.count("*").alias("occurred_at")).select("source_id", F.when(key % 2 == 0, "meeting").otherwise("mail").alias("kind"), F.when(key % 5 == 0, "error").otherwise("ready").alias("status"), "occurred_at")
    chunks = rows.select("source_id", F.expr("seq div 3").alias("chunk")).distinct().withColumn("embedded", F.col("chunk") % 2 == 0)
    out = c.source_list(sources, rows, chunks, rows.where(F.length("text") % 3 == 0), kind="meeting", status="ready", since=F.lit(2), until=F.lit(8))
    return out.withColumn("excerpt", F.array_join(F.transform("excerpt", lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), " | "))


@query(
    "meetings_without_transcript",
    """WITH m AS (SELECT *, 'd' || event_id % 5 || '.org' AS x, 'd' || user_id % 5 || '.org' AS y FROM events WHERE event_id % 3 > 0 AND event_id % 4 <> 1), k AS (SELECT *, x IN ('d1.org', 'd2.org') AS a, y IN ('d1.org', 'd2.org') AND y <> x AS b FROM m)
    SELECT event_id AS meeting_id, CASE WHEN event_id % 10 = 0 THEN '(no subject)' ELSE event_type END AS subject, ts AS start, 'u' || user_id AS organizer, CASE WHEN a AND b THEN x || ',' || y WHEN a THEN x ELSE y END AS domains FROM k WHERE a OR b""",
)
def meetings_without_transcript(spark, d):
    e, key = table(spark, d, "events"), F.col("event_id")
    at = lambda who, n: F.concat(F.lit(who), n % 5, F.lit(".org"))
    attendees = F.array(F.lit("a@Example.com"), at("B@d", key), at("c@D", F.col("user_id")), F.lit("nobody"), F.lit(None))
    meetings = e.select(key.alias("meeting_id"), F.when(key % 10 != 0, F.col("event_type")).alias("subject"), F.col("ts").alias("start"), F.concat(F.lit("u"), "user_id").alias("organizer"), attendees.alias("attendees"), F.when(key % 3 > 0, "https://meet").alias("join_url"))
    gaps = c.meetings_without_transcript(meetings, e.where(key % 4 == 1).select(key.alias("meeting_id")), ["d1.org", "D2.org"])
    return gaps.withColumn("domains", F.array_join("domains", ","))
