"""Streaming queries over the ``events`` files, each equal to its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.plans.fixtures import table
from tideline.plans.registry import query
from tideline.session import shared_path
from tideline.streaming import live


def events(spark, d):
    stream = live.read_files(spark, f"{d}/events.parquet")
    return stream.withColumns({"ts": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("long")})


#: Windows come out when the newest event is this far past their end.
LATE = "2 hours"
DONE = "(SELECT max(ts) FROM events) - INTERVAL 2 HOUR"

RANKS = "[" + ", ".join(f"{(k + 0.5) / live.POINTS:.4f}" for k in range(live.POINTS)) + "]"


@query("stream_tumbling", f"SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events WHERE time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE <= {DONE} GROUP BY ALL")
def stream_tumbling(spark, d):
    return live.to_table(live.tumbling(events(spark, d), 60, LATE))


@query(
    "stream_sliding",
    f"SELECT * FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k.k * INTERVAL 15 MINUTE AS start, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events CROSS JOIN range(4) k(k) GROUP BY ALL) WHERE start + INTERVAL 60 MINUTE <= {DONE}",
)
def stream_sliding(spark, d):
    return live.to_table(live.sliding(events(spark, d), 60, 15, LATE))


@query(
    "stream_sliding_distance",
    f"""WITH e AS (SELECT * FROM events WHERE value IS NOT NULL AND NOT isnan(value)), r AS (SELECT event_type, quantile_disc(value, {RANKS}) AS q FROM e WHERE ts < TIMESTAMP '2024-01-08' GROUP BY event_type
    ), w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k.k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, quantile_disc(value, {RANKS}) AS q FROM e CROSS JOIN range(4) k(k) GROUP BY ALL)
    SELECT start, event_type, n, list_avg(list_transform(range(1, {live.POINTS + 1}), lambda i: abs(w.q[i] - r.q[i]))) AS distance FROM w JOIN r USING (event_type) WHERE start + INTERVAL 60 MINUTE <= {DONE}""",
    "distance",
)
def stream_sliding_distance(spark, d):
    """Windows of an hour, a quarter apart, against the first week, whose quantiles are stored."""
    path = shared_path(spark, "reference")
    first = table(spark, d, "events").where("ts < TIMESTAMP'2024-01-08' AND value IS NOT NULL AND NOT isnan(value)")
    live.value_sketches(first).write.parquet(path)
    return live.to_table(live.sliding_distances(events(spark, d), 60, 15, LATE, spark.read.parquet(path)))


@query(
    "stream_sessions",
    f"""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {DONE}""",
)
def stream_sessions(spark, d):
    return live.to_table(live.user_sessions(events(spark, d), "30 minutes", LATE))


@query(
    "stream_cusum",
    """WITH e AS (SELECT event_type, ts, event_id, (value - 50) / 25 AS z, epoch_us(ts) // 604800000000 AS week FROM events), l AS (SELECT *, max(week) OVER (PARTITION BY event_type) AS last FROM e
    ), s AS (SELECT event_type, week = last AS own, sum(coalesce(z - 0.5, 0)) OVER w AS up, sum(coalesce(-z - 0.5, 0)) OVER w AS down FROM l WINDOW w AS (PARTITION BY event_type, week ORDER BY ts DESC, event_id DESC))
    SELECT event_type, greatest(0, max(up) FILTER (WHERE own)) AS up, greatest(0, max(down) FILTER (WHERE own)) AS down, count(*) AS n FROM s GROUP BY event_type""",
    "up down",
)
def stream_cusum(spark, d):
    """The sums begin anew with each week."""
    z = events(spark, d).select("event_type", F.expr("unix_micros(ts) div 604800000000").alias("episode"), "event_id", "ts", ((F.col("value") - 50) / 25).alias("z"))
    return live.cusum_states(z, 0.5)


@query(
    "stream_scored",
    "WITH m AS (SELECT event_type, median(value) AS center, stddev_pop(value) AS spread FROM events GROUP BY event_type) SELECT event_id, event_type, (value - center) / spread AS deviation FROM events JOIN m USING (event_type)",
    "deviation",
)
def stream_scored(spark, d):
    model = table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile(value, 0.5)").alias("center"), F.stddev_pop("value").alias("spread"))
    return live.to_table(live.scored(events(spark, d), model).select("event_id", "event_type", "deviation"))


@query("stream_deduplicated", "SELECT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark, d):
    again = events(spark, d)
    return live.to_table(live.deduplicated(again.unionByName(again), ["event_id"], "40 days").select("event_id", "user_id", "event_type"))


def fed(spark, d, run):
    """Messages land in two parts, the second with older ones among them; ``run`` takes the stream after each part."""
    path = shared_path(spark, "feed")
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("channel"), F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("body"), (F.col("event_id") % 5 == 0).alias("deleted"), "ts")
    for part in (F.col("version") % 3 != 0, F.col("version") % 3 == 0):
        rows.where(part).write.mode("append").parquet(f"{path}/landed")
        run(spark.readStream.schema(rows.schema).parquet(f"{path}/landed"), path)
    return path


@query("stream_feed", "SELECT id, channel, version, body FROM (SELECT user_id AS id, user_id % 4 AS channel, max(event_id) AS version, arg_max(event_type, event_id) AS body FROM events GROUP BY user_id) WHERE version % 5 <> 0")
def stream_feed(spark, d):
    """What two arrivals leave: the newest version of each message, without the deleted ones."""
    return live.messages(spark, fed(spark, d, live.feed)).where("not deleted").select("id", "channel", "version", "body")


@query(
    "stream_feed_cursors",
    """WITH e AS (SELECT user_id % 4 AS channel, ts, event_id % 3 <> 0 AS early FROM events), c AS (SELECT channel, max(ts) AS first FROM e WHERE early GROUP BY channel)
    SELECT channel, max(ts) AS "cursor", count(*) AS n, count(*) FILTER (WHERE NOT early AND ts < first - INTERVAL 2 HOUR) AS late FROM e LEFT JOIN c USING (channel) GROUP BY channel""",
)
def stream_feed_cursors(spark, d):
    """The cursor of each channel after two arrivals, and how many rows came late."""
    return live.newest(spark, f"{fed(spark, d, lambda stream, path: live.cursors(stream, path, 7200))}/cursors")
