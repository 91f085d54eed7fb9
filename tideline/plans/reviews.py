"""Queries of evidence, investigation tools, prose checks, reviews, names and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators import relations as rel
from tideline.operators import reviews as v
from tideline.operators.faults import LABELS
from tideline.plans import registry
from tideline.plans.drift import ALARMS, BLOCKS, RAMP, own_decided
from tideline.plans.fixtures import grid, table, with_grid
from tideline.plans.registry import query
from tideline.plans.relations import EDGES, GROUPS, LEAST, PAIRS, PLANT, edges, planted, role_scores
from tideline.session import durable

EVIDENCE = RAMP + BLOCKS + ALARMS + """, fp AS (SELECT run_id, sensor, CAST(count(v) AS DOUBLE) AS n, median(v) AS middle, CAST(avg(CAST(v IS NULL AS INT)) AS DOUBLE) AS missing FROM grid GROUP BY ALL
), ev AS (SELECT *, 'ev-' || lpad(CAST(row_number() OVER (PARTITION BY run_id ORDER BY stage, sensor) AS VARCHAR), 5, '0') AS id FROM (
  SELECT run_id, 'fingerprint' AS stage, sensor, ['n', 'middle', 'missing'] AS names, [n, middle, missing] AS nums FROM fp UNION ALL SELECT run_id, 'drift', sensor, ['max_deviation', 'z'], [max_deviation, z] FROM decided))"""


def evidence(spark, d):
    prints = grid(spark, d).groupBy("run_id", "sensor").agg(F.count("v").alias("n"), F.expr("percentile(v, 0.5)").alias("middle"), F.avg(F.col("v").isNull().cast("int")).alias("missing"))
    rows = v.evidence(prints, "fingerprint", ["n", "middle", "missing"]).unionByName(v.evidence(own_decided(spark, d), "drift", ["max_deviation", "z"]))
    return v.with_ids(rows)


@query("evidence_rows", with_grid(EVIDENCE + " SELECT run_id, id, stage, sensor, unnest(names) AS stat, unnest(nums) AS value FROM ev"), "value")
def evidence_rows(spark, d):
    return evidence(spark, d).select("run_id", "id", "stage", "sensor", F.explode("stats").alias("stat", "value"))


@query("evidence_integrity", with_grid(EVIDENCE + " SELECT run_id, sensor AS inference, count(*) + CAST(sensor LIKE 'tax%' AS BIGINT) AS cited, CAST(sensor LIKE 'tax%' AS BIGINT) AS unknown FROM ev GROUP BY run_id, sensor"))
def evidence_integrity(spark, d):
    """Every sensor's inference cites its evidence; those of the tax sensors cite an id that isn't there as well."""
    rows = durable(evidence(spark, d))
    cites = rows.select("run_id", F.col("sensor").alias("inference"), "id")
    lost = cites.where("inference like 'tax%'").select("run_id", "inference", F.lit("ev-99999").alias("id")).distinct()
    return v.integrity(cites.unionByName(lost), rows)


@query("tool_check_rule", with_grid(", q AS (SELECT run_id, sensor, coalesce(quantile_cont(v, 0.01), 0) AS p1, coalesce(quantile_cont(v, 0.99), 0) AS p99 FROM grid WHERE t < 240 GROUP BY ALL) SELECT g.run_id, g.sensor, count(v) AS n, count(*) FILTER (WHERE v < p1 OR v > p99) AS violations, min(t) FILTER (WHERE v < p1 OR v > p99) AS first_t FROM grid g JOIN q USING (run_id, sensor) WHERE t >= 300 GROUP BY ALL"))
def tool_check_rule(spark, d):
    g = grid(spark, d)
    broken = (F.col("v") < F.col("p1")) | (F.col("v") > F.col("p99"))
    rules = k.quantiles(g.where("t < 240"), {"p1": 0.01, "p99": 0.99})
    return g.where("t >= 300").join(rules, ["run_id", "sensor"]).groupBy("run_id", "sensor").agg(F.count("v").alias("n"), F.count_if(broken).alias("violations"), F.min(F.when(broken, F.col("t"))).alias("first_t"))


@query("tool_test_role", f"SELECT * FROM ({registry._oracles['role_scores']}) WHERE sensor = 'price'")
def tool_test_role(spark, d):
    return role_scores(spark, d).where("sensor = 'price'")


@query("tool_find_changepoints")
def tool_find_changepoints(spark, d):
    return k.change_points(grid(spark, d).where("t >= 180 and t < 330"))


HALVES = ", ".join(f"{n} AS (SELECT run_id, sensor, CAST(floor(log10(greatest(median(v), 1e-9))) AS BIGINT) AS incident, CAST(floor(avg(t * v) / avg(v)) AS BIGINT) - {lo} AS onset, CASE WHEN median(v) < avg(v) THEN 'process-step' ELSE 'process-degradation' END AS fault FROM grid WHERE v IS NOT NULL AND t >= {lo} AND t < {hi} GROUP BY run_id, sensor)" for n, lo, hi in (("old", 0, 170), ("new", 170, 340)))


@query(
    "investigation_outcome",
    with_grid(
        ", " + HALVES + """, sh AS (SELECT o.run_id, o.incident, n.incident AS new_incident, count(*) AS overlap, min(o.onset) AS onset, min(n.onset) AS new_onset, min(o.fault) AS fault, min(n.fault) AS new_fault FROM old o JOIN new n USING (run_id, sensor) GROUP BY ALL
        ), pl AS (SELECT *, row_number() OVER (PARTITION BY run_id, incident ORDER BY overlap DESC, new_incident) AS place FROM sh) SELECT run_id, incident, new_incident, overlap, abs(onset - new_onset) > 3.4 OR fault <> new_fault AS changed FROM pl WHERE place = 1"""
    ),
)
def investigation_outcome(spark, d):
    g = grid(spark, d).where("v is not null")

    def half(lo, hi):
        middle = F.expr("percentile(v, 0.5)")
        part = g.where((F.col("t") >= lo) & (F.col("t") < hi)).groupBy("run_id", "sensor")
        return part.agg(F.floor(F.log10(F.greatest(middle, F.lit(1e-9)))).alias("incident"), (F.floor(F.avg(F.col("t") * F.col("v")) / F.avg("v")) - lo).alias("onset"), F.when(middle < F.avg("v"), "process-step").otherwise("process-degradation").alias("fault"))

    return v.outcomes(half(0, 170), half(170, 340), 340)


@query(
    "evidence_series",
    with_grid(
        """, p AS (SELECT * FROM grid WHERE t >= 100 AND t < 340), s AS (SELECT *, min(t) OVER w AS lo, greatest(1, CAST(ceil((max(t) OVER w - min(t) OVER w + 1) / 100.0) AS BIGINT)) AS size FROM p WINDOW w AS (PARTITION BY run_id, sensor))
        SELECT run_id, sensor, (t - lo) // size AS bucket, avg(v) AS v FROM s GROUP BY ALL"""
    ),
    "v",
)
def evidence_series(spark, d):
    return k.downsample(grid(spark, d).where("t >= 100 and t < 340"), 100)


@query("report_sensors", with_grid(RAMP + BLOCKS + ALARMS + ", prints AS (SELECT run_id, sensor, count(v) AS n, median(v) AS middle, avg(CAST(v IS NULL AS INT)) AS missing FROM grid GROUP BY ALL) SELECT run_id, sensor, n, middle, missing, max_deviation, coalesce(drifting, false) AS drifting, onset FROM prints LEFT JOIN decided USING (run_id, sensor)"), "middle missing max_deviation")
def report_sensors(spark, d):
    stats = grid(spark, d).groupBy("run_id", "sensor").agg(F.count("v").alias("n"), F.expr("percentile(v, 0.5)").alias("middle"), F.avg(F.col("v").isNull().cast("int")).alias("missing"))
    return stats.join(own_decided(spark, d).select("run_id", "sensor", "max_deviation", "drifting", "onset"), ["run_id", "sensor"], "left").withColumn("drifting", F.coalesce("drifting", F.lit(False)))


@query(
    "sensor_records",
    with_grid(
        EDGES + PAIRS.replace(PLANT, "") + GROUPS + """, bw AS (SELECT run_id, a AS sensor, abs(rho) AS rho FROM pairs UNION ALL SELECT run_id, b, abs(rho) FROM pairs), pr AS (SELECT run_id, sensor, count(*) AS relations, max(rho) AS strongest FROM bw GROUP BY ALL
        ), lo AS (SELECT run_id, source AS sensor, count(*) AS leads FROM edges GROUP BY ALL), li AS (SELECT run_id, target AS sensor, count(*) AS follows FROM edges GROUP BY ALL), ss AS (SELECT DISTINCT run_id, sensor FROM planted)
        SELECT run_id, sensor, coalesce(relations, 0) AS relations, strongest, coalesce(leads, 0) AS leads, coalesce(follows, 0) AS follows, label AS group_label FROM ss LEFT JOIN pr USING (run_id, sensor) LEFT JOIN lo USING (run_id, sensor) LEFT JOIN li USING (run_id, sensor) LEFT JOIN groups USING (run_id, sensor)"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "strongest",
)
def sensor_records(spark, d):
    g = planted(spark, d)
    pairs, found = durable(rel.rank_pairs(g, LEAST)), durable(edges(spark, d))
    ways = pairs.select("run_id", F.explode(F.array("a", "b")).alias("sensor"), F.abs("rho").alias("rho")).groupBy("run_id", "sensor").agg(F.count("*").alias("relations"), F.max("rho").alias("strongest"))
    leads = found.groupBy("run_id", F.col("source").alias("sensor")).agg(F.count("*").alias("leads"))
    follows = found.groupBy("run_id", F.col("target").alias("sensor")).agg(F.count("*").alias("follows"))
    out = g.select("run_id", "sensor").distinct()
    for part in (ways, leads, follows, rel.redundancy_groups(pairs, 0.95).withColumnRenamed("label", "group_label")):
        out = out.join(part, ["run_id", "sensor"], "left")
    return out.fillna(0, ["relations", "leads", "follows"])


#: A user's event and the next one stand for a diagnosis and its review; the length of the type picks the fault.
FAULTS = list(LABELS)
FAULT_SQL = "[" + ", ".join(f"'{x}'" for x in FAULTS) + "]"


@query("review_match", f"WITH e AS (SELECT event_id, {FAULT_SQL}[length(event_type)] AS own, {FAULT_SQL}[lead(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id)] AS other FROM events) SELECT *, CASE WHEN other IS NULL THEN NULL WHEN own = other THEN 'class' WHEN split_part(own, '-', 1) = split_part(other, '-', 1) THEN 'family' ELSE 'none' END AS match FROM e")
def review_match(spark, d):
    from pyspark.sql import Window

    kinds = F.array(*[F.lit(x) for x in FAULTS])
    e = table(spark, d, "events").withColumn("size", F.length("event_type"))
    following = F.lead("size").over(Window.partitionBy("user_id").orderBy("event_id"))
    return v.review_match(e.select("event_id", F.get(kinds, F.col("size") - 1).alias("own"), F.get(kinds, following - 1).alias("other")))


SUFFIXES = ["temperature", "temp sensor", "feed flows", "flowrate", "the value"]
CONCEPTS = "CASE w " + " ".join(f"WHEN '{w}' THEN '{q}'" for q, same in v.QUANTITIES.items() for w in [q, *same]) + " END"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in v.STOP) + ")"


@query(
    "name_consensus",
    f"""WITH n AS (SELECT user_id AS key, event_id AS seq, event_type || ' ' || [{", ".join(f"'{s}'" for s in SUFFIXES)}][CAST(event_id % 5 AS INTEGER) + 1] AS name FROM events
    ), dn AS (SELECT key, name, count(*) AS n, min(seq) AS first FROM n GROUP BY ALL
    ), un AS (SELECT key, name, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) AS w FROM dn), s1 AS (SELECT key, name, w AS w0, regexp_replace(w, 's$', '') AS w1 FROM un WHERE w NOT IN {STOP_SQL}
    ), tk AS (SELECT DISTINCT key, name, coalesce({CONCEPTS.replace("CASE w", "CASE w0")}, {CONCEPTS.replace("CASE w", "CASE w1")}, w1) AS token FROM s1
    ), sz AS (SELECT key, name, count(*) AS size FROM tk GROUP BY ALL
    ), sh AS (SELECT a.key, a.name, b.name AS other, count(*) AS shared, bool_or(a.token IN ({", ".join(f"'{q}'" for q in v.QUANTITIES)})) AS quantity FROM tk a JOIN tk b ON b.key = a.key AND b.token = a.token GROUP BY ALL
    ), ag AS (SELECT sh.key, sh.name, sh.other FROM sh JOIN sz x ON x.key = sh.key AND x.name = sh.name JOIN sz y ON y.key = sh.key AND y.name = sh.other WHERE quantity OR shared / least(x.size, y.size) >= 0.5
    ), vt AS (SELECT ag.key, ag.name, CAST(sum(o.n) AS BIGINT) AS votes FROM ag JOIN dn o ON o.key = ag.key AND o.name = ag.other GROUP BY ALL
    ), pl AS (SELECT vt.*, row_number() OVER (PARTITION BY vt.key ORDER BY votes DESC, first) AS place FROM vt JOIN dn USING (key, name)) SELECT key, name, votes FROM pl WHERE place = 1""",
)
def name_consensus(spark, d):
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("event_id") % 5).cast("int"))
    return v.consensus(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", suffix).alias("name")))


@query(
    "summary_payload",
    """WITH c AS (SELECT event_type AS run_id, user_id AS sensor, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS contribution FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY contribution DESC, sensor) AS place FROM c
    ) SELECT run_id, sensor, CASE WHEN place <= 20 THEN contribution / sum(contribution) FILTER (WHERE place <= 20) OVER (PARTITION BY run_id) END AS contribution, CAST(place AS INTEGER) AS place, place <= 20 AS kept FROM p WHERE place <= 40""",
    "contribution",
)
def summary_payload(spark, d):
    return v.payload_rows(table(spark, d, "events").groupBy(F.col("event_type").alias("run_id"), F.col("user_id").alias("sensor")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("contribution")))


#: One text for each user: its mean is wrong for every fourth, the label stands twice for every fifth, the alias is unknown for every seventh.
PROSE = """WITH s AS (SELECT user_id AS id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) // count(*) AS BIGINT) AS mean, max(event_id) AS last FROM events GROUP BY user_id
), tx AS (SELECT *, CASE WHEN id % 4 = 1 THEN mean + 1000 ELSE mean END AS said, id % 5 = 2 AS twice, id % 7 = 3 AS odd FROM s
), nums AS (SELECT id, x, length(regexp_replace(CAST(x AS VARCHAR), '^0+|0+$', '', 'g')) AS d0 FROM (SELECT id, unnest([n, said]) AS x FROM tx)), dg AS (SELECT *, least(3, greatest(1, d0)) AS d FROM nums
), ok AS (SELECT dg.id, dg.x, bool_or(CASE d WHEN 1 THEN format('{:.0e}', CAST(dg.x AS DOUBLE)) = format('{:.0e}', CAST(v.x AS DOUBLE)) WHEN 2 THEN format('{:.1e}', CAST(dg.x AS DOUBLE)) = format('{:.1e}', CAST(v.x AS DOUBLE)) ELSE format('{:.2e}', CAST(dg.x AS DOUBLE)) = format('{:.2e}', CAST(v.x AS DOUBLE)) END) AS good, count(DISTINCT dg.d) AS one
  FROM dg JOIN (SELECT id, unnest([n, mean, last]) AS x FROM s) v ON v.id = dg.id GROUP BY dg.id, dg.x)
SELECT tx.id, CAST(CASE WHEN twice THEN 2 ELSE 1 END AS BIGINT) AS own_labels, CAST(0 AS BIGINT) AS other_labels, (SELECT count(*) FROM ok WHERE ok.id = tx.id AND NOT good) AS numbers, CAST(odd AS BIGINT) AS aliases FROM tx"""


def prose(spark, d):
    stats = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.max("event_id").alias("last")).withColumn("mean", F.expr("total div n"))
    said = F.when(F.col("id") % 4 == 1, F.col("mean") + 1000).otherwise(F.col("mean"))
    label = F.lit("Sensor fault: drift (bias)")
    parts = F.array(F.concat(F.when(F.col("id") % 7 == 3, "S777").otherwise("S01"), F.lit(" has "), "n", F.lit(" rows.")), F.concat(F.lit("Their mean is "), said, F.lit(". "), label, F.when(F.col("id") % 5 == 2, F.concat(F.lit(", a sensor fault: drift (bias)"))).otherwise("")))
    texts = stats.select("id", F.posexplode(parts).alias("part", "text"), label.alias("label"))
    values = stats.select("id", F.explode(F.array("n", "mean", "last").cast("array<double>")).alias("value"))
    return texts, values, spark.createDataFrame([("S01",), ("S02",)], "alias string")


@query("prose_validate", f"SELECT *, numbers = 0 AND aliases = 0 AND own_labels = 1 AND other_labels = 0 AS passed FROM ({PROSE})")
def prose_validate(spark, d):
    return v.validate(*prose(spark, d))


@query("review_validate", f"SELECT id, numbers + aliases + own_labels AS errors, numbers = 0 AND aliases = 0 AND own_labels = 0 AS passed FROM (SELECT * REPLACE (CAST(id % 3 = 0 AS BIGINT) AS own_labels) FROM ({PROSE}))")
def review_validate(spark, d):
    """A review may leave its label out, and may not name another: every third text is given a fault that isn't the reviewer's."""
    texts, values, aliases = prose(spark, d)
    other = F.when(F.col("id") % 3 == 0, "Process fault: step shift").otherwise("Sensor fault: drift (bias)")
    once = texts.withColumns({"text": F.when(F.col("part") == 1, F.regexp_replace("text", r", a sensor fault: drift \(bias\)$", "")).otherwise(F.col("text")), "label": other})
    checked = v.validate(once, values, aliases)
    errors = F.col("numbers") + F.col("aliases") + F.col("other_labels")
    return checked.select("id", errors.alias("errors"), (errors == 0).alias("passed"))


#: The steps of a trace, their stats and how often a phrase stands in the result.
STEPS = [("health", ["max_deviation", "n"], 0), ("drift", ["middle", "n"], 4), ("isolation", ["z"], 9), ("propagation", ["z", "missing"], 15), ("control-loop", ["missing"], 20), ("verdict", ["max_deviation", "z", "middle", "other"], 40)]
PHRASE = " leaves its peers"


@query(
    "reasoning_trace",
    with_grid(
        EVIDENCE + ", sp AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {keys}, {n})" for s, keys, n in STEPS) + f""") v(step, keys, n)), st1 AS (SELECT DISTINCT run_id, sensor FROM ev), k AS (SELECT run_id, sensor, step, unnest(keys) AS stat, sensor || repeat('{PHRASE}', n) AS result FROM st1 CROSS JOIN sp
        ), vals AS (SELECT run_id, sensor, stage, unnest(names) AS stat, unnest(nums) AS value FROM ev), f AS (SELECT k.*, value, row_number() OVER (PARTITION BY k.run_id, k.sensor, step, k.stat ORDER BY stage) AS place FROM k JOIN vals USING (run_id, sensor, stat) WHERE isfinite(value))
        SELECT run_id, sensor, step, stat, CASE WHEN length(result) <= 300 THEN result ELSE regexp_extract(substr(result, 1, 297), '^(.+) ', 1) || '...' END AS result, value FROM f WHERE place = 1"""
    ),
    "value",
)
def reasoning_trace(spark, d):
    rows = durable(evidence(spark, d))
    cited = rows.groupBy("run_id", "sensor").agg(F.transform(F.sort_array(F.collect_list(F.struct("stage", "id"))), lambda x: x["id"]).alias("cited"))
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.array(*[F.lit(x) for x in keys]).alias("keys"), F.lit(PHRASE * n).alias("tail")) for s, keys, n in STEPS])
    asked = cited.select("run_id", "sensor", "cited", F.inline(steps)).withColumn("result", F.concat("sensor", "tail"))
    return v.trace(asked, rows)


@query(
    "run_family_notes",
    """WITH RECURSIVE runs AS (SELECT conv_id AS run, conv_id // 2 AS parent, arg_min(length(text) % 10, turn) AS name FROM conversations GROUP BY conv_id), up AS (SELECT run, parent FROM runs WHERE run = 9 UNION ALL SELECT r.run, r.parent FROM up JOIN runs r ON r.run = up.parent AND up.parent <> up.run
    ), family AS (SELECT run FROM up UNION SELECT run FROM runs WHERE name = (SELECT name FROM runs WHERE run = 9)), n AS (SELECT conv_id AS run, role AS alias, turn, text FROM conversations WHERE conv_id IN (SELECT run FROM family)
    ), p AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY run DESC, turn DESC) AS place, count(*) OVER (PARTITION BY alias) AS n FROM n) SELECT alias, n, (SELECT count(DISTINCT run) FROM n WHERE n.alias = p.alias) AS runs, text AS latest FROM p WHERE place = 1""",
)
def run_family_notes(spark, d):
    """Conversations as runs with notes: a run's parent has half its number, its name comes from its first turn."""
    rows = table(spark, d, "conversations")
    runs = rows.groupBy(F.col("conv_id").alias("run")).agg(F.min_by(F.length("text") % 10, "turn").alias("name")).withColumn("parent", F.when(F.col("run") > 0, F.expr("run div 2")))
    return v.family_notes(durable(runs), rows.select(F.col("conv_id").alias("run"), F.col("role").alias("alias"), F.col("turn").alias("seq"), "text"), 9)


@query(
    "tool_rerun_without",
    with_grid(
        PAIRS
        + """, both_ways AS (SELECT run_id, a AS sensor, b AS peer, rho FROM pairs UNION ALL SELECT run_id, b, a, rho FROM pairs
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, sensor ORDER BY round(abs(rho), 9) DESC, peer) AS place FROM both_ways WHERE sensor <> 'price' AND peer <> 'price') SELECT run_id, sensor, peer, rho, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 5"""
    ),
    "rho",
)
def tool_rerun_without(spark, d):
    """Relations and peers again, from a grid in which ``price`` is masked."""
    g = planted(spark, d)
    masked = g.withColumn("v", F.when(F.col("sensor") == "price", None).otherwise(F.col("v")))
    return rel.peers(rel.rank_pairs(masked, LEAST), g.where("sensor = 'price'").select("run_id", "sensor").distinct())
