"""Queries of sources, sinks, principal components and corpus upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.cleaning import clean_number
from tideline.operators import corpus as c
from tideline.operators import health
from tideline.operators import packed as pk
from tideline.plans.corpus import CLAIMS, PHRASES, docs, phrases
from tideline.plans.drift import ramp
from tideline.plans.fixtures import grid, table, with_grid
from tideline.plans.registry import query
from tideline.session import durable, shared_path
from tideline.sources import tables

SENSORS = [m + f for m in ("quantity", "price", "discount") for f in ("", "[A]", "[N]", "[R]")]


@query("src_csv_scan", "SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS price FROM orders", "price")
def src_csv_scan(spark, d):
    path = shared_path(spark, "orders-csv")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    table(spark, d, "orders").select(F.concat(F.lit(" "), F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus", F.concat_ws(",", F.expr("cast(round(o_totalprice * 100) as bigint) div 100").cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")).alias("price")).write.csv(path, header=True, sep=";")
    return tables.read_delimited(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", clean_number(F.col("price")).alias("price"))


@query("sink_run_tables", with_grid(" SELECT run_id, sensor, t, v FROM grid"), "v")
def sink_run_tables(spark, d):
    path = shared_path(spark, "runs")
    g = grid(spark, d)
    tables.write_run(g.unionByName(g.withColumn("run_id", F.lit("other"))), path)
    return tables.load_run(spark, path, "lineitem").select("run_id", "sensor", "t", "v")


@query(
    "sink_run_all",
    with_grid(" SELECT 'grid' AS name, count(*) AS n FROM grid UNION ALL SELECT 'evidence', count(*) FROM (SELECT DISTINCT sensor, episode FROM grid) UNION ALL SELECT 'rules', 3 * count(DISTINCT sensor) FROM grid"),
)
def sink_run_all(spark, d):
    """A run's grid, evidence and rules saved as one, and again; of a save that fails between two tables nothing is seen."""
    root, g = shared_path(spark, "run-store"), durable(grid(spark, d))
    parts = {"grid": g, "evidence": g.groupBy("sensor", "episode").agg(F.count("*").alias("n")), "rules": health.propose_rules(g, 240)}
    tables.save_run(spark, root, "lineitem", parts)
    try:
        tables.save_run(spark, root, "lineitem", {"grid": g.limit(1), "evidence": g.select(F.raise_error(F.lit("no space")).alias("n"))})
    except Exception:  # noqa: BLE001  the failing save is the point
        pass
    loaded = [tables.load_table(spark, root, "lineitem", n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in parts]
    return loaded[0].unionByName(loaded[1]).unionByName(loaded[2])


CORPUS = """s AS (SELECT conv_id AS source_id, turn AS seq, CASE WHEN conv_id % 7 = 0 THEN 'USER' ELSE role END AS speaker, text FROM conversations
), cl AS (SELECT source_id * 1000 + seq AS claim_id, source_id, speaker FROM s WHERE length(text) % 3 = 0), lk AS (SELECT claim_id, claim_id % 4 AS column_id FROM cl WHERE claim_id % 2 = 0)"""


def block_chunks(segments):
    return segments.groupBy("source_id", F.expr("seq div 3").alias("chunk")).agg(F.count("*").alias("n"))


def corpus_tables(spark, d):
    """Conversations as sources; every seventh has one speaker. A third of the turns makes a claim, half of the claims have a link."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), F.when(F.col("conv_id") % 7 == 0, "USER").otherwise(F.col("role")).alias("speaker"), "text")
    claims = said.where(F.length("text") % 3 == 0).select((F.col("source_id") * 1000 + F.col("seq")).alias("claim_id"), "source_id", "speaker")
    sources = said.groupBy("source_id").agg(F.count("*").alias("occurred_at"))
    return {"sources": sources, "segments": said, "chunks": block_chunks(said), "claims": claims, "links": claims.where("claim_id % 2 = 0").select("claim_id", (F.col("claim_id") % 4).alias("column_id"))}


@query(
    "erase_person",
    f"""WITH {CORPUS}, left_s AS (SELECT * FROM s WHERE lower(speaker) <> 'user'), src AS (SELECT DISTINCT source_id FROM s), lsrc AS (SELECT DISTINCT source_id FROM left_s
    ), gone AS (SELECT source_id FROM src WHERE source_id NOT IN (SELECT source_id FROM lsrc)), lcl AS (SELECT * FROM cl WHERE lower(speaker) <> 'user' AND source_id NOT IN (SELECT source_id FROM gone)
    ), n AS (SELECT 'sources' AS name, (SELECT count(*) FROM src) AS before, (SELECT count(*) FROM src WHERE source_id NOT IN (SELECT source_id FROM gone)) AS kept
      UNION ALL SELECT 'segments', (SELECT count(*) FROM s), (SELECT count(*) FROM left_s) UNION ALL SELECT 'claims', (SELECT count(*) FROM cl), (SELECT count(*) FROM lcl)
      UNION ALL SELECT 'chunks', (SELECT count(*) FROM (SELECT DISTINCT source_id, seq // 3 FROM s)), (SELECT count(*) FROM (SELECT DISTINCT source_id, seq // 3 FROM left_s))
      UNION ALL SELECT 'links', (SELECT count(*) FROM lk), (SELECT count(*) FROM lk WHERE claim_id IN (SELECT claim_id FROM lcl)))
    SELECT name, kept, before - kept AS gone FROM n""",
)
def erase_person(spark, d):
    before = corpus_tables(spark, d)
    return c.changes_of(before, c.erase_person(before, " User ", block_chunks))


@query(
    "retain_sources",
    f"""WITH {CORPUS}, src AS (SELECT source_id, count(*) AS occurred_at FROM s GROUP BY source_id), old AS (SELECT source_id FROM src WHERE occurred_at < 5
    ), n AS (SELECT 'sources' AS name, (SELECT count(*) FROM src) AS before, (SELECT count(*) FROM src WHERE source_id NOT IN (SELECT source_id FROM old)) AS kept
      UNION ALL SELECT 'segments', (SELECT count(*) FROM s), (SELECT count(*) FROM s WHERE source_id NOT IN (SELECT source_id FROM old)) UNION ALL SELECT 'claims', (SELECT count(*) FROM cl), (SELECT count(*) FROM cl WHERE source_id NOT IN (SELECT source_id FROM old))
      UNION ALL SELECT 'chunks', (SELECT count(*) FROM (SELECT DISTINCT source_id, seq // 3 FROM s)), (SELECT count(*) FROM (SELECT DISTINCT source_id, seq // 3 FROM s WHERE source_id NOT IN (SELECT source_id FROM old)))
      UNION ALL SELECT 'links', (SELECT count(*) FROM lk), (SELECT count(*) FROM lk WHERE claim_id IN (SELECT claim_id FROM cl WHERE source_id NOT IN (SELECT source_id FROM old))))
    SELECT name, kept, before - kept AS gone FROM n""",
)
def retain_sources(spark, d):
    """Sources of fewer than five turns stand for old ones."""
    before = corpus_tables(spark, d)
    return c.changes_of(before, c.retain(before, F.lit(5)))


@query("alias_import", "SELECT DISTINCT n_name AS name, r_name AS phrase FROM nation JOIN region ON r_regionkey = n_regionkey")
def alias_import(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("r_name").alias("area"), F.col("n_name").alias("land"))
    return tables.import_aliases(rows, nation.select(F.col("n_name").alias("name")))


def component_grid(spark, d):
    return pk.pack(ramp(spark, d).where(F.col("sensor").isin(SENSORS)))


@query("pca_fit")
def pca_fit(spark, d):
    """The components of the complete weeks before week 240, a row for each sensor and component."""
    model = pk.components(component_grid(spark, d), 240)
    wide = model.select("run_id", "n", "k", "t2_limit", "spe_limit", F.inline(F.arrays_zip("sensors", "means", "stdevs", F.sequence(F.lit(0), F.size("sensors") - 1).alias("at"))), "loadings", "variances")
    names = {"sensors": "sensor", "means": "mean", "stdevs": "stdev"}
    return wide.withColumnsRenamed(names).select("run_id", "n", "k", "t2_limit", "spe_limit", "sensor", "mean", "stdev", "at", "variances", F.posexplode("loadings").alias("component", "row")).select(
        "run_id", "n", "k", "t2_limit", "spe_limit", "sensor", "mean", "stdev", "component", F.get("row", F.col("at")).alias("loading"), F.get("variances", F.col("component")).alias("variance")
    )


@query("pca_statistics")
def pca_statistics(spark, d):
    """T2, squared error and what each sensor contributes, for the weeks before and after ``price[A]`` drifts."""
    packed = component_grid(spark, d)
    windows = packed.select("run_id").distinct().select("run_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("long").alias("from"), F.lit(b).cast("long").alias("to")) for n, a, b in (("baseline", 0, 240), ("clean", 240, 300), ("drifting", 300, 400))])))
    return pk.component_statistics(packed, pk.components(packed, 240), windows)


CUES = r"""cues AS (
  SELECT conv_id AS source_id, turn AS seq, turn * 5.0 AS start, turn * 5.0 + 3 + turn % 3 AS stop, role AS speaker, text FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations)
)"""


@query("vtt_cues", f"WITH {CUES} SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS INTEGER) AS pos, start, stop, speaker, text FROM cues", "start stop")
def vtt_cues(spark, d):
    clock = lambda s: F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(".000"))
    start = F.col("turn") * 5
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    cue = F.concat(clock(start), F.lit(" --> "), clock(start + 3 + F.col("turn") % 3), F.lit("\n<v "), F.col("role"), F.lit(">"), body)
    made = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), "turn", cue.alias("cue"))
    vtt = made.groupBy("source_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "cue"))), lambda x: x["cue"]), "\n\n")).alias("text"))
    return c.cues(vtt)


ASKED = [*PHRASES, ("never said", 4)]


@query("open_questions", f"WITH {CLAIMS} SELECT phrase, CAST(column_id AS BIGINT) AS column_id FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in ASKED) + ") q(phrase, column_id) WHERE column_id NOT IN (SELECT column_id FROM claims)")
def open_questions(spark, d):
    wanted = spark.createDataFrame(ASKED, "phrase string, column_id long")
    return wanted.join(c.claims(docs(spark, d), phrases(spark)).select("column_id").distinct(), "column_id", "left_anti").select("phrase", "column_id")


@query("claim_contradicted", rf"WITH {CLAIMS} SELECT DISTINCT c.doc_id, c.column_id FROM claims c JOIN documents d ON d.doc_id = c.doc_id WHERE NOT contains(regexp_replace(d.text, '[^\n]*icense[^\n]*', '', 'g'), c.sentence)")
def claim_contradicted(spark, d):
    """Claims whose sentence is gone once the owner has taken the license lines out of the texts."""
    # line by line: one pattern over the text scans a long line from each of its characters
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.contains(x, F.lit("icense")), "").otherwise(x))
    now = docs(spark, d).select("doc_id", F.array_join(lines, "\n").alias("now"))
    return c.claims(docs(spark, d), phrases(spark)).join(now, "doc_id").where(~F.contains("now", "sentence")).select("doc_id", "column_id").distinct()


@query("link_replace", "WITH old AS (SELECT user_id AS claim_id, event_type AS column_id, bool_or(value > 95) AS confirmed FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), new AS (SELECT DISTINCT user_id AS claim_id, event_type AS column_id FROM events WHERE ts >= TIMESTAMP '2024-01-16') SELECT claim_id, column_id, true AS confirmed FROM old WHERE confirmed UNION ALL SELECT n.claim_id, n.column_id, false FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.confirmed AND o.claim_id = n.claim_id AND o.column_id = n.column_id)")
def link_replace(spark, d):
    e = table(spark, d, "events")
    old = e.where("ts < TIMESTAMP'2024-01-16'").groupBy(F.col("user_id").alias("claim_id"), F.col("event_type").alias("column_id")).agg(F.bool_or(F.col("value") > 95).alias("confirmed"))
    new = e.where("ts >= TIMESTAMP'2024-01-16'").select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("column_id")).distinct()
    kept = old.where("confirmed")
    return kept.unionByName(new.join(kept, ["claim_id", "column_id"], "left_anti").withColumn("confirmed", F.lit(False)))


@query("route_sources", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'fixed' WHEN lang = 'de' THEN 'north' WHEN lang = 'es' THEN 'south' ELSE 'unassigned' END AS workspace FROM documents")
def route_sources(spark, d):
    fixed = spark.createDataFrame([("src1", "fixed"), ("src2", "fixed")], "source string, by_source string")
    by_lang = spark.createDataFrame([("de", "north"), ("es", "south")], "lang string, by_lang string")
    return docs(spark, d).select("doc_id", "source", "lang").join(fixed, "source", "left").join(by_lang, "lang", "left").select("doc_id", F.coalesce("by_source", "by_lang", F.lit("unassigned")).alias("workspace"))


@query("meeting_gaps", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)")
def meeting_gaps(spark, d):
    held = table(spark, d, "conversations").select(F.col("conv_id").alias("user_id"))
    return table(spark, d, "events").select("user_id").distinct().join(held, "user_id", "left_anti")
