"""Queries over documents, pages, conversations, embeddings and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.cleaning import normalize
from tideline.operators import corpus as c
from tideline.plans.fixtures import table
from tideline.plans.registry import query

TERMS = ["thorre", "idiot", "license"]
NORM = r"trim(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(lower({x}), '[‘’‚′]', '''', 'g'), '[“”„″]', '\"', 'g')), '\s+', ' ', 'g'))".replace('\\"', '"')
SENT = r"""sentences AS (
  SELECT doc_id, pos - 1 AS pos, trim(s) AS sentence FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), 1) AS pos FROM documents) WHERE trim(s) <> ''
)"""
BM25 = (
    "post AS (SELECT doc_id, length(text) AS size, t.term, CAST(len(regexp_extract_all(lower(text), t.term)) AS BIGINT) AS tf FROM documents CROSS JOIN (SELECT unnest(['thorre', 'idiot', 'license']) AS term) t"
    "), st AS (SELECT count(DISTINCT doc_id) AS n, avg(size) AS mean FROM post), df AS (SELECT term, count(*) AS df FROM post WHERE tf > 0 GROUP BY term"
    "), hits AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM post JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id"
    "), lexical AS (SELECT doc_id, score FROM hits ORDER BY round(score, 9) DESC, doc_id LIMIT 50)"
)
#: Every vector with an id divisible by 50 is a query against all vectors.
KNN = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 50 = 0), knn AS (SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS INTEGER) AS place FROM (SELECT query_id, vec_id, list_distance(CAST(embedding AS DOUBLE[]), query) AS distance FROM embeddings, q)) WHERE place <= 50)"


def docs(spark, d):
    return table(spark, d, "documents")


@query("ingest_dedupe_by_hash", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def ingest_dedupe_by_hash(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "upsert_by_external_id",
    """WITH m AS (SELECT user_id AS id, event_id AS version, event_type AS body, ts >= TIMESTAMP '2024-01-16' AS late FROM events), old AS (SELECT id, max(version) AS version, arg_max(body, version) AS body FROM m WHERE NOT late GROUP BY id
    ), new AS (SELECT id, max(version) AS version, arg_max(body, version) AS body FROM m WHERE late GROUP BY id)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.version > coalesce(o.version, -1) THEN n.body ELSE o.body END AS body, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL OR n.version < o.version OR n.body = o.body THEN 'keep' ELSE 'replace' END AS action FROM old o FULL JOIN new n ON n.id = o.id""",
)
def upsert_by_external_id(spark, d):
    m = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("body"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).alias("late"))
    latest = lambda x, tag: x.groupBy("id").agg(F.max("version").alias(f"{tag}_version"), F.max_by("body", "version").alias(f"{tag}_body"))
    met = latest(m.where("not late"), "old").join(latest(m.where("late"), "new"), "id", "full")
    newer = F.col("new_version") > F.coalesce("old_version", F.lit(-1))
    action = F.when(F.col("old_version").isNull(), "insert").when(F.col("new_version").isNull() | (F.col("new_version") < F.col("old_version")) | (F.col("new_body") == F.col("old_body")), "keep").otherwise("replace")
    return met.select("id", F.when(newer, F.col("new_body")).otherwise(F.col("old_body")).alias("body"), action.alias("action"))


@query(
    "message_sessions",
    """WITH e AS (SELECT CAST(event_id // 6 % 20 AS INTEGER) AS channel, event_id AS id, ts, CASE WHEN event_id % 12 = 5 THEN event_id - 5 WHEN event_id % 12 = 0 THEN event_id END AS thread FROM events WHERE event_id % 60 <> 0
    ), p AS (SELECT * FROM e WHERE thread IS NULL UNION ALL SELECT * FROM (SELECT * FROM e WHERE thread IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel, thread ORDER BY ts, id) = 1)
    ), s AS (SELECT *, CASE WHEN thread IS NULL AND lag(thread IS NULL) OVER w AND epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS start FROM p WINDOW w AS (PARTITION BY channel ORDER BY ts, id)
    ), i AS (SELECT *, sum(start) OVER (PARTITION BY channel ORDER BY ts, id) AS island FROM s), l AS (SELECT channel, min(id) AS group_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM i WHERE thread IS NULL GROUP BY channel, island)
    SELECT * FROM l UNION ALL SELECT channel, thread, count(*), min(id), max(id) FROM e WHERE thread IS NOT NULL GROUP BY channel, thread""",
)
def message_sessions(spark, d):
    """Events as messages of 20 channels; every twelfth is the root of a thread with a reply, and some roots are missing."""
    e = table(spark, d, "events").where("event_id % 60 <> 0")
    return c.sessions(e.select(F.expr("cast(event_id div 6 % 20 as int)").alias("channel"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 12 == 5, F.col("event_id") - 5).alias("root"), F.when(F.col("event_id") % 12 == 0, 1).alias("replies")), "channel", 1800)


SPOKEN = "SELECT conv_id AS source_id, turn AS seq, CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS speaker, text, turn * 5.0 + turn // 3 AS start, turn * 5.0 + turn // 3 + 3 + turn % 3 AS stop FROM conversations"


@query(
    "speaker_turns",
    f"""WITH c AS ({SPOKEN}), m AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND start - lag(stop) OVER w <= 2 THEN 0 ELSE 1 END AS change FROM c WINDOW w AS (PARTITION BY source_id ORDER BY seq)
    ), s AS (SELECT *, CAST(sum(change) OVER (PARTITION BY source_id ORDER BY seq) AS BIGINT) AS turn FROM m) SELECT source_id, turn, speaker, min(seq) AS from_seq, max(seq) AS to_seq, min(start) AS start, arg_max(stop, seq) AS stop, string_agg(text, ' ' ORDER BY seq) AS text FROM s GROUP BY source_id, turn, speaker""",
    "start stop",
)
def speaker_turns(spark, d):
    start = F.col("turn") * 5.0 + F.expr("turn div 3")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 4 == 3, "user").otherwise(F.col("role")).alias("speaker"), "text", start.alias("start"), (start + 3 + F.col("turn") % 3).alias("stop"))
    return c.turns(rows, 2.0)


@query(
    "paragraph_segments",
    r"""WITH x AS (SELECT doc_id, trim('# Of ' || source || chr(10) || chr(10) || text || chr(10) || ' ' || chr(10) || '- one' || chr(10) || '-   two' || chr(10) || chr(10) || '## More' || chr(10) || 'and  more', chr(10)) AS text FROM documents WHERE text IS NOT NULL
    ), p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS k FROM x
    ), l AS (SELECT *, string_split(raw, chr(10)) AS lines FROM p
    ), t AS (SELECT *, CASE WHEN len(lines) > 1 AND (list_bool_and(list_transform(lines, lambda q: regexp_matches(q, '^\s*\|.*\|\s*$'))) OR list_bool_and(list_transform(lines, lambda q: regexp_matches(q, '^\s*([-*+]|[0-9]+[.)])\s+\S'))))
      THEN array_to_string(list_transform(lines, lambda q: regexp_replace(regexp_replace(q, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)) ELSE regexp_replace(regexp_replace(raw, '\s+', ' ', 'g'), '^ | $', '', 'g') END AS text FROM l)
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, CAST(sum(CASE WHEN regexp_matches(raw, '^#{1,6}\s') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS block, regexp_replace(text, '^#{1,6}\s+', '') AS text FROM t WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k)""",
)
def paragraph_segments(spark, d):
    """Documents with a heading before and a list and another heading behind."""
    text = F.concat(F.lit("# Of "), "source", F.lit("\n\n"), "text", F.lit("\n \n- one\n-   two\n\n## More\nand  more"))
    return c.paragraphs(docs(spark, d).where("text is not null").select("doc_id", text.alias("text")))


TAILS = ["", "\n\n\n\nBest regards,\nSomeone", "\n> quoted\ntail", "\nOn Monday Ann wrote:\ntail", "\n-- \nname\n-----Original Message-----\ntail", "\nFrom: Ann\ntail"]
QUOTES, SIGNATURES = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]" for xs in (c.QUOTE_STARTS, c.SIGNATURE_STARTS))
BEFORE = r"CASE WHEN {at} > 0 THEN list_slice({lines}, 1, {at} - 1) ELSE {lines} END"
FIRST = r"coalesce(list_position(list_transform({lines}, lambda q: list_bool_or(list_transform({patterns}, lambda p: regexp_matches(regexp_replace(q, '^\s+|\s+$', '', 'g'), p)))), true), 0)"


@query(
    "strip_quotes",
    "WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, text || [" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in TAILS) + "][CAST((conv_id + turn) % 6 AS INTEGER) + 1] AS text FROM conversations), l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM t"
    + f"), q AS (SELECT doc_id, {BEFORE.format(at='cut', lines='lines')} AS lines FROM (SELECT *, {FIRST.format(lines='lines', patterns=QUOTES)} AS cut FROM l)), s AS (SELECT doc_id, {BEFORE.format(at='cut', lines='lines')} AS lines FROM (SELECT *, {FIRST.format(lines='lines', patterns=SIGNATURES)} AS cut FROM q))"
    + r" SELECT doc_id, regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text, CAST(len(lines) AS INTEGER) AS n_lines FROM s",
)
def strip_quotes(spark, d):
    """Turns as mails with signatures and quotes of several forms behind."""
    tail = F.element_at(F.array(*map(F.lit, TAILS)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return c.strip_quotes(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat("text", tail).alias("text")))


@query(
    "html_to_text",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", c.html_to_text(F.col("html")).alias("text"))


@query("sentence_split", f"WITH {SENT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence, CAST(ceil(length(sentence) / 4.0) AS BIGINT) AS tokens FROM sentences")
def sentence_split(spark, d):
    return c.sentences(docs(spark, d)).withColumn("tokens", c.tokens_of(F.col("sentence")))


@query("normalize_text", f"SELECT doc_id, {NORM.format(x='text')} AS text FROM documents")
def normalize_text(spark, d):
    """Texts written with ligatures and full-width letters, which the compatibility form takes back."""
    wide = F.translate(F.replace(F.col("text"), F.lit("fi"), F.lit("\ufb01")), "ae", "\uff41\uff45")
    return docs(spark, d).select("doc_id", normalize(wide).alias("text"))


@query("chunk_segments")
def chunk_segments(spark, d):
    return chunked(spark, d)


def chunked(spark, d):
    return c.chunks(table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), F.expr("turn div 6").alias("block"), "text"), 400)


@query("hash_embedding")
def hash_embedding(spark, d):
    return c.hash_embedding(docs(spark, d)).select("doc_id", "embedding")


@query("search_bm25", f"WITH {BM25} SELECT doc_id, score FROM lexical", "score")
def search_bm25(spark, d):
    return c.bm25(docs(spark, d), TERMS, 50)


def knn(spark, d):
    e = table(spark, d, "embeddings")
    return c.nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 50)


@query("search_knn", f"WITH {KNN} SELECT query_id, vec_id, distance, place FROM knn", "distance")
def search_knn(spark, d):
    return knn(spark, d)


FUSED = f"WITH {BM25}, {KNN}, a AS (SELECT query_id, doc_id, rank_a FROM q, (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank_a FROM lexical)), b AS (SELECT query_id, vec_id AS doc_id, place AS rank_b FROM knn), f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b, coalesce(1.0 / (60 + rank_a), 0) + coalesce(1.0 / (60 + rank_b), 0) AS score FROM a FULL JOIN b ON b.doc_id = a.doc_id AND b.query_id = a.query_id)"


def fused(spark, d):
    """The list of the terms with the list of every vector query."""
    a = c.ranked(c.bm25(docs(spark, d), TERMS, 50), "doc_id", [F.desc(F.round("score", 9)), F.col("doc_id")], "rank_a")
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    b = knn(spark, d).select("query_id", F.col("vec_id").alias("doc_id"), F.col("place").alias("rank_b"))
    return c.fuse(queries.join(F.broadcast(a), F.lit(True)), b, ["query_id", "doc_id"])  # the list has 50 rows


@query("search_rrf", FUSED + " SELECT * FROM f", "score")
def search_rrf(spark, d):
    return fused(spark, d)


@query("search_hybrid", FUSED + " SELECT f.query_id, f.doc_id, score, source, substr(text, greatest(CAST(strpos(lower(text), 'idiot') AS BIGINT) - 30, 1), 120) AS snippet FROM f LEFT JOIN documents d ON d.doc_id = f.doc_id", "score")
def search_hybrid(spark, d):
    return fused(spark, d).join(docs(spark, d), "doc_id", "left").select("query_id", "doc_id", "score", "source", c.snippet(F.col("text"), F.lit("idiot")).alias("snippet"))


PHRASES = [("idiot", 1), ("clown", 1), ("license", 2), ("released under", 2), ("under CC BY", 3), ("Apache License, Version", 3)]


def phrases(spark):
    return spark.createDataFrame(PHRASES, "phrase string, column_id long")


BORDER = r"[^\p{L}\p{N}_]"
CLAIMS = (
    SENT
    + ", matched AS (SELECT *, least("
    + ", ".join(f"CASE WHEN contains(lower(sentence), '{a.lower()}') AND regexp_matches(lower(sentence), '(^|{BORDER}){a.lower()}($|{BORDER})') THEN {b} END" for a, b in PHRASES)
    + ") AS column_id FROM sentences WHERE length(sentence) BETWEEN 12 AND 500"
    "), claims AS (SELECT doc_id, pos, sentence, CAST(column_id AS BIGINT) AS column_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM matched WHERE column_id IS NOT NULL) WHERE place <= 20)"
)


@query("claim_extract", f"WITH {CLAIMS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence, column_id FROM claims")
def claim_extract(spark, d):
    return c.claims(docs(spark, d), phrases(spark))


@query("catalog_claim_counts", f"WITH {CLAIMS} SELECT column_id, count(DISTINCT doc_id * 100000 + pos) AS n_claims, count(DISTINCT doc_id) AS n_docs FROM claims GROUP BY column_id")
def catalog_claim_counts(spark, d):
    return c.claims(docs(spark, d), phrases(spark)).groupBy("column_id").agg(F.count_distinct(F.col("doc_id") * 100000 + F.col("pos")).alias("n_claims"), F.count_distinct("doc_id").alias("n_docs"))


COLUMNS = [(1, "insult", ["idiot", "clown"]), (2, "license", ["released under"]), (3, "terms", ["under CC BY", "Apache License, Version"])]


def linked(spark, d):
    said = c.claims(docs(spark, d), phrases(spark)).select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("claim_id"), F.substring("sentence", 1, 300).alias("statement"))
    return c.link_claims(c.link_scores(said, spark.createDataFrame(COLUMNS, "column_id long, name string, phrases array<string>")))


@query("claim_link")
def claim_link(spark, d):
    return linked(spark, d)


@query("quote_verify_exact", f"WITH q AS (SELECT item_id, {NORM.format(x='text')} AS quote FROM benchmark), b AS (SELECT doc_id, {NORM.format(x='text')} AS body FROM documents), h AS (SELECT item_id, min(doc_id) AS doc_id FROM q JOIN b ON contains(body, quote) GROUP BY item_id) SELECT q.item_id, h.doc_id, h.doc_id IS NOT NULL AS verified FROM q LEFT JOIN h USING (item_id)")
def quote_verify_exact(spark, d):
    return c.quotes_exact(table(spark, d, "benchmark"), docs(spark, d))


@query("source_overview", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_doc FROM documents GROUP BY ALL")
def source_overview(spark, d):
    return docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"))


@query("corpus_stats", "SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'segments', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def corpus_stats(spark, d):
    out = None
    for what, name in (("documents", "documents"), ("segments", "conversations"), ("pages", "pages"), ("vectors", "embeddings")):
        part = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("erase_speaker", "SELECT conv_id, turn, role, text FROM conversations WHERE lower(role) <> 'user'")
def erase_speaker(spark, d):
    gone = spark.createDataFrame([("USER",)], "who string").select(F.lower("who").alias("who"))
    rows = table(spark, d, "conversations")
    return rows.join(gone, F.lower(rows["role"]) == gone["who"], "left_anti")


@query("apply_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def apply_retention(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    return e.join(F.broadcast(newest), F.lit(True)).where(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("chunk_speaker")
def chunk_speaker(spark, d):
    """The speaker of each chunk whose segments have one only."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), "role")
    spans = chunked(spark, d).where("piece = 0").select("source_id", "chunk", F.posexplode(F.sequence("from_seq", "to_seq")).alias("at", "seq"))
    return rows.join(spans, ["source_id", "seq"]).groupBy("source_id", "chunk").agg(F.when(F.count_distinct("role") == 1, F.min("role")).alias("speaker"))


@query(
    "tabular_to_text",
    "SELECT 'customer' AS sheet, c_custkey AS row, 'name: ' || c_name || '; segment: ' || c_mktsegment || '; nation: ' || c_nationkey AS text FROM customer UNION ALL SELECT 'lineitem', 0, 'Sensor data file with 3 columns: quantity, price, tax' FROM lineitem HAVING count(*) > 0",
)
def tabular_to_text(spark, d):
    """A sheet of words, whose rows become texts, and one of numbers."""
    words = c.tabular_to_text(table(spark, d, "customer"), "customer", "c_custkey", {"c_name": "name", "c_mktsegment": "segment", "c_nationkey": "nation"})
    return words.unionByName(c.tabular_to_text(table(spark, d, "lineitem"), "lineitem", "l_orderkey", {"l_quantity": "quantity", "l_extendedprice": "price", "l_tax": "tax"}))


@query(
    "email_threads",
    """WITH m AS (SELECT conv_id AS thread, turn AS ts, CASE WHEN role = 'user' THEN 'acme' || conv_id % 7 || '.com' END AS domain, CASE WHEN turn % 2 = 1 THEN 't' || (conv_id + turn) % 3 END AS tag, left(text, 20) AS subject FROM conversations)
    SELECT thread, count(*) AS n, arg_min(subject, ts) AS title, max(ts) AS occurred_at, coalesce(string_agg(DISTINCT domain, ',' ORDER BY domain), '') AS domains, arg_min(tag, ts) FILTER (WHERE tag IS NOT NULL) AS plus_tag FROM m GROUP BY thread""",
)
def email_threads(spark, d):
    """Turns as mails: users write from outside, every other one to a tagged address."""
    sender = F.when(F.col("role") == "user", F.concat(F.lit("U@Acme"), F.col("conv_id") % 7, F.lit(".com"))).otherwise("a@desk.example")
    to = F.when(F.col("turn") % 2 == 1, F.array(F.lit("x+y@else.where"), F.concat(F.lit("Team+T"), (F.col("conv_id") + F.col("turn")) % 3, F.lit("@desk.example")))).otherwise(F.array(F.lit("team@desk.example")))
    mails = table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ts"), F.col("turn").alias("id"), sender.alias("sender"), to.alias("recipients"), F.left("text", F.lit(20)).alias("subject"))
    return c.email_threads(mails, "team@desk.example")


WORDS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
GOLDEN = f"""WITH a AS (SELECT item_id AS query_id, text AS question FROM benchmark WHERE item_id % 50 = 0), t AS (SELECT DISTINCT query_id, unnest({WORDS.format(x='question')}) AS term FROM a
), s AS (SELECT doc_id, {WORDS.format(x='text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM s
), post AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM s) WHERE term IN (SELECT term FROM t) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM post GROUP BY term
), hits AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM post JOIN df USING (term) JOIN t USING (term), st GROUP BY ALL
), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS place FROM hits QUALIFY place <= 3
), r AS (SELECT query_id, min(place) FILTER (WHERE contains({NORM.format(x='d.text')}, {NORM.format(x='a.question')})) AS place FROM a JOIN top USING (query_id) JOIN documents d USING (doc_id) GROUP BY query_id)"""


@query("golden_hit_rate", GOLDEN + " SELECT count(*) AS n, avg(CAST(place IS NOT NULL AS INT)) AS hit_rate, avg(coalesce(1.0 / place, 0)) AS mean_reciprocal FROM r", "hit_rate mean_reciprocal")
def golden_hit_rate(spark, d):
    """Benchmark passages as questions (ids divisible by 50): how often one of the three best texts holds the passage, and how high."""
    asked = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    top = c.lexical_top(docs(spark, d), asked, 3)
    top = c.durable(top.join(asked.select("query_id", normalize(F.col("text")).alias("want")), "query_id"))
    # texts are read past the few results, not shuffled to them
    read = docs(spark, d).select("doc_id", "text").join(c.small(top), "doc_id").withColumn("body", normalize(F.col("text")))
    best = read.groupBy("query_id").agg(F.min(F.when(F.contains("body", "want"), F.col("place"))).alias("place"))
    return best.agg(F.count("*").alias("n"), F.avg(F.col("place").isNotNull().cast("int")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mean_reciprocal"))


@query("catalog_refresh", f"WITH {CLAIMS}, n AS (SELECT column_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM claims GROUP BY column_id) SELECT column_id, n, docs, 0.5 + 0.5 * docs / n AS confidence FROM n", "confidence")
def catalog_refresh(spark, d):
    counts = c.claims(docs(spark, d), phrases(spark)).groupBy("column_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    return counts.withColumn("confidence", 0.5 + 0.5 * F.col("docs") / F.col("n"))


@query("golden_hybrid")
def golden_hybrid(spark, d):
    """Starts of benchmark passages as questions (ids divisible by 50) to both lists, fused: whether one of the three best texts shows the passage's next words."""
    passages = table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.split(F.lower("text"), r"\s+").alias("w"))
    asked = passages.select("query_id", F.array_join(F.slice("w", 1, 12), " ").alias("text"), F.lit(None).cast("string").alias("title"), F.array_join(F.slice("w", 4, 6), " ").alias("contains"))
    titled = docs(spark, d).select("doc_id", "text", F.col("source").alias("title"))
    return c.golden_hits(c.hybrid(titled, asked, 3), asked, titled)
