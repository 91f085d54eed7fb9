"""Queries of threads, transcripts, quotes and the claims of a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import corpus as c
from tideline.plans.corpus import CLAIMS, NORM, docs, phrases
from tideline.plans.fixtures import table
from tideline.plans.registry import query


@query(
    "chunk_thread_parent",
    """WITH s AS (SELECT conv_id AS source_id, turn AS seq, role || ': ' || text AS said FROM conversations), p AS (SELECT source_id, min(seq) AS first_seq, arg_min(said, seq) AS parent FROM s GROUP BY source_id
    ), t AS (SELECT s.source_id, seq, CASE WHEN seq = first_seq THEN said ELSE parent || chr(10) || chr(10) || said END AS text FROM s JOIN p ON p.source_id = s.source_id) SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM t""",
)
def chunk_thread_parent(spark, d):
    return c.thread_chunks(table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text"))


#: A document read aloud: two speakers take its lines in turn, a word lasts 0.3 s, and every 300 words there is a pause of 3 s.
@query(
    "word_turns",
    r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents
    ), w0 AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), 1) AS k FROM l
    ), w1 AS (SELECT doc_id AS source_id, n % 2 AS speaker, word, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS pos FROM w0
    ), w AS (SELECT *, pos * 400 + pos // 300 * 3000 AS start_ms, pos * 400 + pos // 300 * 3000 + 300 AS end_ms FROM w1
    ), c AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR speaker <> lag(speaker) OVER o OR start_ms - lag(end_ms) OVER o > 2000 THEN 1 ELSE 0 END AS change FROM w WINDOW o AS (PARTITION BY source_id ORDER BY pos)
    ), i AS (SELECT *, sum(change) OVER (PARTITION BY source_id ORDER BY pos) AS island FROM c
    ), k AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY source_id, island ORDER BY pos) AS chars FROM i
    ), e AS (SELECT source_id, island, chars FROM k WHERE regexp_matches(word, '[.!?]$')
    ), cuts AS (SELECT DISTINCT source_id, island, CAST(0 AS HUGEINT) AS cut FROM e UNION ALL SELECT cuts.source_id, cuts.island, min(e.chars) AS cut FROM cuts JOIN e ON e.source_id = cuts.source_id AND e.island = cuts.island AND e.chars - cuts.cut > 1200 GROUP BY cuts.source_id, cuts.island, cuts.cut
    ), p AS (SELECT k.*, (SELECT count(*) FROM cuts WHERE cuts.source_id = k.source_id AND cuts.island = k.island AND cut > 0 AND cut < k.chars) AS part FROM k)
    SELECT source_id, CAST(island AS BIGINT) AS island, CAST(part AS INTEGER) AS part, CAST(speaker AS INTEGER) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text FROM p GROUP BY ALL""",
)
def word_turns(spark, d):
    from pyspark.sql import Window

    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    spoken = lines.select("doc_id", "n", F.regexp_extract_all("line", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    # lines are shuffled as texts, which take less than arrays of words
    sized = spoken.select("doc_id", "n", F.size("words").alias("size"), F.array_join("words", " ").alias("said"))
    # a line's first word follows all words of the lines before it
    before = F.sum("size").over(Window.partitionBy("doc_id").orderBy("n")) - F.col("size")
    placed = sized.withColumn("before", before).where("size > 0")
    start = lambda pos: pos * 400 + (pos - pos % 300) * 10
    word = lambda w, k: F.struct((F.col("n") % 2).alias("speaker"), w.alias("word"), start(F.col("before") + k).alias("start_ms"), (start(F.col("before") + k) + 300).alias("end_ms"))
    return c.word_turns(placed.select(F.col("doc_id").alias("source_id"), F.col("before").alias("pos"), F.transform(F.split("said", " "), word).alias("words")))


#: The words three to ten of a message; every other quote has its fourth letter misspelt.
QUOTE = "array_to_string(list_slice(string_split(body, ' '), 3, 10), ' ')"


@query(
    "quote_verify_fuzzy",
    f"""WITH b AS (SELECT conv_id, turn, {NORM.format(x="text")} AS body FROM conversations), q AS (SELECT *, CASE WHEN turn % 2 = 1 THEN substr({QUOTE}, 1, 3) || 'q' || substr({QUOTE}, 5) ELSE {QUOTE} END AS quote FROM b
    ), k AS (SELECT *, len(string_split(quote, ' ')) AS size, string_split(body, ' ') AS words, quote <> '' AND contains(body, quote) AS exact FROM q
    ), win AS (SELECT conv_id, turn, quote, width, i, array_to_string(list_slice(words, i, i + width - 1), ' ') AS text FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i FROM (SELECT *, unnest(list_distinct([size, size + 1, greatest(1, size - 1)])) AS width FROM k WHERE NOT exact AND quote <> ''))
    ), wb AS (SELECT conv_id, turn, width, i, g, count(*) AS n FROM (SELECT conv_id, turn, width, i, unnest(list_transform(range(1, length(text)), lambda x: substr(text, x, 2))) AS g FROM win) GROUP BY ALL
    ), qb AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(quote)), lambda x: substr(quote, x, 2))) AS g FROM k WHERE NOT exact) GROUP BY ALL
    ), shared AS (SELECT wb.conv_id, wb.turn, wb.width, wb.i, sum(least(wb.n, qb.n)) AS s FROM wb JOIN qb USING (conv_id, turn, g) GROUP BY ALL
    ), best AS (SELECT conv_id, turn, max(2.0 * s / (length(quote) - 1 + length(text) - 1)) AS similarity FROM shared JOIN win USING (conv_id, turn, width, i) GROUP BY ALL
    ), r AS (SELECT k.conv_id, k.turn, CASE WHEN exact THEN 1.0 ELSE coalesce(CAST(similarity AS DOUBLE), 0) END AS similarity, exact FROM k LEFT JOIN best USING (conv_id, turn)
    ) SELECT conv_id, turn, similarity, CASE WHEN exact THEN 'exact' WHEN similarity >= 0.9 THEN 'similar' ELSE 'none' END AS method, exact OR similarity >= 0.9 AS verified FROM r""",
    "similarity",
)
def quote_verify_fuzzy(spark, d):
    from tideline.functions.cleaning import normalize

    body = table(spark, d, "conversations").select("conv_id", "turn", normalize(F.col("text")).alias("body"))
    clean = body.withColumn("quote", F.array_join(F.slice(F.split("body", " "), 3, 8), " "))
    wrong = F.concat(F.substring("quote", 1, 3), F.lit("q"), F.expr("substr(quote, 5)"))
    return c.quotes_fuzzy(clean.withColumn("quote", F.when(F.col("turn") % 2 == 1, wrong).otherwise(F.col("quote"))))


#: A claim is confirmed where the label of its document says good, and rejected where it says bad.
JUDGED = f"WITH {CLAIMS}, judged AS (SELECT claims.*, quality FROM claims LEFT JOIN labels ON labels.doc_id = claims.doc_id), columns AS (SELECT * FROM (VALUES (1), (2), (3)) v(column_id))"


def judged(spark, d):
    return c.claims(docs(spark, d), phrases(spark)).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query(
    "data_spec",
    JUDGED + " SELECT CAST(c.column_id AS BIGINT) AS column_id, doc_id, CAST(pos AS INTEGER) AS pos, sentence, doc_id IS NULL AS missing FROM columns c LEFT JOIN (SELECT * FROM judged WHERE quality = 1) j ON j.column_id = c.column_id",
)
def data_spec(spark, d):
    """One row for each confirmed sentence of a column, and one for each column without any."""
    columns = spark.createDataFrame([(1,), (2,), (3,)], "column_id long")
    confirmed = judged(spark, d).where("quality = 1").select("column_id", "doc_id", "pos", "sentence")
    return confirmed.join(F.broadcast(columns), "column_id", "right").withColumn("missing", F.col("doc_id").isNull())  # three rows


@query("claims_of_column", JUDGED + " SELECT column_id, doc_id, CAST(pos AS INTEGER) AS pos, sentence, coalesce(quality = 1, false) AS confirmed FROM judged WHERE quality IS DISTINCT FROM 0")
def claims_of_column(spark, d):
    shown = judged(spark, d).where(~F.col("quality").eqNullSafe(0)).select("column_id", "doc_id", "pos", "sentence", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("confirmed"))
    return shown.orderBy("column_id", F.desc("confirmed"), "doc_id", "pos")


@query("reembed_needed", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing' ELSE 'other size' END AS reason FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL OR len(e.embedding) <> 64")
def reembed_needed(spark, d):
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dims"))
    met = docs(spark, d).select("doc_id").join(stored, "doc_id", "left")
    return met.where("dims is null or dims <> 64").select("doc_id", F.when(F.col("dims").isNull(), "missing").otherwise("other size").alias("reason"))
