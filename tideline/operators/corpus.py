"""Text segments, chunks, embeddings, search and claims as column jobs over text tables."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.cleaning import normalize
from tideline.session import durable, ship, text_batches


def sessions(messages: DataFrame, channel: str, gap_seconds: int) -> DataFrame:
    """``channel, id, ts, root, replies``: one row for each thread (by its root, there or not) and for each run of loose messages within a gap.

    A loose message opens a group after a thread. ``root`` is null outside of threads and for a root itself, which has ``replies``.
    """
    w = Window.partitionBy(channel).orderBy("ts", "id")
    reply, head = F.col("root").isNotNull(), F.coalesce(F.col("replies") > 0, F.lit(False))
    told = messages.select(channel, "id", "ts", F.when(reply, F.col("root")).when(head, F.col("id")).alias("thread"))
    # of a thread only its first message stands between loose ones
    first = F.row_number().over(Window.partitionBy(channel, "thread").orderBy("ts", "id")) == 1
    placed = told.withColumn("stands", F.col("thread").isNull() | first).where("stands")
    near = F.col("thread").isNull() & F.lag(F.col("thread").isNull()).over(w) & (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) <= gap_seconds * 1_000_000)
    loose = placed.withColumn("island", F.sum(F.when(near, 0).otherwise(1)).over(w)).where("thread is null")
    size = [F.count("*").alias("n"), F.min(F.struct("ts", "id"))["id"].alias("first_id"), F.max(F.struct("ts", "id"))["id"].alias("last_id")]
    runs = loose.groupBy(channel, "island").agg(*size).select(channel, F.col("first_id").alias("group_id"), "n", "first_id", "last_id")
    return runs.unionByName(told.where("thread is not null").groupBy(channel, F.col("thread").alias("group_id")).agg(*size))


def turns(segments: DataFrame, gap: float) -> DataFrame:
    """``source_id, seq, speaker, start, stop, text``: neighbouring segments of one speaker, at most ``gap`` seconds apart, are one turn."""
    w = Window.partitionBy("source_id").orderBy("seq")
    same = (F.col("speaker") == F.lag("speaker").over(w)) & (F.col("start") - F.lag("stop").over(w) <= gap)
    marked = segments.withColumn("turn", F.sum(F.when(same, 0).otherwise(1)).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return marked.groupBy("source_id", "turn", "speaker").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.min("start").alias("start"), F.max_by("stop", "seq").alias("stop"), text.alias("text"))


# What makes a line of a table, a line of a list and a heading.
TABLE_LINE, LIST_LINE, HEADING = r"^\s*\|.*\|\s*$", r"^\s*([-*+]|[0-9]+[.)])\s+\S", r"^#{1,6}\s"


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs of a text, which blank lines part, with their number and the number of headings up to them.

    Lines of a paragraph that is all table or all list stay lines; others are joined by spaces.
    """
    clean = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "^\n+|\n+$", "")
    single = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "")
    line = lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")
    split = docs.select("doc_id", F.posexplode(F.split(clean, r"\n\s*\n")).alias("at", "raw")).withColumn("lines", F.split("raw", "\n"))
    every = lambda pattern: F.forall("lines", lambda x: x.rlike(pattern))
    structured = (F.size("lines") > 1) & (every(TABLE_LINE) | every(LIST_LINE))
    told = split.withColumn("text", F.when(structured, F.array_join(F.transform("lines", line), "\n")).otherwise(single(F.col("raw")))).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("at")
    block = F.sum(F.col("raw").rlike(HEADING).cast("int")).over(w)
    return told.select("doc_id", (F.row_number().over(w) - 1).alias("pos"), block.alias("block"), F.regexp_replace("text", r"^#{1,6}\s+", "").alias("text"))


# Lines that begin a quoted message, and lines that begin a signature.
QUOTE_STARTS = (
    r"^>",
    r"(?i)^-{2,}\s*(Original Message|Alkuperäinen viesti|Forwarded message|Välitetty viesti)\s*-{2,}",
    r"(?i)^(On|Le|Am)\s.+\s(wrote|a écrit|schrieb):\s*$",
    r"(?i)^.+\s+kirjoitti( klo .+)?:\s*$",
    r"(?i)^(From|Lähettäjä|Von|De):\s.+$",
    r"^_{5,}\s*$",
)
SIGNATURE_STARTS = (
    r"^--\s*$",
    r"(?i)^(Best regards|Kind regards|Regards|Br|BR|Thanks|Cheers|Ystävällisin terveisin|Terveisin|Yst\. terv\.|Mit freundlichen Grüßen),?\s*$",
    r"(?i)^Sent from my (iPhone|iPad|Android|Galaxy)",
    r"(?i)^Lähetetty (iPhonesta|iPadista|Outlook)",
)


def strip_quotes(docs: DataFrame) -> DataFrame:
    """A text up to its first quoted line, and of that the part before the first signature."""

    def before(lines: Column, patterns: tuple[str, ...]) -> Column:
        trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
        at = F.array_position(F.transform(lines, lambda x: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.rlike(trimmed(x), p))), True)
        return F.when(at > 0, F.slice(lines, 1, at.cast("int") - 1)).otherwise(lines)

    kept = docs.withColumn("kept", before(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), QUOTE_STARTS)).withColumn("kept", before(F.col("kept"), SIGNATURE_STARTS))
    text = F.regexp_replace(F.regexp_replace(F.array_join("kept", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return kept.select("doc_id", text.alias("text"), F.size("kept").alias("n_lines"))


def email_threads(mails: DataFrame, mailbox: str) -> DataFrame:
    """``thread, ts, id, sender, recipients, subject``: one row for each conversation, in order of time, with the domains of senders outside and the tag that the mailbox was written to with.

    Of several tags the first by time counts.
    """
    local, own = mailbox.lower().split("@")
    domain = F.lower(F.regexp_extract("sender", "@(.+)$", 1))
    tags = F.filter(F.transform("recipients", lambda r: F.when(F.regexp_extract(F.lower(r), r"^([^+@]+)\+([^@]+)@(.+)$", 1) == local, F.when(F.regexp_extract(F.lower(r), "@(.+)$", 1) == own, F.regexp_extract(F.lower(r), r"^[^+@]+\+([^@]+)@", 1)))), lambda x: x.isNotNull())
    told = mails.withColumns({"domain": F.when((domain != own) & (domain != ""), domain), "tag": F.get(tags, 0)})
    return told.groupBy("thread").agg(
        F.count("*").alias("n"), F.min_by("subject", F.struct("ts", "id")).alias("title"), F.max("ts").alias("occurred_at"), F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains"),
        F.min(F.when(F.col("tag").isNotNull(), F.struct("ts", "id", "tag")))["tag"].alias("plus_tag"),
    )


#: A sheet with a larger share of numeric cells is sensor data.
NUMERIC_SHARE = 0.5
NUMERIC = r"^[-+]?([0-9]+([.,][0-9]+)?|[.,][0-9]+)([eE][-+]?[0-9]+)?$"


def tabular_to_text(rows: DataFrame, sheet: str, row: str, headers: dict[str, str]) -> DataFrame:
    """``sheet, row, text``: each row as ``header: cell; ...`` without empty cells; of a sheet of numbers only the headers, as row 0. ``headers`` maps columns to names."""
    cells = [F.trim(F.col(c).cast("string")) for c in headers]
    filled, numeric = [F.coalesce((c != "").cast("long"), F.lit(0)) for c in cells], [F.coalesce(c.rlike(NUMERIC).cast("long"), F.lit(0)) for c in cells]
    share = rows.agg((F.sum(sum(numeric[1:], numeric[0])) / F.greatest(F.sum(sum(filled[1:], filled[0])), F.lit(1))).alias("share"))  # one row
    text = F.concat_ws("; ", *[F.when(c != "", F.concat(F.lit(f"{name}: "), c)) for c, name in zip(cells, headers.values())])
    told = rows.select(F.col(row).cast("long").alias("row"), text.alias("text")).where("text <> ''").join(F.broadcast(share), F.col("share") <= NUMERIC_SHARE).select("row", "text")
    note = f"Sensor data file with {len(set(headers.values()))} columns: {', '.join(dict.fromkeys(headers.values()))}"
    only = share.where(F.col("share") > NUMERIC_SHARE).select(F.lit(0).cast("long").alias("row"), F.lit(note).alias("text"))
    return told.unionByName(only).select(F.lit(sheet).alias("sheet"), "row", "text")


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments go, other tags become spaces, common entities are read, blanks are single."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(docs: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def tokens_of(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


SENTENCE = r"[^.!?\n]+[.!?]*"


def split_long(text: Column, most: int) -> Column:
    """The sentences of one text packed in order, up to ``most`` tokens a piece; a longer sentence is a piece of its own."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("open"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state: Column, sentence: Column) -> Column:
        longer = F.when(state["open"] == "", sentence).otherwise(F.concat_ws(" ", state["open"], sentence))
        full = (state["open"] != "") & (tokens_of(longer) > most)
        return F.when(full, F.struct(sentence.alias("open"), F.array_append(state["out"], state["open"]).alias("out"))).otherwise(F.struct(longer.alias("open"), state["out"].alias("out")))

    return F.aggregate(parts, start, step, lambda s: F.array_append(s["out"], s["open"]))


def chunks(segments: DataFrame, most: int) -> DataFrame:
    """Segments packed in order, up to ``most`` tokens a chunk and within one block; a longer segment is split by sentences, into pieces of a chunk of its own.

    Segments are sorted by Spark and pass through a task in batches, which hand on the open chunk, so a source of any length takes bounded memory. A null text is an empty one.
    """
    ship(segments.sparkSession)
    size_of = F.coalesce(tokens_of(F.col("text")), F.lit(0)).cast("long")
    sized = segments.select("source_id", F.col("seq").cast("long").alias("seq"), F.col("block").cast("long").alias("block"), size_of.alias("n"), "text")
    ordered = sized.repartition("source_id").sortWithinPartitions("source_id", "seq", "n", "block")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, size, block, chunk = object(), 0, 0, 0
        for batch in batches:
            own = []
            for key, n, b in zip(*(batch[c].to_pylist() for c in ("source_id", "n", "block"))):
                if key != source:
                    source, size, block, chunk = key, 0, 0, 0
                if size and (size + n > most or (b is not None and block is not None and b != block)):
                    size, block, chunk = n, b, chunk + 1
                else:
                    size += n
                own.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "chunk"])

    dealt = ordered.mapInArrow(deal, T.StructType([*sized.schema.fields, T.StructField("chunk", T.LongType())]))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    whole = dealt.where(F.col("n") <= most).groupBy("source_id", "chunk").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("n"), F.sum("n").alias("tokens"), text.alias("text"))
    long = dealt.where(F.col("n") > most).select("source_id", "chunk", F.col("seq").alias("from_seq"), F.col("seq").alias("to_seq"), F.lit(1).cast("long").alias("n"), F.posexplode(split_long(F.col("text"), most)).alias("piece", "text"))
    return whole.withColumn("piece", F.lit(0)).unionByName(long.withColumn("tokens", tokens_of(F.col("text"))))


DIMENSIONS = 1024
#: Texts that are counted at once.
EMBED_ROWS = 64


def fnv(data: bytes) -> int:
    # The offset and the prime of 32-bit FNV-1a.
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def fnv_of_characters(grams: list[np.ndarray], spelt: list[bytes]) -> np.ndarray:
    """``fnv`` of the UTF-8 bytes of each row of ``grams``, whose columns number the characters in ``spelt``."""
    longest = max(map(len, spelt), default=0)
    octets = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in spelt), np.uint8).reshape(len(spelt), longest).astype(np.uint32)
    lengths = np.array([len(x) for x in spelt])
    h = np.full(len(grams[0]), 0x811C9DC5, np.uint32)
    for column in grams:
        for k in range(longest):
            told = (h ^ octets[column, k]) * np.uint32(0x01000193)
            h = told if k == 0 else np.where(lengths[column] > k, told, h)
    return h


def embedded(texts: list[str | None], known: dict[int, bytes]) -> np.ndarray:
    """One row for each text. A trigram is a number of three characters, each numbered among those of the texts, and its text stands before it: one sort counts
    them all. ``known`` keeps the UTF-8 bytes of each character.
    """
    padded = [f" {(x or '').lower()} " for x in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, np.int64)
    seen[points] = 1
    letters = np.flatnonzero(seen)
    size = len(letters)
    if len(texts) > 1 and len(texts) * size**3 >= 1 << 63:
        return np.concatenate([embedded([x], known) for x in texts])
    for c in letters.tolist():
        if c not in known:
            known[c] = chr(c).encode("utf-8", "surrogatepass")
    seen[letters] = np.arange(size)
    at = seen[points]
    owner = np.repeat(np.arange(len(padded)), [len(x) for x in padded])
    inside = owner[2:] == owner[:-2]
    keys = np.sort((((owner[2:] * size + at[:-2]) * size + at[1:-1]) * size + at[2:])[inside])
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    pairs, counts = keys[first], np.diff(first, append=len(keys))
    last, middle, left = pairs % max(1, size), pairs // max(1, size) % max(1, size), pairs // max(1, size**2)
    row, start = left // max(1, size), left % max(1, size)
    h = fnv_of_characters([start, middle, last], [known[c] for c in letters.tolist()])
    weights = np.log1p(counts) * np.where(h >> 31, 1.0, -1.0)
    out = np.bincount(row * DIMENSIONS + h % DIMENSIONS, weights, len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def vectors_of(texts: pa.Array) -> pa.Array:
    known: dict[int, bytes] = {}
    parts = [embedded(texts[at : at + EMBED_ROWS].to_pylist(), known) for at in range(0, max(1, len(texts)), EMBED_ROWS)]
    return pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parts).ravel()), DIMENSIONS)


def hash_embedding(docs: DataFrame, text: str = "text") -> DataFrame:
    """Signed hashed character trigrams with logarithmic weights, of unit length, in Arrow batches."""
    text_batches(docs.sparkSession)
    return docs.withColumn("embedding", F.arrow_udf(lambda texts: vectors_of(texts).cast(pa.list_(pa.float32())), "array<float>")(F.col(text)))


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """How often each text has each term, as a part of words too."""
    found = [F.struct(F.lit(t).alias("term"), F.regexp_count(F.lower("text"), F.lit(t)).cast("long").alias("tf")) for t in terms]
    return docs.select("doc_id", F.length("text").alias("size"), F.inline(F.array(*found)))


def bm25(docs: DataFrame, terms: list[str], most: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Texts with any of the terms, by BM25."""
    post = postings(docs, terms)
    stats = post.agg(F.count_distinct("doc_id").alias("n"), F.avg("size").alias("mean"))  # one row
    frequency = post.where("tf > 0").groupBy("term").agg(F.count("*").alias("df"))  # one row for each term
    joined = post.where("tf > 0").join(F.broadcast(frequency), "term").join(F.broadcast(stats), F.lit(True))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return joined.groupBy("doc_id").agg(F.sum(score).alias("score")).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(most)


#: Query vectors that are compared with all vectors in one pass.
QUERY_BLOCK = 4096


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    sizes = pc.min_max(pc.list_value_length(vectors)).as_py()
    if vectors.null_count or sizes["min"] != sizes["max"]:
        return np.array(vectors.to_pylist(), float).reshape(len(vectors), -1)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def keep_nearest(batches, ids: np.ndarray, queries: np.ndarray, most: int):
    """Of the vectors in ``batches`` the ``most`` nearest of each query by distance to 9 digits, then id; ties at the border are settled by id.

    A product gives all distances about; only vectors that may be within the border, by a margin above its rounding, are measured exactly.
    """
    held_ids = [np.zeros(0, np.int64)] * len(ids)
    held = [np.zeros(0)] * len(ids)
    lengths = (queries**2).sum(1)
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch["embedding"] if "embedding" in batch.schema.names else vectors_of(batch["text"])
        own, names = matrix(vectors), batch["vec_id"].to_numpy()
        sizes = (own**2).sum(1)
        margin = 4e-9 * (1 + sizes.max())
        for at in range(0, len(ids), 256):
            about = sizes[None] - 2 * queries[at : at + 256] @ own.T + lengths[at : at + 256, None]
            for i, row in enumerate(about, at):
                if len(held[i]) == most:
                    border = held[i][-1] ** 2
                else:
                    last = min(most, len(row)) - 1
                    border = np.partition(row, last)[last]
                pick = np.flatnonzero(row <= border + margin * (1 + lengths[i]))
                if not len(pick):
                    continue
                exact = np.round(np.sqrt(((own[pick] - queries[i]) ** 2).sum(1)), 9)
                distance, name = np.concatenate((held[i], exact)), np.concatenate((held_ids[i], names[pick]))
                order = np.lexsort((name, distance))[:most]
                held[i], held_ids[i] = distance[order], name[order]
    if any(map(len, held)):
        yield pa.record_batch({"query_id": np.repeat(ids, [len(x) for x in held]), "vec_id": np.concatenate(held_ids), "distance": np.concatenate(held)})


def nearest(vectors: DataFrame, wanted: DataFrame, most: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, query`` to ``query_id, vec_id, distance, place``: the nearest vectors of each query by Euclidean distance, ties to the smaller id.

    ``vectors`` has ``vec_id, embedding``, or ``vec_id, text``: then a text becomes its vector of hashed trigrams in the task that compares it.

    Queries are taken in blocks of about ``block``; a block goes to every task, whose vectors meet it as matrix products, and only the best of each task are
    shuffled. The hits of each block are written before the next one is sent, so tasks hold one block at a time.
    """
    spark = vectors.sparkSession
    texts = "embedding" not in vectors.columns
    (text_batches if texts else ship)(spark)
    given = vectors.select("vec_id", "text" if texts else "embedding")
    blocks, parts = max(1, -(-wanted.count() // block)), []
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).select("query_id", "query").toArrow()  # ``block`` rows, about
        held = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), np.array(rows["query"].to_pylist(), float).reshape(rows.num_rows, -1 if rows.num_rows else 0)))
        found = given.mapInArrow(lambda batches, held=held: keep_nearest(batches, *held.value, most), "query_id long, vec_id long, distance double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        found = found.withColumn("place", place).where(F.col("place") <= most)
        if blocks > 1:
            found = durable(found)
            held.destroy()
        parts.append(found)
    return functools.reduce(DataFrame.unionByName, parts)


def hybrid(docs: DataFrame, questions: DataFrame, most: int, deep: int = 50) -> DataFrame:
    """``query_id, text`` to the best texts of each question by both lists, BM25 and hashed trigrams, fused: ``query_id, doc_id, score, place``."""
    lexical = lexical_top(docs, questions, deep).select("query_id", "doc_id", F.col("place").alias("rank_a"))
    asked = hash_embedding(questions.select("query_id", "text")).select("query_id", F.col("embedding").alias("query"))
    near = nearest(docs.select(F.col("doc_id").alias("vec_id"), "text"), asked, deep).select("query_id", F.col("vec_id").alias("doc_id"), F.col("place").alias("rank_b"))
    met = fuse(lexical, near, ["query_id", "doc_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("query_id", "doc_id", "score", "place")


def golden_hits(top: DataFrame, questions: DataFrame, docs: DataFrame, most: int = 400) -> DataFrame:
    """``query_id, place``: the first of a question's results that comes from its ``title``, or whose excerpt holds what it ``contains``; null without one.

    ``questions`` has ``query_id, title, contains``, one of which may be null; ``docs`` has ``doc_id, title, text``. The excerpt is where the text was found, else its start.
    """
    asked = questions.select("query_id", F.col("title").alias("want_title"), F.lower("contains").alias("want"))
    # texts are read past the few results, not shuffled to them
    read = docs.select("doc_id", "title", "text").join(small(durable(top.join(asked, "query_id"))), "doc_id").withColumn("body", F.lower("text"))
    excerpt = F.substring("body", F.greatest(F.instr(F.col("body"), F.col("want")) - 30, F.lit(1)), F.lit(most))
    hit = (F.col("title") == F.col("want_title")) | F.contains(excerpt, F.col("want"))
    found = read.groupBy("query_id").agg(F.min(F.when(hit, F.col("place"))).alias("place"))
    return questions.select("query_id").join(found, "query_id", "left")


def ranked(hits: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Ranks of a top list, which is short."""
    return hits.select(key, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias(name))


def fuse(left: DataFrame, right: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists with ``rank_a`` and ``rank_b``."""
    met = left.join(right, key, "full")
    return met.withColumn("score", F.coalesce(1 / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("rank_b")), F.lit(0.0)))


def snippet(text: Column, term: Column, before: int = 30, length: int = 120) -> Column:
    at = F.instr(F.lower(text), term)
    return F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(length))


#: Phrases or short quotes that stand in one plan; more of them are taken in blocks of so many.
LITERALS = 500
EDGE = r"[^\p{L}\p{N}_]"


def between_borders(text: Column, phrases: list[str]) -> Column:
    """Whether a lower-case text holds one of the phrases between word borders."""
    return text.rlike(f"(?:^|{EDGE})(?:" + "|".join(f"\\Q{p}\\E" for p in phrases) + f")(?:$|{EDGE})")


def claims(docs: DataFrame, phrases: DataFrame, least: int = 12, most: int = 500, limit: int = 20) -> DataFrame:
    """Sentences that hold a phrase (of one word or several) between word borders, with the first column that has one; the first ``limit`` of a text.

    One pattern for a block of phrases finds the sentences; which column a sentence names is asked of the few that were found.
    """
    rows = sorted((r["phrase"].lower(), r["column_id"]) for r in phrases.collect())  # the catalog's phrases
    low, found = F.lower("sentence"), None
    said = sentences(docs).where(F.length("sentence").between(least, most))
    for at in range(0, max(1, len(rows)), LITERALS):
        block = rows[at : at + LITERALS]
        column = F.least(*[F.when(between_borders(low, [p]), F.lit(c)).cast("long") for p, c in block], F.lit(None).cast("long"), F.lit(None).cast("long"))
        part = said.where(between_borders(low, [p for p, _ in block]) if block else F.lit(False)).withColumn("column_id", column)
        found = part if found is None else found.unionByName(part)
    if len(rows) > LITERALS:
        found = found.groupBy("doc_id", "pos", "sentence").agg(F.min("column_id").alias("column_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("doc_id", "pos", "sentence", "column_id")


def quotes_exact(quotes: DataFrame, docs: DataFrame, words_in: int = 8) -> DataFrame:
    """Which texts hold a quote, anywhere, after normalisation; the smallest id of them.

    The words inside a quote, without its first and last, stand between spaces in every text that holds it: up to ``words_in`` of them are
    its key. Keys of texts meet keys of quotes, then the whole quote is looked up in the few texts of each. A quote of one or two words has
    no word inside: it is looked up in every text, in blocks of such quotes.
    """
    text_batches(docs.sparkSession)
    asked = quotes.select("item_id", normalize(F.col("text")).alias("quote")).where("quote <> ''").withColumn("w", F.split("quote", " "))
    asked = durable(asked.withColumn("size", F.least(F.size("w") - 2, F.lit(words_in))).select("item_id", "quote", "size", F.when(F.col("size") > 0, F.xxhash64(F.slice("w", 2, F.greatest("size", F.lit(1))))).alias("key")))
    bodies = docs.select("doc_id", normalize(F.col("text")).alias("body"))
    sizes = [r["size"] for r in asked.where("size > 0").select("size").distinct().collect()]  # up to ``words_in``
    hits = None
    if sizes:
        # the words are split once: each element of the outer array is bound to a variable
        runs = lambda words, k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k)))
        keys = F.flatten(F.transform(F.array(F.split("body", " ")), lambda words: F.array_distinct(F.concat(*[runs(words, k) for k in sorted(sizes)]))))
        met = bodies.select("doc_id", F.explode(keys).alias("key")).join(small(asked.where("size > 0").select("key", "item_id")), "key").select("doc_id", "item_id")
        met = durable(met)
        hits = bodies.join(small(met), "doc_id").join(small(asked.select("item_id", "quote")), "item_id").where(F.contains("body", "quote")).select("item_id", "doc_id")
    short = asked.where("size <= 0")
    blocks = -(-short.count() // LITERALS)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "quote").collect()  # LITERALS rows, about
        known = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["quote"]).alias("quote")) for r in block])
        more = bodies.select("doc_id", F.explode(F.filter(known, lambda q: F.contains(F.col("body"), q["quote"]))).alias("q")).select("q.item_id", "doc_id") if block else None
        hits = more if hits is None else hits if more is None else hits.unionByName(more)
    if hits is None:
        return quotes.select("item_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(False).alias("verified"))
    found = hits.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return quotes.select("item_id").join(found, "item_id", "left").select("item_id", "doc_id", F.col("doc_id").isNotNull().alias("verified"))


#: Rows of a side that is broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows; it is counted first."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def link_scores(said: DataFrame, columns: DataFrame) -> DataFrame:
    """``claim_id, statement`` and ``column_id, name, phrases`` to the score of each pair that has one: 1 for a phrase in the statement, else 0.6 for the
    name between word borders, and the cosine of their hashed trigrams where it is positive. Columns are a short catalog and go to every task.
    """
    text = F.col("column_text")
    described = hash_embedding(columns.withColumn("column_text", F.concat_ws(" ", "name", F.array_join("phrases", " "))).withColumn("text", text)).withColumnRenamed("embedding", "column_vector").drop("text")
    met = hash_embedding(said, "statement").join(F.broadcast(described), F.lit(True)).withColumn("low", normalize(F.col("statement")))
    phrase = F.exists("phrases", lambda p: F.contains(F.col("low"), F.lower(p)))
    named = F.rlike(F.col("low"), F.concat(F.lit(f"(?:^|{EDGE})\\Q"), F.lower("name"), F.lit(f"\\E(?:$|{EDGE})")))
    cosine = F.greatest(F.lit(0.0), F.aggregate(F.zip_with("embedding", "column_vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return met.select("claim_id", "column_id", F.round(F.when(phrase, 1.0).when(named, 0.6).otherwise(0.0) + cosine, 3).alias("score"))


def lexical_top(docs: DataFrame, questions: DataFrame, most: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, text`` to the best texts of each question by BM25 over its distinct words: ``query_id, doc_id, score, place``.

    Texts are read once for up to ``LITERALS`` words, else twice. Only postings of the questions' words leave a text's row, and one row more, of the term "", for its size.
    """
    words = lambda text: F.array_remove(F.split(F.lower(text), EDGE + "+"), "")
    asked = durable(questions.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")))
    sized = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    terms = asked.select("term").distinct()
    few = [r["term"] for r in terms.limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        found = F.coalesce(F.filter("w", lambda w: w.isin(few)), F.array().cast("array<string>"))
        rows = sized.select("doc_id", "size", F.explode(F.concat(F.array(F.lit("")), found)).alias("term"))
    else:
        met = sized.select("doc_id", "size", F.explode("w").alias("term")).join(small(terms), "term", "left_semi")
        rows = met.select("doc_id", "size", "term").unionByName(sized.select("doc_id", "size", F.lit("").alias("term")))
    post = durable(rows.groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf")))
    mean = F.sum(F.col("size") * F.col("tf")) / F.sum(F.when(F.col("size").isNotNull(), F.col("tf")))  # texts that are null have no size
    stats = post.where("term = ''").agg(F.sum("tf").alias("n"), mean.alias("mean"))  # one row
    frequency = post.groupBy("term").agg(F.count("*").alias("df"))
    met = post.join(small(asked.join(frequency, "term")), "term").join(F.broadcast(stats), F.lit(True))
    score = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    total = met.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return total.withColumn("place", place).where(F.col("place") <= most)


def link_claims(scored: DataFrame, least: float = 0.75, most: int = 3) -> DataFrame:
    """``claim_id, column_id, score``: the best columns of each claim."""
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc(F.round("score", 9)), "column_id"))
    return scored.where(F.col("score") >= least).withColumn("place", place).where(F.col("place") <= most)


def cues(transcripts: DataFrame) -> DataFrame:
    """``source_id, text`` (VTT): blocks with times, speaker tag and text without markup."""
    blocks = transcripts.select("source_id", F.posexplode(F.filter(F.split("text", r"\n\s*\n"), lambda b: F.contains(b, F.lit("-->")))).alias("pos", "block"))

    def seconds(part: int) -> Column:
        stamp = F.regexp_extract("block", r"([0-9:.]+)\s+-->\s+([0-9:.]+)", part)
        h, m, s = (F.split(stamp, ":")[i].cast("double") for i in range(3))
        return h * 3600 + m * 60 + s

    body = F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1), r"<[^>]*>", "")
    return blocks.select("source_id", "pos", seconds(1).alias("start"), seconds(2).alias("stop"), F.regexp_extract("block", r"<v ([^>]*)>", 1).alias("speaker"), F.trim(body).alias("text"))


def thread_chunks(segments: DataFrame) -> DataFrame:
    """One chunk for each message of a thread: the first message, then its own. The first is found by a partial aggregate, so long threads don't meet in one task."""
    said = segments.withColumn("said", F.concat_ws(": ", "speaker", "text"))
    parent = said.groupBy("source_id").agg(F.min("seq").alias("first_seq"), F.min_by("said", "seq").alias("parent"))
    text = F.when(F.col("seq") == F.col("first_seq"), F.col("said")).otherwise(F.concat("parent", F.lit("\n\n"), "said"))
    return said.join(parent, "source_id").select("source_id", "seq", text.alias("text")).withColumn("tokens", tokens_of(F.col("text")))


def word_turns(stretches: DataFrame, gap_ms: int = 2000, most_chars: int = 1200) -> DataFrame:
    """``source_id, pos, words``: stretches of one or more consecutive words, in the order of ``pos``, each word with ``speaker, word, start_ms, end_ms``.

    Turns end where the speaker changes, after a pause, and at the first sentence end beyond a number of characters. Inside its row a stretch is
    parted where a turn may end: after a sentence end, at another speaker, and at a pause after the word before. Only these pieces are shuffled, once,
    by source; pauses after all that was said before and speakers are windows over them, and the last rule is a fold over the pieces of one island.
    """
    ended = lambda w: F.coalesce(F.right(w["word"], F.lit(1)).isin(".", "!", "?"), F.lit(False))
    parted = lambda w, v: v.isNull() | ended(v) | ~w["speaker"].eqNullSafe(v["speaker"]) | F.coalesce(w["start_ms"] - v["end_ms"] > gap_ms, F.lit(False))
    # the rows of an array between the given starts
    between = lambda rows, starts: F.transform(starts, lambda s, j: F.slice(rows, s + 1, F.coalesce(F.get(starts, j + 1), F.size(rows)) - s))
    # each element of the outer array is bound to a variable, so words and starts are made once
    first = lambda words: F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: parted(F.get(words, i), F.get(words, i - 1)))
    pieces = F.flatten(F.transform(F.array("words"), lambda words: F.flatten(F.transform(F.array(first(words)), lambda starts: between(words, starts)))))
    piece = stretches.select("source_id", "pos", F.posexplode(F.when(F.size("words") > 0, pieces)).alias("k", "w"))
    field = lambda name: F.transform("w", lambda w: w[name])
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda s, w: s + F.coalesce(F.length(w["word"]) + 1, F.lit(0)))
    said = piece.select(
        "source_id", "pos", "k", F.get("w", F.lit(0))["speaker"].alias("speaker"), F.get("w", F.lit(0))["start_ms"].alias("first_ms"), F.array_min(field("start_ms")).alias("start_ms"), F.array_max(field("end_ms")).alias("end_ms"),
        F.size("w").alias("n"), chars.alias("chars"), ended(F.element_at("w", -1)).alias("ended"), F.when(chars > 0, F.array_join(field("word"), " ")).alias("text"),
    )
    source = Window.partitionBy("source_id").orderBy("pos", "k")
    quiet = F.coalesce(F.col("first_ms") - F.max("end_ms").over(source.rowsBetween(Window.unboundedPreceding, -1)) > gap_ms, F.lit(False))
    change = F.when(F.lag("pos").over(source).isNull() | quiet | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(source)), 1).otherwise(0)
    island = said.withColumn("change", change).withColumn("island", F.sum("change").over(source))
    # a source's islands stay where its pieces are
    rows = F.sort_array(F.collect_list(F.struct("pos", "k", "start_ms", "end_ms", "n", "chars", "ended", "text")))
    whole = island.groupBy("source_id", "island", "speaker").agg(rows.alias("rows"))
    state = lambda i, since, cuts: F.struct(i.alias("i"), since.alias("since"), cuts.alias("cuts"))

    def step(s, r):
        since, i = s["since"] + r["chars"], s["i"] + 1
        return F.when(r["ended"] & (since > most_chars), state(i, F.lit(0).cast("long"), F.array_append(s["cuts"], i))).otherwise(state(i, since, s["cuts"]))

    cuts = F.aggregate("rows", state(F.lit(0), F.lit(0).cast("long"), F.array().cast("array<int>")), step, lambda s: s["cuts"])
    starts = F.concat(F.array(F.lit(0)), F.filter(cuts, lambda c: c < F.size("rows")))
    parts = F.flatten(F.transform(F.array(starts), lambda starts: between(F.col("rows"), starts)))
    cut = whole.select("source_id", "island", "speaker", F.posexplode(parts).alias("part", "r"))
    of = lambda name: F.transform("r", lambda r: r[name])
    n_words = F.aggregate("r", F.lit(0).cast("long"), lambda s, r: s + r["n"])
    return cut.select("source_id", "island", "part", "speaker", F.array_min(of("start_ms")).alias("start_ms"), F.array_max(of("end_ms")).alias("end_ms"), n_words.alias("n_words"), F.array_join(of("text"), " ").alias("text"))


def best_dice(quote: str, body: str) -> float:
    """The largest Dice coefficient of letter pairs between a quote and the windows of a body that have about as many words."""
    pairs = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    want, words, best = pairs(quote), body.split(" "), 0.0
    total, size = sum(want.values()), len(quote.split(" "))
    for width in {size, size + 1, max(1, size - 1)}:
        for i in range(len(words) - width + 1):
            text = " ".join(words[i : i + width])
            both = total + max(0, len(text) - 1)
            if both and 2 * min(total, max(0, len(text) - 1)) / both > best:
                best = max(best, 2 * (want & pairs(text)).total() / both)
    return best


def quotes_fuzzy(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """``quote, body`` of each claim: exact after normalisation, else the most similar window of words. Only pairs that aren't exact reach Python."""
    text_batches(pairs.sparkSession)

    @F.pandas_udf("double")
    def dice(quote: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([best_dice(q, b) if q and b else 0.0 for q, b in zip(quote, body)], dtype="float64")

    ready = pairs.withColumns({"quote": F.coalesce(normalize(F.col("quote")), F.lit("")), "body": F.coalesce(normalize(F.col("body")), F.lit(""))})
    exact = (F.col("quote") != "") & F.contains("body", F.col("quote"))
    plain = ready.where(exact).withColumn("similarity", F.lit(1.0))
    near = ready.where(~exact).withColumn("similarity", dice("quote", "body"))
    method = F.when(exact, "exact").when(F.col("similarity") >= least, "similar").otherwise("none")
    return plain.unionByName(near).withColumn("method", method).withColumn("verified", F.col("method") != "none").drop("quote", "body")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, claims_gone: DataFrame | None = None) -> dict[str, DataFrame]:
    """``sources, segments, chunks, claims, links`` without the sources in ``gone`` (``source_id``) and all that hangs on them; also without the claims in ``claims_gone``.

    A claim goes with its source, a link with its claim.
    """
    left = {n: df.join(gone, "source_id", "left_anti") for n, df in tables.items() if n != "links"}
    if claims_gone is not None:
        left["claims"] = left["claims"].join(claims_gone, "claim_id", "left_anti")
    return left | {"links": tables["links"].join(left["claims"].select("claim_id"), "claim_id", "left_semi")}


def erase_person(tables: dict[str, DataFrame], person: str, rebuild: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The tables without what ``person`` said (names compare without case): their segments and claims, sources that nothing is left of, with all that hangs on
    them, and the chunks of every other source where they spoke, which ``rebuild`` makes again from the segments that are left.
    """
    theirs = lambda df: df.where(F.lower("speaker") == person.strip().lower())
    affected = durable(theirs(tables["segments"]).select("source_id").distinct())
    segments = tables["segments"].where(F.coalesce(F.lower("speaker") != person.strip().lower(), F.lit(True)))
    emptied = durable(affected.join(segments, "source_id", "left_anti"))
    left = cascade(tables | {"segments": segments}, emptied, theirs(tables["claims"]).select("claim_id"))
    again = rebuild(left["segments"].join(affected, "source_id", "left_semi"))
    chunks = left["chunks"].join(affected, "source_id", "left_anti")
    return left | {"chunks": chunks.unionByName(again.select(chunks.columns))}


def retain(tables: dict[str, DataFrame], oldest: Column) -> dict[str, DataFrame]:
    """The tables without sources whose ``occurred_at`` is before ``oldest``, and all that hangs on them."""
    return cascade(tables, durable(tables["sources"].where(F.col("occurred_at") < oldest).select("source_id")))


def changes_of(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """``name, kept, gone`` of each table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.lit(k).alias("side"), "n") for k, side in enumerate((before, after)) for n, df in side.items()]
    both = functools.reduce(DataFrame.unionByName, rows).groupBy("name").pivot("side", [0, 1]).agg(F.first("n"))
    return both.select("name", F.col("1").alias("kept"), (F.col("0") - F.col("1")).alias("gone"))
