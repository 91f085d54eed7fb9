"""The catalog of columns, its claims and open questions, lists of sources, meetings without a transcript.

Every count is aggregated by its key before it is joined, so no join multiplies rows; a column or source without rows has zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Below it a column is in question; the leading segments of an excerpt and their characters.
LOW_CONFIDENCE, EXCERPT, EXCERPT_CHARS = 0.5, 6, 240


def counted(rows: DataFrame, key: str, into: str, *more: Column) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(into), *more)


def refreshed(sensors: DataFrame, checks: DataFrame, stored: DataFrame) -> DataFrame:
    """``name, alias, role, role_confidence, signal_type, hypothesis, hypothesis_confidence``, ``name, agrees`` and the stored ``name, description`` to the rows of the catalog.

    The confidence is the lesser of the role's and the hypothesis', which other models' checks of the name weigh: by half, and by the share of them that agree by the other half.
    Checks without an answer don't count; without a hypothesis the role's stands alone. ``changed`` tells whose description is new, so that only those are embedded again.
    """
    judged = checks.where("agrees is not null").groupBy("name").agg(F.count("*").alias("checks"), F.count_if("agrees").alias("agreeing"))
    rows = sensors.join(judged, "name", "left").join(stored.select("name", F.col("description").alias("before")), "name", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("checks", "agreeing")})
    weight = F.when(F.col("checks") == 0, 1.0).otherwise(0.5 + 0.5 * F.try_divide("agreeing", "checks"))
    known = F.coalesce(F.when(F.col("hypothesis") != "", F.concat(F.lit("is "), "hypothesis")), F.concat(F.lit("has the role "), "role"))
    description = F.concat(F.col("name"), F.lit(" ("), F.col("alias"), F.lit(") "), known, F.lit(" and a "), F.col("signal_type"), F.lit(" signal"))
    confidence = F.least(F.coalesce(F.col("hypothesis_confidence") * weight, F.lit(1.0)), "role_confidence")
    out = rows.select("name", "alias", "role", "signal_type", "hypothesis", confidence.alias("confidence"), "checks", "agreeing", description.alias("description"), "before")
    return out.withColumn("changed", ~F.col("description").eqNullSafe(F.col("before"))).drop("before")


def claim_counts(columns: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    """``columns`` with ``claims``, the distinct claims of links that nobody rejected, and ``confirmed_claims``, those whose link and status are confirmed."""
    status = claims.select("claim_id", F.col("status").eqNullSafe("confirmed").alias("sure"))
    # one row for each column and claim, however many links they have
    pairs = links.where("confirmed is not false").groupBy("column_id", "claim_id").agg(F.coalesce(F.max("confirmed"), F.lit(False)).alias("linked"))
    sure = F.count_if(F.col("linked") & F.coalesce("sure", F.lit(False))).alias("confirmed_claims")
    counts = counted(pairs.join(status, "claim_id", "left"), "column_id", "claims", sure)
    return columns.join(counts, "column_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("claims", "confirmed_claims")})


def open_questions(columns: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    """``column_id, confidence, question, contact, hypothesis_claims`` of columns with little confidence and no confirmed claim, the least sure first, ties by id.

    The contact is the speaker of the column's first claim that has one: links by score, then claims by id. ``columns`` has what ``refreshed`` gives, and ``column_id``.
    """
    asked = claim_counts(columns, links, claims).where((F.col("confidence") < LOW_CONFIDENCE) & (F.col("confirmed_claims") == 0))
    said = links.where("confirmed is not false").join(claims.where("speaker is not null").select("claim_id", "speaker"), "claim_id")
    first = said.groupBy("column_id").agg(F.min_by("speaker", F.struct(-F.col("score"), "claim_id", "speaker")).alias("contact"))
    apart = F.col("checks") - F.col("agreeing")
    doubt = F.when(apart > 0, F.concat(F.lit(" "), apart.cast("string"), F.lit(" of "), F.col("checks").cast("string"), F.lit(" other models gave a different name."))).otherwise("")
    hint = F.coalesce(F.when(F.col("hypothesis") != "", F.concat(F.lit(' Our current guess is "'), "hypothesis", F.lit('".'), doubt)), F.lit(""))
    question = F.concat(F.lit("What does the column "), "name", F.lit(" measure, in which unit, and how often is it logged?"), hint)
    rows = asked.join(first, "column_id", "left").select("column_id", "confidence", question.alias("question"), "contact", F.col("claims").alias("hypothesis_claims"))
    return rows.orderBy(F.round("confidence", 9), "column_id")


def source_list(sources: DataFrame, segments: DataFrame, chunks: DataFrame, claims: DataFrame, kind: str | None = None, status: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """``source_id, kind, status, occurred_at`` with the numbers of segments, chunks, embedded chunks and claims, and an ``excerpt``: speakers and texts of the first segments.

    Filters that are given hold for the sources before anything is counted; times include their ends.
    """
    conditions = [c for c in (kind and F.col("kind") == kind, status and F.col("status") == status) if c is not None]
    conditions += [F.col("occurred_at") >= since] if since is not None else []
    conditions += [F.col("occurred_at") <= until] if until is not None else []
    for condition in conditions:
        sources = sources.where(condition)
    wanted = sources.select("source_id")
    of = lambda rows: rows.join(wanted, "source_id", "left_semi")
    # the rank limit is applied before the shuffle too, so a long source sends few rows
    leading = of(segments).withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("seq"))).where(F.col("place") <= EXCERPT)
    part = F.struct("place", "speaker", F.substring("text", 1, EXCERPT_CHARS).alias("text"))
    excerpt = leading.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(part)), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("excerpt"))
    out = sources.join(counted(of(segments), "source_id", "segments"), "source_id", "left")
    out = out.join(counted(of(chunks), "source_id", "chunks", F.count_if("embedded").alias("embedded_chunks")), "source_id", "left").join(counted(of(claims), "source_id", "claims"), "source_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("segments", "chunks", "embedded_chunks", "claims")})
    return out.join(excerpt, "source_id", "left").withColumn("excerpt", F.coalesce("excerpt", F.expr("cast(array() as array<struct<speaker:string,text:string>>)")))


def meetings_without_transcript(meetings: DataFrame, transcripts: DataFrame, domains: list[str]) -> DataFrame:
    """``meeting_id, subject, start, organizer, attendees, join_url`` to online meetings with an attendee of a customer's domain and no transcript, with those domains in order of attendance."""
    wanted = F.array(*[F.lit(x.lower()) for x in dict.fromkeys(domains)]).cast("array<string>")
    domain = lambda x: F.lower(F.trim(F.substring_index(x, "@", -1)))
    met = F.array_distinct(F.filter(F.transform(F.filter("attendees", lambda x: F.contains(x, F.lit("@"))), domain), lambda x: F.array_contains(wanted, x)))
    online = meetings.where("join_url <> ''").withColumn("domains", met).where(F.size("domains") > 0)
    return online.join(transcripts.select("meeting_id"), "meeting_id", "left_anti").select("meeting_id", F.coalesce("subject", F.lit("(no subject)")).alias("subject"), "start", "organizer", "domains")
