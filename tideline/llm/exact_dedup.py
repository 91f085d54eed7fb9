"""Exact deduplication by a 128-bit content hash, with the bytes compared inside every group.

1. A text's blanks are deleted; its hash is the 128-bit digest of what is left. One aggregation groups by the hash and the bytes themselves,
   so texts that only share a hash are two groups. It sums up before its shuffle: a task sends a distinct text once, however many
   copies it has, and a group of any size is a count and one rank.
2. The row that stays is the one with the most code points in its original text, then the smallest id; length and id are one exact number, so the
   choice is a maximum. Groups are written without their texts.
3. Rows find their group by the hash alone. Only for hashes that hold different texts, which a count over the written groups tells, the texts
   are compared again. Rows carry no text there, and adaptive execution splits the join of a group with very many copies.
4. Rows of equal id, length and text tie for their group; one of them stays, told by a row number that is written with them.

Defined cases: a null text is empty, and all texts of blanks are one group; a null id ranks behind all others; repeated rows are copies of each
other; of the columns all but the text stay (``whole`` keeps it too); an empty table gives an empty table; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, free_name, stored

BLANKS = " \t\n\x0b\x0c\r"
#: More than any difference of ids, so that a longer text wins whatever the ids are.
STEP, LAST_ID = Decimal(10**20), Decimal(2**63)


def content_hash(body: Column) -> Column:
    """128 bits of a text's bytes."""
    return F.unhex(F.md5(body.cast("binary")))


def normalised(text: Column) -> Column:
    """A text without its blanks; a null text is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def rank(text: Column, key: Column) -> Column:
    """One exact number that is greatest for the row that stays: code points first, then the smallest id; a null id counts as 0 there."""
    points = F.coalesce(F.length(text.cast("string")), F.lit(0)).cast("decimal(10,0)")
    early = F.coalesce(F.lit(LAST_ID) - key.cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    return (points * F.lit(STEP) + early).cast("decimal(38,0)")


def id_of(ranked: Column) -> Column:
    """The id in a rank."""
    early = F.pmod(ranked, F.lit(STEP))
    return F.when(early > 0, (F.lit(LAST_ID) - early).cast("long"))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", into: str = "exact", whole: bool = False, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``docs`` without the text (with it if ``whole``) and with a struct of ``keep_id, group_size, kept, text_sha256``."""
    digest, best, body, order, row = (free_name(docs, n) for n in ("hash_", "best_", "body_", "rank_", "row_"))
    columns = [c for c in docs.columns if whole or c != text]
    ranked = rank(F.col(f"`{text}`"), F.col(f"`{key}`"))

    def groups_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(digest, body).agg(F.count("*").alias("size_"), F.max(order).alias(best))

    source = docs.select(*[F.col(f"`{c}`") for c in columns], normalised(F.col(f"`{text}`")).alias(body), ranked.alias(order)).withColumn(digest, hashed(F.col(body)))
    print_ = F.sha2(F.col(body).cast("binary"), 256).alias("print_")
    groups = stored(groups_of(source.select(digest, body, order)).select(digest, print_, "size_", best))
    clashes = groups.groupBy(digest).count().where("count > 1").select(digest)
    carried = [*[F.col(f"`{c}`") for c in columns], F.col(order), F.col("print_"), F.col("size_"), F.col(best)]
    if clashes.isEmpty():
        found = source.drop(body).join(groups, digest).select(*carried)
    else:  # different texts under one hash: their rows are told apart by the texts
        shared = stored(clashes)
        alone = source.drop(body).join(groups.join(shared, digest, "left_anti"), digest).select(*carried)
        mixed = source.join(shared, digest, "left_semi")
        apart = groups_of(mixed.select(digest, body, order)).withColumn("print_", print_)
        found = alone.unionByName(mixed.join(apart, [digest, body]).select(*carried))
    first = F.col(order) == F.col(best)
    marked = stored(found.withColumn("first_", first).withColumn(row, F.monotonically_increasing_id()))
    tied = marked.where("first_").groupBy("print_").agg(F.count("*").alias("n_"), F.min(row).alias("least_")).where("n_ > 1")
    kept = F.col("first_")
    if not tied.isEmpty():
        late = marked.where("first_").join(tied, "print_").where(F.col(row) > F.col("least_")).select(F.col(row), F.lit(True).alias("late_"))
        marked = marked.join(late, row, "left")
        kept = kept & F.col("late_").isNull()
    result = F.struct(id_of(F.col(best)).alias("keep_id"), F.col("size_").alias("group_size"), kept.alias("kept"), F.col("print_").alias("text_sha256"))
    return marked.select(*[F.col(f"`{c}`") for c in columns], result.alias(free_name(docs, into)))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    into = free_name(docs, "exact")
    return exact_groups(docs, text, key, into, whole=True).where(F.col(f"{into}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


OP12_SQL = r"""
WITH bodies AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM bodies
WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "exact.*")
