"""Guards on outgoing text: raw values, forbidden names, size and share of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.kernels import KEYS, round_sig

NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def three_digits(value: Column) -> Column:
    """A number rounded to three digits, halves away from zero, as a double scaled by a power of ten; what isn't finite, or is below 1e-300, stays.

    What is indexed, scanned and sent is rounded by the same arithmetic, else a raw value at a half would be missed.
    """
    size = F.abs(value.cast("double"))
    digits = 2 - F.floor(F.log10(size))
    scale = F.pow(F.lit(10.0), F.abs(digits))
    rounded = F.when(digits < 0, F.round(size / scale) * scale).otherwise(F.round(size * scale) / scale)
    return F.when((size >= 1e-300) & (size < float("inf")), F.signum(value) * rounded).otherwise(value.cast("double"))


def leak_index(g: DataFrame) -> DataFrame:
    """All triples of successive different values of each sensor, rounded to three digits."""
    w = Window.partitionBy(*KEYS).orderBy("t")
    values = g.where("v is not null").select(*KEYS, "t", three_digits(F.col("v")).alias("r"))
    changed = values.withColumn("before", F.lag("r").over(w)).where("before is null or before <> r")
    triples = changed.select(F.col("r").alias("a"), F.lead("r", 1).over(w).alias("b"), F.lead("r", 2).over(w).alias("c"))
    return triples.where("c is not null").distinct()


def leak_scan(payloads: DataFrame, index: DataFrame) -> DataFrame:
    """``payload_id, text``: how many triples of successive numbers of a payload are raw values."""
    numbers = payloads.select("payload_id", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)), lambda x: three_digits(x.cast("double")))).alias("pos", "r"))
    w = Window.partitionBy("payload_id").orderBy("pos")
    changed = numbers.withColumn("before", F.lag("r").over(w)).where("before is null or before <> r")
    triples = changed.select("payload_id", F.col("r").alias("a"), F.lead("r", 1).over(w).alias("b"), F.lead("r", 2).over(w).alias("c")).where("c is not null")
    hits = triples.join(index, ["a", "b", "c"], "left_semi").groupBy("payload_id").agg(F.count("*").alias("hits"))
    return payloads.select("payload_id").join(hits, "payload_id", "left").select("payload_id", F.coalesce("hits", F.lit(0)).alias("hits"))


#: What may stand in a text and looks like a name: evidence ids and aliases of sensors.
TOKENS = r"\bev-[0-9a-f]{8}-\d{5}\b|\bS\d{2,4}\b"
#: Names that stand in a plan as one array.
NAMES = 2000


def name_scan(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, text`` and forbidden names, of one word or several: how often each occurs between word borders, ids and aliases aside.

    Names are looked up in the row of the text, in blocks of NAMES; only the few that a text holds are counted by a pattern.
    """
    rows = sorted({r["name"] for r in names.select("name").collect()})  # the names of a workspace's columns
    bare, out = texts.select("doc_id", F.regexp_replace("text", TOKENS, " ").alias("bare")).withColumn("low", F.lower("bare")), None
    for at in range(0, max(1, len(rows)), NAMES):
        known = F.array(*[F.lit(n) for n in rows[at : at + NAMES]]).cast("array<string>")
        held = F.filter(known, lambda n: F.contains(F.col("low"), F.lower(n)))
        part = bare.select("doc_id", "bare", F.explode(held).alias("name"))
        part = part.select("doc_id", "name", F.regexp_count("bare", F.concat(F.lit(r"(?i)(?<!\w)\Q"), "name", F.lit(r"\E(?!\w)"))).cast("long").alias("n")).where("n > 0")
        out = part if out is None else out.unionByName(part)
    return out


def text_guard(text: Column, most_chars: int = 8000, most_numbers: float = 0.3) -> Column:
    """too long, too many numbers, or ok."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    share = F.size(F.filter(words, lambda x: x.rlike(r"[0-9]"))) / F.greatest(F.size(words), F.lit(1))
    return F.when(F.length(text) > most_chars, "too long").when(share > most_numbers, "too many numbers").otherwise("ok")


def round_values(values: Column) -> Column:
    """Numbers that aren't whole, to three digits."""
    return F.transform(values, lambda x: F.when(x == F.floor(x), x.cast("double")).otherwise(three_digits(x)))


def payload_guards(payloads: DataFrame, least_n: int = 100, most_bytes: int = 8192, most_numbers: int = 20) -> DataFrame:
    """``payload_id, body (JSON text with n and values)``: the first guard that fails, in a fixed order."""
    read = payloads.withColumn("p", F.from_json("body", "n bigint, values array<double>"))
    shorter = F.forall("p.values", lambda x: (x == F.floor(x)) | (F.abs(round_sig(x) - x) <= 1e-9 * F.abs(x)))
    failed = (
        F.when(F.col("p").isNull() | F.col("p.n").isNull() | F.col("p.values").isNull(), "schema")
        .when(F.col("p.n") < least_n, "sample floor")
        .when(F.octet_length("body") > most_bytes, "size")
        .when(F.size("p.values") > most_numbers, "array")
        .when(~shorter, "rounding")
    )
    return read.select("payload_id", F.coalesce(failed, F.lit("pass")).alias("guard"))
