"""Evidence rows and what is checked against them: cited ids, numbers and labels in prose, reviews, names and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators.faults import LABELS

# Words that say nothing about a name, and words for one quantity.
STOP = ["the", "of", "a", "an", "in", "for", "and", "or", "to", "with", "sensor", "signal", "reading", "measurement", "variable", "value", "indicator", "process", "level", "rate", "channel", "check"]
QUANTITIES = {
    "temperature": ["temp"],
    "pressure": ["press"],
    "flow": ["flowrate", "feed", "throughput"],
    "speed": ["velocity", "rpm"],
    "position": ["opening", "travel", "stroke"],
    "valve": ["actuator", "damper"],
    "setpoint": ["reference", "target", "setting", "sp"],
    "counter": ["count", "cycle", "step", "batch", "index", "sequence", "timer", "clock"],
    "state": ["status", "mode", "flag", "discrete", "identifier", "id", "boolean"],
    "voltage": ["volt"],
    "current": ["amperage", "amp"],
    "power": ["watt"],
    "frequency": ["hz"],
    "concentration": ["composition", "purity"],
    "humidity": ["moisture"],
    "vibration": ["acceleration"],
    "torque": [],
    "density": [],
    "ph": [],
}
NUMBER = r"(?<![\w-])-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?!\w)"
ALIAS = r"\bS\d{2,4}\b"


def evidence(stats: DataFrame, stage: str, names: list[str]) -> DataFrame:
    """``run_id, sensor`` and numbers as evidence of a stage: one map of stats for each sensor."""
    return stats.select("run_id", F.lit(stage).alias("stage"), "sensor", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])).alias("stats"))


def with_ids(rows: DataFrame) -> DataFrame:
    """Evidence ids in order of stage and sensor, counted in each run."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("stage", "sensor"))
    return rows.withColumn("id", F.concat(F.lit("ev-"), F.lpad(place.cast("string"), 5, "0")))


def integrity(cites: DataFrame, rows: DataFrame) -> DataFrame:
    """``run_id, inference, id``: how many cited ids each inference has, and how many aren't there."""
    met = cites.join(rows.select("run_id", "id", F.lit(True).alias("known")), ["run_id", "id"], "left")
    return met.groupBy("run_id", "inference").agg(F.count("*").alias("cited"), F.count_if(F.col("known").isNull()).alias("unknown"))


def significant(token: Column) -> Column:
    """Digits a number shows, three at most; zeros at its ends count only after a point."""
    mantissa = F.regexp_replace(F.split(F.lower(token), "e")[0], "[^0-9.]", "")
    bare = F.when(F.contains(mantissa, F.lit(".")), F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+", "")).otherwise(F.regexp_replace(mantissa, "^0+|0+$", ""))
    return F.least(F.lit(3), F.greatest(F.lit(1), F.length(bare)))


def at_precision(value: Column, digits: Column) -> Column:
    return F.when(digits == 1, k.round_sig(value, 1)).when(digits == 2, k.round_sig(value, 2)).otherwise(k.round_sig(value, 3))


def validate(texts: DataFrame, values: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, part, text, label`` against the numbers ``id, value`` and names ``alias`` that it may use.

    A number must equal a value at the number's own precision; the own label must stand exactly once over all parts, and no other.
    """
    tokens = texts.select("id", "part", F.explode(F.regexp_extract_all(F.regexp_replace("text", ALIAS, " "), F.lit(NUMBER), F.lit(0))).alias("token"))
    asked = tokens.withColumns({"number": F.col("token").cast("double"), "digits": significant(F.col("token"))}).withColumn("number", at_precision(F.col("number"), F.col("digits")))
    allowed = values.select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("digits"), "value").select("id", "digits", at_precision(F.col("value"), F.col("digits")).alias("number")).distinct()
    numbers = asked.join(allowed, ["id", "digits", "number"], "left_anti").groupBy("id").agg(F.count("*").alias("numbers"))
    named = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(ALIAS), F.lit(0))).alias("alias")).join(aliases, "alias", "left_anti").groupBy("id").agg(F.count("*").alias("aliases"))
    any_label = "(?i)" + "|".join(x.replace("(", r"\(").replace(")", r"\)") for x in sorted(LABELS.values(), key=len, reverse=True))
    found = texts.select("id", F.lower("label").alias("label"), F.transform(F.regexp_extract_all("text", F.lit(any_label), F.lit(0)), F.lower).alias("labels"))
    own = F.size(F.filter("labels", lambda x: x == F.col("label")))
    counted = found.groupBy("id").agg(F.sum(own).alias("own_labels"), F.sum(F.size("labels") - own).alias("other_labels"))
    out = counted.join(numbers, "id", "left").join(named, "id", "left").fillna(0, ["numbers", "aliases"])
    return out.withColumn("passed", (F.col("numbers") == 0) & (F.col("aliases") == 0) & (F.col("own_labels") == 1) & (F.col("other_labels") == 0))


def review_match(reviews: DataFrame) -> DataFrame:
    """``own, other``: whether a reviewer's fault is the same, of the same family or neither; missing without a reply."""
    same_family = F.split("own", "-")[0] == F.split("other", "-")[0]
    return reviews.withColumn("match", F.when(F.col("other").isNull(), None).when(F.col("own") == F.col("other"), "class").when(same_family, "family").otherwise("none"))


def name_tokens(name: Column) -> Column:
    """The words of a name without fillers, plurals as singulars, words for a quantity as the quantity."""
    words = F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(STOP))
    concept = F.create_map(*[F.lit(x) for q, same in QUANTITIES.items() for w in [q, *same] for x in (w, q)])
    one = lambda w: F.regexp_replace(w, "s$", "")
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(concept[w], concept[one(w)], one(w))))


def consensus(names: DataFrame) -> DataFrame:
    """``key, seq, name``: the name that most others of the key agree with, the earliest of equals.

    Equal names are counted first, so pairs are those of the few different names of a key.
    """
    different = names.where("name is not null").groupBy("key", "name").agg(F.count("*").alias("n"), F.min("seq").alias("first")).withColumn("tokens", name_tokens(F.col("name")))
    other = different.select("key", F.col("name").alias("other"), F.col("tokens").alias("theirs"), F.col("n").alias("weight"))
    shared = F.array_intersect("tokens", "theirs")
    empty = (F.size("tokens") == 0) | (F.size("theirs") == 0)
    quantity = F.arrays_overlap(shared, F.array(*[F.lit(q) for q in QUANTITIES]))
    agree = F.when(empty, F.lower(F.trim("name")) == F.lower(F.trim("other"))).otherwise(quantity | (F.size(shared) / F.least(F.size("tokens"), F.size("theirs")) >= 0.5))
    votes = different.join(other, "key").where(agree).groupBy("key", "name", "first").agg(F.sum("weight").alias("votes"))
    return votes.groupBy("key").agg(F.max_by("name", F.struct("votes", -F.col("first"))).alias("name"), F.max("votes").alias("votes"))


def payload_rows(ranked: DataFrame, most: int = 20) -> DataFrame:
    """``run_id, sensor, contribution``: the first ones with their contributions made to sum to 1; as many of the next are named as left out."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(F.round("contribution", 9)), "sensor"))
    top = ranked.withColumn("place", place).where(F.col("place") <= 2 * most).withColumn("kept", F.col("place") <= most)
    whole = F.sum(F.when(F.col("kept"), F.greatest("contribution", F.lit(0.0)))).over(Window.partitionBy("run_id"))
    return top.withColumn("contribution", F.when(F.col("kept"), F.when(whole > 0, F.greatest("contribution", F.lit(0.0)) / whole).otherwise(F.lit(1.0 / most))))


def outcomes(old: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """``run_id, incident, sensor, onset, fault``: each old incident with the new one that shares most sensors, and whether it changed."""
    met = old.join(new.select("run_id", "sensor", F.col("incident").alias("new_incident"), F.col("onset").alias("new_onset"), F.col("fault").alias("new_fault")), ["run_id", "sensor"])
    shared = met.groupBy("run_id", "incident", "new_incident").agg(F.count("*").alias("overlap"), F.min("onset").alias("onset"), F.min("new_onset").alias("new_onset"), F.min("fault").alias("fault"), F.min("new_fault").alias("new_fault"))
    best = F.row_number().over(Window.partitionBy("run_id", "incident").orderBy(F.desc("overlap"), "new_incident"))
    moved = F.when(F.col("onset").isNull() | F.col("new_onset").isNull(), ~F.col("onset").eqNullSafe(F.col("new_onset"))).otherwise(F.abs(F.col("onset") - F.col("new_onset")) > 0.01 * n)
    return shared.withColumn("place", best).where("place = 1").select("run_id", "incident", "new_incident", "overlap", (moved | (F.col("fault") != F.col("new_fault"))).alias("changed"))


def trace(steps: DataFrame, rows: DataFrame, most: int = 300) -> DataFrame:
    """``run_id, sensor, step, keys, cited, result``: one row for each stat of a step, from the first cited evidence that has a finite value for its key.

    A result longer than ``most`` characters is cut at its last blank.
    """
    asked = steps.select("run_id", "sensor", "step", "result", "cited", F.explode(F.slice("keys", 1, 20)).alias("stat"))
    met = asked.select("*", F.posexplode("cited").alias("place", "id")).join(rows.select("run_id", "id", "stats"), ["run_id", "id"]).withColumn("value", F.element_at("stats", F.col("stat")))
    finite = met.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    head = F.substring("result", 1, most - 3)
    whole = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    short = F.when(F.length("result") <= most, F.col("result")).otherwise(F.concat(F.when(whole != "", whole).otherwise(F.substring("result", 1, most - 4)), F.lit("...")))
    return finite.groupBy("run_id", "sensor", "step", "stat", short.alias("result")).agg(F.min_by("value", "place").alias("value"))


def family_notes(runs: DataFrame, notes: DataFrame, run: int) -> DataFrame:
    """``run, parent, name`` and ``run, alias, seq, text``: notes by alias over a run, its ancestors and the runs of its name."""
    family = runs.sparkSession.sql(
        """WITH RECURSIVE up AS (SELECT run, parent FROM {runs} WHERE run = :run UNION ALL SELECT r.run, r.parent FROM up JOIN {runs} r ON r.run = up.parent)
        SELECT run FROM up UNION SELECT run FROM {runs} WHERE name = (SELECT max(name) FROM {runs} WHERE run = :run)""",
        args={"run": run},
        runs=runs,
    )
    return notes.join(family, "run", "left_semi").groupBy("alias").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"), F.max_by("text", F.struct("run", "seq")).alias("latest"))
