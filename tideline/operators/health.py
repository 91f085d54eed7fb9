"""The health gate: block statistics of each sensor against its own baseline, and rules that are rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators.kernels import KEYS

#: Limits of the checks: name -> default.
LIMITS = {"dropout": 3.0, "dead": 3.0, "stuck": 0.2, "spikes": 0.02, "saturated": 0.3, "noisy": 3.0, "resolution": 4.0, "timebase": 0.5}
CHECKS = ("dropout", "dead", "stuck", "spikes", "saturated", "noisy", "resolution")


def block_size(n: Column) -> Column:
    return F.greatest(F.lit(64), F.least(F.lit(1024), F.expr("n div 64")))


def with_blocks(g: DataFrame, size: int, baseline_end: int | Column) -> DataFrame:
    """Blocks tile each episode, split where the baseline ends; the last tile of a part takes the rest."""
    part = F.when(F.col("t") < baseline_end, 0).otherwise(1)
    own = Window.partitionBy(*KEYS, "episode", "part")
    sized = g.withColumn("part", part).withColumns({"lo": F.min("t").over(own), "hi": F.max("t").over(own)})
    tile = F.least(F.expr(f"(t - lo) div {size}"), F.greatest(F.lit(1), F.expr(f"(hi - lo + 1) div {size}")) - 1)
    return sized.withColumn("block", F.col("lo") + tile * size).drop("lo", "hi")


def block_stats(blocks: DataFrame) -> DataFrame:
    """Missing share, longest run, noise, spike share, mass at the most frequent value, level and step size of each block."""
    by = [*KEYS, "part", "block"]
    d = k.hampel(k.diff(blocks), 3.0)
    mid = d.groupBy(*by).agg(F.expr("percentile(d, 0.5)").alias("mid_d"), F.expr("percentile(v, 0.5)").alias("level"), F.avg(F.col("v").isNull().cast("int")).alias("missing"), F.avg(F.col("spike").cast("int")).alias("spikes"), F.count("*").alias("n"))
    noise = d.join(mid.select(*by, "mid_d"), by).groupBy(*by).agg((F.coalesce(F.expr("percentile(abs(d - mid_d), 0.5)"), F.lit(0.0)) * k.MAD_SCALE / math.sqrt(2)).alias("noise"))
    mass = blocks.where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("m")).groupBy(*by).agg(F.max("m").alias("most"), F.count("*").alias("levels"))
    w = Window.partitionBy(*by).orderBy("t")
    change = F.when(F.col("v").isNull() | F.lag("v").over(w).isNull() | (F.col("v") != F.lag("v").over(w)), 1).otherwise(0)
    runs = blocks.withColumn("change", change).withColumn("island", F.sum("change").over(w)).where("v is not null").groupBy(*by, "island").agg(F.count("*").alias("run"))
    longest = runs.groupBy(*by).agg(F.max("run").alias("longest"))
    gap = blocks.where("v is not null").select(*by, "v").distinct().withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy(*by).orderBy("v")))
    step = gap.groupBy(*by).agg(F.min(F.when(F.col("gap") > 1e-9 * F.abs("v"), F.col("gap"))).alias("step"))
    out = mid.drop("mid_d").join(noise, by).join(mass, by, "left").join(longest, by, "left").join(step, by, "left")
    return out.select(*by, "n", "missing", "noise", "spikes", "level", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce(F.col("most") / F.col("n"), F.lit(0.0)).alias("edge_mass"), F.coalesce("levels", F.lit(0)).alias("levels"), F.coalesce("step", F.lit(0.0)).alias("step"))


def reference(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    """The baseline's own figures for each sensor."""
    base = stats.where("part = 0").groupBy(*KEYS).agg(
        F.max("missing").alias("ref_missing"), F.expr("percentile(longest, 0.99)").alias("ref_run"), F.expr("percentile(noise, 0.5)").alias("ref_noise"), F.max("spikes").alias("ref_spikes"), F.max("edge_mass").alias("ref_mass"),
        F.min(F.when(F.col("step") > 0, F.col("step"))).alias("least_step"), F.max("step").alias("most_step"),
    )
    inside = blocks.where("part = 0").groupBy(*KEYS).agg(F.expr("percentile(v, 0.01)").alias("p1"), F.expr("percentile(v, 0.99)").alias("p99"), F.count_distinct("v").alias("distinct"), F.count("v").alias("count"))
    # steps say something where values repeat
    coarse = (F.col("distinct") > 1) & (F.col("distinct") < F.col("count") / 2)
    return base.join(inside, KEYS).withColumns({n: F.when(coarse, F.col(n)) for n in ("least_step", "most_step")}).drop("count")


def checked(stats: DataFrame, ref: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Every block with a statistic, a threshold and a verdict for every check."""
    c = F.col
    level_inside = c("level").between(c("p1"), c("p99"))
    # how far a block's step size lies outside of the baseline's
    factor = F.coalesce(F.when(c("step") == 0, 1.0).when(c("step") > c("most_step"), c("step") / c("most_step")).when(c("step") < c("least_step"), c("least_step") / c("step")), F.lit(1.0))
    rules = {
        "dropout": (c("missing"), limits["dropout"] * F.greatest(F.lit(0.01), c("ref_missing")), c("missing") > limits["dropout"] * F.greatest(F.lit(0.01), c("ref_missing"))),
        "dead": (c("longest").cast("double"), limits["dead"] * c("ref_run"), c("longest") > limits["dead"] * c("ref_run")),
        "stuck": (c("noise"), limits["stuck"] * c("ref_noise"), c("noise") < limits["stuck"] * c("ref_noise")),
        "spikes": (c("spikes"), F.greatest(F.lit(limits["spikes"]), 3 * c("ref_spikes")), c("spikes") > F.greatest(F.lit(limits["spikes"]), 3 * c("ref_spikes"))),
        "saturated": (c("edge_mass"), F.greatest(F.lit(limits["saturated"]), 3 * c("ref_mass")), (c("distinct") >= 20) & (c("edge_mass") > F.greatest(F.lit(limits["saturated"]), 3 * c("ref_mass")))),
        "noisy": (c("noise"), limits["noisy"] * c("ref_noise"), (c("noise") > limits["noisy"] * c("ref_noise")) & level_inside),
        "resolution": (factor, F.lit(limits["resolution"]), factor > limits["resolution"]),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(n).alias("check"), s.alias("statistic"), t.alias("threshold"), F.coalesce(f, F.lit(False)).alias("failed")) for i, (n, (s, t, f)) in enumerate(rules.items())])
    return stats.join(ref, KEYS).select(*KEYS, "part", "block", F.inline(rows))


def suppressed(checks: DataFrame) -> DataFrame:
    """A noisy block that many sensors share isn't a fault of the sensor: three of them, and a tenth of all."""
    shared = Window.partitionBy("run_id", "block", "check")
    many = (F.sum(F.col("failed").cast("int")).over(shared) >= F.greatest(F.lit(3.0), 0.1 * F.count("*").over(shared))) & (F.col("check") == "noisy")
    return checks.withColumn("plant_wide", many & F.col("failed")).withColumn("failed", F.col("failed") & ~many)


def gate(checks: DataFrame) -> DataFrame:
    """The first failed check of each sensor in the fixed order, and how clear it is."""
    after = checks.where("part = 1")
    worst = F.when(F.col("statistic") < F.col("threshold"), -1.0).otherwise(1.0) * F.abs(F.log2((F.col("statistic") + 1e-9) / (F.col("threshold") + 1e-9)))
    failed = after.where("failed").withColumn("margin", F.abs(worst))
    # block and margin are those of the reported check alone
    each = failed.groupBy(*KEYS, "order", "check").agg(F.min("block").alias("from_block"), F.max("margin").alias("margin"), F.count_distinct("block").alias("n_blocks"))
    first = each.groupBy(*KEYS).agg(F.min_by(F.struct(F.col("check").alias("health"), "from_block", "margin", "n_blocks"), "order").alias("f")).select(*KEYS, "f.*")
    sensors = after.select(*KEYS).distinct()
    return sensors.join(first, KEYS, "left").select(*KEYS, F.coalesce("health", F.lit("healthy")).alias("health"), "from_block", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce(F.least(F.lit(1.0), "margin"), F.lit(1.0)).alias("confidence"))


def merged_windows(flags: DataFrame, flag: str = "flag") -> DataFrame:
    """Runs of flagged samples as windows [from, to)."""
    w = Window.partitionBy(*KEYS).orderBy("t")
    marked = flags.where(F.col(flag)).withColumn("starts", F.when(F.col("t") - F.lag("t").over(w) == 1, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("starts").over(w))
    return island.groupBy(*KEYS, "island").agg(F.min("t").alias("from"), (F.max("t") + 1).alias("to"), F.count("*").alias("n")).drop("island")


def time_regularity(times: DataFrame, step_ms: float) -> DataFrame:
    """``part, ms`` in order: the worst ratio of a step to the nominal one; 0 where time doesn't go forward."""
    w = Window.partitionBy("part").orderBy("row")
    step = times.withColumn("step", F.col("ms") - F.lag("ms").over(w)).where("step is not null")
    ratio = F.when(F.col("step") <= 0, 0.0).otherwise(F.least(F.col("step") / step_ms, step_ms / F.col("step")))
    return step.groupBy("part").agg(F.min(ratio).alias("regularity")).withColumn("failed", F.col("regularity") < LIMITS["timebase"])


# -- rules are rows: rule_id, sensor and parameters


def range_violations(g: DataFrame, rules: DataFrame) -> DataFrame:
    hit = g.join(rules, "sensor").where("v < low or v > high")
    return rules.join(hit.groupBy("rule_id").agg(F.count("*").alias("violations")), "rule_id", "left").select("rule_id", F.coalesce("violations", F.lit(0)).alias("violations"))


def flatline_violations(g: DataFrame, rules: DataFrame) -> DataFrame:
    """Runs longer than ``longest``; episodes aren't used."""
    runs = k.run_lengths(g.withColumn("episode", F.lit(0)))
    hit = runs.join(rules, "sensor").where("length > longest")
    return rules.join(hit.groupBy("rule_id").agg(F.count("*").alias("violations")), "rule_id", "left").select("rule_id", F.coalesce("violations", F.lit(0)).alias("violations"))


def rate_violations(g: DataFrame, rules: DataFrame) -> DataFrame:
    hit = k.diff(g).join(rules, "sensor").where("abs(d) > most")
    return rules.join(hit.groupBy("rule_id").agg(F.count("*").alias("violations")), "rule_id", "left").select("rule_id", F.coalesce("violations", F.lit(0)).alias("violations"))


def relation_violations(g: DataFrame, rules: DataFrame) -> DataFrame:
    """How often ``sensor`` and ``other`` differ by more than ``tolerance``; across episodes, where both have values.

    ``relation`` is equals or tracks (the sensor against the other ``lag`` samples before) or leads (the other against the sensor ``lag`` samples before).
    """
    own, other = g.select("run_id", "sensor", "t", "v"), g.select("run_id", F.col("sensor").alias("other"), F.col("t").alias("t0"), F.col("v").alias("u"))
    behind = F.when(F.col("relation") == "leads", F.col("lag")).otherwise(-F.col("lag"))
    met = own.join(rules, "sensor").withColumn("t0", F.col("t") + behind).join(other, ["run_id", "other", "t0"])
    found = met.groupBy("rule_id").agg(F.count_if(F.abs(F.col("v") - F.col("u")) > F.col("tolerance")).alias("violations"))
    return rules.select("rule_id").join(found, "rule_id", "left").select("rule_id", F.coalesce("violations", F.lit(0)).alias("violations"))


def block_violations(g: DataFrame, rules: DataFrame, size: int) -> DataFrame:
    """Full tumbling blocks whose missing share is above ``most_missing``, or whose aggregates leave [low, high]."""
    blocks = g.groupBy(*KEYS, F.expr(f"t div {size}").alias("block")).agg(
        F.count("*").alias("n"), F.avg(F.col("v").isNull().cast("int")).alias("missing"), F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std")
    )
    value = F.when(F.col("aggregate") == "missing", F.col("missing"))
    for name in ("mean", "median", "min", "max", "std"):
        value = value.when(F.col("aggregate") == name, F.col(name))
    met = blocks.where(F.col("n") == size).join(rules, "sensor").withColumn("value", value)
    return met.groupBy("rule_id", "aggregate").agg(F.count("*").alias("blocks"), F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("violations"))


def violations_in_window(g: DataFrame, rules: DataFrame, window: tuple[int, int]) -> DataFrame:
    """``rule_id, type, sensor, other, relation, lag, low, high, size, aggregate`` to the violations of each rule in a window, whatever its type; a sensor that isn't there has none.

    range: samples outside of [low, high], either of which may be null; rate: steps larger than ``high``; flatline: runs longer than ``high``; relation: samples further apart than
    ``high``, the earlier of which may lie before the window; missing: blocks with a missing share above ``high``; aggregate: blocks whose aggregate lies outside. Blocks are full
    tumbling blocks of ``size`` from the window's start on, or the window itself if it is shorter. Samples that aren't in the grid are missing; episodes don't matter.
    """
    low, high = window
    rows = g.where((F.col("t") >= low) & (F.col("t") < high))
    before = F.lag(F.struct("t", "v")).over(Window.partitionBy("run_id", "sensor").orderBy("t"))
    steps = rows.withColumn("before", before).withColumn("step", F.when(F.col("before.t") == F.col("t") - 1, F.abs(F.col("v") - F.col("before.v"))))
    outside = lambda v: F.coalesce(v < F.col("low"), F.lit(False)) | F.coalesce(v > F.col("high"), F.lit(False))
    of = lambda *types: rules.where(F.col("type").isin(*types))
    points = steps.join(of("range", "rate"), "sensor").where(F.when(F.col("type") == "range", outside(F.col("v"))).otherwise(F.col("step") > F.col("high"))).select("rule_id")
    runs = k.run_lengths(rows.withColumn("episode", F.lit(0))).join(of("flatline"), "sensor").where("length > high").select("rule_id")

    own, other = g.select("run_id", "sensor", "t", "v"), g.select("run_id", F.col("sensor").alias("other"), F.col("t").alias("t0"), F.col("v").alias("u"))
    leads = F.col("relation") == "leads"
    pairs = own.join(of("relation"), "sensor").withColumn("t0", F.col("t") + F.when(leads, F.col("lag")).otherwise(-F.col("lag")))
    at = F.when(leads, F.col("t0")).otherwise(F.col("t"))
    apart = pairs.where((at >= low) & (at < high)).join(other, ["run_id", "other", "t0"]).where(F.abs(F.col("v") - F.col("u")) > F.col("high")).select("rule_id")

    length = F.least(F.col("size"), F.lit(high - low))
    spans = g.select("run_id", "sensor").distinct().join(of("missing", "aggregate").withColumn("size", length), "sensor")
    spans = spans.select("run_id", "rule_id", "sensor", "type", "aggregate", "size", "low", "high", F.explode(F.sequence(F.lit(0), F.expr(f"{high - low} div size - 1"))).alias("block"))
    sums = {"mean": F.avg("v"), "median": F.expr("percentile(v, 0.5D)"), "min": F.min("v"), "max": F.max("v"), "std": F.stddev_pop("v"), "held": F.count("v")}
    inside = rows.join(of("missing", "aggregate").select("sensor", "rule_id", length.alias("size")), "sensor").withColumn("block", F.expr(f"(t - {low}) div size"))
    each = spans.join(inside.groupBy("run_id", "rule_id", "block").agg(*[x.alias(n) for n, x in sums.items()]), ["run_id", "rule_id", "block"], "left").fillna(0, ["held"])
    value = F.coalesce(*[F.when(F.col("aggregate") == n, F.col(n)) for n in sums if n != "held"])
    bad = each.where(F.when(F.col("type") == "missing", (F.col("size") - F.col("held")) / F.col("size") > F.col("high")).otherwise(outside(value))).select("rule_id")

    counts = points.unionByName(runs).unionByName(apart).unionByName(bad).groupBy("rule_id").agg(F.count("*").alias("violations"))
    return rules.select("rule_id", "type", "sensor").join(counts, "rule_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))


def propose_rules(g: DataFrame, baseline_end: int) -> DataFrame:
    """Range, flatline and missing rules from the baseline's quantiles."""
    base = g.where(F.col("t") < baseline_end)
    edges = k.quantiles(base, {"p1": 0.01, "p99": 0.99}).join(k.mad(base), KEYS)
    runs, missing = k.run_stats(base), base.groupBy(*KEYS).agg(F.avg(F.col("v").isNull().cast("int")).alias("missing"))
    joined = edges.join(runs, KEYS, "left").join(missing, KEYS)
    rules = F.array(
        F.struct(F.lit("range").alias("type"), (F.col("p1") - 3 * F.col("mad")).alias("low"), (F.col("p99") + 3 * F.col("mad")).alias("high")),
        F.struct(F.lit("flatline").alias("type"), F.lit(None).cast("double").alias("low"), (3 * F.coalesce("p99_run", F.lit(1.0))).alias("high")),
        F.struct(F.lit("missing").alias("type"), F.lit(None).cast("double").alias("low"), F.greatest(F.lit(0.05), 3 * F.col("missing")).alias("high")),
    )
    return joined.select(*KEYS, F.inline(rules))


def restate(rules: DataFrame) -> DataFrame:
    """A rule row in words."""
    words = (
        F.when(F.col("type") == "range", F.concat(F.col("sensor"), F.lit(" stays between "), F.round("low", 2).cast("decimal(20,2)").cast("string"), F.lit(" and "), F.round("high", 2).cast("decimal(20,2)").cast("string")))
        .when(F.col("type") == "flatline", F.concat(F.col("sensor"), F.lit(" does not repeat a value more than "), F.floor("high").cast("string"), F.lit(" times")))
        .otherwise(F.concat(F.col("sensor"), F.lit(" misses at most "), F.round(F.col("high") * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("% of a block")))
    )
    return rules.withColumn("text", words)


# How a rule of each type reads, and a limit of one side or both.
RULE_WORDS = {
    "range": "%s must stay %s",
    "flatline": "%s must not stay flat for more than %s samples",
    "rate": "%s must not change faster than %s per sample",
    "leads": "%s must lead %s by %s samples within %s",
    "tracks": "%s must track %s within %s",
    "equals": "%s must equal %s within %s",
    "missing": "%s must not be missing more than %s%% in %s samples",
    "aggregate": "%s of %s over %s samples must stay %s",
}
BOUND_WORDS = {"both": "between %s and %s", "high": "below %s", "low": "above %s"}


def short_number(x: Column) -> Column:
    """Three significant digits without trailing zeros; what is beyond 26 digits or below the 12th place is written with an exponent, or as 0."""
    rounded = k.round_sig(x)
    return F.coalesce(F.regexp_replace(rounded.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", ""), rounded.cast("string"))


def in_words(rules: DataFrame) -> DataFrame:
    """``rules`` as ``violations_in_window`` takes them, of every type, with a sentence, ``text``. A relation without a lag has lag 0, a limit without either side is one above 0."""
    low, high = short_number(F.coalesce("low", F.lit(0.0))), short_number(F.col("high"))
    both = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.format_string(BOUND_WORDS["both"], low, high))
    bounds = both.when(F.col("high").isNotNull(), F.format_string(BOUND_WORDS["high"], high)).otherwise(F.format_string(BOUND_WORDS["low"], low))
    parts = {
        "range": ["sensor", bounds],
        "flatline": ["sensor", F.col("high").cast("long")],
        "rate": ["sensor", high],
        "leads": ["sensor", "other", F.coalesce("lag", F.lit(0)), high],
        "tracks": ["sensor", "other", high],
        "equals": ["sensor", "other", high],
        "missing": ["sensor", short_number(F.col("high") * 100), "size"],
        "aggregate": ["aggregate", "sensor", "size", bounds],
    }
    kind, text = F.when(F.col("type") == "relation", F.col("relation")).otherwise(F.col("type")), F.lit(None).cast("string")
    for name, columns in parts.items():
        text = F.when(kind == name, F.format_string(RULE_WORDS[name], *columns)).otherwise(text)
    return rules.withColumn("text", text)
