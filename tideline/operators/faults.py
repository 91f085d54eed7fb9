"""Separation of faults: drivers and victims, groups of drivers, control loops, kinds of process fault and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators import trends
from tideline.operators.kernels import KEYS
from tideline.operators.relations import redundancy_groups
from tideline.session import durable

# The kinds of fault by family, and what a report calls them.
LABELS = {
    "sensor-dropout": "Sensor fault: dropout",
    "sensor-dead": "Sensor fault: dead",
    "sensor-stuck": "Sensor fault: stuck",
    "sensor-spikes": "Sensor fault: spikes",
    "sensor-saturated": "Sensor fault: saturated",
    "sensor-noisy": "Sensor fault: noisy",
    "sensor-drift": "Sensor fault: drift",
    "sensor-drift-bias": "Sensor fault: drift (bias)",
    "sensor-drift-gain": "Sensor fault: drift (gain)",
    "sensor-drift-hidden": "Sensor fault: drift hidden by the control loop",
    "data-timebase": "Data fault: timebase",
    "data-resolution": "Data fault: resolution change",
    "data-logging": "Data fault: logging",
    "process-degradation": "Process fault: degradation",
    "process-slow-degradation": "Process fault: slow degradation",
    "process-step": "Process fault: step shift",
    "process-oscillation": "Process fault: oscillation",
}


def fault_of_health(health: Column) -> Column:
    return F.concat(F.when(health.isin("timebase", "resolution"), "data-").otherwise("sensor-"), health)


def label_of(fault: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), fault)


def family_of(fault: Column) -> Column:
    return F.split(fault, "-")[0]


def drivers(moving: DataFrame) -> DataFrame:
    """``run_id, sensor, family, drifting, victim_of``: drifting sensors, each a driver or the victim of one that drifts too.

    A driver is a source if all its siblings hold or are its victims.
    """
    drifting = moving.where("drifting")
    known = drifting.select("run_id", F.col("sensor").alias("victim_of"), F.lit(True).alias("known"))
    marked = drifting.join(known, ["run_id", "victim_of"], "left").withColumn("victim_of", F.when(F.col("known"), F.col("victim_of"))).drop("known")
    siblings = moving.select("run_id", "family", F.col("sensor").alias("other"), F.col("drifting").alias("moves")).join(marked.select("run_id", F.col("sensor").alias("other"), F.col("victim_of").alias("caused")), ["run_id", "other"], "left")
    own = marked.where("victim_of is null").select("run_id", "family", "sensor")
    held = own.join(siblings, ["run_id", "family"]).where("sensor <> other").groupBy(*KEYS).agg(F.bool_and(~F.col("moves") | F.col("caused").eqNullSafe(F.col("sensor"))).alias("source"))
    return marked.join(held, KEYS, "left").withColumns({"driver": F.col("victim_of").isNull(), "source": F.coalesce("source", F.lit(False))})


def both_ways(relations: DataFrame) -> DataFrame:
    return relations.select("run_id", "a", "b").unionByName(relations.select("run_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def directed(relations: DataFrame) -> DataFrame:
    """Relations that are clearly stronger at a lag, as ``source`` before ``target``."""
    lagging = relations.where((F.col("lag") != 0) & (F.abs("rho_at_lag") > F.abs("rho") + 0.02))
    first = F.col("lag") > 0
    return lagging.select("run_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"))


def driver_groups(found: DataFrame, relations: DataFrame, n: int, n_sensors: int) -> DataFrame:
    """``sensor, onset, reach, source``: drivers that are related (neighbours, or with one in common) and start together are one group.

    A group of a tenth of the plant takes in all drivers that start with one of its members. Sources leave a mixed group. A group lasts
    until the next one starts. Everything is keyed by run; pairs are those of a run's few drivers.
    """
    near = both_ways(relations)
    hop = near.join(near.select("run_id", F.col("a").alias("b"), F.col("b").alias("c")), ["run_id", "b"]).select("run_id", "a", F.col("c").alias("b"))
    own = durable(found.select(*KEYS, "onset", "reach", "source"))
    left = own.select("run_id", F.col("sensor").alias("a"), F.col("onset").alias("onset_a"), F.col("reach").alias("reach_a"))
    right = own.select("run_id", F.col("sensor").alias("b"), F.col("onset").alias("onset_b"), F.col("reach").alias("reach_b"))
    slack = F.greatest(2 * F.greatest("reach_a", "reach_b"), F.lit(0.01 * n))
    close = durable(left.join(right, "run_id").where((F.col("a") != F.col("b")) & (F.abs(F.col("onset_a") - F.col("onset_b")) <= slack)).select("run_id", "a", "b"))
    linked = durable(close.join(near.unionByName(hop).distinct(), ["run_id", "a", "b"], "left_semi"))

    def labelled(pairs: DataFrame) -> DataFrame:
        label = redundancy_groups(pairs.withColumn("rho", F.lit(1.0)), 0.5)
        return own.join(label, KEYS, "left").withColumn("label", F.coalesce("label", "sensor"))

    size = F.count("*").over(Window.partitionBy("run_id", "label"))
    wide = labelled(linked).withColumn("size", size).where(F.col("size") >= max(3, -(-n_sensors // 10))).select("run_id", F.col("sensor").alias("a"))
    grouped = labelled(linked.unionByName(close.join(wide, ["run_id", "a"], "left_semi")))
    group = Window.partitionBy("run_id", "label")
    mixed = F.bool_or("source").over(group) & F.bool_or(~F.col("source")).over(group)
    split = grouped.withColumn("apart", mixed & F.col("source"))
    out = split.groupBy("run_id", "label", "apart").agg(F.sort_array(F.collect_list("sensor")).alias("members"), F.min("onset").alias("onset")).withColumn("drivers", F.array_join("members", ","))
    order = Window.partitionBy("run_id").orderBy("onset", "drivers")
    return out.withColumn("until", F.coalesce(F.lead("onset").over(order), F.lit(n))).select("run_id", "members", "drivers", "onset", "until")


def level_dependence(dev: DataFrame, start: int) -> DataFrame:
    """Spearman's rho of deviation and expected level from ``start`` on: a gain fault follows the level."""
    after = dev.where((F.col("t") >= start) & F.col("deviation").isNotNull() & F.col("expected").isNotNull())
    ranks = [k.average_ranks(after.withColumn("v", F.col(c))).select(*KEYS, "t", F.col("rank").alias(n)) for c, n in (("deviation", "u"), ("expected", "w"))]
    return ranks[0].join(ranks[1], [*KEYS, "t"]).groupBy(*KEYS).agg(k.correlation("u", "w").alias("rho"), F.count("*").alias("n"))


def control_loops(found: DataFrame, moving: DataFrame, roles: DataFrame, relations: DataFrame) -> DataFrame:
    """A drifting actuator that leads a controlled sensor which holds; ``downstream`` are the sensors that either of them leads."""
    edge = directed(relations)
    acting = found.where("driver").join(roles.where("role = 'actuator'"), KEYS, "left_semi").select("run_id", F.col("sensor").alias("actuator"))
    still = roles.where("role = 'controlled'").join(moving.where("drifting"), KEYS, "left_anti").select("run_id", F.col("sensor").alias("controlled"))
    held = acting.join(edge.select("run_id", F.col("source").alias("actuator"), F.col("target").alias("controlled")), ["run_id", "actuator"]).join(still, ["run_id", "controlled"])
    loop = held.groupBy("run_id", "actuator").agg(F.min("controlled").alias("controlled"))
    ends = loop.select("*", F.explode(F.array("actuator", "controlled")).alias("source"))
    led = ends.join(edge, ["run_id", "source"]).where("target <> actuator and target <> controlled").select("run_id", "actuator", F.col("target").alias("sensor")).distinct()
    shifted = led.join(moving.where("drifting").select(*KEYS, F.lit(1).alias("hit")), KEYS, "left").groupBy("run_id", "actuator").agg(F.count("*").alias("downstream"), F.count("hit").alias("shifted"))
    return loop.join(shifted, ["run_id", "actuator"], "left").select("run_id", "actuator", "controlled", F.coalesce("downstream", F.lit(0)).alias("downstream"), F.coalesce("shifted", F.lit(0)).alias("shifted"))


def process_kind(dev: DataFrame, start: int, n: int, reach: int) -> DataFrame:
    """Trend of the block medians of |deviation|, else a jump at the onset, else a period, else plain degradation."""
    series = dev.select(*KEYS, F.lit(0).alias("episode"), "t", F.col("deviation").alias("v"))
    after = series.where(F.col("t") >= start)
    blocks = k.block_medians(after.withColumn("v", F.abs("v")), max(1, n // 200)).select(*KEYS, F.lit(0).alias("episode"), F.col("center").alias("t"), F.col("median").alias("v"))
    sides = {"before": (start - reach, start), "after": (start, start + reach)}
    jump = series.groupBy(*KEYS).agg(*[F.expr(f"percentile(CASE WHEN t >= {lo} AND t < {hi} THEN v END, 0.5)").alias(s) for s, (lo, hi) in sides.items()]).select(*KEYS, F.abs(F.col("after") - F.col("before")).alias("jump"))
    period = k.dominant_period(k.autocorrelation(after, 40), 0.5)
    counts = blocks.where("v is not null").groupBy(*KEYS).agg(F.count("*").alias("blocks"))
    met = counts.join(trends.theil_sen(blocks).select(*KEYS, "slope"), KEYS, "left").join(trends.mann_kendall(blocks).select(*KEYS, "p"), KEYS, "left").join(jump, KEYS, "left").join(period, KEYS, "left")
    trend = (F.col("blocks") >= 4) & (F.col("p") < 0.01) & (F.col("slope") > 0)
    kind = F.when(trend, "process-slow-degradation").when(F.col("jump") > 2, "process-step").when(F.col("period") > 0, "process-oscillation").otherwise("process-degradation")
    return met.withColumn("fault", kind)


def onset_agreement(onsets: DataFrame, relations: DataFrame) -> DataFrame:
    """Of the directed relations between sensors with an onset, how many start in the order of the lag."""
    edge = directed(relations)
    first = onsets.select("run_id", F.col("sensor").alias("source"), F.col("onset").alias("before"))
    then = onsets.select("run_id", F.col("sensor").alias("target"), F.col("onset").alias("after"))
    return edge.join(first, ["run_id", "source"]).join(then, ["run_id", "target"]).groupBy("run_id").agg(F.count("*").alias("edges"), F.count_if(F.col("after") >= F.col("before")).alias("agree"))


def scale_change(g: DataFrame, onset: int, least: int = 10) -> DataFrame:
    """Ratios of level and of noise after an onset to those before; a gain changes both the same way, the noise by over half the level's log ratio."""
    sides = []
    for side, rows in (("before", g.where(F.col("t") < onset)), ("after", g.where(F.col("t") >= onset))):
        level = rows.groupBy(*KEYS).agg(F.expr("percentile(v, 0.5)").alias(f"level_{side}"), F.count("v").alias(f"n_{side}"))
        sides.append(level.join(k.noise_level(rows).withColumnRenamed("noise", f"noise_{side}"), KEYS, "left"))
    met = sides[0].join(sides[1], KEYS)
    enough = (F.col("n_before") >= least) & (F.col("n_after") >= least)
    level = F.when(enough & (F.signum("level_before") == F.signum("level_after")) & (F.col("level_before") != 0), F.col("level_after") / F.col("level_before")).otherwise(1.0)
    spread = F.when(enough & (F.col("noise_before") > 0), F.col("noise_after") / F.col("noise_before")).otherwise(1.0)
    ratios = met.select(*KEYS, level.alias("level_ratio"), spread.alias("spread_ratio")).withColumns({"l": F.log("level_ratio"), "s": F.when(F.col("spread_ratio") > 0, F.log("spread_ratio")).otherwise(float("-inf"))})
    gain = (F.abs("l") > 0.05) & (F.signum("l") == F.signum("s")) & (F.abs("s") > 0.5 * F.abs("l"))
    return ratios.withColumn("gain", gain).drop("l", "s")


def verdict(cases: DataFrame) -> DataFrame:
    """The first row of the table that matches a group of drivers gives its fault."""
    c = F.col
    drift = F.when(~c("modelled"), "sensor-drift").when(c("gain"), "sensor-drift-gain").otherwise("sensor-drift-bias")
    fault = (
        F.when((c("shared_share") >= 0.8) & (F.abs(c("onset") - c("shared_at")) <= c("slack")), "data-logging")
        .when(c("all_sources"), drift)
        .when((c("n_drivers") == 1) & c("redundant"), "sensor-drift")
        .when((c("n_drivers") == 1) & ~c("in_loop"), drift)
        .when(c("in_loop"), F.when(c("shifted") > 0, "sensor-drift-hidden").otherwise("process-degradation"))
        .otherwise(F.coalesce(c("kind"), F.lit("process-degradation")))
    )
    return cases.withColumn("fault", fault)
