"""Fingerprints, signal types and the clean baseline of a run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import health, kernels as k
from tideline.operators.kernels import KEYS
from tideline.session import ship


def flat_share(held: DataFrame) -> DataFrame:
    """Share of the samples in runs of three or more."""
    return k.run_lengths(held).groupBy(*KEYS).agg((F.sum(F.when(F.col("length") >= 3, F.col("length")).otherwise(0)) / F.sum("length")).alias("flat_share"))


def monotonic_share(g: DataFrame) -> DataFrame:
    """Net direction of all moves, as a share of the moves."""
    moves = F.count_if(F.col("d") != 0)
    return k.diff(g).groupBy(*KEYS).agg(F.when(moves > 0, F.abs(F.sum(F.signum("d"))) / moves).otherwise(0.0).alias("monotonic_share"))


def fingerprint(g: DataFrame, held: DataFrame) -> DataFrame:
    """One row of statistics for each sensor."""
    base = g.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg(F.col("v").isNull().cast("int")).alias("missing_rate"), F.count_distinct("v").alias("n_distinct"), *[k.quantile("v", p).alias(n) for n, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99))]
    )
    return base.join(k.noise_level(g), KEYS).join(flat_share(held), KEYS).join(monotonic_share(g), KEYS)


def signal_type(prints: DataFrame, acf_time: DataFrame) -> DataFrame:
    c = F.col
    kind = (
        F.when(c("n_distinct") <= 1, "constant")
        .when(c("n_distinct") == 2, "binary")
        .when((c("n_distinct") <= 8) & (c("flat_share") > 0.9), "state")
        .when(c("monotonic_share") > 0.98, "counter")
        .when(c("flat_share") > 0.6, "step")
        .when(c("acf_time") > 20, "slow")
        .otherwise("fast")
    )
    return prints.join(acf_time, KEYS).select(*KEYS, kind.alias("signal"))


def changes(g: DataFrame, points: DataFrame) -> DataFrame:
    """Every change point with the medians of the segments beside it and the scale before it."""
    w = Window.partitionBy(*KEYS).orderBy("cut_t")
    placed = points.select(*KEYS, "cut_t").distinct().withColumns({"before_t": F.coalesce(F.lag("cut_t").over(w), F.lit(-(1 << 62))), "after_t": F.coalesce(F.lead("cut_t").over(w), F.lit(1 << 62))})
    near = g.join(placed, KEYS).where((F.col("t") >= F.col("before_t")) & (F.col("t") < F.col("after_t")))
    levels = near.groupBy(*KEYS, "cut_t").agg(F.expr("percentile(CASE WHEN t < cut_t THEN v END, 0.5)").alias("before"), F.expr("percentile(CASE WHEN t >= cut_t THEN v END, 0.5)").alias("after"))
    spread = near.where("t < cut_t").join(levels.select(*KEYS, "cut_t", "before"), [*KEYS, "cut_t"]).groupBy(*KEYS, "cut_t").agg((F.expr("percentile(abs(v - before), 0.5)") * k.MAD_SCALE).alias("scale"))
    return levels.join(spread, [*KEYS, "cut_t"], "left").withColumn("move", F.abs(F.col("after") - F.col("before")) / F.greatest(F.col("scale"), F.lit(1e-12)))


def change_groups(found: DataFrame, n: int, n_sensors: int) -> DataFrame:
    """Change points of a run in order, each in the group that its first member opened within a hundredth of the run.

    A group counts if enough sensors share it, or one moves by more than three scales. One small ordered fold per run.
    """
    ship(found.sparkSession)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, first, group = rows.sort_values(["cut_t", "sensor"]), None, -1
        labels = []
        for t in rows["cut_t"]:
            if first is None or t - first > 0.01 * n:
                first, group = t, group + 1
            labels.append(group)
        rows["group"] = labels
        out = rows.groupby("group").agg(run_id=("run_id", "first"), start=("cut_t", "min"), sensors=("sensor", "nunique"), largest=("move", "max")).reset_index()
        out["counts"] = (out["sensors"] >= max(3, 0.25 * n_sensors)) | (out["largest"] > 3)
        return out[["run_id", "group", "start", "sensors", "largest", "counts"]]

    return found.select("run_id", "sensor", "cut_t", "move").groupBy("run_id").applyInPandas(fold, "run_id string, group long, start long, sensors long, largest double, counts boolean")


def select_baseline(g: DataFrame, groups: DataFrame | None, least: int = 100) -> DataFrame:
    """From the start to the first counted change, or to 60% of the run; snapped back to an episode's start within 5%."""
    ends = g.groupBy("run_id").agg(F.min("t").alias("lo"), (F.max("t") + 1).alias("hi"))
    if groups is None:
        chosen = ends.withColumn("wanted", F.floor(F.col("lo") + 0.6 * (F.col("hi") - F.col("lo"))))
    else:
        first = groups.where("counts").groupBy("run_id").agg(F.min("start").alias("change"))
        chosen = ends.join(first, "run_id", "left").withColumn("wanted", F.when(F.col("change") - F.col("lo") >= least, F.col("change")).otherwise(F.floor(F.col("lo") + 0.6 * (F.col("hi") - F.col("lo")))))
    starts = g.groupBy("run_id", "episode").agg(F.min("t").alias("start")).drop("episode")
    near = (F.col("start") <= F.col("wanted")) & (F.col("wanted") - F.col("start") <= 0.05 * (F.col("hi") - F.col("lo"))) & (F.col("start") > F.col("lo"))
    snapped = chosen.join(starts, "run_id").groupBy("run_id", "lo", "hi", "wanted").agg(F.max(F.when(near, F.col("start"))).alias("snap"))
    return snapped.select("run_id", F.col("lo").alias("from"), F.coalesce("snap", "wanted").alias("to"))


def override_baseline(chosen: DataFrame, wanted: DataFrame, lo: int, hi: int) -> DataFrame:
    """``run_id, a, b``: an operator's window, clamped to the grid, in place of the chosen one."""
    return chosen.join(wanted, "run_id", "left").select("run_id", F.greatest(F.lit(lo), F.coalesce("a", "from")).alias("from"), F.least(F.lit(hi), F.coalesce("b", "to")).alias("to"))


def bound_by_health(g: DataFrame, end: int | Column, size: int) -> DataFrame:
    """A baseline from 0 to ``end`` (a number, or a column of ``g`` with one value for each run) ends before a sensor that fails a check from inside it to the end of the grid."""
    ends = g.groupBy("run_id").agg(F.max(F.lit(end).cast("long")).alias("end"))
    blocks = health.with_blocks(g, size, F.floor(F.lit(end) / 2))
    stats = health.block_stats(blocks)
    return bound_by_checks(health.checked(stats, health.reference(blocks, stats)), ends)


def bound_by_checks(checks: DataFrame, ends: DataFrame) -> DataFrame:
    """``run_id, end`` of baselines from 0 on, and checks with the first half as reference, to where the baselines end."""
    failed = checks.where("part = 1").groupBy(*KEYS, "block").agg(F.bool_or("failed").alias("bad"))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    tail = failed.withColumn("all_bad", F.bool_and("bad").over(w)).where("all_bad").groupBy(*KEYS).agg(F.min("block").alias("from_block"))
    cut = tail.join(ends, "run_id").where("from_block >= end - end div 2 and from_block < end")
    return ends.join(cut.groupBy("run_id").agg(F.min("from_block").alias("cut")), "run_id", "left").select("run_id", F.coalesce("cut", "end").alias("to"))
