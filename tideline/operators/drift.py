"""Drift against peers: masks, peer models, deviations, decisions and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators import trends
from tideline.operators.kernels import KEYS
from tideline.session import durable, ship


def apply_masks(g: DataFrame, masks: DataFrame) -> DataFrame:
    """``run_id, sensor, from, to``: samples in a masked window become missing. Windows are a few per sensor."""
    hit = g.select(*KEYS, "t").join(masks, KEYS).where((F.col("t") >= F.col("from")) & (F.col("t") < F.col("to"))).select(*KEYS, "t").distinct().withColumn("masked", F.lit(True))
    return g.join(hit, [*KEYS, "t"], "left").withColumn("v", F.when(F.col("masked"), None).otherwise(F.col("v"))).drop("masked")


def align_peers(g: DataFrame, peers: DataFrame) -> DataFrame:
    """Every sample of a sensor with its peers' samples, each shifted by its lag inside the episode."""
    left = g.select(*KEYS, "episode", "t", "v").join(peers.select(*KEYS, "peer", "lag"), KEYS).withColumn("t2", F.col("t") - F.col("lag"))
    right = g.select("run_id", F.col("sensor").alias("peer"), "episode", F.col("t").alias("t2"), F.col("v").alias("u"))
    return left.join(right, ["run_id", "peer", "episode", "t2"], "left").select(*KEYS, "episode", "t", "v", "peer", "u")


def fit_models(aligned: DataFrame, baseline_end: int, most: int = 5, least: int = 100) -> DataFrame:
    """Coefficients of a robust fit of each sensor on its peers over the baseline, as rows ``peer, coef``; the intercept has an empty peer.

    Peers with too few joint samples don't take part. One small fit per sensor, sensors in parallel.
    """
    joint = aligned.where((F.col("t") < baseline_end) & F.col("v").isNotNull() & F.col("u").isNotNull())
    enough = joint.groupBy(*KEYS, "peer").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    placed = enough.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy("peer"))).where(F.col("place") <= most)
    wide = joint.join(placed.select(*KEYS, "peer", "place"), [*KEYS, "peer"]).groupBy(*KEYS, "t", F.col("v").alias("y")).pivot("place", list(range(1, most + 1))).agg(F.first("u"))
    names = placed.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("place", "peer"))).alias("peers"))
    used = names.withColumn("k", F.size("peers"))
    filled = wide.join(used.select(*KEYS, "k"), KEYS).select(*KEYS, "y", *[F.when(F.col("k") >= i, F.col(str(i))).otherwise(0.0).alias(f"x{i}") for i in range(1, most + 1)])
    fits = k.huber_fit(filled, [f"x{i}" for i in range(1, most + 1)])
    peers = [F.struct(F.element_at("peers", i)["peer"].alias("peer"), F.col(f"x{i}").alias("coef")) for i in range(1, most + 1)]
    rows = fits.join(names, KEYS).select(*KEYS, "sigma", F.array(F.struct(F.lit("").alias("peer"), F.col("intercept").alias("coef")), *[F.when(F.size("peers") >= i, p) for i, p in enumerate(peers, 1)]).alias("rows"))
    return rows.select(*KEYS, "sigma", F.explode(F.filter("rows", lambda x: x.isNotNull())).alias("r")).select(*KEYS, "sigma", "r.*")


def deviations(aligned: DataFrame, model: DataFrame) -> DataFrame:
    """Distance of each sample from its expectation, in sigmas; missing if any peer is."""
    base = model.where("peer = ''").select(*KEYS, "sigma", F.col("coef").alias("intercept"))
    met = aligned.join(model.where("peer <> ''").select(*KEYS, "peer", "coef"), [*KEYS, "peer"])
    summed = met.groupBy(*KEYS, "episode", "t", "v").agg(F.sum(F.col("coef") * F.col("u")).alias("part"), F.count("u").alias("seen"), F.count("*").alias("wanted"))
    expected = F.when(F.col("seen") == F.col("wanted"), F.col("part") + F.col("intercept"))
    return summed.join(base, KEYS).withColumn("expected", expected).select(*KEYS, "episode", "t", "v", "expected", ((F.col("v") - F.col("expected")) / F.greatest("sigma", F.lit(1e-12))).alias("deviation"))


def block_stats(dev: DataFrame, start: int, size: int, fine: int) -> DataFrame:
    """From ``start`` on: the largest fine block median, the slope of the block medians and their trend test."""
    after = dev.where(F.col("t") >= start).select(*KEYS, F.lit(0).alias("episode"), "t", F.col("deviation").alias("v"))
    blocks = k.block_medians(after, size).select(*KEYS, F.lit(0).alias("episode"), F.col("block").alias("t"), F.col("median").alias("v"))
    peak = k.block_medians(after, fine).groupBy(*KEYS).agg(F.max(F.abs("median")).alias("max_deviation"))
    return peak.join(trends.theil_sen(blocks).select(*KEYS, "slope"), KEYS, "left").join(trends.mann_kendall(blocks).select(*KEYS, "z", "p"), KEYS, "left")


def decide(stats: DataFrame, alarms: DataFrame, limit: float) -> DataFrame:
    """Drifting: far enough from the expectation, and with a trend or a CUSUM alarm."""
    first = alarms.groupBy(*KEYS).agg(F.min("alarm").alias("alarm"), F.min_by("onset", "alarm").alias("onset"))
    joined = stats.join(first, KEYS, "left")
    return joined.withColumn("drifting", (F.col("max_deviation") >= limit) & ((F.coalesce("p", F.lit(1.0)) < 0.01) | F.col("alarm").isNotNull()))


def choose_path(paths: DataFrame) -> DataFrame:
    """``path`` (in order of preference) and ``drifting``: the first drifting path, else the first there is."""
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("drifting"), "path"))
    return paths.withColumn("place", place).where("place = 1").drop("place")


def in_range(g: DataFrame, decided: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Whether the median of the block that ends at the alarm lies inside the baseline's p1..p99."""
    near = g.join(decided.select(*KEYS, "alarm"), KEYS).where((F.col("t") <= F.col("alarm")) & (F.col("t") > F.col("alarm") - size))
    middle = near.groupBy(*KEYS).agg(F.expr("percentile(v, 0.5)").alias("median"))
    return middle.join(edges, KEYS).select(*KEYS, "median", F.col("median").between(F.col("p1"), F.col("p99")).alias("in_range"))


def refits(aligned: DataFrame, suspects: DataFrame, baseline_end: int, limit: float) -> DataFrame:
    """Every peer of a suspect, fitted again without the suspect: is it still far from its expectation?

    All refits are rows of one job, keyed by the pair, and each pair is fitted once.
    """
    jobs = suspects.select("run_id", F.col("sensor").alias("suspect"))
    met = aligned.join(jobs, "run_id").where((F.col("sensor") != F.col("suspect")) & (F.col("peer") != F.col("suspect")))
    keyed = met.withColumn("sensor", F.concat_ws("|", "sensor", "suspect")).drop("suspect")
    keyed = durable(keyed)
    model = durable(fit_models(keyed, baseline_end))
    dev = deviations(keyed, model).where(F.col("t") >= baseline_end)
    far = dev.groupBy(*KEYS).agg(F.expr("percentile(abs(deviation), 0.5)").alias("typical"))
    split = far.select("run_id", F.split("sensor", r"\|")[0].alias("peer"), F.split("sensor", r"\|")[1].alias("suspect"), "typical")
    return durable(split.withColumn("flat", F.col("typical") < limit))


def responsible(peers: DataFrame, refit: DataFrame) -> DataFrame:
    """A suspect is responsible if all sensors that have it as a peer are flat once they are fitted without it."""
    touched = peers.select("run_id", F.col("sensor").alias("peer"), F.col("peer").alias("suspect"))
    return refit.join(touched, ["run_id", "peer", "suspect"]).groupBy("run_id", "suspect").agg(F.bool_and("flat").alias("responsible"), F.count("*").alias("n_peers"))


def victims(decided: DataFrame, refit: DataFrame, found: DataFrame) -> DataFrame:
    """Drifting sensors that go flat without a responsible one, each given to the first that explains it, in order of onset.

    The order matters, so it is a fold over the few drifting sensors of a run; runs are in parallel.
    """
    ship(decided.sparkSession)
    explained = refit.where("flat").join(found.where("responsible"), ["run_id", "suspect"]).join(decided.where("drifting").select("run_id", F.col("sensor").alias("peer"), "onset"), ["run_id", "peer"])

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, str] = {}
        for row in rows.sort_values(["onset", "suspect", "peer"]).itertuples():
            if row.peer not in taken and row.suspect not in taken:
                taken[row.peer] = row.suspect
        return pd.DataFrame({"run_id": rows["run_id"].iloc[0], "victim": list(taken), "driver": list(taken.values())})

    return explained.select("run_id", "suspect", "peer", "onset").groupBy("run_id").applyInPandas(assign, "run_id string, victim string, driver string")


def report(decided: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each drifting sensor: onset, delay, rate per 1000 samples, severity and confidence."""
    joined = decided.where("drifting").join(found.select("run_id", F.col("suspect").alias("sensor"), "responsible"), KEYS, "left")
    return joined.select(
        *KEYS, "onset", "alarm", (F.col("alarm") - F.col("onset")).alias("delay"), (F.col("slope") * 1000).alias("rate"), "z", "p", F.least(F.lit(1.0), F.col("max_deviation") / 10).alias("severity"), (1 - F.coalesce("p", F.lit(1.0))).alias("confidence"), F.coalesce("responsible", F.lit(False)).alias("responsible")
    )


def calibrate(dev: DataFrame, baseline_end: int, slacks: list[float], limits: list[float], segment: int) -> DataFrame:
    """False alarm and detection rates of every (slack, limit) on held-out baseline segments, clean and with a planted bias.

    Every combination is a row group of one job; the smallest limit with few false alarms is the choice.
    """
    base = dev.where(F.col("t") < baseline_end).select(*KEYS, F.expr(f"cast(t div {segment} as int)").alias("episode"), "t", F.col("deviation").alias("v"))
    ramp = F.col("v") + F.when(F.col("bias") > 0, F.col("bias") * (F.col("t") % segment) / segment).otherwise(0.0)
    copies = base.select("*", F.explode(F.array(*[F.lit(float(b)) for b in (0, 2, 4)])).alias("bias")).withColumn("v", ramp)
    out = None
    n = copies.select(*KEYS, "episode", "bias").distinct().groupBy("bias").agg(F.count("*").alias("segments"))
    for slack in slacks:
        for limit in limits:
            tagged = copies.withColumn("sensor", F.concat_ws("|", "sensor", "bias"))
            alarms = k.cusum(tagged, slack, limit).groupBy(F.split("sensor", r"\|")[1].cast("double").alias("bias")).agg(F.count("*").alias("alarms"))
            part = n.join(alarms, "bias", "left").select(F.lit(slack).alias("slack"), F.lit(limit).alias("limit"), "bias", "segments", (F.coalesce("alarms", F.lit(0)) / F.col("segments")).alias("rate"))
            out = part if out is None else out.unionByName(part)
    return out
