"""Statistical kernels over ``run_id, sensor, episode, t, v`` tables.

Every kernel is keyed by run and sensor; no statistic crosses an episode unless it is said to. A missing value is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.session import durable

KEYS = ["run_id", "sensor"]
MAD_SCALE = 1.4826


def in_episode() -> WindowSpec:
    return Window.partitionBy(*KEYS, "episode").orderBy("t")


def quantile(value: str, p: float) -> Column:
    return F.expr(f"coalesce(percentile({value}, {p}D), 0D)")


def quantiles(g: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles by linear interpolation; 0 for a sensor without values."""
    return g.groupBy(*KEYS).agg(*[quantile("v", p).alias(n) for n, p in probs.items()])


def bucket_means(g: DataFrame, size: int) -> DataFrame:
    return g.groupBy(*KEYS, F.expr(f"t div {size}").alias("bucket")).agg(F.avg("v").alias("v"))


def downsample(g: DataFrame, target: int) -> DataFrame:
    """At most ``target`` bucket means of each sensor."""
    span = Window.partitionBy(*KEYS)
    sized = g.withColumn("size", F.greatest(F.lit(1), F.ceil((F.max("t").over(span) - F.min("t").over(span) + 1) / target)).cast("long"))
    return sized.withColumn("bucket", F.expr("(t - min(t) OVER (PARTITION BY run_id, sensor)) div size")).groupBy(*KEYS, "bucket").agg(F.avg("v").alias("v"))


def mad(g: DataFrame, value: str = "v") -> DataFrame:
    """Median absolute deviation, scaled to a standard deviation."""
    center = g.groupBy(*KEYS).agg(F.expr(f"percentile({value}, 0.5)").alias("center"))
    away = g.join(center, KEYS).withColumn("away", F.abs(F.col(value) - F.col("center")))
    return away.groupBy(*KEYS).agg((quantile("away", 0.5) * MAD_SCALE).alias("mad"))


def diff(g: DataFrame) -> DataFrame:
    """First difference inside episodes; a missing neighbour gives a missing difference."""
    return g.withColumn("d", F.col("v") - F.lag("v").over(in_episode()))


def noise_level(g: DataFrame) -> DataFrame:
    return mad(diff(g), "d").select(*KEYS, (F.col("mad") / math.sqrt(2)).alias("noise"))


def step_size(g: DataFrame) -> DataFrame:
    """The smallest gap between sorted values that is more than a billionth of the value."""
    values = g.where("v is not null").select(*KEYS, "v").distinct()
    gap = values.withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy(*KEYS).orderBy("v")))
    return gap.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(F.col("gap") > 1e-9 * F.abs("v"), F.col("gap"))), F.lit(0.0)).alias("step"))


def run_lengths(g: DataFrame) -> DataFrame:
    """Runs of identical values, broken by missing values and by episodes."""
    changed = g.withColumn("change", F.when(F.col("v").isNull() | F.lag("v").over(in_episode()).isNull() | (F.col("v") != F.lag("v").over(in_episode())), 1).otherwise(0))
    island = changed.withColumn("island", F.sum("change").over(in_episode()))
    return island.where("v is not null").groupBy(*KEYS, "episode", "island").agg(F.count("*").alias("length"), F.min("t").alias("start"))


def run_stats(g: DataFrame) -> DataFrame:
    return run_lengths(g).groupBy(*KEYS).agg(F.max("length").alias("longest"), F.expr("percentile(length, 0.99)").alias("p99_run"), F.count("*").alias("n_runs"))


def hold(g: DataFrame) -> DataFrame:
    """The run length that covers more than 80% of the samples, else 1; the first seen on equal cover."""
    by_length = run_lengths(g).groupBy(*KEYS, "length").agg((F.count("*") * F.col("length")).alias("covered"), F.min("start").alias("start"))
    total = Window.partitionBy(*KEYS)
    best = by_length.withColumn("total", F.sum("covered").over(total)).withColumn("place", F.row_number().over(total.orderBy(F.desc("covered"), "start")))
    return best.where("place = 1").select(*KEYS, F.when(F.col("covered") > 0.8 * F.col("total"), F.col("length")).otherwise(1).alias("hold"))


def compress_hold(g: DataFrame, period: int) -> DataFrame:
    """The first value of each block of a sample-and-hold period."""
    return g.where("v is not null").groupBy(*KEYS, F.expr(f"t div {period}").alias("block")).agg(F.min_by("v", "t").alias("v"))


def histogram(g: DataFrame) -> DataFrame:
    """20 bins: below p1, 18 equal bins, above p99; every bin is listed."""
    edges = g.groupBy(*KEYS).agg(F.expr("percentile(v, 0.01)").alias("lo"), F.expr("percentile(v, 0.99)").alias("hi"))
    inside = F.least(F.lit(18), 1 + F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 18))
    bin_ = F.when(F.col("v") < F.col("lo"), 0).when(F.col("v") > F.col("hi"), 19).when(F.col("hi") <= F.col("lo"), 9).otherwise(inside).cast("int")
    counted = g.where("v is not null").join(edges, KEYS).groupBy(*KEYS, bin_.alias("bin")).agg(F.count("*").alias("n"))
    dense = edges.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(19))).alias("bin"))
    return dense.join(counted, [*KEYS, "bin"], "left").select(*KEYS, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def lagged(g: DataFrame, lags: list[int]) -> DataFrame:
    """Every sample with the one ``lag`` later in its episode."""
    ahead = g.select(*KEYS, "episode", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "t", F.col("v").alias("u"))
    later = g.select(*KEYS, "episode", F.col("t").alias("t2"), F.col("v").alias("w"))
    return ahead.withColumn("t2", F.col("t") + F.col("lag")).join(later, [*KEYS, "episode", "t2"])


def autocorrelation(g: DataFrame, most: int) -> DataFrame:
    """By lag; the denominator is over the whole series, pairs lie inside episodes."""
    mean = g.groupBy(*KEYS).agg(F.avg("v").alias("m"))
    centred = g.join(mean, KEYS).withColumn("v", F.col("v") - F.col("m")).drop("m")
    whole = centred.groupBy(*KEYS).agg(F.sum(F.col("v") * F.col("v")).alias("den"))
    pairs = lagged(centred, list(range(1, most + 1))).groupBy(*KEYS, "lag").agg(F.sum(F.col("u") * F.col("w")).alias("num"))
    return pairs.join(whole, KEYS).select(*KEYS, "lag", F.when(F.col("den") > 0, F.coalesce("num", F.lit(0.0)) / F.col("den")).otherwise(0.0).alias("acf"))


def acf_time(acf: DataFrame) -> DataFrame:
    """The first lag at which the autocorrelation is below 1/e; the last lag where there is none."""
    return acf.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(F.col("acf") < math.exp(-1), F.col("lag"))), F.max("lag")).alias("acf_time"))


def dominant_period(acf: DataFrame, least: float) -> DataFrame:
    """The highest local peak after the first negative lag, if it reaches ``least``."""
    order = Window.partitionBy(*KEYS).orderBy("lag")
    near = acf.withColumns({"before": F.lag("acf").over(order), "after": F.lead("acf").over(order), "first_negative": F.min(F.when(F.col("acf") < 0, F.col("lag"))).over(Window.partitionBy(*KEYS))})
    peak = near.where((F.col("lag") > F.col("first_negative")) & (F.col("acf") > F.col("before")) & (F.col("acf") >= F.col("after")) & (F.col("acf") >= least))
    found = peak.groupBy(*KEYS).agg(F.max_by("lag", F.struct("acf", -F.col("lag"))).alias("period"))
    return acf.select(*KEYS).distinct().join(found, KEYS, "left").select(*KEYS, F.coalesce("period", F.lit(0)).alias("period"))


def average_ranks(g: DataFrame) -> DataFrame:
    """Ranks with ties averaged; a missing value has no rank."""
    tie = Window.partitionBy(*KEYS, "v")
    ranked = g.where("v is not null").withColumn("rank", F.rank().over(Window.partitionBy(*KEYS).orderBy("v")) + (F.count("*").over(tie) - 1) / 2)
    return ranked.select(*KEYS, "episode", "t", "v", "rank")


def correlation(u: str, w: str) -> Column:
    """Pearson from complete pairs; 0 without variance."""
    return F.coalesce(F.when((F.stddev_pop(u) > 1e-12) & (F.stddev_pop(w) > 1e-12), F.try_divide(F.covar_pop(u, w), F.stddev_pop(u) * F.stddev_pop(w))), F.lit(0.0))


def spearman(g: DataFrame) -> DataFrame:
    """All pairs of sensors of a run; ranks are taken before pairing."""
    ranks = average_ranks(g)
    left, right = ranks.select("run_id", F.col("sensor").alias("a"), "t", F.col("rank").alias("u")), ranks.select("run_id", F.col("sensor").alias("b"), "t", F.col("rank").alias("w"))
    return left.join(right, ["run_id", "t"]).where("a < b").groupBy("run_id", "a", "b").agg(correlation("u", "w").alias("rho"), F.count("*").alias("n"))


def cross_correlation(g: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """``run_id, a, b`` to the best lag of b behind a: the largest absolute correlation, ties to the smaller lag."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    left = g.select("run_id", F.col("sensor").alias("a"), "episode", "t", F.col("v").alias("u"))
    right = g.select("run_id", F.col("sensor").alias("b"), "episode", F.col("t").alias("t2"), F.col("v").alias("w"))
    met = pairs.select("run_id", "a", "b", lags).join(left, ["run_id", "a"]).withColumn("t2", F.col("t") + F.col("lag")).join(right, ["run_id", "b", "episode", "t2"])
    rho = met.where("u is not null and w is not null").groupBy("run_id", "a", "b", "lag").agg(correlation("u", "w").alias("rho"))
    best = Window.partitionBy("run_id", "a", "b").orderBy(F.desc(F.round(F.abs("rho"), 9)), F.abs("lag"), "lag")
    return rho.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def cusum(g: DataFrame, slack: float, limit: float) -> DataFrame:
    """Two-sided CUSUM in closed form; alarm at the first upward crossing of an episode, onset at the last zero before it, or the episode's start.

    The recursion S = max(0, S + v - k) is the running sum minus its running minimum (0 at most), so no state is carried.
    A missing value adds 0.
    """
    upto = in_episode().rowsBetween(Window.unboundedPreceding, 0)
    out = g
    for side, sign in (("up", 1), ("down", -1)):
        out = out.withColumn("p", F.sum(F.coalesce(sign * F.col("v") - slack, F.lit(0.0))).over(upto))
        out = out.withColumn(f"s_{side}", F.col("p") - F.least(F.lit(0.0), F.min("p").over(upto)))
        out = out.withColumn(f"zero_{side}", F.coalesce(F.max(F.when(F.col(f"s_{side}") <= 0, F.col("t"))).over(upto), F.min("t").over(upto)))
    out = out.drop("p")
    crossed = (F.greatest("s_up", "s_down") > limit) & (F.coalesce(F.lag(F.greatest("s_up", "s_down")).over(in_episode()), F.lit(0.0)) <= limit)
    alarm = out.withColumn("crossed", crossed).where("crossed").withColumn("onset", F.when(F.col("s_up") >= F.col("s_down"), F.col("zero_up")).otherwise(F.col("zero_down")))
    return alarm.groupBy(*KEYS, "episode").agg(F.min("t").alias("alarm"), F.min_by("onset", "t").alias("onset"))


def standardised(g: DataFrame) -> DataFrame:
    """Values less their median, by their scaled MAD."""
    center = g.groupBy(*KEYS).agg(F.expr("percentile(v, 0.5)").alias("center"))
    return g.join(center, KEYS).join(mad(g), KEYS).withColumn("v", (F.col("v") - F.col("center")) / F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0)).drop("center", "mad")


def mid_quantiles(value: Column | str, count: int) -> Column:
    probs = ", ".join(f"{(k + 0.5) / count}D" for k in range(count))
    return F.expr(f"percentile({value}, array({probs}))")


def wasserstein(left: Column, right: Column) -> Column:
    """Mean distance of two equally long arrays of quantiles."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(left)


def window_distance(g: DataFrame, border: int, count: int = 200) -> DataFrame:
    """Wasserstein-1 distance between the values before and from ``border`` on."""
    sides = g.groupBy(*KEYS).agg(mid_quantiles(f"CASE WHEN t < {border} THEN v END", count).alias("a"), mid_quantiles(f"CASE WHEN t >= {border} THEN v END", count).alias("b"))
    return sides.select(*KEYS, wasserstein(F.col("a"), F.col("b")).alias("distance"))


def rolling_median(g: DataFrame, half: int = 3) -> DataFrame:
    frame = f"OVER (PARTITION BY run_id, sensor, episode ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return g.withColumn("median", F.expr(f"percentile(v, 0.5) {frame}"))


def array_median(values: Column) -> Column:
    """The median of an array without nulls."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.element_at(ordered, F.floor((n - 1) / 2).cast("int") + 1), F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def hampel(g: DataFrame, k: float, half: int = 3) -> DataFrame:
    """Spikes: further from the window's median than ``k`` scaled MADs of the window; needs 3 values."""
    near = g.withColumn("near", F.collect_list("v").over(in_episode().rowsBetween(-half, half)))
    center = near.withColumn("median", array_median(F.col("near")))
    spread = center.withColumn("spread", MAD_SCALE * array_median(F.transform("near", lambda x: F.abs(x - F.col("median")))))
    spike = (F.size("near") >= 3) & F.col("v").isNotNull() & (F.abs(F.col("v") - F.col("median")) > k * F.col("spread"))
    return spread.withColumn("spike", F.coalesce(spike, F.lit(False))).drop("near")


def block_medians(g: DataFrame, size: int) -> DataFrame:
    """Medians of fixed blocks; the last one takes the remainder."""
    ends = g.groupBy(*KEYS).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    count = F.greatest(F.lit(1), F.expr(f"(hi - lo + 1) div {size}"))
    keyed = g.join(ends, KEYS).withColumn("block", F.least(F.expr(f"(t - lo) div {size}"), count - 1))
    return keyed.groupBy(*KEYS, "block").agg(F.avg("t").alias("center"), F.expr("percentile(v, 0.5)").alias("median"))


def best_splits(segments: DataFrame, least: int | Column) -> DataFrame:
    """``run_id, sensor, segment, t, v`` (complete) to the cut of each segment that lowers the squared error most.

    Costs of all cuts of all segments come from running sums, in one pass.
    """
    own = Window.partitionBy(*KEYS, "segment")
    upto = own.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    centred = segments.withColumn("c", F.col("v") - F.avg("v").over(own))  # so that large values don't cancel
    sums = centred.withColumns({"n1": F.count("*").over(upto), "s1": F.sum("c").over(upto), "n": F.count("*").over(own)})
    gain = F.col("s1") * F.col("s1") * F.col("n") / (F.col("n1") * (F.col("n") - F.col("n1")))
    cut = sums.where((F.col("n1") >= least) & (F.col("n") - F.col("n1") >= least)).withColumn("gain", gain).withColumn("cut_t", F.col("t") + 1)
    order = own.orderBy(F.desc(round_sig(F.col("gain"), 9)), "cut_t")
    return cut.withColumn("place", F.row_number().over(order)).where("place = 1").select(*KEYS, "segment", "cut_t", "gain")


#: Bucket means of a run that a segmentation works on.
MOST_POINTS = 4096


def change_points(g: DataFrame, least: int | None = None) -> DataFrame:
    """Binary segmentation on bucket means, level by level: in every round all segments of all sensors split at once where the gain pays, until none does.

    A split pays if it lowers the squared error by more than 2 ln(points) squared scales; the scale is the larger of MAD and noise, or the deviation where
    both are 0. Segments keep ``least`` points (default: a hundredth of the run), so rounds end. Cuts at the ends of episodes don't count.
    """
    c = F.col
    runs = durable(g.groupBy("run_id").agg(F.min("t").alias("lo"), (F.max("t") - F.min("t") + 1).alias("span")).withColumn("bucket", F.ceil(c("span") / MOST_POINTS).cast("long")))
    small = F.broadcast(runs)  # one row for each run
    center = g.groupBy(*KEYS).agg(F.expr("percentile(v, 0.5)").alias("center"))
    spread = g.join(center, KEYS).groupBy(*KEYS).agg(F.sqrt(F.avg((c("v") - c("center")) * (c("v") - c("center")))).alias("spread"))
    scale = F.when(F.greatest("mad", "noise") > 0, F.greatest("mad", "noise")).otherwise(F.coalesce("spread", F.lit(0.0)))
    price = mad(g).join(noise_level(g), KEYS).join(spread, KEYS).join(small, "run_id").select(*KEYS, (2 * F.log(F.ceil(c("span") / c("bucket")).cast("double")) * F.greatest(scale * scale, F.lit(1e-18))).alias("price"))
    points = g.where("v is not null").join(small, "run_id").groupBy(*KEYS, c("episode").cast("string").alias("segment"), F.expr("(t - lo) div bucket").alias("t"), "span", "bucket").agg(F.avg("v").alias("v"))
    fewest = F.greatest(F.lit(2), F.ceil(F.greatest(2 * c("bucket"), F.expr("span div 100")) / c("bucket"))) if least is None else F.lit(least)
    segments, price, found = durable(points.withColumn("least", fewest).drop("span", "bucket")), durable(price), None
    while True:
        paid = durable(best_splits(segments, c("least")).join(price, KEYS).where("gain > price").select(*KEYS, "segment", "cut_t", "gain"))
        found = paid if found is None else found.unionByName(paid)
        if paid.isEmpty():
            break
        cuts = paid.drop("gain")
        segments = durable(segments.join(cuts, [*KEYS, "segment"], "inner").withColumn("segment", F.concat("segment", F.when(c("t") < c("cut_t"), "l").otherwise("r"))).drop("cut_t"))
    placed = found.join(small, "run_id").select(*KEYS, (c("lo") + c("cut_t") * c("bucket")).alias("cut_t"), "gain", F.greatest(F.lit(2), F.expr("span div 1000")).alias("slack"))
    ends = g.groupBy("run_id", "episode").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b")).select(F.col("run_id").alias("of"), F.explode(F.array("a", "b")).alias("end"))
    return placed.join(ends, (c("of") == c("run_id")) & (F.abs(c("cut_t") - c("end")) <= c("slack")), "left_anti").select(*KEYS, "cut_t", "gain")


def round_sig(value: Column, digits: int = 3) -> Column:
    """A number rounded to significant digits."""
    return F.format_string(f"%.{digits - 1}e", value).cast("double")


def rolling_distance(g: DataFrame, width: int, border: int, count: int = 50) -> DataFrame:
    """Wasserstein-1 of windows of ``width``, one every quarter of it, to the values before ``border``."""
    stride = max(1, width // 4)
    reference = g.where(F.col("t") < border).groupBy(*KEYS).agg(mid_quantiles("v", count).alias("a"))
    first = F.expr(f"t div {stride}")
    ends = F.explode(F.sequence(first, first + (width // stride - 1))).alias("window")
    windows = g.where("v is not null").select(*KEYS, "t", "v", ends).groupBy(*KEYS, "window").agg(mid_quantiles("v", count).alias("b"), F.count("*").alias("n"))
    return windows.where(F.col("n") >= width // 2).join(reference, KEYS).select(*KEYS, "window", "n", wasserstein(F.col("a"), F.col("b")).alias("distance"))


def inject_fault(g: DataFrame, kind: str, start: int, size: float, scale: DataFrame) -> DataFrame:
    """A copy with a fault from ``start`` on, ``size`` times the sensor's scale (``run_id, sensor, scale``) strong."""
    s = F.col("scale") * size
    changed = {
        "bias": F.col("v") + s,
        "ramp": F.col("v") + s * (F.col("t") - start) / 100,
        "gain": F.col("v") * (1 + size / 10),
        "step": F.col("v") + F.when(F.col("t") >= start + 20, s).otherwise(0.0),
        "dead": F.first("v", ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "spikes": F.col("v") + F.when(F.pmod(F.col("t"), F.lit(17)) == 0, s * 5).otherwise(0.0),
        "noise": F.col("v") + s * (F.pmod(F.col("t") * 7919, F.lit(201)) - 100) / 100,
        "resolution": F.when(s > 0, F.round(F.col("v") / s) * s).otherwise(F.col("v")),
        "dropout": F.when(F.pmod(F.xxhash64("run_id", "sensor", "t"), F.lit(100)) < int(10 * size), None).otherwise(F.col("v")),
    }[kind]
    return g.join(scale, KEYS).withColumn("v", F.when(F.col("t") >= start, changed).otherwise(F.col("v"))).drop("scale")


def huber(x, y, rounds: int = 5):
    """Coefficients and scale of a robust fit: weights fall off beyond 1.345 scaled residuals, a small ridge keeps the normal equations solvable."""
    import numpy as np

    w, beta, sigma = np.ones(len(y)), np.zeros(x.shape[1]), 0.0
    for _ in range(rounds if len(y) > x.shape[1] else 0):
        beta = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-8 * np.eye(x.shape[1]), x.T @ (w * y))
        rest = y - x @ beta
        sigma = MAD_SCALE * float(np.median(np.abs(rest - np.median(rest))))
        if sigma <= 0:
            break
        w = 1 / np.maximum(1, np.abs(rest) / (1.345 * sigma))
    return beta, sigma


def huber_fit(rows: DataFrame, regressors: list[str], rounds: int = 5) -> DataFrame:
    """``run_id, sensor, y`` and regressors to the coefficients of a robust fit, one small fit per sensor, many in parallel."""
    import numpy as np
    import pandas as pd

    from tideline.session import ship

    ship(rows.sparkSession)
    names = ["intercept", *regressors]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        complete = pdf.dropna(subset=["y", *regressors])
        x = np.column_stack([np.ones(len(complete)), complete[regressors].to_numpy(float)])
        beta, sigma = huber(x, complete["y"].to_numpy(float), rounds)
        return pd.DataFrame([[*pdf[KEYS].iloc[0], len(x), sigma, *beta]], columns=[*KEYS, "n", "sigma", *names])

    schema = "run_id string, sensor string, n long, sigma double, " + ", ".join(f"{n} double" for n in names)
    return rows.groupBy(*KEYS).applyInPandas(fit, schema)
