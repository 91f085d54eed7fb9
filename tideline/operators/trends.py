"""Trends of series of any length: Mann-Kendall by counting inversions in blocks, Theil-Sen by all pairs of a short series and sampled pairs of a long one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import running_count
from tideline.session import durable, ship

KEYS = ["run_id", "sensor"]
#: Places in time of one block; most ranges of values, whatever the length.
BLOCK, MOST_RANGES = 8192, 4096
#: A series with more values than this is judged by so many sampled pairs.
ALL_PAIRS, SAMPLED = 1500, 200_000


def pair_signs(values: np.ndarray, groups: np.ndarray | None = None) -> int:
    """The sum of sign(later - earlier) over all pairs in order of time, of one group each; in linear-log work.

    Ranks are read bit by bit from the top: of pairs that agree above a bit and differ in it, those with 0 before 1 go up. Each bit is a running
    sum; then the values are dealt by the bits read so far, in unchanged order of time.
    """
    if len(values) < 2:
        return 0
    levels, rank = np.unique(values, return_inverse=True)
    bits = int(len(levels) - 1).bit_length()
    key = rank if groups is None else (groups.astype(np.int64) << bits) + rank
    key, total = key[np.argsort(key >> bits, kind="stable")], 0
    for bit in range(bits - 1, -1, -1):
        one, above = (key >> bit) & 1, key >> (bit + 1)
        first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        zeros = np.cumsum(1 - one)
        before = zeros - np.repeat(zeros[first] - (1 - one[first]), sizes)
        ups, ones = int((before * one).sum()), np.add.reduceat(one, first)
        total += 2 * ups - int((ones * (sizes - ones)).sum())
        key = key[np.argsort(key >> bit, kind="stable")]
    return total


def one_block(rows: DataFrame) -> DataFrame:
    """``s`` of series that lie in one block each."""

    def count(block: pa.Table) -> pa.Table:
        block = block.sort_by("t")
        return pa.table([block["run_id"].slice(0, 1), block["sensor"].slice(0, 1), pa.array([float(pair_signs(block["v"].to_numpy()))])], names=[*KEYS, "s"])

    return rows.groupBy(*KEYS).applyInArrow(count, "run_id string, sensor string, s double")


def many_blocks(rows: DataFrame, block: int, ranges: int) -> DataFrame:
    """``s`` of series over many blocks of time and ranges of values.

    A pair lies in one block, or in one range, or in neither: pairs of one block are counted there, pairs of one range there, those of one block and one range are
    taken off once, and all others follow from how many values each block has in each range, by running sums over blocks, then over ranges. Ranges
    begin at approximate quantiles; the values equal to one are a range of their own, which has no pair to count, so a very frequent value meets nowhere.
    """
    edges = rows.groupBy(*KEYS).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [(k + 1) / ranges for k in range(ranges - 1)] or [0.5], 10_000))).alias("edges"))
    dealt = rows.withColumn("place", F.floor(F.col("t") / block))
    told = dealt.select(*KEYS, "place").distinct().join(edges, KEYS).select(F.col("run_id").alias("of_run"), F.col("sensor").alias("of_sensor"), F.col("place").alias("at"), "edges")

    def cells(block: pa.Table, told: pa.Table) -> pa.Table:
        block = block.sort_by("t")
        v, t, borders = block["v"].to_numpy(), block["t"].to_numpy(), np.array(told["edges"][0].as_py())
        low, high = np.searchsorted(borders, v, "left"), np.searchsorted(borders, v, "right")
        which = low + high  # odd: equal to a border
        order = np.argsort(which, kind="stable")
        named, first = np.unique(which[order], return_index=True)
        parts = np.split(order, first[1:])
        open_ = named % 2 == 0
        same = lambda x: pa.array([x] * len(named))
        times, values = ([a[p].tolist() if o else [] for p, o in zip(parts, open_)] for a in (t, v))
        inside = np.zeros(len(named))
        inside[0] = pair_signs(v) - pair_signs(v, which)  # pairs of one block, without those of one range
        return pa.table(
            [same(block["run_id"][0].as_py()), same(block["sensor"][0].as_py()), same(block["place"][0].as_py()), pa.array(named, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(inside), pa.array(times, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))],
            names=[*KEYS, "place", "range", "n", "inside", "ts", "vs"],
        )

    schema = "run_id string, sensor string, place long, range long, n long, inside double, ts array<long>, vs array<double>"
    cell = durable(dealt.groupBy(*KEYS, "place").cogroup(told.groupBy("of_run", "of_sensor", "at")).applyInArrow(cells, schema))

    def level(part: pa.Table) -> pa.Table:
        t, v = (pa.concat_arrays([x.values for x in part[n] if len(x)]).to_numpy() if part.num_rows else np.zeros(0) for n in ("ts", "vs"))
        return pa.table([part["run_id"].slice(0, 1), part["sensor"].slice(0, 1), pa.array([float(pair_signs(v[np.argsort(t, kind="stable")]))])], names=[*KEYS, "s"])

    levels = cell.where("range % 2 = 0").select(*KEYS, "range", "ts", "vs").groupBy(*KEYS, "range").applyInArrow(level, "run_id string, sensor string, s double")
    every = cell.select(*KEYS, "place").distinct().join(cell.select(*KEYS, "range").distinct(), KEYS)  # of one series
    dense = every.join(cell.select(*KEYS, "place", "range", "n"), [*KEYS, "place", "range"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    earlier = dense.withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy(*KEYS, "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = Window.partitionBy(*KEYS, "place")
    below = F.coalesce(F.sum("earlier").over(place.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = earlier.withColumns({"below": below, "all": F.sum("earlier").over(place)}).select(*KEYS, (F.col("n") * (2 * F.col("below") + F.col("earlier") - F.col("all"))).cast("double").alias("s"))
    parts = cell.select(*KEYS, F.col("inside").alias("s")).unionByName(levels).unionByName(crossing)
    return parts.groupBy(*KEYS).agg(F.sum("s").alias("s"))


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative number, by the five-term rational approximation 7.1.26 of Abramowitz and Stegun."""
    # The published coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    u = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * u
    return poly * F.exp(-x * x)


def mann_kendall(g: DataFrame, block: int = BLOCK) -> DataFrame:
    """S, its variance corrected for ties, z with continuity correction and the two-sided p; series of fewer than three values have no trend."""
    ship(g.sparkSession)
    rows = durable(g.where("v is not null").select(*KEYS, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")))
    most = rows.groupBy(*KEYS).agg((F.floor(F.max("t") / block) - F.floor(F.min("t") / block) + 1).alias("blocks")).agg(F.max("blocks")).first()[0] or 1
    s = one_block(rows) if most == 1 else many_blocks(rows, block, min(most, MOST_RANGES))
    ties = rows.groupBy(*KEYS, "v").agg(F.count("*").alias("k"))
    n = ties.groupBy(*KEYS).agg(F.sum("k").alias("n"), F.sum(F.expr("cast(k as double) * (k - 1) * (2 * k + 5)")).alias("tied"))
    var = s.join(n, KEYS).withColumn("var", F.expr("(cast(n as double) * (n - 1) * (2 * n + 5) - tied) / 18D")).withColumn("s", F.when(F.col("n") >= 3, F.col("s")).otherwise(0.0))
    z = var.withColumn("z", F.when(F.col("var") > 0, (F.col("s") - F.signum("s")) / F.sqrt("var")).otherwise(0.0))
    return z.select(*KEYS, "s", "var", "z", erfc(F.abs("z") / math.sqrt(2)).alias("p"))


def theil_sen(g: DataFrame, all_pairs: int = ALL_PAIRS, sampled: int = SAMPLED) -> DataFrame:
    """Median slope and intercept: all pairs of a series of at most ``all_pairs`` values, ``sampled`` pairs picked by hash of a longer one."""
    ship(g.sparkSession)
    rows = durable(g.where("v is not null").select(*KEYS, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")))
    size = rows.groupBy(*KEYS).agg(F.count("*").alias("n"))

    def fit(series: pa.Table) -> pa.Table:
        t, v = (series[n].to_numpy().astype(float) for n in ("t", "v"))
        a, b = np.triu_indices(len(t), 1)
        run = t[b] - t[a]
        slopes = (v[b] - v[a])[run != 0] / run[run != 0]
        return pa.table([series["run_id"].slice(0, 1), series["sensor"].slice(0, 1), pa.array([float(np.median(slopes)) if len(slopes) else 0.0])], names=[*KEYS, "slope"])

    short = rows.join(size.where(F.col("n") <= all_pairs).select(*KEYS), KEYS).groupBy(*KEYS).applyInArrow(fit, "run_id string, sensor string, slope double")
    long = size.where(F.col("n") > all_pairs)
    slope = short
    if not long.isEmpty():
        at = lambda salt: 1 + F.pmod(F.xxhash64(F.lit(salt), *KEYS, "k"), F.col("n"))
        picked = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(sampled)))).select(*KEYS, at(1).alias("a"), at(2).alias("b"))
        numbered = running_count(rows.join(long.select(*KEYS), KEYS), KEYS, "t", F.lit(True), "nth")
        side = lambda nth, t, v: numbered.select(*KEYS, F.col("nth").alias(nth), F.col("t").alias(t), F.col("v").alias(v))
        met = picked.join(side("a", "t1", "v1"), [*KEYS, "a"]).join(side("b", "t2", "v2"), [*KEYS, "b"]).where("t1 <> t2")
        slope = short.unionByName(met.groupBy(*KEYS).agg(F.expr("percentile((v2 - v1) / (t2 - t1), 0.5)").alias("slope")))
    rest = rows.join(slope, KEYS).groupBy(*KEYS, "slope").agg(F.expr("percentile(v - slope * t, 0.5)").alias("intercept"))
    return rest.select(*KEYS, "slope", "intercept")
