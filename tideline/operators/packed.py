"""Series as rows. A run's grid is bounded by buckets and sensors, so a series fits a row, and one pass over such rows stands for many joins of samples.

``pack`` makes a row of each series. A pass is a map over rows in Arrow batches, series in parallel; where the sensors of a run meet, it is a task for each
run. What a pass returns are few rows for each series, which Spark joins and groups. The column forms in ``kernels``, ``health``, ``relations`` and ``drift`` say
the same for tables of any shape; tests hold the passes against them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.kernels import KEYS, MAD_SCALE, MOST_POINTS, huber
from tideline.operators.trends import pair_signs
from tideline.session import durable, ship

CELLS = "array<struct<t: long, episode: int, v: double>>"
MOVES = "array<struct<t: long, episode: int, v: double, expected: double, deviation: double>>"


def pack(g: DataFrame) -> DataFrame:
    """``run_id, sensor, s``: one row for each series, its samples by time."""
    cell = F.struct(F.col("t").cast("long").alias("t"), F.col("episode").cast("int").alias("episode"), F.col("v").cast("double").alias("v"))
    return g.groupBy(*KEYS).agg(F.sort_array(F.collect_list(cell)).alias("s"))


def unpack(packed: DataFrame, column: str = "s") -> DataFrame:
    return packed.select(*[c for c in packed.columns if c != column], F.inline(column))


def shifted(packed: DataFrame, start: str, zero: str) -> DataFrame:
    """Samples from ``start`` on, with time counted from ``zero``; both are columns, which stay behind."""
    later = F.filter("s", lambda x: x["t"] >= F.col(start))
    return packed.withColumn("s", F.transform(later, lambda x: F.struct((x["t"] - F.col(zero)).alias("t"), x["episode"].alias("episode"), x["v"].alias("v"))))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def as_table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; a list of structs is given as a struct array."""
    columns = []
    for field in schema:
        values = [r.get(field.name) for r in rows]
        if any(isinstance(x, pa.Array) for x in values):
            offsets = np.cumsum([0, *map(len, values)])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(values)).cast(field.type))
        else:
            columns.append(pa.array([None if isinstance(x, float) and math.isnan(x) else x for x in values], field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def samples(cells: pa.StructArray | None, names: tuple[str, ...] = ("t", "episode", "v")) -> list[np.ndarray]:
    """Columns of a row's samples; a missing value is NaN."""
    if cells is None:
        return [np.zeros(0) for _ in names]
    return [cells.field(n).to_numpy(zero_copy_only=False) for n in names]


def struct_of(**columns: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, from_pandas=True) for c in columns.values()], names=list(columns))


def each(packed: DataFrame, make: Callable[..., Iterator[dict]], ddl: str, column: str = "s", names: tuple[str, ...] = ("t", "episode", "v")) -> DataFrame:
    """``make(*samples, **other columns)`` gives the result rows of a series; the keys go in front."""
    ship(packed.sparkSession)
    ddl = f"run_id string, sensor string, {ddl}"
    schema, others = arrow_schema(ddl), [c for c in packed.columns if c not in (*KEYS, column)]

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key = {c: batch[c][i].as_py() for c in KEYS}
                out += [key | row for row in make(*samples(batch[column][i].values, names), **{c: batch[c][i].as_py() for c in others})]
            yield as_table(out, schema)

    return packed.mapInArrow(run, ddl)


# -- statistics of one series


def median(v: np.ndarray) -> float:
    v = v[~np.isnan(v)]
    return float(np.median(v)) if len(v) else math.nan


def quantile(v: np.ndarray, p: float) -> float:
    v = v[~np.isnan(v)]
    return float(np.quantile(v, p)) if len(v) else math.nan


def mad(v: np.ndarray) -> float:
    """Scaled; 0 without values."""
    v = v[~np.isnan(v)]
    return MAD_SCALE * float(np.median(np.abs(v - np.median(v)))) if len(v) else 0.0


def differences(episode: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = np.full(len(v), np.nan)
    same = episode[1:] == episode[:-1]
    d[1:][same] = (v[1:] - v[:-1])[same]
    return d


def noise(episode: np.ndarray, v: np.ndarray) -> float:
    return mad(differences(episode, v)) / math.sqrt(2)


def borders(*columns: np.ndarray) -> np.ndarray:
    """Where stretches of equal values begin, and the end."""
    many = len(columns[0])
    change = np.zeros(max(0, many - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [many])) if many else np.zeros(1, np.int64)


def run_sizes(episode: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of one value, broken by missing values and by episodes."""
    edges = borders(episode, np.where(np.isnan(v), np.arange(len(v)) + 0.5, 0), np.where(np.isnan(v), np.inf, v))
    starts, sizes = edges[:-1], np.diff(edges)
    real = ~np.isnan(v[starts]) if len(starts) else np.zeros(0, bool)
    return starts[real], sizes[real]


def least_gap(v: np.ndarray) -> float:
    """The smallest gap between sorted values that is more than a billionth of the value; 0 without one."""
    levels = np.unique(v[~np.isnan(v)])
    gap = np.diff(levels)
    gap = gap[gap > 1e-9 * np.abs(levels[1:])]
    return float(gap.min()) if len(gap) else 0.0


def row_median(sorted_rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    at = np.arange(len(count))
    low, high = np.maximum((count - 1) // 2, 0), np.minimum(count // 2, sorted_rows.shape[1] - 1)
    return np.where(count > 0, (sorted_rows[at, low] + sorted_rows[at, high]) / 2, np.nan)


def spikes(episode: np.ndarray, v: np.ndarray, limit: float = 3.0, half: int = 3) -> np.ndarray:
    """Hampel flags: further from the window's median than ``limit`` scaled MADs of the window; needs 3 values."""
    out = np.zeros(len(v), bool)
    edges = borders(episode)
    for a, b in zip(edges[:-1], edges[1:]):
        padded = np.concatenate((np.full(half, np.nan), v[a:b], np.full(half, np.nan)))
        near = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)  # NaN goes last
        count = (~np.isnan(near)).sum(1)
        center = row_median(near, count)
        spread = MAD_SCALE * row_median(np.sort(np.abs(near - center[:, None]), axis=1), count)
        with np.errstate(invalid="ignore"):
            out[a:b] = (count >= 3) & (np.abs(v[a:b] - center) > limit * spread)
    return out


def block_medians(t: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Medians of fixed blocks from the first time on; the last one takes the rest."""
    if not len(t):
        return np.zeros(0)
    count = max(1, int(t[-1] - t[0] + 1) // size)
    if len(t) == t[-1] - t[0] + 1 and count > 1:  # no step is left out: all but the last block are rows of one matrix
        rows = np.sort(v[: (count - 1) * size].reshape(count - 1, size), axis=1)
        return np.append(row_median(rows, (~np.isnan(rows)).sum(1)), median(v[(count - 1) * size :]))
    block = np.minimum((t - t[0]) // size, count - 1)
    edges = borders(block)
    return np.array([median(v[a:b]) for a, b in zip(edges[:-1], edges[1:])])


def trend(y: np.ndarray) -> tuple[float, float, float]:
    """Theil-Sen slope over all pairs (of few blocks), Mann-Kendall z and p; missing values are left out."""
    x = np.flatnonzero(~np.isnan(y))
    y, n = y[x], len(x)
    a, b = np.triu_indices(n, 1)
    slope = float(np.median((y[b] - y[a]) / (x[b] - x[a]))) if n > 1 else 0.0
    _, ties = np.unique(y, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
    s = pair_signs(y) if n > 2 else 0
    z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
    return slope, float(z), math.erfc(abs(z) / math.sqrt(2))


def one_sided(v: np.ndarray, slack: float | np.ndarray) -> np.ndarray:
    """The recursion max(0, s + v - slack) along the last axis; a missing value adds 0."""
    p = np.cumsum(np.where(np.isnan(v), 0.0, v - slack), axis=-1)
    return p - np.minimum(0.0, np.minimum.accumulate(p, axis=-1))


def first_alarm(t: np.ndarray, episode: np.ndarray, v: np.ndarray, slack: float, limit: float) -> tuple[int, int] | None:
    """The first upward crossing of a two-sided CUSUM that begins anew with each episode, and its onset: the last zero before, or the episode's start."""
    edges = borders(episode)
    for a, b in zip(edges[:-1], edges[1:]):
        up, down = one_sided(v[a:b], slack), one_sided(-v[a:b], slack)
        over = np.flatnonzero(np.maximum(up, down) > limit)
        if len(over):
            at = int(over[0])
            zeros = np.flatnonzero((up if up[at] >= down[at] else down)[: at + 1] <= 0)
            return int(t[a + at]), int(t[a + (zeros[-1] if len(zeros) else 0)])
    return None


def autocorrelation(t: np.ndarray, episode: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Of lags 1 to ``most``; the denominator is over the whole series, pairs lie inside episodes."""
    if not len(t):
        return np.zeros(most)
    span = int(t[-1] - t[0]) + 1
    c, e = np.full(span, np.nan), np.full(span, -1, np.int64)
    c[t - t[0]], e[t - t[0]] = v - np.nanmean(v) if (~np.isnan(v)).any() else v, episode
    whole = float(np.nansum(c * c))
    sums = [float(np.nansum((c[:-k] * c[k:])[e[:-k] == e[k:]])) if k < span else 0.0 for k in range(1, most + 1)]
    return np.array(sums) / whole if whole > 0 else np.zeros(most)


def period_of(acf: np.ndarray, least: float = 0.5) -> int:
    """The lag of the highest local peak after the first negative one, if it reaches ``least``, else 0; ``acf`` begins with lag 1."""
    below = np.flatnonzero(acf < 0)
    peaks = [k for k in range(below[0] + 1, len(acf) - 1) if acf[k] > acf[k - 1] and acf[k] >= acf[k + 1] and acf[k] >= least] if len(below) else []
    return int(max(peaks, key=lambda k: (acf[k], -k))) + 1 if peaks else 0


# -- passes


def change_points(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """Binary segmentation as in ``kernels.change_points``, a series in a task; ``runs`` has ``lo, span, bucket, episode ends`` of each run."""

    def cuts(t, episode, v, lo, span, bucket):
        price = max(mad(v), noise(episode, v)) or float(np.sqrt(np.nanmean((v - median(v)) ** 2)) if (~np.isnan(v)).any() else 0.0)
        price = 2 * math.log(math.ceil(span / bucket)) * max(price * price, 1e-18)
        least = max(2, math.ceil(max(2 * bucket, span // 100) / bucket))
        real = ~np.isnan(v)
        place, episode, v = (t[real] - lo) // bucket, episode[real], v[real]
        edges = borders(place, episode)
        sums = np.add.reduceat(v, edges[:-1]) if len(v) else v
        points, means, of = place[edges[:-1]] if len(v) else place, sums / np.diff(edges) if len(v) else v, episode[edges[:-1]] if len(v) else episode
        spans = borders(of)
        todo = list(zip(spans[:-1], spans[1:]))
        while todo:
            a, b = todo.pop()
            n = b - a
            if n < 2 * least:
                continue
            first = np.arange(least, n - least + 1)
            s = np.cumsum(means[a:b] - means[a:b].mean())[first - 1]
            gain = s * s * n / (first * (n - first))
            best = int(np.flatnonzero(gain >= gain.max() * (1 - 1e-9))[0])
            if gain[best] > price:
                cut = a + int(first[best])
                yield {"cut_t": int(lo + (points[cut - 1] + 1) * bucket), "gain": float(gain[best])}
                todo += [(a, cut), (cut, b)]

    found = each(packed.join(F.broadcast(runs.select("run_id", "lo", "span", "bucket")), "run_id"), cuts, "cut_t long, gain double")  # a row for each run
    slack = F.greatest(F.lit(2), F.expr("span div 1000"))
    ends = F.broadcast(runs.select("run_id", "span", "ends"))
    return found.join(ends, "run_id").where(~F.exists("ends", lambda e: F.abs(F.col("cut_t") - e) <= slack)).select(*KEYS, "cut_t", "gain")


def episode_ends(packed: DataFrame) -> DataFrame:
    """``run_id, sensor, episode, a, b``: the first step of each episode of a series and the one after its last."""

    def one(t, episode, v):
        edges = borders(episode)
        for a, b in zip(edges[:-1], edges[1:]):
            yield {"episode": int(episode[a]), "a": int(t[a]), "b": int(t[b - 1]) + 1}

    return each(packed.select(*KEYS, "s"), one, "episode int, a long, b long")


def run_spans(ends: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """``run_id, lo, span, bucket, ends``: first step, length, steps of a bucket, and where episodes begin and end."""
    of = ends.groupBy("run_id", "episode").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    whole = of.groupBy("run_id").agg(F.min("a").alias("lo"), (F.max("b") - F.min("a")).alias("span"), F.flatten(F.collect_list(F.array("a", "b"))).alias("ends"))
    return whole.withColumn("bucket", F.ceil(F.col("span") / most).cast("long"))


def changes(packed: DataFrame, points: DataFrame) -> DataFrame:
    """As ``signals.changes``: every change point with the medians of the segments beside it and the scale before it."""

    def moves(t, episode, v, cuts):
        edges = [-math.inf, *sorted(cuts), math.inf]
        for a, cut, b in zip(edges, edges[1:-1], edges[2:]):
            left, right = v[(t >= a) & (t < cut)], v[(t >= cut) & (t < b)]
            before, after, scale = median(left), median(right), mad(left)
            yield {"cut_t": int(cut), "before": before, "after": after, "scale": scale, "move": abs(after - before) / max(scale, 1e-12)}

    listed = points.groupBy(*KEYS).agg(F.collect_set("cut_t").alias("cuts"))
    return each(packed.join(listed, KEYS), moves, "cut_t long, before double, after double, scale double, move double")


def tiles(t: np.ndarray, episode: np.ndarray, size: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Part (0 before ``end``) and block of each sample, as in ``health.with_blocks``."""
    part = (t >= end).astype(np.int64)
    edges, block = borders(episode, part), t.copy()
    for a, b in zip(edges[:-1], edges[1:]):
        lo, hi = t[a], t[b - 1]
        block[a:b] = lo + np.minimum((t[a:b] - lo) // size, max(1, (hi - lo + 1) // size) - 1) * size
    return part, block


def health_blocks(packed: DataFrame, size: int) -> DataFrame:
    """As ``health.block_stats``; ``packed`` has the baseline's end ``end``. Each row also has the baseline's p1, p99, distinct values and count."""

    def blocks(t, episode, v, end):
        if not len(t):
            return
        part, block = tiles(t, episode, size, end)
        d, flags = differences(episode, v), spikes(episode, v)
        base = v[(part == 0) & ~np.isnan(v)]
        own = {"base_p1": quantile(base, 0.01), "base_p99": quantile(base, 0.99), "base_distinct": len(np.unique(base)), "base_count": len(base)}
        edges = borders(part, block)
        for a, b in zip(edges[:-1], edges[1:]):
            w = v[a:b]
            levels, counts = np.unique(w[~np.isnan(w)], return_counts=True)
            _, runs = run_sizes(np.zeros(b - a), w)
            yield own | {
                "part": int(part[a]), "block": int(block[a]), "n": int(b - a), "missing": float(np.isnan(w).mean()), "noise": mad(d[a:b]) / math.sqrt(2), "spikes": float(flags[a:b].mean()), "level": median(w),
                "longest": int(runs.max(initial=0)), "edge_mass": float(counts.max(initial=0) / (b - a)), "levels": len(levels), "step": least_gap(w),
            }

    return each(packed, blocks, "part int, block long, n long, missing double, noise double, spikes double, level double, longest long, edge_mass double, levels long, step double, base_p1 double, base_p99 double, base_distinct long, base_count long")


def health_reference(stats: DataFrame) -> DataFrame:
    """As ``health.reference``, from the rows of ``health_blocks``."""
    c = F.col
    base = stats.where("part = 0").groupBy(*KEYS).agg(
        F.max("missing").alias("ref_missing"), F.expr("percentile(longest, 0.99)").alias("ref_run"), F.expr("percentile(noise, 0.5)").alias("ref_noise"), F.max("spikes").alias("ref_spikes"), F.max("edge_mass").alias("ref_mass"),
        F.min(F.when(c("step") > 0, c("step"))).alias("least_step"), F.max("step").alias("most_step"), *[F.max(f"base_{n}").alias(n) for n in ("p1", "p99", "distinct", "count")],
    )
    coarse = (c("distinct") > 1) & (c("distinct") < c("count") / 2)
    return base.withColumns({n: F.when(coarse, c(n)) for n in ("least_step", "most_step")}).drop("count")


def masked(packed: DataFrame, bad: DataFrame, size: int) -> DataFrame:
    """``packed`` (with ``end``) with the samples of the blocks in ``bad`` (``part, block``) missing."""

    def hide(t, episode, v, end, blocks):
        part, block = tiles(t, episode, size, end)
        hit = np.zeros(len(t), bool)
        for x in blocks or ():
            hit |= (part == x["part"]) & (block == x["block"])
        yield {"s": struct_of(t=t, episode=episode, v=np.where(hit, np.nan, v))}

    listed = bad.groupBy(*KEYS).agg(F.collect_list(F.struct("part", "block")).alias("blocks"))
    return each(packed.join(listed, KEYS, "left"), hide, f"s {CELLS}")


LAGS = 40


def fingerprints(packed: DataFrame, until: int | None = None) -> DataFrame:
    """One row of all statistics for each series, of the samples before ``until``: shares, quantiles, spread, histogram, hold, step, noise, autocorrelation and period.

    Step, noise, flat and monotonic share are those of the series compressed to its hold.
    """

    def one(t, episode, v):
        if until is not None:
            t, episode, v = (x[t < until] for x in (t, episode, v))
        starts, sizes = run_sizes(episode, v)
        hold = 1
        if len(sizes):
            kinds = np.unique(sizes)
            cover = np.array([(sizes == n).sum() * n for n in kinds])
            best = min(range(len(kinds)), key=lambda i: (-cover[i], t[starts[sizes == kinds[i]][0]]))
            hold = int(kinds[best]) if cover[best] > 0.8 * sizes.sum() else 1
        y, e = v, episode
        if hold > 1:
            real = np.flatnonzero(~np.isnan(v))
            first = real[borders(t[real] // hold)[:-1]]
            y, e = v[first], episode[first]
        _, runs = run_sizes(e, y)
        d = differences(e, y)
        d = d[~np.isnan(d) & (d != 0)]
        p1, p99 = quantile(v, 0.01), quantile(v, 0.99)
        real = v[~np.isnan(v)]
        if len(real) and p99 > p1:
            inside = np.minimum(18, 1 + np.floor((real - p1) / (p99 - p1) * 18)).astype(int)
        else:
            inside = np.full(len(real), 9)
        bins = np.bincount(np.where(real < p1, 0, np.where(real > p99, 19, inside)), minlength=20)
        acf = autocorrelation(t, episode, v, LAGS)
        low = np.flatnonzero(acf < math.exp(-1))
        spread, step = mad(v), least_gap(y)
        scale = spread if spread > 0 else least_gap(v)
        yield {
            "n": len(v), "missing_rate": float(np.isnan(v).mean()) if len(v) else 0.0, "n_distinct": len(np.unique(real)), **{f"p{p}": quantile(v, p / 100) for p in (1, 5, 25, 50, 75, 95, 99)}, "mad": spread, "histogram": bins.tolist(), "step": step, "hold": hold,
            "noise": mad(differences(e, y)) / math.sqrt(2), "acf_time": int(low[0]) + 1 if len(low) else LAGS, "period": period_of(acf), "flat_share": float(runs[runs >= 3].sum() / runs.sum()) if len(runs) else 0.0,
            "monotonic_share": float(abs(np.sign(d).sum()) / len(d)) if len(d) else 0.0, "range_per_mad": (p99 - p1) / scale if scale > 0 else 0.0,
        }

    ddl = "n long, missing_rate double, n_distinct long, p1 double, p5 double, p25 double, p50 double, p75 double, p95 double, p99 double, mad double, histogram array<long>, step double, hold long, noise double, acf_time int, period int, flat_share double, monotonic_share double, range_per_mad double"
    return each(packed, one, ddl)


# -- passes over all sensors of a run


def matrix(rows: pa.Table, column: str = "s") -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """Sensors in order, the first time, the episode of each time, and the values by time and sensor."""
    rows = rows.sort_by("sensor")
    parts = [samples(x.values) for x in rows[column]]
    real = [p for p in parts if len(p[0])]
    lo, hi = (min(int(p[0][0]) for p in real), max(int(p[0][-1]) for p in real)) if real else (0, -1)
    episode, values = np.full(hi - lo + 1, -1, np.int64), np.full((hi - lo + 1, len(parts)), np.nan)
    for k, (t, e, v) in enumerate(parts):
        episode[t.astype(np.int64) - lo], values[t.astype(np.int64) - lo, k] = e, v
    return rows["sensor"].to_pylist(), lo, episode, values


def ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks, centred; 0 where missing."""
    out, real = np.zeros(len(v)), ~np.isnan(v)
    _, which, counts = np.unique(v[real], return_inverse=True, return_counts=True)
    out[real] = (np.cumsum(counts) - (counts - 1) / 2)[which] - (real.sum() + 1) / 2
    return out


def correlations(x: np.ndarray, h: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Pearson of all columns of ``x`` and ``y`` over the rows that both have (``h``, ``k``); 0 without variance."""
    n = np.maximum(h.T @ k, 1)
    a, b = x.T @ k, h.T @ y
    va, vb = (x * x).T @ k - a * a / n, h.T @ (y * y) - b * b / n
    sound = (va > 1e-9) & (vb > 1e-9)
    return np.where(sound, (x.T @ y - a * b / n) / np.sqrt(np.where(sound, va * vb, 1.0)), 0.0)


def relations(packed: DataFrame, least: float, most_lag: int) -> DataFrame:
    """``run_id, a, b, rho, lag, rho_at_lag, at_zero`` of the baseline (t < 0): rank correlation of at least ``least`` at lag 0, and the best lag of b behind a."""
    ship(packed.sparkSession)
    ddl = "run_id string, a string, b string, rho double, lag int, rho_at_lag double, at_zero double"
    schema = arrow_schema(ddl)

    def run(rows: pa.Table) -> pa.Table:
        sensors, lo, episode, v = matrix(rows)
        episode, v = episode[: max(0, -lo)], v[: max(0, -lo)]
        here = (~np.isnan(v)).astype(float)
        order = np.column_stack([ranks(c) for c in v.T]) if v.size else v
        rho = correlations(order, here, order, here)
        centers, scales = np.array([median(c) for c in v.T]), np.array([mad(c) for c in v.T])
        x = np.where(here > 0, (v - centers) / np.where(scales > 0, scales, 1.0), 0.0)
        by_lag = {}
        for lag in range(min(most_lag, max(0, len(v) - 1)) + 1):
            same = episode[: len(v) - lag] == episode[lag:]
            found = correlations(x[: len(v) - lag][same], here[: len(v) - lag][same], x[lag:][same], here[lag:][same])
            by_lag[lag], by_lag[-lag] = found, found.T
        a, b = np.nonzero(np.triu((here.T @ here > 0) & (np.abs(rho) >= least), 1))
        out = []
        for i, j in zip(a, b):
            best = max(by_lag, key=lambda k: (round(abs(by_lag[k][i, j]), 9), -abs(k), -k))
            zero = float(by_lag[0][i, j])
            out.append({"run_id": rows["run_id"][0].as_py(), "a": sensors[i], "b": sensors[j], "rho": float(rho[i, j]), "lag": best, "rho_at_lag": float(by_lag[best][i, j]), "at_zero": zero})
        return pa.Table.from_batches([as_table(out, schema)])

    return packed.select(*KEYS, "s").groupBy("run_id").applyInArrow(run, ddl)


def fitted(v: np.ndarray, episode: np.ndarray, base: np.ndarray, own: int, peers: list[tuple[int, int]], least: int = 100, most: int = 5):
    """Robust fit of a column on its peers (column, lag) over the rows of ``base``: peers used, coefficients, scale and the expectation of each row; None without peers."""
    used, columns = [], []
    for peer, lag in peers:
        at = np.arange(len(v)) - lag
        inside = (at >= 0) & (at < len(v))
        u = np.full(len(v), np.nan)
        u[inside] = np.where(episode[at[inside]] == episode[inside], v[at[inside], peer], np.nan)
        if (base & ~np.isnan(v[:, own]) & ~np.isnan(u)).sum() >= least and len(used) < most:
            used.append(peer)
            columns.append(u)
    if not used:
        return None
    x = np.column_stack([np.ones(len(v)), *columns])
    complete = base & ~np.isnan(v[:, own]) & ~np.isnan(x).any(1)
    beta, sigma = huber(x[complete], v[complete, own])
    return used, beta, sigma, x @ beta


def peer_lists(rows: pa.Table, sensors: list[str]) -> dict[str, list[tuple[int, int]]]:
    index, out = {s: k for k, s in enumerate(sensors)}, {s: [] for s in sensors}
    for x in sorted(rows.to_pylist(), key=lambda x: x["peer"]):
        if x["sensor"] in index and x["peer"] in index:
            out[x["sensor"]].append((index[x["peer"]], int(x["lag"])))
    return out


def deviations(packed: DataFrame, peers: DataFrame) -> DataFrame:
    """``sigma, model, d``: the distance of each sample from its expectation in sigmas, by a fit on the peers over t < 0, else from the own baseline.

    ``model`` has the coefficients by peer (the intercept's name is empty); null where the baseline alone judges.
    """
    ship(packed.sparkSession)
    ddl = f"run_id string, sensor string, sigma double, model array<struct<peer: string, coef: double>>, d {MOVES}"
    schema = arrow_schema(ddl)

    def run(rows: pa.Table, links: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([as_table([], schema)])
        sensors, lo, episode, v = matrix(rows)
        steps = [samples(x.values)[0].astype(np.int64) for x in rows.sort_by("sensor")["s"]]
        t, out = np.arange(lo, lo + len(v)), []
        known = peer_lists(links, sensors)
        for k, name in enumerate(sensors):
            fit = fitted(v, episode, t < 0, k, known[name])
            if fit:
                used, beta, sigma, expected = fit
                model = [{"peer": p, "coef": float(c)} for p, c in zip(["", *[sensors[u] for u in used]], beta)]
            else:
                center, sigma, model = median(v[t < 0, k]), mad(v[t < 0, k]), None
                expected = np.full(len(v), center)
            own = steps[k] - lo  # the steps that the series has
            moved = struct_of(t=t[own], episode=episode[own].astype(np.int32), v=v[own, k], expected=expected[own], deviation=(v[own, k] - expected[own]) / max(sigma, 1e-12))
            out.append({"run_id": rows["run_id"][0].as_py(), "sensor": name, "sigma": sigma, "model": model, "d": moved})
        return pa.Table.from_batches([as_table(out, schema)])

    return packed.select(*KEYS, "s").groupBy("run_id").cogroup(peers.select(F.col("run_id").alias("of"), "sensor", "peer", "lag").groupBy("of")).applyInArrow(run, ddl)


def refits(packed: DataFrame, peers: DataFrame, suspects: DataFrame, limit: float) -> DataFrame:
    """``run_id, suspect, peer, typical, flat``: every other sensor with a model, fitted without the suspect; it is flat if its median |deviation| is below ``limit``."""
    ship(packed.sparkSession)
    ddl = "run_id string, peer string, suspect string, typical double, flat boolean"
    schema = arrow_schema(ddl)
    told = peers.select(F.col("run_id").alias("of"), "sensor", "peer", "lag").unionByName(suspects.select(F.col("run_id").alias("of"), F.lit(None).cast("string").alias("sensor"), F.col("sensor").alias("peer"), F.lit(0).alias("lag")))

    def run(rows: pa.Table, links: pa.Table) -> pa.Table:
        listed = links.to_pylist()
        wanted = sorted(x["peer"] for x in listed if x["sensor"] is None)
        if not rows.num_rows or not wanted:
            return pa.Table.from_batches([as_table([], schema)])
        sensors, lo, episode, v = matrix(rows)
        t, known, out, whole = np.arange(lo, lo + len(v)), peer_lists(links, sensors), [], {}

        def typical(k: int, left: list[tuple[int, int]]) -> float | None:
            fit = fitted(v, episode, t < 0, k, left)
            return fit and median(np.abs(v[t >= 0, k] - fit[3][t >= 0]) / max(fit[2], 1e-12))

        for suspect in wanted:
            for k, name in enumerate(sensors):
                if name == suspect:
                    continue
                left = [p for p in known[name] if sensors[p[0]] != suspect]
                if len(left) == len(known[name]):  # the fit doesn't change
                    whole[name] = size = whole[name] if name in whole else typical(k, left)
                else:
                    size = typical(k, left)
                if size is not None and not math.isnan(size):
                    out.append({"run_id": rows["run_id"][0].as_py(), "peer": name, "suspect": suspect, "typical": size, "flat": bool(size < limit)})
        return pa.Table.from_batches([as_table(out, schema)])

    return durable(packed.select(*KEYS, "s").groupBy("run_id").cogroup(told.groupBy("of")).applyInArrow(run, ddl))


MOVE_NAMES = ("t", "episode", "deviation")


def median_deviation(moved: DataFrame) -> DataFrame:
    """``before``: the median |deviation| from t = 0 on; series without one are left out."""

    def one(t, episode, d):
        size = median(np.abs(d[t >= 0]))
        if not math.isnan(size):
            yield {"before": size}

    return each(moved.select(*KEYS, "d"), one, "before double", "d", MOVE_NAMES)


def block_trends(moved: DataFrame, slack: float, limit: float, size: int, fine: int) -> DataFrame:
    """From t = 0 on: largest fine block median, slope and trend of the block medians, and the first CUSUM alarm with its onset."""

    def one(t, episode, d):
        after = t >= 0
        t, episode, d = t[after], episode[after], d[after]
        slope, z, p = trend(block_medians(t, d, size))
        near = np.abs(block_medians(t, d, fine))
        alarm = first_alarm(t, episode, d, slack, limit) or (None, None)
        yield {"max_deviation": float(np.nanmax(near)) if (~np.isnan(near)).any() else math.nan, "slope": slope, "z": z, "p": p, "alarm": alarm[0], "onset": alarm[1]}

    return each(moved.select(*KEYS, "d"), one, "max_deviation double, slope double, z double, p double, alarm long, onset long", "d", MOVE_NAMES)


def fault_marks(moved: DataFrame, n: int, reach: int, least: int = 10) -> DataFrame:
    """``gain, follows_rho, kind`` of drivers (``onset`` is a column), as ``faults.scale_change``, ``level_dependence`` and ``process_kind`` tell them, with time counted from the onset."""

    def one(t, episode, v, expected, d, onset):
        t = t - onset
        before, after = t < 0, t >= 0
        real = ~np.isnan(v)
        gain, rho = False, None
        if (real & before).any() and (real & after).any():
            levels, spreads = [median(v[x]) for x in (before, after)], [noise(episode[x], v[x]) for x in (before, after)]
            if min((real & before).sum(), (real & after).sum()) >= least:
                level = levels[1] / levels[0] if levels[0] and np.sign(levels[0]) == np.sign(levels[1]) else 1.0
                spread = spreads[1] / spreads[0] if spreads[0] > 0 else 1.0
                a, b = math.log(level), math.log(spread) if spread > 0 else -math.inf
                gain = abs(a) > 0.05 and np.sign(a) == np.sign(b) and abs(b) > 0.5 * abs(a)
        both = after & ~np.isnan(d) & ~np.isnan(expected)
        if both.any():
            x, y = ranks(d[both]), ranks(expected[both])
            rho = float((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())) if x.std() > 1e-12 and y.std() > 1e-12 else 0.0
        medians = block_medians(t[after], np.abs(d[after]), max(1, n // 200))
        slope, _, p = trend(medians)
        jump = abs(median(d[after & (t < reach)]) - median(d[before & (t >= -reach)]))
        acf = autocorrelation(t[after], episode[after], d[after], LAGS)
        kind = "process-slow-degradation" if (~np.isnan(medians)).sum() >= 4 and p < 0.01 and slope > 0 else "process-step" if jump > 2 else "process-oscillation" if period_of(acf) else "process-degradation"
        yield {"gain": bool(gain), "rho": rho, "kind": kind}

    return each(moved.select(*KEYS, "onset", "d"), one, "gain boolean, rho double, kind string", "d", ("t", "episode", "v", "expected", "deviation"))


# -- calibration: every choice is judged in one scan of the baseline's segments, clean and with planted faults

#: Slacks and limits of the CUSUM; planted drifts: a ramp up to so many sigmas, and a gain that grows to so much; the share of clean segments that may raise an alarm.
SLACKS, LIMITS, BIASES, GAIN, TARGET = (0.5, 1.0), (5.0, 10.0, 20.0, 50.0, 100.0, 200.0), (0.5, 1.0, 2.0, 4.0, 8.0), 1.1, 0.01
DRIFTS = ("clean", *(f"bias {m:g}" for m in BIASES), f"gain {GAIN:g}")


def segments_of(n: int, length: int, most: int = 20) -> int:
    """Segments of a baseline of ``length`` steps in a run of ``n``: no shorter than two windows of the run, nor than 500 steps, but two at least."""
    window = min(max(round(n / 40), 50), 5000)
    return min(most, max(2, length // max(500, 2 * window)))


def drift_sweep(moved: DataFrame, n: int, size: int, fine: int, far: float, least: int = 100) -> DataFrame:
    """``slack, limit, fault, pairs, fired, delay`` summed over the segments of all series' baselines (t < 0): how many raised an alarm, and the steps until it.

    A planted drift counts as found if the segment would be judged drifting; a clean one is a false alarm if it would, or if the CUSUM alone alarms.
    """

    def one(t, episode, v, d, sigma):
        base = t < 0
        t, episode, v, d = t[base], episode[base], v[base], d[base]
        if (~np.isnan(d)).sum() < least:
            return
        total = np.zeros((len(SLACKS), len(LIMITS), len(DRIFTS), 3))
        many = segments_of(n, len(t))
        edges = [k * len(t) // many for k in range(many + 1)]
        for a, b in zip(edges[:-1], edges[1:]):
            if np.isnan(d[a:b]).all():
                continue
            ramp = np.arange(b - a) / max(1, b - a - 1)
            x = d[a:b] + np.array([0 * ramp, *(m * ramp for m in BIASES), (GAIN - 1) * ramp * np.nan_to_num(v[a:b]) / max(sigma, 1e-12)])
            wide = [block_medians(t[a:b], row, size) for row in x]
            reach = np.array([np.nanmax(np.abs(block_medians(t[a:b], row, fine))) for row in x])
            trends = np.array([trend(m)[2] for m in wide]) < 0.01
            late = np.array([next((min(b - a, int((k + 0.5) * size)) for k, m in enumerate(w) if abs(m) >= far), b - a) for w in wide])
            parts = borders(episode[a:b])
            for i, slack in enumerate(SLACKS):
                s = np.concatenate([np.maximum(one_sided(x[:, c:e], slack), one_sided(-x[:, c:e], slack)) for c, e in zip(parts[:-1], parts[1:])], axis=1)
                for j, limit in enumerate(LIMITS):
                    over = s > limit
                    alarm = over.any(1)
                    fired = (reach >= far) & (trends | alarm)
                    fired[0] |= alarm[0]
                    total[i, j, :, 0] += 1
                    total[i, j, :, 1] += fired
                    total[i, j, :, 2] += np.where(fired, np.where(alarm, over.argmax(1), late), 0)
        for i, slack in enumerate(SLACKS):
            for j, limit in enumerate(LIMITS):
                for f, fault in enumerate(DRIFTS):
                    pairs, fired, delay = (int(x) for x in total[i, j, f])
                    yield {"slack": slack, "limit": limit, "fault": fault, "pairs": pairs, "fired": fired, "delay": delay}

    rows = each(moved.select(*KEYS, "sigma", "d"), one, "slack double, limit double, fault string, pairs long, fired long, delay long", "d", ("t", "episode", "v", "deviation"))
    return rows.groupBy("slack", "limit", "fault").agg(*[F.sum(c).alias(c) for c in ("pairs", "fired", "delay")])


def choose_drift(sweep: DataFrame, target: float = TARGET) -> DataFrame:
    """``sweep`` with ``rate``, ``delay`` (mean steps of those found) and ``chosen``: of each slack the smallest limit with few false alarms, of these the one that finds most, soonest."""
    c = F.col
    found = F.sum(F.when(c("fault") != "clean", c("fired")).otherwise(0))
    each_one = sweep.groupBy("slack", "limit").agg(F.max(F.when(c("fault") == "clean", c("fired") / F.greatest(c("pairs"), F.lit(1)))).alias("false_rate"), found.alias("found"), F.sum(F.when(c("fault") != "clean", c("delay")).otherwise(0)).alias("waited"))
    own = Window.partitionBy("slack").orderBy(c("false_rate") > target, F.when(c("false_rate") > target, -c("limit")).otherwise(c("limit")))
    all_ = Window.partitionBy(F.lit(1)).orderBy(c("false_rate") > target, F.desc("found"), "waited", "limit", "slack")  # a row for each slack
    best = each_one.withColumn("place", F.row_number().over(own)).where("place = 1").withColumn("first", F.row_number().over(all_)).where("first = 1").select("slack", "limit", F.lit(True).alias("chosen"))
    rate = c("fired") / F.greatest(c("pairs"), F.lit(1))
    return sweep.join(best, ["slack", "limit"], "left").select("slack", "limit", "fault", "pairs", rate.alias("rate"), (c("delay") / F.when(c("fired") > 0, c("fired"))).alias("delay"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


#: Candidates of each health limit, the one that is preferred first; the check that it belongs to; planted faults.
CANDIDATES = {"dead": (3.0, 5.0, 10.0, 20.0), "stuck": (0.2, 0.1, 0.05), "sigma": (4.0, 5.0, 6.0, 8.0), "noisy": (2.0, 3.0, 5.0)}
HEALTH_FAULTS = ("clean", "flatline", "spikes", "noise", "dropout", "gain", "resolution")
#: Least shares and factors of the checks that have no candidates.
DROPOUT, SHARE, MASS, COARSE = 3.0, 0.02, 0.3, 4.0


def planted_health(v: np.ndarray, fault: str, seed: int) -> np.ndarray:
    """A copy of a segment with a fault in all of it."""
    real = v[~np.isnan(v)]
    if fault == "flatline":
        return np.full(len(v), real[0])
    if fault == "spikes":
        out = v.copy()
        out[::50] += 6 * mad(v) * np.where(np.arange(len(out[::50])) % 2, -1, 1)
        return out
    if fault == "noise":
        padded = np.concatenate((np.full(3, np.nan), v, np.full(3, np.nan)))
        near = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 7), axis=1)
        center = row_median(near, (~np.isnan(near)).sum(1))
        return center + 3 * (v - center)
    if fault == "dropout":
        return np.where(np.random.default_rng(seed).random(len(v)) < 0.2, np.nan, v)
    if fault == "resolution":
        step = 4 * least_gap(v)
        return np.round(v / step) * step if step > 0 else v
    return 1.1 * v if fault == "gain" else v


def health_sweep(packed: DataFrame, size: int) -> DataFrame:
    """``segment, fault, block, check, candidate, failed`` for every block of the baseline's segments (t < 0), clean and with each planted fault, and every candidate of each limit.

    The references are those of the whole baseline in blocks of the same size; a series without two values says nothing.
    """

    def figures(v: np.ndarray) -> dict:
        levels, counts = np.unique(v[~np.isnan(v)], return_counts=True)
        flat = np.zeros(len(v))
        return {"missing": float(np.isnan(v).mean()), "run": int(run_sizes(flat, v)[1].max(initial=0)), "noise": noise(flat, v), "mass": float(counts.max(initial=0) / len(v)), "level": median(v), "step": least_gap(v), **{f"s{k:g}": float(spikes(flat, v, k).mean()) for k in CANDIDATES["sigma"]}}

    def tiled(v: np.ndarray) -> list[np.ndarray]:
        count = max(1, len(v) // size)
        return [v[k * size : (k + 1) * size if k + 1 < count else len(v)] for k in range(count)]

    def one(t, episode, v):
        base = t < 0
        v, episode = v[base], episode[base]
        real = v[~np.isnan(v)]
        levels = len(np.unique(real))
        if levels < 2:
            return
        ref = [figures(x) for a, b in zip(borders(episode)[:-1], borders(episode)[1:]) for x in tiled(v[a:b])]
        top = {k: max(f[k] for f in ref) for k in ("missing", "mass", *(f"s{x:g}" for x in CANDIDATES["sigma"]))}
        run, quiet = float(np.quantile(run_sizes(episode, v)[1], 0.99)), noise(episode, v)
        steps = [f["step"] for f in ref if f["step"] > 0] if levels < len(real) / 2 else []
        p1, p99 = np.quantile(real, 0.01), np.quantile(real, 0.99)
        many = min(20, max(4, len(v) // 500))
        edges = [k * len(v) // many for k in range(many + 1)]
        for segment, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b - a < 8 or np.isnan(v[a:b]).all():
                continue
            for fault in HEALTH_FAULTS:
                for block, part in enumerate(tiled(planted_health(v[a:b], fault, segment))):
                    f = figures(part)
                    inside = p1 <= f["level"] <= p99
                    factor = max(f["step"] / max(steps), min(steps) / f["step"], 1.0) if steps and f["step"] > 0 else 1.0
                    failed = {
                        "dead": [f["run"] > c * run for c in CANDIDATES["dead"]], "stuck": [f["noise"] < c * quiet for c in CANDIDATES["stuck"]], "sigma": [f[f"s{c:g}"] > max(SHARE, 3 * top[f"s{c:g}"]) for c in CANDIDATES["sigma"]],
                        "noisy": [inside and f["noise"] > c * quiet for c in CANDIDATES["noisy"]], "other": [f["missing"] > DROPOUT * max(0.01, top["missing"]) or levels >= 20 and f["mass"] > max(MASS, 3 * top["mass"]) or factor > COARSE],
                    }
                    for check, flags in failed.items():
                        for candidate, flag in zip(CANDIDATES.get(check, (0.0,)), flags):
                            yield {"segment": segment, "fault": fault, "block": block, "check": check, "candidate": candidate, "failed": bool(flag)}

    return each(packed.select(*KEYS, "s"), one, "segment int, fault string, block int, check string, candidate double, failed boolean")


def choose_health(sweep: DataFrame, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """``check, candidate, rate, chosen``: false alarms of every candidate over clean segments, the first in order with few is chosen, else the last;
    and ``fault, rate, block``: how many segments with each fault any check with the chosen limits finds, and in which block at the median."""
    order = F.array_position(F.array(*[F.lit(x) for n in CANDIDATES for x in CANDIDATES[n]]), F.col("candidate"))
    by_check = {n: F.array_position(F.array(*map(F.lit, CANDIDATES[n])), F.col("candidate")) for n in CANDIDATES}
    place = order
    for n, at in by_check.items():
        place = F.when(F.col("check") == n, at).otherwise(place)
    by = [*KEYS, "segment", "fault"]
    clean = sweep.where((F.col("fault") == "clean") & (F.col("check") != "other")).groupBy(*by, "check", "candidate").agg(F.bool_or("failed").alias("failed"))
    rates = clean.groupBy("check", "candidate").agg(F.avg(F.col("failed").cast("int")).alias("rate"), F.count("*").alias("pairs")).withColumn("place", place)
    own = Window.partitionBy("check").orderBy(F.col("rate") > target, F.when(F.col("rate") > target, -F.col("place")).otherwise(F.col("place")))
    told = durable(rates.withColumn("chosen", F.row_number().over(own) == 1).select("check", "candidate", "pairs", "rate", "chosen"))
    picked = told.where("chosen").select("check", "candidate").unionByName(sweep.sparkSession.range(1).select(F.lit("other").alias("check"), F.lit(0.0).alias("candidate")))
    hit = sweep.join(F.broadcast(picked), ["check", "candidate"]).groupBy(*by).agg(F.bool_or("failed").alias("found"), F.min(F.when(F.col("failed"), F.col("block"))).alias("block"))  # five rows are sent
    return told, hit.groupBy("fault").agg(F.count("*").alias("pairs"), F.avg(F.col("found").cast("int")).alias("rate"), F.expr("percentile(block, 0.5)").alias("block"))


# -- principal components of a run


def components(packed: DataFrame, until: int, share: float = 0.9, most_rows: int = 4096) -> DataFrame:
    """``run_id, n, k, sensors, means, stdevs, loadings, values, t2_limit, spe_limit``: the components that hold ``share`` of the variance of complete steps before ``until``.

    Constant sensors are left out, so are runs of fewer than two others or of too few steps. At most ``most_rows`` evenly spaced steps are fitted; limits are 1.5 times the 99th percentile over all.
    """
    ship(packed.sparkSession)
    ddl = "run_id string, n long, k int, sensors array<string>, means array<double>, stdevs array<double>, loadings array<array<double>>, variances array<double>, t2_limit double, spe_limit double"
    schema = arrow_schema(ddl)

    def run(rows: pa.Table) -> pa.Table:
        sensors, lo, _, v = matrix(rows)
        v = v[: max(0, until - lo)]
        v = v[~np.isnan(v).any(1)]
        x = v[:: max(1, -(-len(v) // most_rows))]
        moving = np.flatnonzero((x != x[:1]).any(0)) if len(x) else np.zeros(0, int)
        if len(moving) < 2 or len(x) <= len(moving):
            return pa.Table.from_batches([as_table([], schema)])
        means, stdevs = x[:, moving].mean(0), x[:, moving].std(0, ddof=1)
        values, vectors = np.linalg.eigh(np.cov((x[:, moving] - means) / stdevs, rowvar=False))
        values, vectors = values[::-1], vectors[:, ::-1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
        k = max(1, min(len(moving) - 1, int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12)) + 1))
        model = {"means": means, "stdevs": stdevs, "loadings": vectors[:, :k].T, "variances": np.maximum(values[:k], 1e-12)}
        t2, spe, _, _ = outside((v[:, moving]), **model)
        one = {"run_id": rows["run_id"][0].as_py(), "n": len(v), "k": k, "sensors": [sensors[i] for i in moving], **{n: a.tolist() for n, a in model.items()}, "t2_limit": 1.5 * float(np.quantile(t2, 0.99)), "spe_limit": 1.5 * float(np.quantile(spe, 0.99))}
        return pa.Table.from_batches([as_table([one], schema)])

    return packed.select(*KEYS, "s").groupBy("run_id").applyInArrow(run, ddl)


def outside(v: np.ndarray, means, stdevs, loadings, variances) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each step T2, the squared error, and what each sensor contributes to them; an error counts more the more of its sensor the components explain."""
    loadings, variances = np.asarray(loadings), np.asarray(variances)
    z = (v - means) / stdevs
    s = z @ loadings.T
    rest = z - s @ loadings
    return (s * s / variances).sum(1), (rest * rest).sum(1), (s / variances) @ loadings * z, rest * rest / np.maximum(1 - (loadings**2).sum(0), 1e-9)


def component_statistics(packed: DataFrame, models: DataFrame, windows: DataFrame) -> DataFrame:
    """``run_id, name, from, to`` to ``run_id, name, n, t2, spe, t2_limit, spe_limit, verdict, sensor, share``: means over the complete steps of each window, a row for each sensor with its share.

    Shares are of the squared error where it is beyond its limit, else of T2, whose negative parts don't count; without any they are equal.
    """
    ship(packed.sparkSession)
    ddl = "run_id string, name string, n long, t2 double, spe double, t2_limit double, spe_limit double, verdict string, sensor string, share double"
    schema = arrow_schema(ddl)
    asked = windows.join(models, "run_id").withColumnRenamed("run_id", "of")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            sensors, lo, _, v = matrix(rows)
            for w in asked.select(["name", "from", "to", "sensors", "means", "stdevs", "loadings", "variances", "t2_limit", "spe_limit"]).to_pylist():
                x = v[max(0, w["from"] - lo) : max(0, w["to"] - lo)][:, [sensors.index(s) for s in w["sensors"]]]
                x = x[~np.isnan(x).any(1)]
                t2, spe, by_t2, by_spe = outside(x, w["means"], w["stdevs"], w["loadings"], w["variances"])
                mean_t2, mean_spe = (float(a.mean()) if len(a) else 0.0 for a in (t2, spe))
                raw = by_spe.sum(0) if mean_spe > w["spe_limit"] else np.maximum(by_t2, 0).sum(0)
                share = raw / raw.sum() if raw.sum() > 0 else np.full(len(raw), 1 / len(raw))
                verdict = "relations broke" if mean_spe > w["spe_limit"] else "moved inside its relations" if mean_t2 > w["t2_limit"] else "inside its limits"
                out += [{"run_id": rows["run_id"][0].as_py(), "name": w["name"], "n": len(x), "t2": mean_t2, "spe": mean_spe, "t2_limit": w["t2_limit"], "spe_limit": w["spe_limit"], "verdict": verdict, "sensor": s, "share": float(c)} for s, c in zip(w["sensors"], share)]
        return pa.Table.from_batches([as_table(out, schema)])

    return packed.select(*KEYS, "s").groupBy("run_id").cogroup(asked.groupBy("of")).applyInArrow(run, ddl)
