"""Reports, investigation tools and the audit log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import kernels as k
from tideline.operators.kernels import KEYS
from tideline.session import durable, ship


def compare_windows(g: DataFrame, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """Counts, medians, scaled MADs, the Wasserstein distance (200 mid-quantiles) and histograms of two windows of each sensor.

    Both histograms have the bounds ``lo``, the lesser 1st percentile, and ``hi``, the greater 99th: below, 18 bins of equal width, above; ``bins_a`` and ``bins_b`` hold counts. An
    empty window has null medians and quantiles, and zeros for counts; it leaves the bounds to the other.
    """
    sides = {n: f"CASE WHEN t >= {lo} AND t < {hi} THEN v END" for n, (lo, hi) in (("a", a), ("b", b))}
    first = [F.expr(x).alias(f"{name}_{n}") for n, s in sides.items() for name, x in (("n", f"count({s})"), ("median", f"percentile({s}, 0.5D)"), ("p1", f"percentile({s}, 0.01D)"), ("p99", f"percentile({s}, 0.99D)"))]
    first += [k.mid_quantiles(s, 200).alias(f"q_{n}") for n, s in sides.items()]
    told = g.groupBy(*KEYS).agg(*first).withColumns({"lo": F.least("p1_a", "p1_b"), "hi": F.greatest("p99_a", "p99_b"), "distance": k.wasserstein(F.col("q_a"), F.col("q_b"))}).drop("q_a", "q_b")
    bin_ = F.expr("CASE WHEN v < lo THEN 0 WHEN v > hi THEN 19 WHEN hi > lo THEN least(19, 1 + floor((v - lo) / ((hi - lo) / 18))) ELSE 9 END")
    placed = g.join(told.select(*KEYS, "median_a", "median_b", "lo", "hi"), KEYS).withColumn("bin", bin_)
    second = [F.expr(f"percentile(abs({s} - median_{n}), 0.5D) * {k.MAD_SCALE}D").alias(f"mad_{n}") for n, s in sides.items()]
    second += [F.array(*[F.expr(f"count_if(bin = {j} AND ({s}) IS NOT NULL)") for j in range(20)]).alias(f"bins_{n}") for n, s in sides.items()]
    names = [f"{x}_{n}" for x in ("n", "median", "mad", "bins") for n in sides]
    return told.join(placed.groupBy(*KEYS).agg(*second), KEYS).select(*KEYS, *names, "lo", "hi", "distance")


def relation_in_window(g: DataFrame, pairs: DataFrame, window: tuple[int, int], most: int = 64) -> DataFrame:
    """``run_id, a, b`` pairs to Spearman's ``rho`` over the ``n`` samples of a window where both have values, and the ``lag`` of b behind a, up to ``most`` samples within
    episodes, with the largest absolute correlation, ``rho_at_lag``. Ranks are taken in the window, before pairing. A pair that never meets has rho 0 and no lag.
    """
    low, high = window
    rows = g.where((F.col("t") >= low) & (F.col("t") < high))
    ranks = k.average_ranks(rows)
    of = lambda name, rank: ranks.select("run_id", F.col("sensor").alias(name), "t", F.col("rank").alias(rank))
    met = pairs.select("run_id", "a", "b").join(of("a", "u"), ["run_id", "a"], "left").join(of("b", "w"), ["run_id", "b", "t"], "left")
    both = [F.when(F.col("u").isNotNull() & F.col("w").isNotNull(), F.col(c)).alias(c) for c in ("u", "w")]
    rho = met.select("run_id", "a", "b", *both).groupBy("run_id", "a", "b").agg(k.correlation("u", "w").alias("rho"), F.count("u").alias("n"))
    lags = k.cross_correlation(rows, pairs, max(0, min(most, high - low - 2))).select("run_id", "a", "b", "lag", F.col("rho").alias("rho_at_lag"))
    return rho.join(lags, ["run_id", "a", "b"], "left")


def alerts(health: DataFrame, drift: DataFrame) -> DataFrame:
    """``run_id, sensor, kind, verdict``: sensors whose health is another than healthy, and those that drift. A sensor may have both."""
    failed = health.where("health <> 'healthy'").select("run_id", "sensor", F.lit("health").alias("kind"), F.col("health").alias("verdict"))
    return failed.unionByName(drift.where("drifting").select("run_id", "sensor", F.lit("drift").alias("kind"), F.lit("drifting").alias("verdict")))


def csv_line(columns: list[str], rows: DataFrame) -> Column:
    """A record by RFC 4180: cells with commas, quotes or line ends are quoted, quotes doubled; null is an empty cell, and what is no text is written as JSON."""
    cells = []
    for c in columns:
        nested = isinstance(rows.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
        text = F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit(""))
        cells.append(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *cells)


def log_lines(log: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``order, csv, json``: each entry as a CSV record and as a JSON object, nulls written."""
    return log.select(order, csv_line(columns, log).alias("csv"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def export_log(log: DataFrame, columns: list[str], order: str, path: str, form: str) -> None:
    """Writes the log in order of ``order`` as text files, whose names follow that order: ``csv`` with one header line and CRLF, or ``json``, an object a line. Sorted by ranges, so no task holds it whole."""
    if form not in ("csv", "json"):
        raise ValueError(f"no format {form}")
    lines = log_lines(log, columns, order).select(F.lit(1).alias("part"), F.col(order).alias("at"), F.col(form).alias("value"))
    if form == "csv":
        kind = lines.schema["at"].dataType
        lines = lines.unionByName(log.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(kind).alias("at"), F.lit(",".join(columns)).alias("value")))
    lines.orderBy("part", "at").select("value").write.option("lineSep", "\r\n" if form == "csv" else "\n").text(path)


def run_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two runs that differ, by key."""
    met = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("in_old")).join(new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("in_new")), keys, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return met.withColumn("change", change).where("change is not null").select(*keys, "old", "new", "change")


def effective(overrides: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of every key by sequence."""
    return overrides.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def chains(links: DataFrame, rounds: int = 20) -> DataFrame:
    """``id, supersedes``: the newest successor of every row, by doubling of steps, so rounds grow with the logarithm of the chain."""
    step = durable(links.where("supersedes is not null").select(F.col("supersedes").alias("id"), F.col("id").alias("head")))
    for _ in range(rounds):
        ahead = step.select(F.col("id").alias("head"), F.col("head").alias("further"))
        after = durable(step.join(ahead, "head", "left").select("id", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("moved")))
        step = after.select("id", "head")
        if not after.where("moved").limit(1).count():
            break
    return links.select("id").join(step, "id", "left").select("id", F.coalesce("head", "id").alias("head"))


def lanes(g: DataFrame, baseline_end: int, most: int = 240) -> DataFrame:
    """Each sensor's points for a chart, and its baseline band."""
    band = k.quantiles(g.where(F.col("t") < baseline_end), {"p1": 0.01, "p99": 0.99})
    return k.downsample(g, most).join(band, KEYS)


def assign_ids(rows: DataFrame, run: str, order: list[str], prefix: str) -> DataFrame:
    """Ids in a stated order, the same however the rows are partitioned."""
    return rows.withColumn("id", F.concat(F.lit(prefix), F.lpad(F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("string"), 6, "0")))


def build_chain(log: DataFrame) -> DataFrame:
    """``run_id, seq, text``: each row's hash over the one before and its text; a null text counts as empty, rows of equal ``seq`` follow by text.

    One chain per run, runs in parallel. Rows are sorted by Spark and pass through a task in batches, which hand on the last hash, so a run of any length takes bounded memory.
    """
    ship(log.sparkSession)
    ordered = log.select(F.col("run_id").cast("string"), F.col("seq").cast("long"), F.col("text").cast("string")).repartition("run_id").sortWithinPartitions("run_id", "seq", "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, own = object(), ""
        for batch in batches:
            before, after = [], []
            for key, text in zip(batch["run_id"].to_pylist(), batch["text"].to_pylist()):
                if key != run:
                    run, own = key, ""
                before.append(own)
                own = hashlib.sha256((own + (text or "")).encode()).hexdigest()
                after.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=["run_id", "seq", "text", "prev_hash", "hash"])

    return ordered.mapInArrow(link, "run_id string, seq long, text string, prev_hash string, hash string")


def verify_chain(log: DataFrame) -> DataFrame:
    """The first row of each run that doesn't follow from the one before; checked in parallel, as every row holds both hashes."""
    w = Window.partitionBy("run_id").orderBy("seq")
    linked = F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit(""))
    own = F.sha2(F.concat("prev_hash", F.coalesce("text", F.lit(""))), 256) == F.col("hash")
    return log.withColumn("good", linked & own).groupBy("run_id").agg(F.count("*").alias("n"), F.min(F.when(~F.col("good"), F.col("seq"))).alias("first_bad"))


def faceted(rows: DataFrame, clauses: list[list[tuple[str, str]]]) -> DataFrame:
    """Rows for which every clause has one (column, value) that holds."""
    condition = F.lit(True)
    for clause in clauses:
        one = F.lit(False)
        for column, value in clause:
            one = one | F.contains(F.lower(F.col(column).cast("string")), F.lit(value.lower()))
        condition = condition & one
    return rows.where(condition)


def shared_change(points: DataFrame, tolerance: int) -> DataFrame:
    """``run_id, sensor, cut_t``: the place that the most sensors share within a tolerance. Band join by bucket."""
    size = tolerance + 1
    left = points.select("run_id", F.col("cut_t").alias("at_t"), F.explode(F.array(*[F.expr(f"cut_t div {size}") + j for j in (-1, 0, 1)])).alias("b")).distinct()
    right = points.select("run_id", "sensor", F.col("cut_t").alias("near_t"), F.expr(f"cut_t div {size}").alias("b"))
    met = left.join(right, ["run_id", "b"]).where(F.abs(F.col("at_t") - F.col("near_t")) <= tolerance)
    counts = met.groupBy("run_id", "at_t").agg(F.count_distinct("sensor").alias("sensors"))
    return counts.groupBy("run_id").agg(F.max_by("at_t", F.struct("sensors", -F.col("at_t"))).alias("at_t"), F.max("sensors").alias("sensors"))


def ranking(decided: DataFrame) -> DataFrame:
    """Drifting sensors by their share of all deviation, drivers before victims."""
    run = Window.partitionBy("run_id")
    share = decided.where("drifting").withColumn("contribution", F.col("max_deviation") / F.sum("max_deviation").over(run))
    return share.withColumn("place", F.row_number().over(run.orderBy("victim", F.desc(F.round("contribution", 9)), "sensor"))).select("run_id", "sensor", "victim", "contribution", "place")


def ancestors(links: DataFrame) -> DataFrame:
    """``id, supersedes`` to ``id, ancestor, depth``: all that an id supersedes, directly or not, with the fewest steps; an id on a cycle is no ancestor of itself.

    Each round joins the longest paths so far, of ``step`` steps each, with all of them: a path with fewest steps is such a one and a shorter one, so each is made once
    on a chain. Rounds grow with the logarithm of the longest chain, and end when no path has twice the steps.
    """
    paths, step = durable(links.where("supersedes is not null and supersedes <> id").select("id", F.col("supersedes").alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct()), 1
    while paths.where(F.col("depth") == step).limit(1).count():
        further = paths.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        longer = paths.where(F.col("depth") == step).join(further, "ancestor").where("next <> id").select("id", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        paths, step = durable(paths.unionByName(longer).groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))), 2 * step
    return paths
