"""Relations between sensors, flow order, and roles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators.kernels import KEYS
from tideline.session import durable, ship


def rank_pairs(g: DataFrame, least: float) -> DataFrame:
    """All-pairs Spearman of complete samples from block sums: a time step is one row of ranks, and only sums by pair are shuffled."""
    ship(g.sparkSession)
    wide = k.average_ranks(g).groupBy("run_id", "t").agg(F.sort_array(F.collect_list(F.struct("sensor", "rank"))).alias("cells"))  # a row for each step, of the sensors of a run

    def sums(batches):
        for batch in batches:
            lists = batch["cells"]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            cells = lists.flatten()
            sensors, column = np.unique(np.array(cells.field("sensor").to_pylist(), object).astype(str), return_inverse=True)
            runs, run = np.unique(np.array(batch["run_id"].to_pylist(), object).astype(str), return_inverse=True)
            for k, name in enumerate(runs):
                mine = run[owner] == k
                rows = np.unique(owner[mine], return_inverse=True)[1]
                here, x = np.zeros((2, rows.max() + 1, len(sensors))) if mine.any() else np.zeros((2, 0, len(sensors)))
                here[rows, column[mine]], x[rows, column[mine]] = 1.0, cells.field("rank").to_numpy(zero_copy_only=False)[mine]
                # a matrix product for each sum: numbers of steps with both, sums of either, squares of either, products
                found = {"n": here.T @ here, "sa": x.T @ here, "saa": (x * x).T @ here, "sab": x.T @ x}
                i, j = np.nonzero(np.triu(found["n"], 1))
                yield pa.record_batch(
                    {"run_id": [str(name)] * len(i), "a": sensors[i].tolist(), "b": sensors[j].tolist(), "n": found["n"][i, j], "sa": found["sa"][i, j], "sb": found["sa"][j, i], "saa": found["saa"][i, j], "sbb": found["saa"][j, i], "sab": found["sab"][i, j]},
                    schema=pa.schema([(c, pa.string()) for c in ("run_id", "a", "b")] + [(c, pa.float64()) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]),
                )

    part = wide.mapInArrow(sums, "run_id string, a string, b string, n double, sa double, sb double, saa double, sbb double, sab double")
    total = part.groupBy("run_id", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    rho = F.when((va > 1e-9) & (vb > 1e-9), (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb)).otherwise(0.0)
    return total.withColumn("rho", rho).where(F.abs("rho") >= least).select("run_id", "a", "b", F.col("n").cast("long").alias("n"), "rho")


#: Time steps that one task takes for lagged sums.
SPAN = 2048


def lagged_pairs(g: DataFrame, most: int) -> DataFrame:
    """``run_id, a, b, lag, rho_at_lag, at_zero``: the best lag of b behind a for every pair of sensors of a run, as ``cross_correlation`` finds it, from block sums.

    Steps are dealt in spans, and a span takes the ``most`` steps after it too, so a task holds ``SPAN + most`` steps of a run's sensors. It gives
    sums by pair and lag as matrix products; only those are shuffled.
    """
    ship(g.sparkSession)
    span = F.floor(F.col("t") / SPAN)
    spans = F.when(F.pmod(F.col("t"), F.lit(SPAN)) < most, F.array(span, span - 1)).otherwise(F.array(span))
    dealt = k.standardised(g.where("v is not null")).select("run_id", "episode", "sensor", "t", "v", F.explode(spans).alias("span"))

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        sensors, column = np.unique(rows["sensor"].to_numpy(dtype=object).astype(str), return_inverse=True)
        here, x = np.zeros((2, SPAN + most, len(sensors)))
        step = rows["t"].to_numpy() - rows["span"].iloc[0] * SPAN
        here[step, column], x[step, column] = 1.0, rows["v"].to_numpy()
        parts = []
        for lag in range(most + 1):
            u, hu, w, hw = x[:SPAN], here[:SPAN], x[lag : SPAN + lag], here[lag : SPAN + lag]
            n = hu.T @ hw
            i, j = np.nonzero(np.triu(n, 1) if lag == 0 else n - np.diag(np.diag(n)))
            found = {"n": n, "su": u.T @ hw, "sw": hu.T @ w, "suu": (u * u).T @ hw, "sww": hu.T @ (w * w), "suw": u.T @ w}
            flip = i > j
            parts.append(pd.DataFrame({"a": sensors[np.where(flip, j, i)], "b": sensors[np.where(flip, i, j)], "lag": np.where(flip, -lag, lag), **{c: m[i, j] for c, m in found.items()}}))
        return pd.concat(parts).assign(run_id=rows["run_id"].iloc[0])[["run_id", "a", "b", "lag", *LAG_SUMS]]

    part = dealt.groupBy("run_id", "episode", "span").applyInPandas(sums, "run_id string, a string, b string, lag int, " + ", ".join(f"{c} double" for c in LAG_SUMS))
    total = part.groupBy("run_id", "a", "b", "lag").agg(*[F.sum(c).alias(c) for c in LAG_SUMS])
    vu, vw = F.col("suu") - F.col("su") * F.col("su") / F.col("n"), F.col("sww") - F.col("sw") * F.col("sw") / F.col("n")
    rho = F.when((vu > 1e-9) & (vw > 1e-9), (F.col("suw") - F.col("su") * F.col("sw") / F.col("n")) / F.sqrt(vu * vw)).otherwise(0.0)
    best = F.struct(F.round(F.abs("rho"), 9), -F.abs("lag"), -F.col("lag"))
    return total.withColumn("rho", rho).groupBy("run_id", "a", "b").agg(F.max_by("lag", best).alias("lag"), F.max_by("rho", best).alias("rho_at_lag"), F.coalesce(F.max(F.when(F.col("lag") == 0, F.col("rho"))), F.lit(0.0)).alias("at_zero"))


LAG_SUMS = ("n", "su", "sw", "suu", "sww", "suw")


def lag_edges(g: DataFrame, pairs: DataFrame, most: int, gain: float = 0.02) -> DataFrame:
    """Pairs whose best lag beats lag 0; the edge goes from the leading sensor to the following one."""
    best = k.cross_correlation(g, pairs, most).withColumnRenamed("rho", "best")
    flat = k.cross_correlation(g, pairs, 0).select("run_id", "a", "b", F.col("rho").alias("at_zero"))
    led = best.join(flat, ["run_id", "a", "b"]).where(F.abs("best") > F.abs("at_zero") + gain)
    ahead = F.col("lag") > 0
    return led.select("run_id", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("target"), F.abs("lag").alias("lag"), F.col("best").alias("rho"), "at_zero")


def redundancy_groups(pairs: DataFrame, least: float) -> DataFrame:
    """Connected components over strong pairs, two or more sensors each: the smallest name spreads until nothing changes.

    A label takes its own sensor's label on the way, so rounds grow with the logarithm of the longest chain.
    """
    edges = pairs.where(F.abs("rho") >= least).select("run_id", "a", "b")
    both = durable(edges.unionByName(edges.select("run_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = durable(both.select("run_id", F.col("a").alias("sensor")).distinct().withColumn("label", F.col("sensor")))
    while True:
        near = both.join(label.withColumnRenamed("sensor", "b"), ["run_id", "b"]).groupBy("run_id", F.col("a").alias("sensor")).agg(F.min("label").alias("near"))
        least_near = label.join(near, ["run_id", "sensor"]).withColumn("next", F.least("label", "near"))
        after = durable(least_near.join(label.select("run_id", F.col("sensor").alias("next"), F.col("label").alias("further")), ["run_id", "next"]).select("run_id", "sensor", "label", F.least("next", "further").alias("new")))
        label = after.select("run_id", "sensor", F.col("new").alias("label"))
        if after.where("new < label").isEmpty():
            return label


def flow_order(edges: DataFrame) -> DataFrame:
    """Topological order of the lag edges of each run; the weakest edge of a cycle goes. A small graph per run, runs in parallel."""
    ship(edges.sparkSession)

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        links = sorted(zip(rows["source"], rows["target"], rows["rho"].abs()), key=lambda x: (x[2], x[0], x[1]))
        left, out = sorted(set(rows["source"]) | set(rows["target"])), []
        while left:
            ready = [s for s in left if not any(t == s for _, t, _ in links)]
            if not ready:
                inside = _cycle(links)
                links.remove(min(inside, key=lambda x: (x[2], x[0], x[1])))
                continue
            out.append(ready[0])
            left.remove(ready[0])
            links = [x for x in links if x[0] != ready[0]]
        return pd.DataFrame({"run_id": rows["run_id"].iloc[0], "sensor": out, "place": range(len(out))})

    return edges.groupBy("run_id").applyInPandas(order, "run_id string, sensor string, place long")


def _cycle(links: list[tuple]) -> list[tuple]:
    """The links of one cycle; every node that is left has a link into it."""
    into = {t: (s, t, w) for s, t, w in links}
    node, seen = links[0][1], []
    while node not in seen:
        seen.append(node)
        node = into[node][0] if node in into else links[0][0]
    return [into[n] for n in seen[seen.index(node) :] if n in into]


def peers(pairs: DataFrame, failed: DataFrame, most: int = 5) -> DataFrame:
    """The strongest neighbours of each sensor, failed sensors left out; where ``pairs`` has a lag (of b behind a), it is that of the sensor behind its peer."""
    lag = ["lag"] if "lag" in pairs.columns else []
    sides = (pairs.select("run_id", F.col(x).alias("sensor"), F.col(y).alias("peer"), "rho", *[(sign * F.col(c)).alias(c) for c in lag]) for x, y, sign in (("a", "b", -1), ("b", "a", 1)))
    both = next(sides).unionByName(next(sides))
    sound = both.join(failed.select("run_id", F.col("sensor").alias("peer")), ["run_id", "peer"], "left_anti")
    place = F.row_number().over(Window.partitionBy("run_id", "sensor").orderBy(F.desc(F.round(F.abs("rho"), 9)), "peer"))
    return sound.withColumn("place", place).where(F.col("place") <= most).select("run_id", "sensor", "peer", "rho", *lag, "place")


ROLES = ("setpoint", "controlled", "actuator", "redundant", "upstream", "downstream", "counter", "state")
#: A role needs this score; an actuator by rule leads with this correlation, and has a partner with that one.
FLOOR, LEAD_RHO, PARTNER_RHO = 0.3, 0.5, 0.95


def range_per_mad(base: DataFrame) -> DataFrame:
    """The range from p1 to p99 of baseline samples by their scaled MAD, or by the step size where that is 0."""
    q = k.quantiles(base, {"p1": 0.01, "p99": 0.99}).join(k.mad(base), KEYS).join(k.step_size(base), KEYS)
    scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("step"))
    return q.select(*KEYS, F.when(scale > 0, (F.col("p99") - F.col("p1")) / scale).otherwise(0.0).alias("range_per_mad"))


def role_scores(prints: DataFrame, ranges: DataFrame, edges: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """A score from 0 to 1 for each role of each sensor; a constant sensor has none.

    ``edges`` (source, target, lag, rho at the lag, at_zero) lead; ``pairs`` without an edge are partners at lag 0; ``groups`` are redundant sensors.
    """
    c, side = F.col, ["run_id", "sensor"]
    x = durable(prints.join(ranges, KEYS).withColumn("step_like", c("flat_share") / (1 + F.greatest(F.lit(0), c("n_distinct") - 2) / 8)))
    both = durable(pairs.select("run_id", "a", "b", "rho").unionByName(pairs.select("run_id", c("b").alias("a"), c("a").alias("b"), "rho")))
    led = edges.select("run_id", c("source").alias("a"), c("target").alias("b"))
    lagged = led.unionByName(led.select("run_id", c("b").alias("a"), c("a").alias("b")))
    like = x.select("run_id", c("sensor").alias("source"), "step_like")
    into = edges.join(like, ["run_id", "source"]).groupBy("run_id", c("target").alias("sensor")).agg(F.count("*").alias("n_in"), F.max(c("step_like") * c("rho") * c("rho")).alias("tracks"), F.max(c("step_like") * F.abs("rho")).alias("follows"))
    into = durable(into)
    out = edges.join(into.select("run_id", c("sensor").alias("target"), "tracks"), ["run_id", "target"]).groupBy("run_id", c("source").alias("sensor"))
    out = out.agg(F.count("*").alias("n_out"), F.max(F.abs("rho") * c("tracks")).alias("leads"), F.max(F.abs("rho")).alias("tracked"), F.bool_or(F.abs("at_zero") >= LEAD_RHO).alias("led"))
    own, other = x.select("run_id", c("sensor").alias("a"), c("range_per_mad").alias("ra")), x.select("run_id", c("sensor").alias("b"), c("range_per_mad").alias("rb"))
    ranged = both.join(own, ["run_id", "a"]).join(other, ["run_id", "b"])
    # the strongest partner at lag 0 with a narrower range, of a sensor that leads another
    near = ranged.where((F.abs("rho") >= PARTNER_RHO) & (c("rb") < c("ra"))).join(lagged, ["run_id", "a", "b"], "left_anti").join(out.where("led").select("run_id", c("sensor").alias("a")), ["run_id", "a"], "left_semi")
    first = F.row_number().over(Window.partitionBy("run_id", "a").orderBy(F.desc(F.round(F.abs("rho"), 9)), "b"))
    partner = durable(near.withColumn("place", first).where("place = 1").select("run_id", "a", "b", F.abs("rho").alias("score")))
    acts = partner.select("run_id", c("a").alias("sensor"), c("score").alias("rule_actuator"))
    held = partner.groupBy("run_id", c("b").alias("sensor")).agg(F.max("score").alias("rule_controlled"))
    wide, narrow = F.greatest("ra", "rb"), F.least("ra", "rb")
    grouped = ranged.join(groups.select("run_id", c("sensor").alias("a"), "label"), ["run_id", "a"]).join(groups.select("run_id", c("sensor").alias("b"), "label"), ["run_id", "b", "label"])
    grouped = grouped.groupBy("run_id", c("a").alias("sensor")).agg(F.max(F.abs("rho") * F.sqrt(F.when(wide > 0, narrow / wide).otherwise(1.0))).alias("agrees"))
    for part in (into, out, acts, held, grouped):
        x = x.join(part, side, "left")
    n_in, n_out, tracks, follows, leads, tracked = (F.coalesce(n, F.lit(0)) for n in ("n_in", "n_out", "tracks", "follows", "leads", "tracked"))
    degree, steady = n_in + n_out, 1 - c("step_like")
    scores = {
        "setpoint": c("step_like") * tracked,
        "controlled": F.greatest(tracks * (1 - leads), F.coalesce("rule_controlled", F.lit(0.0))),
        "actuator": F.greatest(leads * (0.6 + 0.4 * follows) * steady, F.coalesce("rule_actuator", F.lit(0.0))),
        "redundant": F.coalesce("agrees", F.lit(0.0)),
        "upstream": F.when(degree > 0, n_out / degree * F.least(F.lit(1.0), n_out / 3) * steady).otherwise(0.0),
        "downstream": F.when(degree > 0, n_in / degree * F.least(F.lit(1.0), n_in / 3) * (1 - tracks)).otherwise(0.0),
        "counter": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("monotonic_share") - 0.5) / 0.5)),
        "state": F.when(c("n_distinct") == 2, 1.0).when(c("n_distinct") <= 8, c("step_like")).otherwise(0.0) * (1 - tracked),
    }
    return x.select(*side, "missing_rate", *[F.when(c("n_distinct") <= 1, 0.0).otherwise(scores[r]).cast("double").alias(r) for r in ROLES])


def assign_roles(scores: DataFrame, least: float = FLOOR) -> DataFrame:
    """The best role if it reaches ``least``, ties in the order of ROLES; confidence is its lead over the next, less missing samples."""
    long = scores.unpivot(["run_id", "sensor", "missing_rate"], list(ROLES), "role", "score")
    order = Window.partitionBy("run_id", "sensor").orderBy(F.desc(F.round("score", 9)), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")))
    placed = long.withColumns({"place": F.row_number().over(order), "next": F.lead("score").over(order)}).where("place = 1")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - F.col("next")) * (1 - F.col("missing_rate"))))
    return placed.select("run_id", "sensor", F.when(F.col("score") >= least, F.col("role")).otherwise("unknown").alias("role"), confidence.alias("confidence"))


def override_roles(roles: DataFrame, overrides: DataFrame) -> DataFrame:
    return roles.join(overrides.withColumnRenamed("role", "wanted"), ["run_id", "sensor"], "left").select("run_id", "sensor", F.coalesce("wanted", "role").alias("role"), F.when(F.col("wanted").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))
