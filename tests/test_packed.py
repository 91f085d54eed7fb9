"""Passes over packed series against the column forms, and against numpy where there is none."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import drift, faults, health
from tideline.operators import kernels as k
from tideline.operators import packed as p
from tideline.operators import relations as r
from tideline.operators import signals as s
from tideline.plans import drift as plans
from tideline.plans import fixtures
from tideline.session import durable

DATA = "/root/testdata/sf0.001"
END = 240
#: Weeks have rows enough there for a drift to stand out.
FINE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def grid(spark):
    """The grid with a drift, missing values and repeated values; week 240 is 0."""
    g = plans.ramp(spark, DATA).withColumn("t", F.col("t") - END)
    return durable(g.withColumn("v", F.when(F.pmod(F.xxhash64("sensor", "t"), F.lit(19)) == 0, None).when(F.col("sensor") == "discount", F.round("v", 1)).otherwise(F.col("v"))))


@pytest.fixture(scope="module")
def packed(grid):
    return durable(p.pack(grid))


def same(ours, theirs, keys, digits=1e-9):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (ours.select(*theirs.columns), theirs))
    assert len(a) == len(b) > 0
    for c in theirs.columns:
        if a[c].dtype.kind in "if" or b[c].dtype.kind in "if":
            x, y = a[c].astype(float).to_numpy(), b[c].astype(float).to_numpy()
            assert np.allclose(x, y, rtol=digits, atol=1e-9, equal_nan=True), c
        else:
            assert a[c].tolist() == b[c].tolist(), c


KEYS = ["run_id", "sensor"]


def test_health(grid, packed):
    blocks = durable(health.with_blocks(grid, 64, 0))
    stats, ours = durable(health.block_stats(blocks)), durable(p.health_blocks(packed.withColumn("end", F.lit(0)), 64))
    same(ours, stats, [*KEYS, "part", "block"])
    same(p.health_reference(ours), health.reference(blocks, stats), KEYS)
    bad = stats.where("sensor like 'p%' and block % 3 = 0").select(*KEYS, "part", "block")
    hidden = blocks.join(bad.withColumn("bad", F.lit(True)), [*KEYS, "part", "block"], "left").select(*KEYS, "episode", "t", F.when(F.col("bad"), None).otherwise(F.col("v")).alias("v"))
    same(p.unpack(p.masked(packed.withColumn("end", F.lit(0)), bad, 64)), hidden, [*KEYS, "t"])


def test_change_points_and_moves(grid, packed):
    runs = p.run_spans(p.episode_ends(packed))
    theirs = durable(k.change_points(grid))
    same(p.change_points(packed, runs), theirs, [*KEYS, "cut_t"])
    same(p.changes(packed, theirs), s.changes(grid, theirs), [*KEYS, "cut_t"])


def test_relations(grid, packed):
    base = grid.where("t < 0")
    theirs = r.rank_pairs(base, 0.3).select("run_id", "a", "b", "rho").join(r.lagged_pairs(base, 5), ["run_id", "a", "b"])
    same(p.relations(packed, 0.3, 5), theirs, ["a", "b"], 1e-6)


def test_deviations_refits_and_trends(grid, packed):
    peers = durable(plans.peers(grid))
    aligned = durable(drift.align_peers(grid, peers))
    models = durable(drift.fit_models(aligned, 0))
    dev, ours = durable(drift.deviations(aligned, models)), durable(p.deviations(packed, peers))
    modelled = ours.where("model is not null")
    same(modelled.select(*KEYS, "sigma", F.inline("model")), models, [*KEYS, "peer"], 1e-6)
    same(p.unpack(modelled.select(*KEYS, "d"), "d"), dev, [*KEYS, "t"], 1e-6)
    alone = p.unpack(ours.where("model is null").select(*KEYS, "d"), "d").where("sensor = 'discount'").toPandas()
    base = alone[alone["t"] < 0]["v"]
    assert np.allclose(alone["expected"], base.median()) and np.allclose(alone["deviation"], (alone["v"] - base.median()) / max(1.4826 * (base - base.median()).abs().median(), 1e-12), equal_nan=True)

    alarms = k.cusum(dev.where("t >= 0").withColumn("v", F.col("deviation")), 0.5, 20.0)
    theirs = drift.decide(drift.block_stats(dev, 0, 16, 4), alarms, 3.0).drop("drifting")
    same(p.block_trends(modelled, 0.5, 20.0, 16, 4), theirs, KEYS, 1e-4)  # p by another approximation
    suspects = grid.select("run_id").distinct().select("run_id", F.explode(F.array(F.lit("price[A]"), F.lit("rows"))).alias("sensor"))
    same(p.refits(packed, peers, suspects, 1.5), drift.refits(aligned, suspects, 0, 1.5), ["suspect", "peer"], 1e-6)


def test_fault_marks(grid, packed):
    ours = p.deviations(packed, durable(plans.peers(grid)))
    long = durable(p.unpack(ours.select(*KEYS, "d"), "d"))
    late = long.withColumn("t", F.col("t") - 60)
    marks = p.fault_marks(ours.withColumn("onset", F.lit(60)), 358, 16)
    same(marks.select(*KEYS, "gain"), faults.scale_change(late.select(*KEYS, "episode", "t", "v"), 0).select(*KEYS, "gain"), KEYS)
    theirs = faults.level_dependence(late, 0).select(*KEYS, "rho").toPandas().set_index("sensor")["rho"]
    for x in marks.collect():
        if x.sensor in theirs:
            assert math.isclose(x.rho, theirs[x.sensor], abs_tol=1e-6)
    same(marks.select(*KEYS, F.col("kind").alias("fault")), faults.process_kind(late, 0, 358, 16).select(*KEYS, "fault"), KEYS)


def test_fingerprints(grid, packed):
    ours = durable(p.fingerprints(packed))
    held = ours.where("hold = 1")  # step, noise and shares are those of the compressed series
    same(ours, grid.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg(F.col("v").isNull().cast("int")).alias("missing_rate"), F.count_distinct("v").alias("n_distinct")), KEYS)
    same(ours, k.quantiles(grid, {f"p{q}": q / 100 for q in (1, 5, 25, 50, 75, 95, 99)}), KEYS)
    for theirs in (k.mad(grid), k.hold(grid), k.acf_time(durable(k.autocorrelation(grid, 40))), k.dominant_period(durable(k.autocorrelation(grid, 40)), 0.5), r.range_per_mad(grid)):
        same(ours, theirs, KEYS, 1e-6)
    only = held.select(*KEYS)
    for theirs in (k.step_size(grid), k.noise_level(grid), s.flat_share(grid), s.monotonic_share(grid)):
        same(held, theirs.join(only, KEYS), KEYS, 1e-6)
    same(ours.select(*KEYS, F.posexplode("histogram").alias("bin", "n")), k.histogram(grid), [*KEYS, "bin"])


def test_change_groups(spark, grid):
    """Groups opened by their first member, by hand."""
    rows = [("r", "a", 100, 1.0), ("r", "b", 103, 2.0), ("r", "c", 104, 1.0), ("r", "a", 200, 1.0), ("r", "b", 206, 5.0), ("q", "a", 50, 4.0)]
    found = spark.createDataFrame(rows, "run_id string, sensor string, cut_t long, move double")
    got = sorted((x.run_id, x.group, x.start, x.sensors, x.largest, x.counts) for x in s.change_groups(found, 500, 8).collect())
    assert got == [("q", 0, 50, 1, 4.0, True), ("r", 0, 100, 3, 2.0, True), ("r", 1, 200, 1, 1.0, False), ("r", 2, 206, 1, 5.0, True)]


def test_baseline_ends_before_a_failing_sensor(spark):
    """A sensor that is dead from step 800 of 1,000 on, to the end: the baseline ends where its first dead block begins."""
    rng = np.random.default_rng(1)
    rows = [("r", name, 0, t, float(7 if name == "b" and t >= 800 else rng.standard_normal())) for name in "ab" for t in range(1200)]
    g = spark.createDataFrame(rows, "run_id string, sensor string, episode int, t long, v double")
    to = s.bound_by_health(g, 1000, 64).first().to
    assert 736 <= to <= 832 and (to - 500) % 64 == 0
    assert s.bound_by_health(g.where("sensor = 'a'"), 1000, 64).first().to == 1000


def test_report_of_a_planted_drift(spark):
    rows = {x.sensor: x for x in plans.drift_report(spark, FINE).collect()}
    assert "price[A]" in rows
    x = rows["price[A]"]
    assert x.responsible and 300 <= x.onset <= x.alarm <= 340 and x.delay == x.alarm - x.onset and 0.3 < x.severity <= 1 and x.rate > 0 and math.isclose(x.confidence, 1 - x.p)
    blame = {y.suspect: y.responsible for y in plans.drift_responsible(spark, FINE).collect()}
    assert blame["price[A]"] and blame.keys() <= rows.keys() | {"price"}
    assert {(y.victim, y.driver) for y in plans.drift_victims(spark, FINE).collect()} <= {(v, d) for v in rows for d in rows if v != d}


def test_hold_is_compressed(spark):
    rng = np.random.default_rng(0)
    values = np.repeat(rng.standard_normal(60), 5)
    g = spark.createDataFrame([("r", "s", 0, t, float(v)) for t, v in enumerate(values)], "run_id string, sensor string, episode int, t long, v double")
    row = p.fingerprints(p.pack(g)).first()
    assert row.hold == 5 and row.flat_share == 0 and math.isclose(row.noise, p.noise(np.zeros(60), values[::5]))


def planted(n=4000, seed=3):
    """Two groups of followers with lags; sensor b2 of the second drifts from 70% on."""
    rng, rows = np.random.default_rng(seed), {}
    for g in "ab":
        lead = np.zeros(n + 20)
        for t in range(1, n + 20):
            lead[t] = 0.9 * lead[t - 1] + rng.standard_normal()
        for i, (lag, gain) in enumerate(zip((0, 3, 6, 10), (1, 0.8, 0.6, 1.2))):
            rows[f"{g}{i}"] = 10 * i + gain * lead[20 - lag : 20 - lag + n] + rng.standard_normal(n)
    start = int(0.7 * n)
    rows["b2"][start:] += 8 * rows["b2"][:start].std() * np.minimum(1, np.arange(n - start) / 300)
    return rows


@pytest.fixture(scope="module")
def plant(spark):
    rows = planted()
    frame = pd.DataFrame([("demo", name, t // 1000, t, float(v)) for name, values in rows.items() for t, v in enumerate(values)], columns=["run_id", "sensor", "episode", "t", "v"])
    return durable(spark.createDataFrame(frame))


def test_drift_calibration_chooses(spark, plant):
    base = 2400
    own = plant.withColumn("t", F.col("t") - base)
    packed = durable(p.pack(own))
    moved = durable(p.deviations(packed, r.peers(p.relations(packed, 0.3, 20).withColumn("rho", F.col("rho_at_lag")), own.select(*KEYS).limit(0))))
    table = p.choose_drift(durable(p.drift_sweep(moved, 4000, 20, 20, 3.0))).toPandas()
    assert set(table["fault"]) == set(p.DRIFTS) and len(table) == len(p.SLACKS) * len(p.LIMITS) * len(p.DRIFTS)
    assert set(table["pairs"]) == {8 * p.segments_of(4000, base)}
    clean = table[table["fault"] == "clean"].set_index(["slack", "limit"])["rate"]
    chosen = table[table["chosen"]]
    slack, limit = chosen[["slack", "limit"]].drop_duplicates().iloc[0]
    assert len(chosen) == len(p.DRIFTS) and clean[slack, limit] <= p.TARGET
    assert all(clean[slack, x] > p.TARGET for x in p.LIMITS if x < limit)
    rates = chosen.set_index("fault")["rate"]
    assert rates["bias 8"] > 0.9 and rates["bias 8"] >= rates["bias 2"] >= rates["bias 0.5"]
    # one segment by hand: a CUSUM of each slack and limit
    d = moved.where("sensor = 'a1'").select(F.inline("d")).toPandas()
    d = d[d["t"] < 0].sort_values("t")
    edges, many = [i * len(d) // p.segments_of(4000, base) for i in range(p.segments_of(4000, base) + 1)], 0
    for a, b in zip(edges[:-1], edges[1:]):
        part = d.iloc[a:b]
        many += any(p.first_alarm(e["t"].to_numpy(), e["episode"].to_numpy(), e["deviation"].to_numpy(), 0.5, 5.0) is not None for _, e in part.groupby("episode"))
    alone = p.drift_sweep(moved.where("sensor = 'a1'"), 4000, 20, 20, 1e9).where("fault = 'clean' and slack = 0.5 and limit = 5").first()
    assert alone.fired == many


def test_health_calibration_chooses(plant):
    told, found = p.choose_health(durable(p.health_sweep(p.pack(plant.withColumn("t", F.col("t") - 2400)), 64)))
    told, found = told.toPandas(), found.toPandas().set_index("fault")
    assert {c: tuple(told[told["check"] == c].sort_values("candidate", ascending=c != "stuck")["candidate"]) for c in p.CANDIDATES} == p.CANDIDATES
    for check, rows in told.groupby("check"):
        rows = rows.set_index("candidate").loc[list(p.CANDIDATES[check])]
        good = [c for c in rows.index if rows["rate"][c] <= p.TARGET]
        assert rows.index[rows["chosen"]].tolist() == [good[0] if good else rows.index[-1]]
    assert found["rate"]["flatline"] > 0.95 and found["rate"]["dropout"] > 0.9 and found["rate"]["clean"] < 0.2 and found["rate"]["noise"] > found["rate"]["clean"]


def test_components_equal_numpy(plant):
    packed = durable(p.pack(plant))
    model = p.components(packed, 2400).first()
    wide = plant.toPandas().pivot(index="t", columns="sensor", values="v").sort_index()
    x = wide.iloc[:2400].to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.corrcoef(x, rowvar=False))
    values, vectors = values[::-1], vectors[:, ::-1]
    many = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9)) + 1
    assert (model.n, model.k, model.sensors) == (2400, many, list(wide.columns)) and np.allclose(model.variances, values[:many])
    q = vectors[:, :many]
    t2, spe = ((z @ q) ** 2 / values[:many]).sum(1), ((z - z @ q @ q.T) ** 2).sum(1)
    assert np.isclose(model.t2_limit, 1.5 * np.quantile(t2, 0.99)) and np.isclose(model.spe_limit, 1.5 * np.quantile(spe, 0.99))
    windows = plant.select("run_id").distinct().select("run_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("long").alias("from"), F.lit(b).cast("long").alias("to")) for n, a, b in (("base", 0, 2400), ("late", 3200, 4000))])))
    rows = p.component_statistics(packed, p.components(packed, 2400), windows).toPandas()
    base, late = rows[rows["name"] == "base"], rows[rows["name"] == "late"].set_index("sensor")
    assert np.isclose(base["t2"].iloc[0], t2.mean()) and np.isclose(base["spe"].iloc[0], spe.mean()) and set(base["verdict"]) == {"inside its limits"}
    # the drifting sensor breaks the relations and contributes most
    assert set(late["verdict"]) == {"relations broke"} and late["share"].idxmax() == "b2" and np.isclose(late["share"].sum(), 1)
    y = (wide.iloc[3200:].to_numpy() - x.mean(0)) / x.std(0, ddof=1)
    rest = ((y - y @ q @ q.T) ** 2 / np.maximum(1 - (q * q).sum(1), 1e-9)).sum(0)
    assert np.allclose(late["share"].loc[list(wide.columns)], rest / rest.sum())


def test_odd_series(spark):
    schema = "run_id string, sensor string, episode int, t long, v double"
    empty = p.pack(spark.createDataFrame([], schema))
    odd = p.pack(spark.createDataFrame([("r", "none", 0, k, None) for k in range(30)] + [("r", "one", 0, 0, 1.0)] + [("r", "same", k // 10, k, 2.0) for k in range(30)], schema))
    peers = spark.createDataFrame([("r", "same", "one", 0)], "run_id string, sensor string, peer string, lag int")
    for packed in (empty, odd):
        many = packed.count()
        assert p.fingerprints(packed).count() == many and p.deviations(packed, peers).count() == many
        assert p.components(packed, 30).count() == 0 and p.relations(packed, 0.3, 3).count() == 0
        assert p.change_points(packed, p.run_spans(p.episode_ends(packed))).count() == 0
        assert p.health_blocks(packed.withColumn("end", F.lit(15)), 64).count() >= many
        assert p.block_trends(p.deviations(packed, peers), 0.5, 5.0, 4, 2).count() == many and p.drift_sweep(p.deviations(packed, peers), 30, 4, 2, 3.0).count() == 0
