"""The chained analysis: what it learns from raw rows, and what it says of a planted drift."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import kernels as k
from tideline.operators import relations as r
from tideline.operators import signals as s
from tideline.operators.analysis import analyse, block_size
from tideline.plans import analysis, fixtures
from tideline.plans.drift import ramp

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    return {name: df.toPandas() for name, df in analysis.analysed(spark, DATA).items()}


def test_the_drifting_sensor_is_an_incident_and_its_total_is_not(found):
    """Thin last weeks may raise one more alarm."""
    rows = {tuple(x.drivers): x for x in found["incidents"].itertuples()}
    assert ("price[A]",) in rows and len(rows) <= 2 and not any("price" in d for d in rows)
    drift = rows["price[A]",]
    assert drift.fault.startswith("sensor-drift") and drift.family == "sensor" and 295 <= drift.onset <= 330 and drift.n_victims == 1


def test_what_contains_it_is_its_victim(found):
    assert set(zip(found["victims"]["victim"], found["victims"]["driver"])) == {("price", "price[A]")}
    assert found["baseline"]["to"][0] <= 300


def test_peers_are_of_the_same_measure_and_carry_signed_lags(found):
    assert len(found["peers"]) > 20 and all(a.split("[")[0] == b.split("[")[0] for a, b in zip(found["peers"]["sensor"], found["peers"]["peer"]))
    both = {(a, b): lag for a, b, lag in found["peers"][["sensor", "peer", "lag"]].itertuples(index=False)}
    assert all(both[b, a] == -lag for (a, b), lag in both.items() if (b, a) in both)


def test_without_the_drifting_sensor_nothing_is_left(spark):
    assert analysis.analysed(spark, DATA, ["price[A]"])["incidents"].where("array_contains(drivers, 'price[A]') or array_contains(drivers, 'price')").count() == 0


def test_an_empty_grid_has_no_incidents(spark):
    empty = spark.createDataFrame([], "run_id string, sensor string, episode int, t long, v double")
    assert all(df.count() == 0 for df in analyse(empty, F.col("sensor")).values())


def test_block_sums_give_the_best_lags(spark, monkeypatch):
    monkeypatch.setattr(r, "SPAN", 50)
    g = fixtures.grid(spark, DATA).withColumn("t", F.col("t") - 111)
    ours = r.lagged_pairs(g, 6).toPandas().set_index(["a", "b"]).sort_index()
    pairs = r.rank_pairs(g, 0.0).select("run_id", "a", "b")
    want, flat = (k.cross_correlation(g, pairs, m).toPandas().set_index(["a", "b"]).sort_index() for m in (6, 0))
    assert list(ours.index) == list(want.index) and list(ours["lag"]) == list(want["lag"])
    assert (ours["rho_at_lag"] - want["rho"]).abs().max() < 1e-9 and (ours["at_zero"] - flat["rho"]).abs().max() < 1e-9


def test_a_lagging_copy_is_found_behind(spark):
    g = ramp(spark, DATA).where("sensor = 'rows'")
    late = g.withColumns({"sensor": F.lit("late"), "t": F.col("t") + 3}).join(g.select("episode", "t"), ["episode", "t"], "left_semi").select(*g.columns)
    row = r.lagged_pairs(g.unionByName(late), 6).head()
    assert (row.a, row.b, row.lag) == ("late", "rows", -3) and row.rho_at_lag > 0.999


def test_runs_have_baselines_of_their_own(spark):
    g = spark.createDataFrame(pd.DataFrame([(run, "s", 0, t, float(t % 7)) for run, n in (("a", 400), ("b", 300)) for t in range(n)], columns=["run_id", "sensor", "episode", "t", "v"]))
    ends = g.withColumn("end", F.when(F.col("run_id") == "a", 240).otherwise(180))
    assert {x.run_id: x["to"] for x in s.bound_by_health(ends, F.col("end"), 64).collect()} == {"a": 240, "b": 180}


@pytest.mark.parametrize("n, day, want", [(20160, 1440, 1440), (20160, 0, 100), (20160, 12, 100), (50, 0, 1)])
def test_drift_blocks(n, day, want):
    assert block_size(n, day) == want
