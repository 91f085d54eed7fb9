"""Trends against all pairs."""

import math
import random

import numpy as np
import pytest

from tideline.operators import trends


def signs(v):
    v = np.asarray(v, float)
    return int(np.sign(v[None, :] - v[:, None])[np.triu_indices(len(v), 1)].sum()) if len(v) > 1 else 0


@pytest.mark.parametrize("levels", [1, 2, 3, 50, 10**6])
def test_pair_signs(levels):
    rng = np.random.default_rng(levels)
    for n in (0, 1, 2, 3, 17, 200):
        v, groups = rng.integers(0, levels, n) / 7, rng.integers(0, 4, n)
        assert trends.pair_signs(v) == signs(v)
        assert trends.pair_signs(v, groups) == sum(signs(v[groups == k]) for k in range(4))


def series():
    rng = random.Random(8)
    out = {"walk": [], "ties": [], "hot": [], "down": [], "gaps": [], "two": [1.0, 2.0], "one": [1.0], "same": [3.0] * 300}
    level = 0.0
    for k in range(700):
        level += rng.gauss(0, 1)
        out["walk"].append(level)
        out["ties"].append(float(rng.randrange(4)))
        out["hot"].append(5.0 if rng.random() < 0.5 else rng.gauss(5, 1))
        out["down"].append(-k / 10 + rng.gauss(0, 3))
        out["gaps"].append(None if rng.random() < 0.7 else rng.gauss(k / 50, 1))
    return out


@pytest.mark.parametrize("block", [16, 100, 8192])
def test_mann_kendall(spark, block):
    data = series()
    rows = [("r", name, k - 30, v) for name, values in data.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run_id string, sensor string, t long, v double")
    got = {r.sensor: r for r in trends.mann_kendall(df, block).collect()}
    assert set(got) == set(data)
    for name, values in data.items():
        v = np.array([x for x in values if x is not None])
        n, s = len(v), signs(v) if len(v) > 2 else 0
        _, ties = np.unique(v, return_counts=True)
        var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
        z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
        assert got[name].s == s and math.isclose(got[name].var, var) and math.isclose(got[name].z, z, abs_tol=1e-12), name
        assert abs(got[name].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-6


def test_long_series(spark):
    """20,160 points, as long as the largest grid, with ties; the slope of sampled pairs is within its error."""
    rng = np.random.default_rng(1)
    v = np.round(np.arange(20_160) * 2e-4 + rng.standard_normal(20_160), 1)
    df = spark.createDataFrame([("r", "s", k, float(x)) for k, x in enumerate(v)], "run_id string, sensor string, t long, v double")
    # S of all 203 million pairs, by ranks of what came before
    order, counts, s = np.unique(v), np.zeros(len(np.unique(v)), np.int64), 0
    for k in np.searchsorted(order, v):
        s += int(counts[:k].sum() - counts[k + 1 :].sum())
        counts[k] += 1
    for block in (1000, 8192, 1 << 20):
        assert trends.mann_kendall(df, block).first().s == s
    fit = trends.theil_sen(df).first()
    assert abs(fit.slope - 2e-4) < 5e-6 and abs(fit.intercept) < 0.1


def test_theil_sen_short(spark):
    data = series()
    df = spark.createDataFrame([("r", name, k, v) for name, values in data.items() for k, v in enumerate(values)], "run_id string, sensor string, t long, v double")
    got = {r.sensor: r for r in trends.theil_sen(df).collect()}
    for name, values in data.items():
        t, v = np.array([(k, x) for k, x in enumerate(values) if x is not None]).T
        a, b = np.triu_indices(len(t), 1)
        slope = np.median((v[b] - v[a]) / (t[b] - t[a])) if len(t) > 1 else 0.0
        assert math.isclose(got[name].slope, slope, abs_tol=1e-12) and math.isclose(got[name].intercept, np.median(v - slope * t), abs_tol=1e-9), name
