"""Tools of an investigation and exports of the log, by hand."""

import csv
import io
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import reports

GRID = "run_id string, sensor string, episode int, t long, v double"


def frame(spark, series, episode=40):
    rows = [("r", name, t // episode, t, v) for name, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, GRID).repartition(3)


def test_windows_of_a_sensor(spark):
    rng = np.random.default_rng(1)
    moved = [None if t % 11 == 0 else float(rng.normal(5 if t < 60 else 9, 1 + t % 2)) for t in range(120)]
    got = {x.sensor: x for x in reports.compare_windows(frame(spark, {"moved": moved, "flat": [2.0] * 120, "late": [None] * 60 + [float(t) for t in range(60)], "none": [None] * 120}), (0, 60), (60, 120)).collect()}
    a, b = (np.array([v for v in part if v is not None]) for part in (moved[:60], moved[60:]))
    mad = lambda x: 1.4826 * np.median(np.abs(x - np.median(x)))
    low, high = min(np.quantile(a, 0.01), np.quantile(b, 0.01)), max(np.quantile(a, 0.99), np.quantile(b, 0.99))
    bins = lambda x: np.bincount([0 if v < low else 19 if v > high else min(19, 1 + int((v - low) // ((high - low) / 18))) for v in x], minlength=20).tolist()
    mids = (np.arange(200) + 0.5) / 200
    m = got["moved"]
    assert (m.n_a, m.n_b, m.bins_a, m.bins_b) == (len(a), len(b), bins(a), bins(b))
    want = [np.median(a), np.median(b), mad(a), mad(b), low, high, np.abs(np.quantile(a, mids) - np.quantile(b, mids)).mean()]
    assert np.allclose([m.median_a, m.median_b, m.mad_a, m.mad_b, m.lo, m.hi, m.distance], want)
    assert got["flat"].bins_a[9] == 60 and (got["flat"].mad_a, got["flat"].distance) == (0.0, 0.0)
    assert (got["late"].n_a, got["late"].median_a, got["late"].n_b, sum(got["late"].bins_a), sum(got["late"].bins_b)) == (0, None, 60, 0, 60)
    assert (got["none"].n_a, got["none"].lo, sum(got["none"].bins_b)) == (0, None, 0)


def test_relation_in_a_window(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=160)
    later = np.concatenate([rng.normal(size=3), base[:-3] ** 3])  # follows by three samples
    series = {"a": base.tolist(), "b": later.tolist(), "same": np.exp(base).tolist(), "gone": [None] * 160}
    g = frame(spark, series, 160)
    pairs = spark.createDataFrame([("r", "a", "b"), ("r", "a", "same"), ("r", "a", "gone")], "run_id string, a string, b string")
    got = {x.b: x for x in reports.relation_in_window(g, pairs, (20, 140)).collect()}
    ranks = lambda x: np.argsort(np.argsort(x)).astype(float)
    assert abs(got["b"].rho - np.corrcoef(ranks(base[20:140]), ranks(later[20:140]))[0, 1]) < 1e-9
    assert (got["b"].lag, got["b"].n) == (3, 120) and abs(got["b"].rho_at_lag - np.corrcoef(base[20:137], later[23:140])[0, 1]) < 1e-9
    assert abs(got["same"].rho - 1) < 1e-9 and got["same"].lag == 0
    assert (got["gone"].rho, got["gone"].n, got["gone"].lag) == (0.0, 0, None)
    # lags end where the window does, and cross no episode
    assert {x.b: x.lag for x in reports.relation_in_window(g, pairs, (20, 24)).collect()}["b"] in (-2, -1, 0, 1, 2)
    split = reports.relation_in_window(frame(spark, series, 2), pairs, (0, 160)).collect()
    assert all(x.lag is None or abs(x.lag) < 2 for x in split)


def test_alerts_of_both_kinds(spark):
    health = spark.createDataFrame([("r", "a", "stuck"), ("r", "b", "healthy"), ("r", "c", "healthy")], "run_id string, sensor string, health string")
    drift = spark.createDataFrame([("r", "a", True), ("r", "b", True), ("r", "c", False)], "run_id string, sensor string, drifting boolean")
    assert sorted(map(tuple, reports.alerts(health, drift).collect())) == [("r", "a", "drift", "drifting"), ("r", "a", "health", "stuck"), ("r", "b", "drift", "drifting")]


def test_a_log_is_exported_and_read_again(spark, tmp_path):
    texts = ["plain", 'a "quote", and a comma', "line\nbreak", "carriage\rreturn", "", None, "ünï, code", ' "', "end"]
    entries = [(k, texts[k % len(texts)], {"k": k, "s": 'x,"y"'} if k % 2 else None, k % 3 == 0) for k in range(200)]
    log = spark.createDataFrame(entries, "seq long, text string, payload struct<k:long,s:string>, good boolean").repartition(7)
    columns = ["seq", "text", "payload", "good"]
    reports.export_log(log, columns, "seq", f"{tmp_path}/csv", "csv")
    whole = "".join(p.read_bytes().decode() for p in sorted(Path(f"{tmp_path}/csv").glob("part-*")))
    got = list(csv.reader(io.StringIO(whole, newline="")))
    assert got[0] == columns and whole.endswith("\r\n") and len(got) == 201
    for (seq, text, payload, good), (a, b, c, d) in zip(entries, got[1:]):
        assert (int(a), b, json.loads(c) if c else None, d) == (seq, text or "", payload, "true" if good else "false")
    reports.export_log(log, columns, "seq", f"{tmp_path}/json", "json")
    lines = "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/json").glob("part-*"))).splitlines()
    assert [tuple(json.loads(x)[c] for c in columns) for x in lines] == entries
    reports.export_log(log.where(F.lit(False)), columns, "seq", f"{tmp_path}/empty", "csv")
    assert "".join(p.read_text() for p in Path(f"{tmp_path}/empty").glob("part-*")).strip() == "seq,text,payload,good"
    with pytest.raises(ValueError, match="xml"):
        reports.export_log(log, columns, "seq", f"{tmp_path}/xml", "xml")
