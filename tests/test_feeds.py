"""Feeds whose writes follow what lands, windows against stored sketches, chains and chunks of one long key, by hand."""

import datetime as dt
import hashlib
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tideline.operators import corpus, reports
from tideline.streaming import live

SCHEMA = "channel long, id long, version long, body string, deleted boolean, ts timestamp"
START = dt.datetime(2024, 1, 1)


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/landed")


def arrive(spark, path, **of):
    live.feed(spark.readStream.schema(SCHEMA).parquet(f"{path}/landed"), path, **of)


def message(i, version, gone=False):
    return (None if i % 7 == 0 else i % 4, i, version, f"text {i} {version}", gone, START + dt.timedelta(seconds=version))


def rows_of(folder):
    return {f.parent.name: f.stat().st_size for f in Path(folder).rglob("*.parquet")}


def test_a_feed_writes_what_lands(spark, tmp_path):
    path, rng, want = str(tmp_path), random.Random(3), {}
    parts = [[message(i, 1) for i in range(3000)]]
    parts += [[message(rng.randrange(3100), rng.randrange(4), rng.random() < 0.3) for _ in range(20)] for _ in range(4)]
    parts.append([message(i, 9) for i in range(3000)])  # outweighs what is there
    parts += [[message(5, 3), message(5, 12, True), message(5, 11)], [message(6, 2), message(6, 2)]]
    for number, part in enumerate(parts):
        land(spark, path, part)
        arrive(spark, path, buckets=4)
        for m in part:
            want[m[1]] = max(want.get(m[1], m), m, key=lambda x: (x[2], x[4]))
        got = {r.id: (r.version, r.deleted, r.body) for r in live.messages(spark, path).collect()}
        assert got == {i: (m[2], m[4], m[3]) for i, m in want.items()}
        written = spark.read.parquet(f"{path}/messages/batch={number}").count()
        assert written <= len(part) if number != 6 else written >= 3000  # the batch after the large one writes buckets as one
    # what was written as one again is gone where it lay before, and only two manifests are kept
    assert not rows_of(f"{path}/messages/batch=0") and not rows_of(f"{path}/messages/batch=5") and rows_of(f"{path}/messages/batch=6")
    assert sorted(p.name for p in Path(f"{path}/manifest").glob("version=*")) == ["version=6", "version=7"]


def test_a_feed_repeats_a_batch_that_failed(spark, tmp_path):
    path = str(tmp_path)
    for k in range(4):
        land(spark, path, [message(i, k) for i in range(k, 40)])
        arrive(spark, path, buckets=3, most_parts=1)
        before = sorted(map(repr, live.messages(spark, path).collect()))
        # the stream's last mark is lost, with and without the table's: the batch runs again, from the manifest before it
        for mark in Path(f"{path}/manifest/state/commits").glob(f"*{k}*"):
            mark.unlink()
        if k % 2:
            live.remove(spark, [f"{path}/manifest/done/batch={k}", f"{path}/manifest/version={k}"])
        arrive(spark, path, buckets=3, most_parts=1)
        assert sorted(map(repr, live.messages(spark, path).collect())) == before and len(before) == 40
    assert {r.version for r in live.messages(spark, path).where("id = 39").collect()} == {3}


def test_windows_against_a_stored_sketch(spark, tmp_path):
    rng, path = np.random.default_rng(2), str(tmp_path)
    rows = [("a", START + dt.timedelta(seconds=i * 0.36), float(v)) for i, v in enumerate(rng.gamma(2.0, 10.0, 40_000))]
    rows += [("b", START + dt.timedelta(minutes=i), float(i % 7) if i % 5 else None) for i in range(240)] + [("c", START, 1.0), ("a", START, float("nan")), ("a", START + dt.timedelta(days=1), 1.0)]
    frame = spark.createDataFrame(rows, "event_type string, ts timestamp, value double")
    frame.coalesce(1).write.parquet(f"{path}/landed")
    held = [("a", float(v)) for v in rng.gamma(2.0, 12.0, 30_000)] + [("b", float(k)) for k in range(5)]
    live.value_sketches(spark.createDataFrame(held, "event_type string, value double")).write.parquet(f"{path}/stored")
    stream = spark.readStream.schema(frame.schema).parquet(f"{path}/landed")
    got = {(r.event_type, r.start): r for r in live.to_table(live.sliding_distances(stream, 60, 15, "1 hour", spark.read.parquet(f"{path}/stored"))).collect()}
    ranks = (np.arange(200) + 0.5) / 200
    at = lambda values, q: np.sort(values)[np.clip(np.ceil(np.round(np.clip(q, 0, 1) * len(values), 9)).astype(int) - 1, 0, len(values) - 1)]
    checked = {"a": 0, "b": 0}
    for (kind, start), r in got.items():
        values = np.array([v for k, ts, v in rows if k == kind and start <= ts < start + dt.timedelta(hours=1) and v is not None and v == v])
        against = np.array([v for k, v in held if k == kind])
        assert r.n == len(values)
        want = np.abs(at(values, ranks) - at(against, ranks)).mean()
        slack = 0.0 if len(values) < 2048 and kind == "b" else sum((at(x, ranks + 0.002) - at(x, ranks - 0.002)).mean() for x in (values, against))
        assert abs(r.distance - want) <= slack + 1e-9
        checked[kind] += 1
    assert checked["a"] >= 15 and checked["b"] >= 15


def test_windows_are_not_broadcast_to_their_reference(spark, tmp_path, monkeypatch):
    """The last batch has no new rows, only the windows in state; they go by the reference, or are shuffled to a large one, and never pass the driver."""
    path = str(tmp_path)
    rows = [(k, START + dt.timedelta(minutes=i), float((i * 7) % 11 + (k == "b"))) for k in ("a", "b") for i in range(600)]
    frame = spark.createDataFrame(rows, "event_type string, ts timestamp, value double")
    frame.coalesce(1).write.parquet(f"{path}/landed")
    live.value_sketches(frame).write.parquet(f"{path}/stored")
    got = {}
    for most in (live.BROADCAST_TYPES, 1):
        monkeypatch.setattr(live, "BROADCAST_TYPES", most)
        stream = live.sliding_distances(spark.readStream.schema(frame.schema).parquet(f"{path}/landed"), 60, 15, "1 hour", spark.read.parquet(f"{path}/stored"))
        run = stream.writeStream.format("parquet").option("path", f"{path}/out{most}").option("checkpointLocation", f"{path}/state{most}").trigger(availableNow=True).start()
        run.awaitTermination()
        assert len(run.recentProgress) > 1 and run.recentProgress[-1].numInputRows == 0
        plan = run._jsq.explainInternal(False)
        assert "BuildLeft" not in plan and ("BroadcastHashJoin" if most > 1 else "SortMergeJoin") in plan
        got[most] = sorted(map(tuple, spark.read.parquet(f"{path}/out{most}").collect()))
    assert len({str(x) for x in got.values()}) == 1 and len(got[1]) > 50


def test_long_chains_and_sources_pass_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [("long", k, None if k % 9 == 0 else f"row {k}") for k in range(200)] + [("one", 0, "x"), (None, 0, "y"), (None, 1, "")]
        log = spark.createDataFrame(rows, "run_id string, seq long, text string").repartition(5)
        want, own = {}, {}
        for run, seq, text in rows:
            prev = own.get(run, "")
            own[run] = hashlib.sha256((prev + (text or "")).encode()).hexdigest()
            want[run, seq] = (prev, own[run])
        built = reports.build_chain(log)
        assert {(r.run_id, r.seq): (r.prev_hash, r.hash) for r in built.collect()} == want
        assert all(r.first_bad is None for r in reports.verify_chain(built).collect())
        assert "mapInArrow" in built._jdf.queryExecution().toString() or "MapInArrow" in built._jdf.queryExecution().toString()
        segments = [(1, k, k // 50, "x" * (4 * (k % 11))) for k in range(300)] + [(2, k, 0, None) for k in range(20)]
        got = corpus.chunks(spark.createDataFrame(segments, "source_id long, seq long, block long, text string").repartition(5), 40).collect()
        chunk, size, block, bounds = 0, 0, 0, {}
        for _, k, b, text in segments[:300]:
            n = k % 11
            if size and (size + n > 40 or b != block):
                chunk, size, block = chunk + 1, n, b
            else:
                size += n
            low, _ = bounds.get(chunk, (k, k))
            bounds[chunk] = (low, k)
        assert {r.chunk: (r.from_seq, r.to_seq) for r in got if r.source_id == 1} == bounds
        assert [(r.from_seq, r.to_seq, r.n, r.tokens, r.text) for r in got if r.source_id == 2] == [(0, 19, 20, 0, "")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert corpus.chunks(spark.createDataFrame([], "source_id long, seq long, block long, text string"), 40).count() == 0
    assert reports.build_chain(log.where("false").withColumn("more", F.lit(1))).count() == 0
