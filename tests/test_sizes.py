"""Rules and costs that show on larger tables only."""

import datetime as dt
import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tideline import session
from tideline.operators import corpus, kernels, reports
from tideline.operators import privacy as guards
from tideline.plans import files, fixtures, privacy, threads
from tideline.plans import kernels as plans
from tideline.streaming import live


def written(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_contradicted_claims_of_a_long_line(spark, tmp_path):
    long = "a very long line " * 20_000 + ". You are an idiot here."
    rows = [(1, long), (2, "This is released under the license MIT.\nWhat an idiot he is."), (3, None)]
    written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    began = time.perf_counter()
    assert {(r.doc_id, r.column_id) for r in files.claim_contradicted(spark, str(tmp_path)).collect()} == {(2, 2)}
    assert time.perf_counter() - began < 30


def test_halves_of_three_digits_go_up_in_sql_too(spark):
    values = [1.0, 7.0, 10.0, 99.0, 999.0, 1000.0, 1004.0, 1005.0, 1705.0, 1715.0, 2995.0, 9995.0, 10_250.0, 10_350.0, 99_950.0, 1_234_500.0]
    ours = spark.createDataFrame([(v,) for v in values], "v double").select(kernels.round_sig("v").alias("r")).collect()
    theirs = duckdb.sql(f"SELECT {privacy.THREE.format(x='v')} FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()
    assert [r.r for r in ours] == [r[0] for r in theirs] and ours[8].r == 1710.0


def test_leak_index_rounds_parts_of_a_number_like_its_sql(spark):
    values = [0.07125, 0.04325, 0.0372, 25.45, 25.25, 1.005, 1.015, 9.995, 99.95, 0.1, 0.001, 1e-6, 36_949.99, 38_250.0, -0.07125, 0.0]
    ours = spark.createDataFrame([(v,) for v in values], "v double").select(guards.three_digits(F.col("v")).alias("r")).collect()
    theirs = duckdb.sql(f"SELECT {privacy.THREE.format(x='v')} FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()
    assert [r.r for r in ours] == [r[0] for r in theirs] and ours[0].r == 0.0712
    odd = spark.createDataFrame([(float("inf"),), (None,), (1e-310,)], "v double").select(guards.three_digits(F.col("v")).alias("r")).collect()
    assert [r.r for r in odd] == [float("inf"), None, 1e-310]
    # what was sent rounded is found again: raw values at a half too
    raw = spark.createDataFrame([("x", "s", t, v) for t, v in enumerate((0.04325, 0.07125, 1.005))], "run_id string, sensor string, t long, v double")
    sent = raw.groupBy().agg(guards.round_values(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"])).cast("string").alias("text"))
    assert [r.hits for r in guards.leak_scan(sent.select(F.lit(1).alias("payload_id"), "text"), guards.leak_index(raw)).collect()] == [1]


def test_leak_index_holds_the_triples_of_every_sensor(spark, tmp_path):
    rng = random.Random(9)
    rows = [(dt.date(1994, 1, 3) + dt.timedelta(days=7 * week + rng.randrange(5)), rng.choice("ANR"), rng.randrange(1, 51) * 1.0, rng.randrange(90_000, 9_000_000) / 100, rng.randrange(11) / 100, rng.randrange(9) / 100) for week in range(60) for _ in range(rng.randrange(12, 30))]
    written(spark, tmp_path, "lineitem", rows, "l_shipdate date, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    series = defaultdict(list)
    for r in fixtures.grid(spark, str(tmp_path)).where("v is not null").withColumn("r", guards.three_digits(F.col("v"))).orderBy("sensor", "t").collect():
        if series[r.sensor][-1:] != [r.r]:
            series[r.sensor].append(r.r)
    own = {k: set(zip(x, x[1:], x[2:], strict=False)) for k, x in series.items()}
    got = [tuple(r) for r in privacy.leak_index(spark, str(tmp_path)).collect()]
    assert len(own) == 20 and all(own.values()) and set(got) == set().union(*own.values()) and len(set(got)) == len(got)


def test_quantiles_of_a_large_reference_are_exact(spark):
    rng = np.random.default_rng(3)
    held = {"a": rng.gamma(2.0, 12.0, 30_000), "b": rng.integers(0, 9, 5000).astype(float), "c": np.array([1.5, 2.5, 7.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in held.items() for v in x] + [("a", None), ("a", float("nan"))], "event_type string, value double")
    got = {r.event_type: r.stored for r in live.value_sketches(rows).collect()}
    ranks = 2 * np.arange(live.POINTS) + 1
    assert got == {k: np.sort(x)[-(-ranks * len(x) // (2 * live.POINTS)) - 1].tolist() for k, x in held.items()}


def test_edges_of_histograms_are_the_same_number_in_sql(spark):
    rng = np.random.default_rng(5)
    held = {k: rng.integers(0, 60 * 10 ** (k % 4), 200 + 13 * k).astype(float).tolist() for k in range(30)}
    frame = spark.createDataFrame([(k, v) for k, x in held.items() for v in x], "k int, v double")
    ours = {r.k: (r.lo, r.hi) for r in frame.groupBy("k").agg(F.expr("percentile(v, 0.01)").alias("lo"), F.expr("percentile(v, 0.99)").alias("hi")).collect()}
    for k, x in held.items():
        p1, p99 = (duckdb.sql(f"SELECT {plans.PLACED.format(p='p')} FROM (SELECT {sorted(x)}::DOUBLE[] AS x, {len(x) - 1} * CAST({p} AS DOUBLE) AS p)").fetchall()[0][0] for p in (0.01, 0.99))
        assert (p1, p99) == ours[k]


def test_trigrams_counted_at_once_equal_the_plain_form():
    texts = ["Pump pressure pump", None, "", "a", "\U0001f600 Å中 straße", "x" * 300]
    want = np.zeros((len(texts), corpus.DIMENSIONS))
    for i, x in enumerate(texts):
        padded = f" {(x or '').lower()} "
        for gram, n in Counter(padded[k : k + 3] for k in range(len(padded) - 2)).items():
            h = corpus.fnv(gram.encode())
            want[i, h % corpus.DIMENSIONS] += np.log1p(n) * (1 if h >> 31 else -1)
        want[i] /= np.linalg.norm(want[i]) or 1
    assert np.allclose(corpus.embedded(texts, {}), want, atol=1e-6) and corpus.embedded([], {}).shape == (0, corpus.DIMENSIONS)


def test_batches_of_texts_stay_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for held, want in (("10000", str(session.TEXT_ROWS)), ("0", str(session.TEXT_ROWS)), ("7", "7")):
            spark.conf.set(key, held)
            pairs = spark.createDataFrame([("a b c", "a b d"), (None, "x")], "quote string, body string")
            assert [r.method for r in corpus.quotes_fuzzy(pairs).collect()].count("none") == 2
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_ancestors_of_a_chain_are_made_once(spark):
    links = spark.createDataFrame([(k, k - 1 if k else None) for k in range(1500)] + [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5000)], "id long, supersedes long")
    began = time.perf_counter()
    got = reports.ancestors(links).agg(F.count("*"), F.sum(F.when(F.col("id") < 5000, F.col("id") - F.col("ancestor") - F.col("depth")).otherwise(0)), F.sum(F.when(F.col("id") >= 5000, F.col("depth")))).first()
    assert tuple(got) == (1500 * 1499 // 2 + 9, 0, 3 * (1 + 2) + 1 + 2 + 3)
    assert time.perf_counter() - began < 60


def plain_turns(words, gap, most):
    out, since, latest, cut = [], 0, 0, False
    for w in words:
        fresh = not out or w["speaker"] != out[-1][0] or w["start_ms"] - latest > gap
        if fresh or cut:
            _, island, part = out[-1][:3] if out else (None, 0, 0)
            out.append([w["speaker"], island + fresh, 0 if fresh else part + 1, w["start_ms"], w["end_ms"], 0, []])
            since = 0
        turn = out[-1]
        turn[3], turn[4], turn[5] = min(turn[3], w["start_ms"]), max(turn[4], w["end_ms"]), turn[5] + 1
        turn[6].append(w["word"])
        since += len(w["word"]) + 1
        cut = since > most and w["word"][-1:] in (".", "!", "?")
        latest = max(latest, w["end_ms"])
    return [(*turn[:6], " ".join(turn[6])) for turn in out]


def test_turns_of_stretches_equal_the_plain_form(spark):
    draw, rows, want = random.Random(3), [], {}
    for source in range(12):
        words, at, speaker = [], 0, 0
        for _ in range(draw.choice([1, 5, 300])):
            # some words begin before the one before has ended, or last until after later ones
            at = max(0, at + draw.choice([-300, 50, 100, 100, 900, 1001, 1200]))
            speaker = speaker if draw.random() < 0.93 else draw.choice([0, 1, None])
            words.append({"speaker": speaker, "word": draw.choice(["so", "pump.", "Why?", "", "pressure", "\U0001f600", "end.\u2028"]), "start_ms": at, "end_ms": at + draw.choice([100, 300, 300, 2500])})
            at += 100
        want[source] = plain_turns(words, 1000, 30)
        k = 0
        while k < len(words):
            size = draw.choice([1, 1, 4, 60])
            rows.append((source, k, words[k : k + size]))
            k += size
        rows.append((source, k, []))
    draw.shuffle(rows)
    stretches = spark.createDataFrame(rows, "source_id long, pos long, words array<struct<speaker: int, word: string, start_ms: long, end_ms: long>>").repartition(5)
    got = {}
    for r in corpus.word_turns(stretches, 1000, 30).orderBy("source_id", "island", "part").collect():
        got.setdefault(r.source_id, []).append((r.speaker, r.island, r.part, r.start_ms, r.end_ms, r.n_words, r.text))
    assert got == want and any(r[2] > 1 for turns in want.values() for r in turns)


def test_words_of_turns_are_shuffled_once_and_as_texts(spark, tmp_path):
    written(spark, tmp_path, "documents", [(k, "\n".join(f"line {j} of a text." for j in range(50))) for k in range(20)], "doc_id long, text string")
    got = threads.word_turns(spark, str(tmp_path))
    assert got.count() == 20 * 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "posexplode(words" not in plan


def test_words_of_questions_are_found_in_one_read_of_the_texts(spark, monkeypatch):
    rows = [(1, "The pump, the PUMP and a valve"), (2, "no such thing"), (3, ""), (4, None), (5, "Größe der pump_2"), (5, "valve valve"), (6, "valve")]
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", read("text"))
    questions = spark.createDataFrame([(1, "the pump?"), (2, "größe of a Valve"), (3, "")], "query_id long, text string")
    found = lambda: sorted((r.query_id, r.place, r.doc_id, round(r.score, 9)) for r in corpus.lexical_top(docs, questions, 3).collect())
    once = found()
    assert reads.value == len(rows) and [x[:3] for x in once] == [(1, 1, 1), (2, 1, 5), (2, 2, 1), (2, 3, 6)]
    # by hand: the six texts that aren't null have 7, 3, 0, 3, 2 and 1 words
    idf, mean = lambda df: np.log(1 + (7 - df + 0.5) / (df + 0.5)), 16 / 6
    part = lambda df, tf, size: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    assert abs(once[0][3] - part(1, 2, 7) - part(1, 2, 7)) < 1e-6 and abs(once[3][3] - part(3, 1, 1)) < 1e-6
    monkeypatch.setattr(corpus, "LITERALS", 2)
    assert found() == once
    assert corpus.lexical_top(docs, questions.where("query_id = 3"), 3).count() == 0


def test_texts_become_vectors_where_they_are_compared(spark):
    docs = spark.createDataFrame([(k, None if k == 3 else f"pump {k % 7} of line {k}") for k in range(40)], "vec_id long, text string")
    asked = corpus.hash_embedding(spark.createDataFrame([(1, "pump 3"), (2, "line 39"), (3, None)], "query_id long, text string")).select("query_id", F.col("embedding").alias("query"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus.nearest(docs, asked, 5)) == rows(corpus.nearest(corpus.hash_embedding(docs), asked, 5))


def test_texts_are_not_shuffled_to_results(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        docs = spark.createDataFrame([(k, f"t{k}", f"Text {k} of a pump") for k in range(50)], "doc_id long, title string, text string")
        questions = spark.createDataFrame([(1, "t7", None), (2, None, "TEXT 9"), (3, "t1", None)], "query_id long, title string, contains string")
        top = spark.createDataFrame([(1, 8, 1), (1, 7, 2), (2, 9, 1), (3, 2, 1)], "query_id long, doc_id long, place int")
        hits = corpus.golden_hits(top, questions, docs)
        assert {r.query_id: r.place for r in hits.collect()} == {1: 2, 2: 1, 3: None}
        assert "hashpartitioning(doc_id" not in hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
