"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tideline.llm import periodic_runs

DATA = "/root/testdata/sf0.001"


def every_run(words, least=24, times=3):
    """All runs by trying each period; a stretch that a shorter period explains is left out."""
    found, many = [], len(words)
    for period in range(1, many // times + 1):
        start = 0
        while start + period < many:
            end = start
            while end + period < many and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            if end > start and length >= max(least, times * period):
                stretch = words[start : start + length]
                if not any(stretch[q:] == stretch[:-q] for q in range(1, period)):
                    found.append((start, length, period))
            start = max(end, start + 1) if end > start else start + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.mark.parametrize("letters, least, times", [(1, 24, 3), (2, 6, 2), (2, 5, 3), (3, 4, 2), (4, 24, 3)])
def test_every_run_of_random_words(letters, least, times):
    rng = random.Random(letters)
    for k in range(150):
        words = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            at, period = rng.randrange(len(words) + 1), rng.randrange(1, 12)
            unit = [b"%d" % rng.randrange(letters) for _ in range(period)]
            words[at:at] = (unit * 12)[: rng.randrange(period, 8 * period + 9)]
        assert periodic_runs.text_runs(words, least, times) == every_run(words, least, times)


def test_fibonacci_words_and_long_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic_runs.text_runs(b, 6, 2) == every_run(b, 6, 2)
    long = [b"w%d" % (k % 977) for k in range(60_000)]
    assert periodic_runs.text_runs([b"x", *long, b"y"]) == [(1, 60_000, 977)]
    assert periodic_runs.text_runs([b"same"] * 50_000) == [(0, 50_000, 1)]


def test_query(spark):
    got = periodic_runs.op11_periodic_runs(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    # a search of every period takes long on long texts
    short = {r.doc_id for r in docs if len(r.text.split()) < 1500}
    assert sorted(tuple(r) for r in got.select(*names).collect() if r.doc_id in short) == sorted(expected(r.doc_id, r.text) for r in docs if r.doc_id in short)
    assert got.count() == len(docs) and any(r.n_runs for r in got.collect())


def test_odd(spark, texts, empty):
    found = periodic_runs.periodic_runs(texts.withColumnRenamed("quality", "periodic")).select("text", "periodic_.*").collect()
    assert len(found) == texts.count()
    for r in found:
        words = (r.text or "").encode().split()
        assert r.n_words == len(words)
        if len(words) < 3000:
            assert [tuple(x) for x in r.runs] == every_run(words)
        else:  # "word{k % 977} and" 30,000 times
            assert [tuple(x) for x in r.runs] == [(0, 60_000, 2 * 977)] and len(r.collapsed.split()) == 2 * 977
    assert periodic_runs.periodic_runs(empty).count() == 0
    nothing = [r for r in found if not r.text]
    assert all(r.n_words == 0 and r.runs == [] and r.strongest is None and r.collapsed == "" for r in nothing) and nothing
    tie = periodic_runs.strongest([(0, 30, 10), (5, 60, 20), (70, 31, 10)])
    assert tie == (70, 31, 10) and periodic_runs.strongest([(0, 30, 10), (5, 60, 20)]) == (0, 30, 10)


def test_leaves_out_only_what_holds_no_run():
    rng = np.random.default_rng(3)
    words = [b"%d" % k for k in rng.integers(0, 50_000, 4000)]
    words[500:560] = words[0:60]  # a passage twice, no run
    words[2000:2090] = (words[2000:2013] * 8)[:90]
    assert periodic_runs.text_runs(words) == every_run(words)
    hashes = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    assert [b - a for a, b in periodic_runs.stretches(hashes, 24, 3)] == [90]
