"""Searches and quotes against plain Python: ties at the border, several blocks of queries, long texts."""

import time

import numpy as np
from pyspark.sql import functions as F

from tideline.operators import corpus as c


def plain_nearest(vectors, queries, most):
    out = []
    for q, v in queries:
        ranked = sorted((round(float(np.linalg.norm(np.array(x) - np.array(v))), 9), i) for i, x in vectors)[:most]
        out += [(q, i, d, place) for place, (d, i) in enumerate(ranked, 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.vec_id, round(r.distance, 9), r.place) for r in df.collect())


def test_nearest_settles_ties_by_id(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(500, 0, -1)] + [(1000 + i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(700)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [5.0, 1.0, -2.0])]
    asked = spark.createDataFrame(queries, "query_id long, query array<double>")
    for most in (1, 50, 2000):
        assert found(c.nearest(vectors, asked, most)) == plain_nearest(rows, queries, most)
    # as many blocks as queries, each written before the next
    assert found(c.nearest(vectors, asked, 50, block=1)) == plain_nearest(rows, queries, 50)
    assert c.nearest(vectors.where("false"), asked, 5).count() == 0 and c.nearest(vectors, asked.where("false"), 5).count() == 0


def test_quotes_in_a_long_text(spark):
    words = [f"w{k * 7919 % 100_003}" for k in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short text only")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, " ".join(words[150_000:150_020])), (2, " ".join(words[5:9]) + " x"), (3, "text only"), (4, "“Short” text")], "item_id long, text string")
    began = time.perf_counter()
    got = {r.item_id: (r.doc_id, r.verified) for r in c.quotes_exact(quotes, docs).collect()}
    assert got == {1: (1, True), 2: (None, False), 3: (2, True), 4: (None, False)}
    assert time.perf_counter() - began < 40


def test_hybrid_and_golden_hits(spark):
    docs = spark.createDataFrame([(1, "Pump log", "The pump lost pressure after the filter change."), (2, "Notes", "Nothing of interest was said that day."), (3, "Valve log", "A valve stuck at half past nine; pressure rose."), (4, None, None)], "doc_id long, title string, text string")
    questions = spark.createDataFrame([(1, "why did the pump lose pressure", "Pump log", None), (2, "stuck valve", None, "VALVE stuck"), (3, "holiday plans", "Pump log", "beach"), (4, "", None, "x")], "query_id long, text string, title string, contains string")
    top = c.hybrid(docs, questions, 3)
    by_question = {}
    for r in top.collect():
        by_question.setdefault(r.query_id, []).append((r.place, r.doc_id))
    assert min(by_question[1])[1] == 1 and min(by_question[2])[1] == 3 and all(len(v) <= 3 for v in by_question.values())
    hits = {r.query_id: r.place for r in c.golden_hits(top, questions, docs).collect()}
    assert hits[1] == 1 and hits[2] == 1 and hits[4] is None
    # the fused score is the sum of both reciprocal ranks
    lexical = {(r.query_id, r.doc_id): r.place for r in c.lexical_top(docs, questions, 50).collect()}
    vectors = {r.vec_id: np.array(r.embedding, float) for r in c.hash_embedding(docs.select(F.col("doc_id").alias("vec_id"), "text")).collect()}
    asked = {r.query_id: np.array(r.embedding, float) for r in c.hash_embedding(questions).collect()}
    for q, vector in asked.items():
        order = sorted(vectors, key=lambda v: (round(float(np.linalg.norm(vectors[v] - vector)), 9), v))
        fused = {v: 1 / (60 + order.index(v) + 1) + (1 / (60 + lexical[q, v]) if (q, v) in lexical else 0) for v in vectors}
        best = sorted(fused, key=lambda v: (-round(fused[v], 9), v))[:3]
        assert [d for _, d in sorted(by_question[q])] == best
