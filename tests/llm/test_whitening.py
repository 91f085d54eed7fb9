"""Whitening against a dense eigenvalue decomposition."""

import numpy as np
import pytest

from tideline.llm import whitening

DATA = "/root/testdata/sf0.01"


def dense(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    z = x - sums / n
    v = z.T @ z / n
    values, q = np.linalg.eigh(v)
    return x, n, sums, values[::-1], q[:, ::-1], np.trace(v)


def test_query_equals_dense(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, sums, values, q, trace = dense([r.embedding for r in rows])
    got = whitening.op13_embedding_whitening(spark, DATA).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 32 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    at = {r.vec_id: i for i, r in enumerate(rows)}
    exact = [int(((n * a.astype(object) - sums) ** 2).sum()) for a in x]
    for component, part in got.groupby("component"):
        e, ours = values[component - 1], part.whitened.to_numpy()
        order = [at[v] for v in part.vec_id]
        theirs = ((x - sums / n) @ q[:, component - 1] / np.sqrt(e))[order]
        gap = min(abs(e - o) for i, o in enumerate(values) if i != component - 1) / values[0]
        assert np.abs(ours - theirs * np.sign(ours @ theirs)).max() < 1e-12 / gap
        assert np.allclose(part.explained, e / trace, rtol=1e-10)
        assert part.deviation.tolist() == [exact[i] for i in order]
    again = whitening.op13_embedding_whitening(spark, DATA).toPandas().sort_values(["component", "vec_id"])
    assert again.whitened.tolist() == got.whitened.tolist()


@pytest.mark.parametrize("spectrum", [np.linspace(1, 0.9, 200), 0.9 ** np.arange(200), np.r_[1e6, 1e3, np.ones(198)], np.r_[np.ones(20), np.full(180, 1e-9)]])
def test_filter_finds_leading_values(spectrum):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    v = (q * spectrum) @ q.T
    passes = []
    values, vectors, residual = whitening.leading(lambda b: (passes.append(1), v @ b)[1], 200, 32)
    assert np.allclose(values, np.sort(spectrum)[::-1][:32], rtol=1e-9, atol=1e-12 * spectrum.max())
    assert np.allclose(vectors.T @ vectors, np.eye(32), atol=1e-13) and residual < 1e-11
    # plain power iteration needs thousands of passes for the close spectra
    assert len(passes) < 400


def test_odd(spark):
    schema = "vec_id long, embedding array<float>, n int, x_ string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1, "a"), (2, [None, 1.0], 1, "a"), (3, [nan, 1.0], 1, "a"), (4, [inf, 0.0], 1, "a"), (5, [0.0, 0.0], 1, "a"), (6, [1.0], 1, None), (None, [], 2, "b"), (7, [1e30, 1.0], 1, "a"), (7, [-3.0, 2.5], 1, "a")]
    df = spark.createDataFrame(rows, schema)
    got = whitening.whiten(df, into="n").select("vec_id", "x_", "n_.*").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 5), (False, 6), (False, 7), (False, 7), (True, 0)]
    assert {r.n for r in got} == {5} and all(len(r.whitened) == len(r.explained) <= 2 for r in got) and got[0].identity_error < 1e-6
    assert whitening.whiten(df.where("false")).count() == 0
    same = whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25], 1, "") for k in range(9)], schema)).select("white.*").collect()
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(9, 0, [])] * 9
    assert whitening.whiten(df.where("vec_id = 6")).select("white.*").first().whitened == []
    assert whitening.whiten(df.where("vec_id is null")).select("white.*").first().deviation == 0


def test_more_rows_than_a_batch_and_low_rank(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((25_000, 3)) @ rng.standard_normal((3, 70)) / 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    _, n, _, values, _, trace = dense(data)
    one = whitening.whiten(df).select("white.*").first()
    assert np.allclose(one.explained, values[:32] / trace, rtol=1e-6) and one.identity_error < 1e-6 and one.n == n
