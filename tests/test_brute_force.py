"""Queries that SQL can't express against plain Python over the same rows."""

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest

from tideline.operators import corpus, privacy, relations
from tideline.operators.corpus import best_dice
from tideline.plans import fixtures, registry
from tideline.streaming import live

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def read(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def grid(spark):
    return fixtures.grid(spark, DATA).toPandas()


def sentences(text):
    return [x for x in (m.strip(" ") for m in re.findall(r"[^.!?\n]+[.!?]*", text)) if x]


def plain_chunks(most=400):
    """``source_id, chunk, piece, from_seq, to_seq, n, tokens, text`` of the conversations."""
    tokens, out = lambda x: math.ceil(len(x) / 4), []
    for source, rows in read("conversations").sort_values("turn").groupby("conv_id"):
        open_, chunk = [], -1
        for turn, text in [*zip(rows["turn"], rows["text"]), (None, "")]:
            size = sum(tokens(x) for _, x in open_)
            if open_ and (turn is None or size + tokens(text) > most or open_[-1][0] // 6 != turn // 6):
                chunk += 1
                if size <= most:
                    out.append((source, chunk, 0, open_[0][0], open_[-1][0], len(open_), size, "\n".join(x for _, x in open_)))
                else:
                    pieces = []
                    for s in sentences(open_[0][1]):
                        if pieces and tokens(f"{pieces[-1]} {s}") <= most:
                            pieces[-1] += f" {s}"
                        else:
                            pieces.append(s)
                    out += [(source, chunk, k, open_[0][0], open_[0][0], 1, tokens(x), x) for k, x in enumerate(pieces)]
                open_ = []
            open_.append((turn, text))
    return out


def test_chunks_are_packed_in_order(spark):
    ours = QUERIES["chunk_segments"](spark, DATA).toPandas()
    want = plain_chunks()
    assert sorted(ours[["source_id", "chunk", "piece", "from_seq", "to_seq", "n", "tokens", "text"]].itertuples(index=False, name=None)) == sorted(want)
    assert max(t for *_, t, _ in want) <= 400 or any(len(sentences(x)) == 1 for *_, x in want)


def test_chunks_split_long_segments(spark):
    text = "A sentence of some words. " * 50
    frame = spark.createDataFrame([(1, 0, 0, "short"), (1, 1, 0, text), (1, 2, 0, "tail"), (1, 3, 1, "other block"), (2, 0, 0, "x" * 900)], "source_id long, seq long, block long, text string")
    got = corpus.chunks(frame, 100).orderBy("source_id", "from_seq", "piece").collect()
    assert [(r.source_id, r.chunk, r.piece) for r in got] == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 2, 0), (1, 3, 0), (2, 0, 0)]
    assert all(r.tokens <= 100 for r in got if r.source_id == 1) and " ".join(r.text for r in got if r.chunk == 1) == text.strip()


def test_speakers_of_chunks(spark):
    roles = {(r.conv_id, r.turn): r.role for r in read("conversations").itertuples()}
    want = {}
    for source, chunk, piece, low, high, *_ in plain_chunks():
        held = {roles[source, t] for t in range(low, high + 1) if (source, t) in roles}
        want[source, chunk] = held.pop() if len(held) == 1 else None
    got = {(r.source_id, r.chunk): r.speaker for r in QUERIES["chunk_speaker"](spark, DATA).collect()}
    assert got == want


def trigrams(text):
    padded, counts, want = f" {text.lower()} ", {}, np.zeros(1024)
    for i in range(len(padded) - 2):
        counts[padded[i : i + 3]] = counts.get(padded[i : i + 3], 0) + 1
    for gram, n in counts.items():
        h = 2166136261
        for b in gram.encode():
            h = (h ^ b) * 16777619 % 2**32
        want[h % 1024] += math.log1p(n) * (1 if h >= 2**31 else -1)
    return want / max(np.linalg.norm(want), 1e-12)


def test_claims_are_linked_by_phrases_names_and_likeness(spark):
    from tideline.plans.corpus import COLUMNS

    said = {r.doc_id * 1_000_000 + r.pos: r.sentence[:300] for r in QUERIES["claim_extract"](spark, DATA).collect()}
    want = []
    for claim, text in said.items():
        low, scores = " ".join(text.lower().split()), []
        for column, name, phrases in COLUMNS:
            score = 1.0 if any(p.lower() in low for p in phrases) else 0.6 if re.search(rf"(?:^|\W){name}(?:$|\W)", low) else 0.0
            scores.append((-round(score + max(0.0, trigrams(text) @ trigrams(" ".join([name, *phrases]))), 3), column))
        want += [(claim, c, -s) for s, c in sorted(scores)[:3] if -s >= 0.75]
    got = [(r.claim_id, r.column_id, r.score) for r in QUERIES["claim_link"](spark, DATA).collect()]
    assert {g[:2] for g in got} == {w[:2] for w in want} and len(got) == len(want)
    assert all(abs(a[2] - b[2]) < 2e-3 for a, b in zip(sorted(got), sorted(want)))


def test_phrases_of_several_words_and_the_limit_of_a_text(spark):
    docs = spark.createDataFrame([(1, "The flow rate is high. A workflow rate is not it. " + "Flow, rate apart here. " + "We saw the flow-rate drop. " * 30)], "doc_id long, text string")
    phrases = spark.createDataFrame([("flow rate", 2), ("flow-rate", 1), ("the flow rate", 3)], "phrase string, column_id long")
    got = corpus.claims(docs, phrases).orderBy("pos").collect()
    assert [(r.pos, r.column_id) for r in got[:2]] == [(0, 2), (3, 1)] and len(got) == 20


def test_quotes_are_found_anywhere(spark):
    body = "He said \u201cthe tank overflows at night\u201d, then left.  \uff21 full stop"
    docs = spark.createDataFrame([(5, body), (3, "nothing of it"), (7, body)], "doc_id long, text string")
    quotes = ["the tank overflows at night", "tank overflows", "tank", "overflows at nig", "ank overflows at nigh", "said \"the tank", "a full stop", "no such thing here at all", "THEN   left.", ""]
    frame = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = {r.item_id: r.doc_id for r in corpus.quotes_exact(frame, docs).collect()}
    assert got == {**{k: 5 for k in range(10)}, 7: None, 9: None}


def test_names_of_several_words(spark):
    texts = spark.createDataFrame([(1, "The Main Pump and the main pump; mainpump. S12 ev-0123abcd-00001 a+b (a+b)")], "doc_id long, text string")
    names = spark.createDataFrame([("main pump",), ("S12",), ("a+b",), ("pump",), ("ev-0123abcd-00001",)], "name string")
    assert {r.name: r.n for r in privacy.name_scan(texts, names).collect()} == {"main pump": 2, "a+b": 2, "pump": 2}


def test_groups_of_a_long_chain(spark):
    chain = [("r", f"s{k:03}", f"s{k + 1:03}", 0.99) for k in range(60)] + [("r", "x", "y", -0.97), ("r", "x", "s000", 0.5)]
    got = relations.redundancy_groups(spark.createDataFrame(chain, "run_id string, a string, b string, rho double"), 0.95).collect()
    assert {r.label for r in got} == {"s000", "x"} and len(got) == 63


def test_log_chain_links_every_row(spark):
    ours = QUERIES["log_chain_build"](spark, DATA).toPandas().sort_values(["run_id", "seq"])
    assert len(ours) == len(read("events"))
    for _, rows in ours.groupby("run_id"):
        before = ""
        for text, prev, own in zip(rows["text"], rows["prev_hash"], rows["hash"]):
            assert prev == before and own == hashlib.sha256((before + text).encode()).hexdigest()
            before = own


def fold(rows, slack=0.5):
    """The plain CUSUM, begun anew with each week."""
    up = down = 0.0
    week = None
    for r in rows.itertuples():
        if r.episode != week:
            up, down, week = 0.0, 0.0, r.episode
        if r.z == r.z:
            up, down = max(0.0, up + r.z - slack), max(0.0, down - r.z - slack)
    return up, down


def test_stream_cusum_equals_the_fold(spark, tmp_path):
    events = read("events").sort_values(["ts", "event_id"])
    events["episode"] = events["ts"].astype("datetime64[us]").astype("int64") // 604_800_000_000
    events["z"] = (events["value"] - 50) / 25
    ours = QUERIES["stream_cusum"](spark, DATA).toPandas().set_index("event_type")
    for kind, rows in events.groupby("event_type"):
        up, down = fold(rows)
        assert ours.loc[kind, "n"] == len(rows)
        assert ours.loc[kind, "up"] == pytest.approx(up, abs=1e-5) and ours.loc[kind, "down"] == pytest.approx(down, abs=1e-5)
    # the same in five batches that land one after the other, with a missing value and a null
    rows = events[["event_type", "episode", "event_id", "ts", "z"]].copy()
    rows.iloc[7, 4], rows.iloc[9, 4] = float("nan"), None
    for k in range(5):
        part = rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        frame = spark.createDataFrame(part)
        frame.withColumn("ts", frame["ts"].cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
    schema = spark.read.parquet(f"{tmp_path}/landed").schema
    many = live.cusum_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landed"), 0.5).toPandas().set_index("event_type")
    for kind, part in rows.groupby("event_type"):
        up, down = fold(part)
        assert many.loc[kind, "n"] == len(part) and many.loc[kind, "up"] == pytest.approx(up, abs=1e-5) and many.loc[kind, "down"] == pytest.approx(down, abs=1e-5)


def test_embeddings_are_hashed_trigrams_of_unit_length(spark):
    ours = QUERIES["hash_embedding"](spark, DATA).toPandas().set_index("doc_id")["embedding"]
    for doc, text in read("documents")[["doc_id", "text"]].itertuples(index=False, name=None):
        assert np.allclose(np.array(ours[doc]), trigrams(text), atol=1e-4)


def test_huber_fit_equals_reweighted_least_squares(spark, grid):
    ours = QUERIES["stat_huber_fit"](spark, DATA).toPandas().set_index("sensor")
    x = grid[grid["sensor"] == "rows"].set_index("t")["v"]
    for sensor in ("price", "tax", "quantity[A]"):
        y = grid[grid["sensor"] == sensor].set_index("t")["v"]
        both = pd.concat([x.rename("x"), y.rename("y")], axis=1).dropna()
        a, w = np.column_stack([np.ones(len(both)), both["x"]]), np.ones(len(both))
        for _ in range(5):
            beta = np.linalg.solve((a * w[:, None]).T @ a + 1e-8 * np.eye(2), (a * w[:, None]).T @ both["y"].to_numpy())
            rest = both["y"].to_numpy() - a @ beta
            sigma = 1.4826 * np.median(np.abs(rest - np.median(rest)))
            w = np.minimum(1, 1.345 * sigma / np.maximum(np.abs(rest), 1e-300))
        assert ours.loc[sensor, "n"] == len(both)
        assert ours.loc[sensor, "intercept"] == pytest.approx(beta[0], rel=1e-4) and ours.loc[sensor, "x"] == pytest.approx(beta[1], rel=1e-4, abs=1e-5)


def test_change_points_pay_and_leave_nothing_that_pays_more(spark, grid):
    ours = QUERIES["stat_change_points"](spark, DATA).toPandas()
    cost = lambda x: float(((x - x.mean()) ** 2).sum())
    span = grid["t"].max() - grid["t"].min() + 1
    least, slack = max(2, span // 100), max(2, span // 1000)
    ends = [e for _, part in grid.groupby("episode") for e in (part["t"].min(), part["t"].max() + 1)]
    for sensor, rows in grid.groupby("sensor"):
        whole = rows.sort_values("t")
        steps, rows = whole.groupby("episode")["v"].apply(lambda v: pd.Series(np.diff(v))).dropna(), whole.dropna(subset=["v"])
        mad = lambda x: 1.4826 * (x - x.median()).abs().median()
        price = 2 * math.log(span) * max(mad(rows["v"]), mad(steps) / math.sqrt(2)) ** 2
        want = []

        def split(part):
            gains = [(float(f"{cost(part['v']) - cost(part['v'][:i]) - cost(part['v'][i:]):.7e}"), -part["t"].iloc[i - 1] - 1) for i in range(least, len(part) - least + 1)]
            if gains and max(gains)[0] > price:
                cut = -max(gains)[1]
                want.append(cut)
                split(part[part["t"] < cut])
                split(part[part["t"] >= cut])

        for _, part in rows.groupby("episode"):
            split(part)
        assert sorted(ours[ours["sensor"] == sensor]["cut_t"]) == sorted(c for c in want if min(abs(c - e) for e in ends) > slack), sensor


def test_flow_order_drops_the_weakest_link_of_a_ring(spark):
    links = [("r", "a", "b", 0.9), ("r", "b", "c", -0.8), ("r", "c", "a", 0.3), ("r", "c", "d", 0.5), ("q", "y", "x", 0.4)]
    got = relations.flow_order(spark.createDataFrame(links, "run_id string, source string, target string, rho double")).orderBy("run_id", "place").collect()
    assert [(r.run_id, r.sensor, r.place) for r in got] == [("q", "y", 0), ("q", "x", 1), ("r", "a", 0), ("r", "b", 1), ("r", "c", 2), ("r", "d", 3)]


def test_peer_models_are_robust_fits_of_the_aligned_peers(spark, grid):
    from tideline.plans.drift import END, PEERS

    ours = QUERIES["peer_model_fit"](spark, DATA).toPandas()
    wide = grid.pivot_table(index=["episode", "t"], columns="sensor", values="v").reset_index()
    for sensor in ("price", "price[R]", "quantity"):
        columns = []
        for _, peer, lag in sorted(p for p in PEERS if p[0] == sensor):
            columns.append((peer, wide.groupby("episode")[peer].shift(lag)))  # the weeks of an episode have no gap
        both = pd.concat([wide[sensor].rename("y"), *[c.rename(n) for n, c in columns]], axis=1)[wide["t"] < END].dropna()
        a, y, w = np.column_stack([np.ones(len(both)), *[both[n] for n, _ in columns]]), both["y"].to_numpy(), np.ones(len(both))
        for _ in range(5):
            beta = np.linalg.solve((a * w[:, None]).T @ a + 1e-8 * np.eye(a.shape[1]), (a * w[:, None]).T @ y)
            rest = y - a @ beta
            w = np.minimum(1, 1.345 * 1.4826 * np.median(np.abs(rest - np.median(rest))) / np.maximum(np.abs(rest), 1e-300))
        got = ours[ours["sensor"] == sensor].set_index("peer")["coef"]
        assert set(got.index) == {"", *[n for n, _ in columns]}
        for name, want in zip(["", *[n for n, _ in columns]], beta):
            assert got[name] == pytest.approx(want, rel=1e-3, abs=1e-4), (sensor, name)


def test_process_kind_follows_its_measures(spark):
    ours = QUERIES["process_kind"](spark, DATA).toPandas().set_index("sensor")
    for row in ours.itertuples():
        trend = row.blocks >= 4 and row.p < 0.01 and row.slope > 0
        want = "process-slow-degradation" if trend else "process-step" if row.jump > 2 else "process-oscillation" if row.period > 0 else "process-degradation"
        assert row.fault == want
    assert len(ours) == 20


@pytest.mark.parametrize(
    "quote, body, least, most",
    [("the tank overflows at night", "we saw the tank overflows at night often", 1.0, 1.0), ("the tank overflaws at night", "we saw the tank overflows at night often", 0.9, 0.999), ("no such thing here", "zzz qqq", 0.0, 0.2), ("a", "b", 0.0, 0.0), ("one two three four", "one two", 0.0, 0.7)],
)
def test_best_dice(quote, body, least, most):
    assert least <= best_dice(quote, body) <= most
