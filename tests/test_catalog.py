"""The catalog, its questions, lists of sources and meetings, by hand."""

from pyspark.sql import functions as F

from tideline.operators import catalog


def test_confidence_and_description(spark):
    sensors = "name string, alias string, role string, role_confidence double, signal_type string, hypothesis string, hypothesis_confidence double"
    rows = [("t", "S1", "driver", 0.9, "gauge", "oil", 0.8), ("u", "S2", "driver", 0.3, "gauge", "oil", 0.8), ("v", "S3", "peer", 0.6, "counter", None, None), ("w", "S4", "peer", 0.9, "gauge", "", 0.8), ("x", "S5", "peer", None, "gauge", "air", 0.5)]
    checks = [("t", True), ("t", False), ("t", False), ("t", None), ("w", True), ("x", False), ("gone", True)]
    stored = [("t", "t (S1) is oil and a gauge signal"), ("v", "v (S3) is wind and a counter signal"), ("gone", "x")]
    got = catalog.refreshed(spark.createDataFrame(rows, sensors), spark.createDataFrame(checks, "name string, agrees boolean"), spark.createDataFrame(stored, "name string, description string"))
    of = {r.name: (round(r.confidence, 9), r.checks, r.agreeing, r.changed) for r in got.collect()}
    assert of == {"t": (round(0.8 * (0.5 + 0.5 / 3), 9), 3, 1, False), "u": (0.3, 0, 0, True), "v": (0.6, 0, 0, True), "w": (0.8, 1, 1, True), "x": (0.25, 1, 0, True)}
    told = {r.name: r.description for r in got.collect()}
    assert told["v"] == "v (S3) has the role peer and a counter signal" and told["w"] == "w (S4) has the role peer and a gauge signal"


def test_counts_and_questions(spark):
    columns = spark.createDataFrame([(1, "a", 0.2, "oil", 3, 1), (2, "b", 0.1, None, 0, 0), (3, "c", 0.4, "air", 2, 2), (4, "d", 0.5, None, 0, 0), (5, "e", None, None, 0, 0), (6, "f", 0.2, None, 0, 0)], "column_id long, name string, confidence double, hypothesis string, checks long, agreeing long")
    claims = spark.createDataFrame([(10, "confirmed", "Ann"), (11, "open", "Bob"), (12, "confirmed", None), (13, "open", "Cy")], "claim_id long, status string, speaker string")
    # claim 10 is linked twice to column 1, once rejected; column 3 has a confirmed link to a confirmed claim; claim 99 is gone
    links = [(10, 1, 0.9, False), (10, 1, 0.4, None), (11, 1, 0.4, True), (12, 3, 0.5, True), (12, 3, 0.5, True), (13, 3, 0.1, None), (12, 6, 0.9, None), (13, 6, 0.2, None), (99, 6, 0.9, True), (11, 77, 0.5, True)]
    linked = spark.createDataFrame(links, "claim_id long, column_id long, score double, confirmed boolean")
    counts = {r.column_id: (r.claims, r.confirmed_claims) for r in catalog.claim_counts(columns, linked, claims).collect()}
    assert counts == {1: (2, 0), 2: (0, 0), 3: (2, 1), 4: (0, 0), 5: (0, 0), 6: (3, 0)}
    asked = [(r.column_id, r.contact, r.hypothesis_claims) for r in catalog.open_questions(columns, linked, claims).collect()]
    assert asked == [(2, None, 0), (1, "Ann", 2), (6, "Cy", 3)]
    text = {r.column_id: r.question for r in catalog.open_questions(columns, linked, claims).collect()}
    assert text[1].endswith('Our current guess is "oil". 2 of 3 other models gave a different name.') and text[2] == "What does the column b measure, in which unit, and how often is it logged?"


def test_sources_with_excerpts(spark):
    sources = spark.createDataFrame([(1, "mail", "ready", 5), (2, "mail", "ready", 9), (3, "call", "ready", 5), (4, "mail", "error", None)], "source_id long, kind string, status string, occurred_at long")
    segments = spark.createDataFrame([(1, k, "s", "x" * (300 if k == 0 else k)) for k in range(20)] + [(3, 0, None, None)], "source_id long, seq long, speaker string, text string").repartition(4)
    chunks = spark.createDataFrame([(1, True), (1, False), (1, None), (3, True)], "source_id long, embedded boolean")
    claims = spark.createDataFrame([(1,), (1,), (None,)], "source_id long")
    got = {r.source_id: r for r in catalog.source_list(sources, segments, chunks, claims).collect()}
    assert {k: (r.segments, r.chunks, r.embedded_chunks, r.claims) for k, r in got.items()} == {1: (20, 3, 1, 2), 2: (0, 0, 0, 0), 3: (1, 1, 1, 0), 4: (0, 0, 0, 0)}
    assert [len(x.text) for x in got[1].excerpt] == [240, 1, 2, 3, 4, 5] and got[2].excerpt == [] and [tuple(x) for x in got[3].excerpt] == [(None, None)]
    some = lambda **of: sorted(r.source_id for r in catalog.source_list(sources, segments, chunks, claims, **of).collect())
    assert some(kind="mail") == [1, 2, 4] and some(kind="mail", status="ready") == [1, 2] and some(since=F.lit(6)) == [2] and some(until=F.lit(5)) == [1, 3]


def test_meetings(spark):
    schema = "meeting_id long, subject string, start long, organizer string, attendees array<string>, join_url string"
    rows = [(1, None, 1, "o", ["x@A.com", "y@b.com", "z@a.com", "w@c.com"], "u"), (2, "s", 1, "o", ["x@a.com"], "u"), (3, "s", 1, "o", ["x@a.com"], None), (4, "s", 1, "o", ["x@sub.a.com", None, "a.com"], "u"), (5, "s", 1, "o", None, "u"), (6, "s", 1, "o", ["x@a.com"], "")]
    gaps = catalog.meetings_without_transcript(spark.createDataFrame(rows, schema), spark.createDataFrame([(2,), (None,)], "meeting_id long"), ["b.com", "A.COM", "b.com"])
    assert [(r.meeting_id, r.subject, r.domains) for r in gaps.collect()] == [(1, "(no subject)", ["a.com", "b.com"])]
    assert catalog.meetings_without_transcript(spark.createDataFrame(rows, schema), spark.createDataFrame([], "meeting_id long"), []).count() == 0
