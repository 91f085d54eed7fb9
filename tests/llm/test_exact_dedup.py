"""Exact deduplication against its SQL, and against plain Python where hashes clash or rows are odd."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tideline.llm import exact_dedup

DATA = "/root/testdata/sf0.001"


def plain(rows):
    """Of (doc_id, text) rows the sorted multiset of results; which of fully equal rows stays is open."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for body, members in groups.items():
        for place, (_, _, _, doc_id) in enumerate(sorted(members, key=lambda m: m[:3])):
            out.append((doc_id, sorted(members, key=lambda m: m[:3])[0][3], len(members), place == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(map(repr, out))


def ours(docs, **options):
    return sorted(repr(tuple(r)) for r in exact_dedup.exact_groups(docs, into="exact_", **options).select("doc_id", "exact_.*").collect())


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = con.sql(exact_dedup.OP12_SQL)
    got = exact_dedup.op12_exact_dedup(spark, DATA)
    assert sorted(got.columns) == sorted(theirs.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*theirs.columns).collect()) == sorted(map(repr, theirs.fetchall()))


def test_odd_rows(spark, texts, empty):
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    assert ours(texts) == plain(rows)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).columns == empty.columns
    clashing = texts.withColumn("exact", F.lit(1)).withColumn("hash_", F.lit(2)).withColumn("row_", F.lit(3))
    assert {"exact", "exact_", "hash_", "row_"} <= set(exact_dedup.exact_groups(clashing).columns)
    kept = exact_dedup.exact_dedup(texts)
    assert kept.columns == texts.columns and kept.count() == len({re.sub(r"\s", "", t or "") for _, t in rows})


def test_hash_clashes_and_ties(spark):
    rng = random.Random(5)
    bodies = ["", "a b", "ab", "a\tb ", "abc", "abé", "abé ", "x" * 3000] + [f"text {k % 9}" for k in range(30)]
    rows = [(rng.choice([None, k % 40, -k, 2**63 - 1 - k]), rng.choice(bodies)) for k in range(400)] + [(7, "tie tie")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert ours(docs) == plain(rows)
    # all texts share one of three hashes: the bytes decide
    assert ours(docs, hashed=lambda body: F.pmod(F.xxhash64(body), F.lit(3))) == plain(rows)
