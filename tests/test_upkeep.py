"""Runs saved whole, erasure and retention without orphans, chains and cycles, derived fields of many columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import corpus as c
from tideline.operators import grids, reports
from tideline.plans import files
from tideline.sources import tables

DATA = "/root/testdata/sf0.001"


def test_a_run_is_saved_whole_or_not_at_all(spark, tmp_path):
    root, one = str(tmp_path), spark.range(3).toDF("v")
    first = tables.save_run(spark, root, "a", {"grid": one, "rules": one.limit(1)})
    with pytest.raises(Exception, match="no space"):
        tables.save_run(spark, root, "a", {"grid": one.limit(0), "rules": one.select(F.raise_error(F.lit("no space")).alias("v"))})
    assert tables.load_table(spark, root, "a", "grid").count() == 3 and tables.load_table(spark, root, "a", "rules").count() == 1
    again = tables.save_run(spark, root, "a", {"grid": one.limit(2), "rules": one})
    tables.save_run(spark, root, "b", {"grid": one})
    assert again != first and tables.load_table(spark, root, "a", "grid").count() == 2
    assert {r.run_id: r.tables for r in tables.manifests(spark, root).collect()} == {"a": ["grid", "rules"], "b": ["grid"]}
    with pytest.raises(LookupError):
        tables.load_table(spark, root, "b", "rules")
    with pytest.raises(LookupError):
        tables.load_table(spark, root, "c", "grid")


def test_erasure_leaves_no_orphan(spark):
    before = files.corpus_tables(spark, DATA)
    after = c.erase_person(before, "user", files.block_chunks)
    assert after["segments"].where("lower(speaker) = 'user'").count() == 0 and after["claims"].where("lower(speaker) = 'user'").count() == 0
    for name, key, of in (("segments", "source_id", "sources"), ("chunks", "source_id", "sources"), ("claims", "source_id", "sources"), ("links", "claim_id", "claims"), ("sources", "source_id", "segments")):
        assert after[name].join(after[of], key, "left_anti").count() == 0
    assert sorted(map(tuple, after["chunks"].collect())) == sorted(map(tuple, files.block_chunks(after["segments"]).collect()))
    untouched = c.erase_person(before, "nobody", files.block_chunks)
    assert {r.gone for r in c.changes_of(before, untouched).collect()} == {0}
    gone = {r.name: r.gone for r in c.changes_of(before, c.retain(before, F.lit(1 << 40))).collect()}
    assert gone == {n: df.count() for n, df in before.items()}


def test_ancestors_of_long_chains_and_cycles(spark):
    chain = [(k, k - 1 if k else None) for k in range(1000)]
    cycle = [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5000), (6000, 6000)]
    got = reports.ancestors(spark.createDataFrame(chain + cycle, "id long, supersedes long"))
    of = {}
    for r in got.collect():
        of.setdefault(r.id, {})[r.ancestor] = r.depth
    assert all(of[k] == {j: k - j for j in range(k)} for k in range(1, 1000)) and 0 not in of and 6000 not in of
    assert of[5000] == {5001: 1, 5002: 2} and of[5003] == {5000: 1, 5001: 2, 5002: 3}
    assert reports.ancestors(spark.createDataFrame([], "id long, supersedes long")).count() == 0


def test_derived_fields_of_sixty_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(1, 10_000, (400, 60)).astype(float)
    x[:, 10], x[:, 20], x[:, 30], x[:, 40] = x[:, 3] + x[:, 4], 1.19 * x[:, 5], x[:, 6] - x[:, 7], x[:, 10] + x[:, 8]
    rows = [[float(v) for v in r] for r in x] + [[None] + [1.0] * 59]
    names = [f"f{k}" for k in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    found = {r.field: r.formula for r in grids.derived_fields(df, names).collect()}
    # in the order of the columns f5 follows from f20 and f6 from f30; f40 needs f10, which follows itself
    assert found == {"f5": "f5 = 0.840336 x f20", "f6": "f6 = f7 + f30", "f10": "f10 = f3 + f4"}
    assert grids.derived_fields(df.limit(40), names).count() == 0 and grids.derived_fields(df, names[:1]).count() == 0
    kinds = spark.createDataFrame([("f10", "number"), ("f3", "number")], "col string, kind string")
    assert {r.col: r.kind for r in grids.without_derived(kinds, grids.derived_fields(df, names)).collect()} == {"f10": "text", "f3": "number"}
