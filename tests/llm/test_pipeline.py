"""The pipeline's stages one after another, each against what its operator says."""

import corpus_pipeline
from pyspark.sql import functions as F

from tideline.llm import line_dedup, quality, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = held[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "best_fit_packing" or docs.columns == columns
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_rules(raw).where("quality.kept").collect()}
    assert {r.doc_id for r in held["quality_rules"].collect()} == kept
    lines = {r.doc_id: r.text for r in line_dedup.dedup_lines(held["quality_rules"]).collect()}
    assert {r.doc_id: r.text for r in held["line_dedup"].collect()} == lines
    near = simhash.simhash_components(held["line_dedup"]).where("doc_id = near.component_id")
    assert {r.doc_id for r in held["simhash_near_dedup"].collect()} == {r.doc_id for r in near.collect()}
    mixed = held["source_mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed <= 3
    assert held["best_fit_packing"].where("piece = 0").count() == held["source_mixing"].count()
    total = corpus_pipeline.run(spark, DATA)
    assert total.count() == held["best_fit_packing"].count()


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
