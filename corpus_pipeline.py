"""A training corpus from raw documents in five stages; each works on what the one before it kept.

Quality rules drop documents, frequent lines leave texts, one document of each near-duplicate group stays, sources are
mixed to their target weights (a document that the mix takes twice is two rows), and what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import free_name, shared_folder
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.mixing import mixed_documents
from tideline.llm.packing import pack_documents
from tideline.llm.quality import quality_rules
from tideline.llm.simhash import simhash_components


def columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "quality")
    return columns(quality_rules(docs, into=name).where(F.col(f"{name}.kept")), docs)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their frequent lines; ``n_chars`` follows the text."""
    out = columns(dedup_lines(docs), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; rows without an id, which no group can name, stay too."""
    name = free_name(docs, "near")
    marked = simhash_components(docs, into=name)
    return columns(marked.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col(f"{name}.component_id"))), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_frequent_lines),
    ("simhash_near_dedup", keep_one_of_near),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: The SimHash, the mix's draws and the packing have no SQL form; the tests hold each stage against its operator, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
