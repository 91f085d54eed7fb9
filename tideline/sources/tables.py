"""Delimited files in, partitioned run tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent delimiter of the first line; the first of the list on a tie. One line comes to the driver."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(DELIMITERS, key=lambda x: (line.count(x), -DELIMITERS.index(x)))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text; short and long rows are taken as they are."""
    return spark.read.csv(path, header=True, sep=sniff_delimiter(spark, path), mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)


def write_run(df: DataFrame, path: str) -> None:
    """A table partitioned by run, so that one run can be read or replaced alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def save_run(spark: SparkSession, root: str, run_id: str, parts: dict[str, DataFrame]) -> str:
    """All tables of a run, or none: tables are written to a folder of their own, and one manifest row, written last, makes them the run's. Returns the folder.

    A writer that fails in between leaves a folder that no manifest names; a run that is saved again keeps its old tables for those who read them.
    """
    version = uuid.uuid4().hex
    folder = f"{root}/tables/{version}"
    for name, df in parts.items():
        df.write.parquet(f"{folder}/{name}")
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(folder).alias("folder"), F.array(*[F.lit(n) for n in sorted(parts)]).alias("tables"), F.unix_micros(F.current_timestamp()).alias("saved_at"))
    row.coalesce(1).write.parquet(f"{root}/manifest/version={version}")  # a row is there or it is not
    return folder


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The newest manifest of each run."""
    rows = spark.read.parquet(f"{root}/manifest")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("folder", "tables", "saved_at"), F.struct("saved_at", "version")).alias("m")).select("run_id", "m.*")


def load_table(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    """A table of a saved run, by its manifest."""
    found = manifests(spark, root).where(F.col("run_id") == run_id).select("folder", "tables").head()  # one row
    if found is None or name not in found["tables"]:
        raise LookupError(f"run {run_id} has no table {name}")
    return spark.read.parquet(f"{found['folder']}/{name}")


def import_aliases(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows`` of texts and a catalog of names: the column with the most known names is the key, the others are phrases."""
    cells = rows.select(F.monotonically_increasing_id().alias("row"), *rows.columns).unpivot(["row"], rows.columns, "col", "cell").where("cell is not null and cell <> ''")
    hits = cells.join(catalog.select(F.col("name").alias("cell")), "cell", "left_semi").groupBy("col").agg(F.count("*").alias("hits"))
    key = hits.agg(F.max_by("col", F.struct("hits", "col")).alias("key"))  # one row
    marked = cells.join(F.broadcast(key), F.lit(True))
    names = marked.where("col = key").select("row", F.col("cell").alias("name")).join(catalog, "name")
    return names.join(marked.where("col <> key").select("row", F.col("cell").alias("phrase")), "row").select("name", "phrase").distinct()
