"""Profiles of raw columns and detection of the layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.cleaning import clean_number, clean_time, shape
from tideline.operators.ordered import previous

ROW = "row"


def cells(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """``row, idx, col, cell``: a row for every cell, all as text; ``row`` orders the table."""
    items = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(c).alias("col"), F.trim(F.col(c).cast("string")).alias("cell")) for i, c in enumerate(columns)])
    return df.select(F.col(row).alias(ROW), F.inline(items))


def ranked_values(c: DataFrame) -> DataFrame:
    """Values of each column by frequency, ties by value."""
    counted = c.where("cell <> ''").groupBy("idx", "col", "cell").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("idx", "col").orderBy(F.desc("n"), "cell")))


def profiles(c: DataFrame, levels: int = 12) -> DataFrame:
    """Filled cells, share of numbers, distinct values, most frequent levels and shape of each column."""
    base = c.groupBy("idx", "col").agg(
        F.count("*").alias("n"), F.count_if(F.col("cell") != "").alias("filled"), F.count_distinct(F.when(F.col("cell") != "", F.col("cell"))).alias("n_distinct"), F.count_if(clean_number(F.col("cell")).isNotNull()).alias("numbers")
    )
    top = ranked_values(c).where(F.col("place") <= levels).groupBy("idx", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]), "|").alias("levels"))
    shapes = c.where("cell <> ''").groupBy("idx", "col", shape(F.col("cell")).alias("pattern")).agg(F.count("*").alias("k"))
    major = shapes.withColumn("p", F.row_number().over(Window.partitionBy("idx", "col").orderBy(F.desc("k"), "pattern"))).where("p = 1").select("idx", "col", "pattern")
    out = base.join(top, ["idx", "col"], "left").join(major, ["idx", "col"], "left")
    return out.withColumn("numeric_share", F.coalesce(F.col("numbers") / F.when(F.col("filled") > 0, F.col("filled")), F.lit(0.0))).drop("numbers")


def time_units(c: DataFrame) -> DataFrame:
    """iso, s, ms or none for each column: most cells parse, or lie in the epoch's range and mostly go forward."""
    value = c.where("cell <> ''").select("idx", "col", ROW, clean_number(F.col("cell")).alias("number"), clean_time(F.col("cell"), "iso").alias("iso"))
    step = previous(value, ["idx", "col"], ROW, ["number"]).withColumn("forward", (F.col("number") >= F.col("before_number")).cast("int"))
    stats = step.groupBy("idx", "col").agg(
        F.avg(F.col("iso").isNotNull().cast("int")).alias("iso"),
        F.avg(F.coalesce(F.col("number").between(3e8, 4e9), F.lit(False)).cast("int")).alias("s"),
        F.avg(F.coalesce(F.col("number").between(3e11, 4e12), F.lit(False)).cast("int")).alias("ms"),
        F.avg("forward").alias("forward"),
    )
    unit = F.when(F.col("iso") >= 0.9, "iso").when((F.col("s") >= 0.9) & (F.col("forward") >= 0.95), "s").when((F.col("ms") >= 0.9) & (F.col("forward") >= 0.95), "ms").otherwise("none")
    return stats.select("idx", "col", unit.alias("unit"))


def regularity(c: DataFrame, unit: str) -> DataFrame:
    """Median step in milliseconds, and whether four fifths of the steps are within half of it."""
    value = c.where("cell <> ''").select("idx", "col", ROW, clean_time(F.col("cell"), unit).alias("ms"))
    step = previous(value, ["idx", "col"], ROW, ["ms"]).withColumn("step", F.col("ms") - F.col("before_ms"))
    middle = step.groupBy("idx", "col").agg(F.expr("percentile(step, 0.5)").alias("median_step"))
    near = step.join(middle, ["idx", "col"]).groupBy("idx", "col", "median_step").agg(F.avg((F.abs(F.col("step") - F.col("median_step")) <= 0.5 * F.col("median_step")).cast("int")).alias("near"))
    return near.select("idx", "col", "median_step", (F.coalesce("near", F.lit(0.0)) >= 0.8).alias("regular"))


def counters(c: DataFrame) -> DataFrame:
    """Columns that mostly go up by one, and otherwise start anew."""
    value = c.select("idx", "col", ROW, clean_number(F.col("cell")).alias("number"))
    step = previous(value, ["idx", "col"], ROW, ["number"]).withColumn("delta", F.col("number") - F.col("before_number")).where("delta is not null")
    reset = (F.col("delta") < 0) & (F.col("number") <= 1)
    stats = step.groupBy("idx", "col").agg(F.avg((F.col("delta") == 1).cast("int")).alias("ones"), F.avg(((F.col("delta") == 1) | reset).cast("int")).alias("ones_or_reset"))
    return stats.select("idx", "col", "ones", ((F.col("ones") >= 0.9) & (F.col("ones_or_reset") >= 0.99)).alias("is_counter"))


def kinds(c: DataFrame) -> DataFrame:
    """timestamp, counter, category, id, number, text or empty for each column."""
    joined = profiles(c).join(time_units(c), ["idx", "col"], "left").join(counters(c), ["idx", "col"], "left")
    whole = c.where("cell <> ''").groupBy("idx", "col").agg(F.bool_and(F.coalesce(clean_number(F.col("cell")) % 1 == 0, F.lit(False))).alias("whole"))
    share = F.col("n_distinct") / F.col("filled")
    kind = (
        F.when(F.col("filled") == 0, "empty")
        .when(F.coalesce("unit", F.lit("none")) != "none", "timestamp")
        .when(F.coalesce("is_counter", F.lit(False)), "counter")
        .when((F.col("numeric_share") >= 0.9) & F.col("whole") & (F.col("n_distinct") <= 12) & (F.col("filled") >= 50), "category")
        .when((F.col("numeric_share") >= 0.9) & F.col("whole") & (share > 0.9), "id")
        .when(F.col("numeric_share") >= 0.9, "number")
        .when(share <= 0.2, "category")
        .when(share > 0.9, "id")
        .otherwise("text")
    )
    return joined.join(whole, ["idx", "col"], "left").select("idx", "col", kind.alias("kind"))


def layout(kind: DataFrame, regular: DataFrame) -> DataFrame:
    """The first timestamp and counter columns; records if the timestamp is irregular, else a stream."""
    joined = kind.join(regular.select("idx", "col", "regular"), ["idx", "col"], "left")
    first = joined.agg(
        F.min_by("col", F.when(F.col("kind") == "timestamp", F.col("idx"))).alias("time_column"),
        F.min_by("col", F.when(F.col("kind") == "counter", F.col("idx"))).alias("counter_column"),
        F.min_by("regular", F.when(F.col("kind") == "timestamp", F.col("idx"))).alias("regular"),
    )
    return first.select("time_column", "counter_column", F.when(F.col("time_column").isNotNull() & ~F.coalesce("regular", F.lit(True)), "records").otherwise("stream").alias("layout"))
