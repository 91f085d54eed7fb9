"""Scans in the order of a whole number over tables of any length: blocks of the order are scanned on their own and what passes a border is carried.

A key's rows are dealt by blocks of the order, so a column or run of any length is many tasks' work. What the next block needs of the one before (its last
row, its running sum) is one row for each block, and only those few rows are put in order in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order that one block holds.
BLOCK = 1 << 16
AT, BEFORE = "block_", "before_"


def blocked(df: DataFrame, order: str, size: int = BLOCK) -> DataFrame:
    """``df`` with the number of each row's block."""
    return df.withColumn(AT, F.floor(F.col(order) / size))


def previous(df: DataFrame, keys: list[str], order: str, values: list[str], size: int = BLOCK) -> DataFrame:
    """``df`` with ``before_<value>``: the values in the row before, by ``order`` within ``keys``; null in the first. Orders are distinct within keys."""
    own, held = Window.partitionBy(*keys, AT).orderBy(order), F.struct(*values)
    scanned = blocked(df, order, size).withColumns({f"{BEFORE}{v}": F.lag(v).over(own) for v in values} | {"first_": F.row_number().over(own) == 1})
    # the last row of each block that has rows goes to the next such block
    last = blocked(df, order, size).groupBy(*keys, AT).agg(F.max_by(held, order).alias("last_"))
    carried = last.select(*keys, AT, F.lag("last_").over(Window.partitionBy(*keys).orderBy(AT)).alias("carried_"))
    met = scanned.join(carried, [*keys, AT], "left")
    values_of = {f"{BEFORE}{v}": F.when(F.col("first_"), F.col("carried_")[v]).otherwise(F.col(f"{BEFORE}{v}")) for v in values}
    return met.withColumns(values_of).drop("first_", "carried_", AT)


def running_count(df: DataFrame, keys: list[str], order: str, holds: Column, into: str, size: int = BLOCK) -> DataFrame:
    """``df`` with the number of rows up to and with each, by ``order`` within ``keys``, for which ``holds``."""
    one = F.coalesce(holds, F.lit(False)).cast("long")
    marked = blocked(df, order, size).withColumn("one_", one)
    sums = marked.groupBy(*keys, AT).agg(F.sum("one_").alias("sum_"))
    before = F.sum("sum_").over(Window.partitionBy(*keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum("one_").over(Window.partitionBy(*keys, AT).orderBy(order))
    met = marked.withColumn("own_", own).join(sums.select(*keys, AT, F.coalesce(before, F.lit(0)).alias("carried_")), [*keys, AT])
    return met.withColumn(into, F.col("own_") + F.col("carried_")).drop(AT, "one_", "own_", "carried_")
