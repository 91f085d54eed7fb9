"""The chained analysis over the grid, in which ``price[A]`` drifts from week 300 on; no stage reads a fixed table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators.analysis import analyse
from tideline.plans.drift import ramp
from tideline.plans.registry import query

#: Weeks that a sensor may lead another.
MOST_LAG = 6


def analysed(spark, d, masked=()):
    g = ramp(spark, d).withColumn("v", F.when(F.col("sensor").isin(*masked), None).otherwise(F.col("v")))
    return analyse(g, F.split("sensor", r"\[")[0], MOST_LAG)


@query("analysis_incidents")
def analysis_incidents(spark, d):
    """Faults with their drivers, onset, victims and confidence, from raw rows."""
    return analysed(spark, d)["incidents"].withColumn("drivers", F.array_join("drivers", ","))


@query("analysis_without_sensor")
def analysis_without_sensor(spark, d):
    """The whole analysis again with ``price[A]`` masked."""
    return analysed(spark, d, ["price[A]"])["incidents"].withColumn("drivers", F.array_join("drivers", ","))
