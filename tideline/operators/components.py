"""Principal components of the sensors of a run, and how far samples lie outside of them."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide(g: DataFrame, sensors: list[str]) -> DataFrame:
    """Complete time steps with one column for each sensor."""
    named = g.groupBy("run_id", "t").pivot("sensor", sensors).agg(F.first("v"))
    return named.dropna().select("run_id", "t", *[F.col(f"`{s}`").alias(f"x{i}") for i, s in enumerate(sensors)])


def fit(steps: DataFrame, n: int, share: float = 0.9):
    """Standardisation and the components that hold ``share`` of the variance."""
    assembled = VectorAssembler(inputCols=[f"x{i}" for i in range(n)], outputCol="raw").transform(steps)
    scaler = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(assembled)
    pca = PCA(k=n, inputCol="z", outputCol="y").fit(scaler.transform(assembled))
    held, k = 0.0, 0
    for k, part in enumerate(pca.explainedVariance.toArray(), 1):  # one number for each sensor
        held += part
        if held >= share:
            break
    return scaler, pca, k


def statistics(steps: DataFrame, model, n: int) -> DataFrame:
    """T2 inside the components and the squared error outside of them, for every step."""
    scaler, pca, k = model
    scored = pca.transform(scaler.transform(VectorAssembler(inputCols=[f"x{i}" for i in range(n)], outputCol="raw").transform(steps)))
    arrays = scored.select("run_id", "t", vector_to_array("z").alias("z"), vector_to_array("y").alias("y"))
    variances = F.array(*[F.lit(float(v) * n) for v in pca.explainedVariance.toArray()[:k]])
    t2 = F.aggregate(F.zip_with(F.slice("y", 1, k), variances, lambda a, v: a * a / F.greatest(v, F.lit(1e-12))), F.lit(0.0), lambda s, x: s + x)
    square = lambda c: F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return arrays.select("run_id", "t", t2.alias("t2"), F.greatest(square(F.col("z")) - square(F.slice("y", 1, k)), F.lit(0.0)).alias("spe"))
