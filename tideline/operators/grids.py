"""From raw rows to a bounded grid of metrics: row and time buckets, episodes, and the metrics of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.cleaning import shape
from tideline.operators.ordered import previous, running_count


def bucket_rows(df: DataFrame, index: str, columns: list[str], most: int) -> DataFrame:
    """Rows in order of ``index`` to means over the smallest power-of-two bucket at which at most ``most`` buckets are left."""
    ends = df.agg(F.min(index).alias("first_"), F.count("*").alias("n_"))
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_") / most)))
    sized = df.join(F.broadcast(ends.withColumn("size_", F.pow(F.lit(2.0), size).cast("long"))), F.lit(True))  # one row
    bucket = F.floor((F.col(index) - F.col("first_")) / F.col("size_")).alias("t")
    return sized.groupBy(bucket).agg(*[F.avg(c).alias(c) for c in columns], F.min(index).alias("first_row"))


def episodes(df: DataFrame, keys: list[str], order: str, counter: str) -> DataFrame:
    """A counter that isn't above its predecessor starts an episode; ``order`` is a whole number, distinct within ``keys``."""
    seen = previous(df, keys, order, [counter])
    return running_count(seen, keys, order, F.col(counter) <= F.col(f"before_{counter}"), "episode").drop(f"before_{counter}")


def merge_short(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """One episode where the median length of the episodes is below ``least``."""
    sizes = df.groupBy(*keys, "episode").agg(F.count("*").alias("size"))
    middle = sizes.groupBy(*keys).agg(F.expr("percentile(size, 0.5)").alias("middle"))
    return df.join(middle, keys).withColumn("episode", F.when(F.col("middle") < least, 0).otherwise(F.col("episode"))).drop("middle")


def quarantine(cells: DataFrame) -> DataFrame:
    """``episode, col, number``: columns without numbers, or constant inside every episode."""
    spread = cells.groupBy("col", "episode").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("number").alias("k"), F.count("*").alias("n"))
    whole = spread.groupBy("col").agg(F.bool_or(F.col("lo") < F.col("hi")).alias("moves"), (F.sum("k") / F.sum("n")).alias("share"))
    return whole.select("col", F.when(F.col("share") < 0.9, "not numeric").when(~F.coalesce("moves", F.lit(False)), "constant").alias("reason")).where("reason is not null")


def aliases(columns: DataFrame) -> DataFrame:
    """Opaque names in column order: S01, S02 and so on."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("idx"))
    return columns.withColumn("alias", F.concat(F.lit("S"), F.lpad(place.cast("string"), 2, "0")))


#: Choices of a time bucket, in minutes.
MINUTES = (1, 5, 15, 60, 120, 240, 360, 720, 1440, 10080)


def bucket_choices(rows: DataFrame, ms: str, least: int = 100) -> DataFrame:
    """Median rows of the non-empty inner buckets for every choice; the first with ``least`` is chosen, else the last."""
    sized = rows.select(F.explode(F.array(*[F.lit(m) for m in MINUTES])).alias("minutes"), F.col(ms).alias("ms")).withColumn("bucket", F.floor(F.col("ms") / (F.col("minutes") * 60000)))
    counts = sized.groupBy("minutes", "bucket").agg(F.count("*").alias("n"))
    own = Window.partitionBy("minutes")
    inner = counts.withColumns({"lo": F.min("bucket").over(own), "hi": F.max("bucket").over(own)}).where((F.col("bucket") > F.col("lo")) & (F.col("bucket") < F.col("hi")))
    middle = inner.groupBy("minutes").agg(F.expr("percentile(n, 0.5)").alias("median_rows"))
    first = F.min(F.when(F.col("median_rows") >= least, F.col("minutes"))).over(Window.partitionBy(F.lit(1)))
    return middle.withColumn("chosen", F.col("minutes") == F.coalesce(first, F.max("minutes").over(Window.partitionBy(F.lit(1)))))


def time_bucket(ms: Column, minutes: int) -> Column:
    return F.floor(ms / (minutes * 60000))


def dense(buckets: DataFrame, values: list[str]) -> DataFrame:
    """``bucket`` and values with the empty buckets between the first and the last, where counts are 0."""
    ends = buckets.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    every = ends.select(F.explode(F.sequence("lo", "hi")).alias("bucket"))
    return every.join(buckets, "bucket", "left").select("bucket", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


# -- metrics: name -> aggregate over one bucket of records


def null_rate(cell: Column) -> Column:
    return F.avg((F.coalesce(cell, F.lit("")) == "").cast("int"))


def round_share(number: Column) -> Column:
    return F.avg((number == F.floor(number)).cast("int"))


def zero_digit_share(cell: Column) -> Column:
    return F.avg(cell.rlike(r"0\D*$").cast("int"))


def duplicate_rate(value: Column) -> Column:
    return 1 - F.count_distinct(value) / F.count(value)


def format_violations(records: DataFrame, cell: str) -> DataFrame:
    """``bucket`` and cells: the share of filled cells whose shape isn't the table's most frequent."""
    shaped = records.where(F.coalesce(cell, F.lit("")) != "").withColumn("shape", shape(F.col(cell)))
    major = shaped.groupBy("shape").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "shape").limit(1).select(F.col("shape").alias("major"))
    return shaped.join(F.broadcast(major), F.lit(True)).groupBy("bucket").agg(F.avg((F.col("shape") != F.col("major")).cast("int")).alias("violations"))  # one row


def level_shares(records: DataFrame, category: str, most: int = 12) -> DataFrame:
    """Share of each of the most frequent levels, and of all others together, by bucket."""
    top = records.groupBy(F.col(category).alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "level").limit(most).select("level", F.lit(True).alias("top"))
    named = records.withColumn("level", F.col(category)).join(top, "level", "left").withColumn("level", F.when(F.col("top"), F.col("level")).otherwise("(other)"))
    counts = named.groupBy("bucket", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bucket"))).drop("n")


def split_metrics(records: DataFrame, category: str, number: str) -> DataFrame:
    """Rows and median in total and for each level, in one pass over the records."""
    sets = records.groupingSets([["bucket", category], ["bucket"]], "bucket", category)
    return sets.agg(F.count("*").alias("n"), F.expr(f"percentile({number}, 0.5)").alias("median")).select("bucket", F.coalesce(category, F.lit("(all)")).alias("level"), "n", "median")


def derived_fields(wide: DataFrame, columns: list[str], least: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """``field, formula``: columns that follow from others in all complete rows, as z = k x, z = x + y or z = x - y (x before y), in the order of the columns.

    A column that was found explains no other. Sums of products of all pairs, a matrix from one pass, tell which formulas may hold; a second pass tests those few
    row by row. Both plans have one size, whatever the number of columns.
    """
    import numpy as np
    import pyarrow as pa

    from tideline.session import ship

    spark, many = wide.sparkSession, len(columns)
    ship(spark)
    rows = wide.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = spark.createDataFrame([], "field string, formula string")
    if many < 2:
        return schema

    def complete(batch) -> np.ndarray:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        return x[np.isfinite(x).all(1)]

    def products(batches):
        total, n = np.zeros((many, many)), 0
        for batch in batches:
            x = complete(batch)
            total, n = total + x.T @ x, n + len(x)
        yield pa.record_batch({"i": np.arange(many), "row": pa.array(list(total), pa.list_(pa.float64())), "n": np.full(many, n)})

    sums = rows.mapInArrow(products, "i long, row array<double>, n long").select("i", "n", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # one matrix
    s, n = np.zeros((many, many)), max((r["n"] for r in sums), default=0)
    for r in sums:
        s[r["i"], r["j"]] = r["v"]
    if n < least:
        return schema
    d, formulas = np.diag(s), []  # z, x, y, factor of x, factor of y
    for z in range(many):
        for x in range(many):
            if x == z:
                continue
            k = s[z, x] / d[x] if d[x] > 0 else 0.0
            if k not in (0.0, 1.0) and d[z] - k * s[z, x] <= 1e-9 * d[z]:
                formulas.append((z, x, x, k, 0.0))
            for y in range(x + 1, many):
                for sign in (1.0, -1.0):
                    rest = d[z] + d[x] + d[y] - 2 * s[z, x] - 2 * sign * s[z, y] + 2 * sign * s[x, y]
                    if y != z and rest <= 1e-9 * max(d[z], d[x], d[y]):
                        formulas.append((z, x, y, 1.0, sign))

    def failures(batches):
        found = np.zeros(len(formulas), np.int64)
        for batch in batches:
            v = complete(batch)
            for f, (z, x, y, k, sign) in enumerate(formulas):
                own = k * v[:, x] + sign * v[:, y]
                found[f] += (np.abs(v[:, z] - own) > tolerance * np.maximum(1, np.maximum(np.abs(v[:, z]), np.abs(own)))).sum()
        yield pa.record_batch({"f": np.arange(len(formulas)), "failed": found})

    held = {r["f"] for r in rows.mapInArrow(failures, "f long, failed long").groupBy("f").agg(F.sum("failed").alias("failed")).where("failed = 0").collect()} if formulas else set()  # the few formulas
    known, out = set(), []
    for f, (z, x, y, k, sign) in enumerate(formulas):
        if f in held and not {z, x, y} & known:
            known.add(z)
            out.append((columns[z], f"{columns[z]} = {k:.6g} x {columns[x]}" if not sign else f"{columns[z]} = {columns[x]} {'+' if sign > 0 else '-'} {columns[y]}"))
    return spark.createDataFrame(out, "field string, formula string")


def without_derived(kinds: DataFrame, found: DataFrame) -> DataFrame:
    """``col, kind``: a number that follows from others is text, so no metric is made of it."""
    return kinds.join(found.select(F.col("field").alias("col"), F.lit(True).alias("follows")), "col", "left").withColumn("kind", F.when(F.col("follows"), "text").otherwise(F.col("kind"))).drop("follows")


def top_variance(metrics: DataFrame, most: int = 199) -> DataFrame:
    """``metric, v``: the metrics with the largest relative variance, constant ones left out; ``rows`` always stays."""
    spread = metrics.groupBy("metric").agg((F.var_pop("v") / F.greatest(F.avg("v") * F.avg("v"), F.lit(1e-12))).alias("spread"))
    placed = spread.where((F.col("spread") > 0) & (F.col("metric") != "rows")).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("spread", 9)), "metric")))
    return placed.where(F.col("place") <= most)


def families(sensors: DataFrame) -> DataFrame:
    """Sensors of the same metric over different levels of one category, two or more."""
    stem = F.regexp_extract("sensor", r"^(.*)\[[^\]]*\]$", 1)
    return sensors.withColumn("family", stem).where("family <> ''").groupBy("family").agg(F.array_join(F.sort_array(F.collect_set("sensor")), ",").alias("members"), F.count_distinct("sensor").alias("n")).where("n >= 2")
