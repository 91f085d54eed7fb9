"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame and SQL functions only.

Each source's documents fall by hash into blocks. A source's target is met by whole passes over its blocks and one partial
pass over blocks in permuted order, down to single documents in the block where the target lies. One use of a block in one
pass is a unit. The exact number of units of every source is split among the output shards by a binary tree: at a node,
the left half of the shards gets half of the units, and how many of them come from each source is a multivariate
hypergeometric draw (one conditional draw per source, by inversion of its distribution). A leaf then takes the next
units of each source's permutation, so shards draw disjoint blocks, and rows are shuffled inside each shard.

Blocks of a source are BLOCKS at most, so what a source gathers in one task is bounded; documents meet their block's plan by
source and block, which no source can make hot. Draws depend on the seed and the data only.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; equal rows go together; all
columns stay; a source of size 0 has target 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, cut, documents, free_name, stored

WEIGHTS = (1, 2, 3)
REPEATS, SHARDS, BLOCKS, SEED = 3, 256, 4096, 20240607


def hypergeometric(all_units: str, own: str, taken: str, chance: str) -> str:
    """SQL: how many of ``taken`` units, drawn without return from ``all_units``, are among the ``own``; by inversion at ``chance``.

    Weights run by their ratio from 8 deviations below the mean to 8 above, outside of which there is no mass in doubles.
    """
    ratio = "((p.k - x) * (p.n - x)) / ((x + 1D) * (p.t - p.k - p.n + x + 1D))"
    return f"""
    element_at(transform(transform(transform(array(named_struct(
        't', {all_units}, 'k', {own}, 'n', {taken}, 'u', {chance},
        'm', CASE WHEN {all_units} > 0 THEN {taken} * {own} / cast({all_units} as double) ELSE 0D END,
        'd', CASE WHEN {all_units} > 1 THEN 8 * sqrt({taken} * ({own} / cast({all_units} as double)) * (1 - {own} / cast({all_units} as double))
             * ({all_units} - {taken}) / ({all_units} - 1D)) + 2 ELSE 2D END)),
      p -> named_struct('t', p.t, 'k', p.k, 'n', p.n, 'u', p.u,
        'a', greatest(0L, p.n - (p.t - p.k), cast(floor(p.m - p.d) as bigint)), 'b', least(p.n, p.k, cast(ceil(p.m + p.d) as bigint)))),
      p -> named_struct('t', p.t, 'k', p.k, 'n', p.n, 'a', p.a, 'b', p.b, 'goal', p.u * aggregate(sequence(p.a, p.b), named_struct('w', 1D, 's', 0D),
        (s, x) -> named_struct('w', s.w * coalesce({ratio}, 0D), 's', s.s + s.w), s -> s.s))),
      p -> aggregate(sequence(p.a, p.b), named_struct('w', 1D, 's', 0D, 'x', p.b, 'found', false),
        (s, x) -> named_struct('w', s.w * coalesce({ratio}, 0D), 's', s.s + s.w,
          'x', CASE WHEN NOT s.found AND s.s + s.w >= p.goal THEN x ELSE s.x END, 'found', s.found OR s.s + s.w >= p.goal), s -> s.x)), 1)"""


def split_shards(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``sid, quota`` of each source to ``shard, sid, quota``: the splitting tree. ``shards`` is a power of two."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("sid").cast("long").alias("sid"), F.col("quota").cast("long").alias("q")))).alias("qs"))
    node = node.select(F.lit(0).cast("long").alias("node"), "qs")
    chance = f"(pmod(xxhash64({seed}L, depth, node, e.sid), 4503599627370496L) + 0.5D) / 4503599627370496D"
    draw = hypergeometric("s.t", "e.q", "s.n", chance)
    for depth in range(shards.bit_length() - 1):
        node = (
            node.withColumn("depth", F.lit(depth).cast("long"))
            .withColumn("units", F.expr("aggregate(qs, 0L, (s, e) -> s + e.q)"))
            .withColumn(
                "left",
                F.expr(
                    f"""aggregate(qs, named_struct('t', units, 'n', units div 2, 'out', cast(array() as array<bigint>)),
                    (s, e) -> element_at(transform(array({draw}), y -> named_struct('t', s.t - e.q, 'n', s.n - y, 'out', concat(s.out, array(y)))), 1), s -> s.out)"""
                ),
            )
            .select(
                F.expr(
                    """explode(array(
                    named_struct('node', 2 * node, 'qs', zip_with(qs, left, (e, y) -> named_struct('sid', e.sid, 'q', y))),
                    named_struct('node', 2 * node + 1, 'qs', zip_with(qs, left, (e, y) -> named_struct('sid', e.sid, 'q', e.q - y)))))"""
                ).alias("child")
            )
            .select("child.*")
        )
    return node.select(F.col("node").alias("shard"), F.inline("qs")).withColumnRenamed("q", "quota")


def targets(sources: DataFrame, weights: tuple, repeats: int) -> DataFrame:
    """``source, source_size`` to these with ``sid`` and ``target``: shares by weight, at most ``repeats`` times the size, the excess reshared.

    The targets are least(cap, level * weight) for the one level at which they sum to the total; in order of cap / weight
    it is the first at which the rest of the total, shared among the rest of the weights, stays below the next cap.
    One row per source is sorted here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    by_cap = everything.orderBy("ratio", "sid")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    sized = (
        sources.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(repeats))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("heavy", F.sum("weight").over(everything))
    )
    levels = sized.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("heavy") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ).withColumn("place", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)
    return levels.withColumn("target", F.least(F.col("cap"), F.col("weight") * first["level"])).select("source", "source_size", "sid", "target")


def mix_sources(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", into: str = "mix", weights: tuple = WEIGHTS, repeats: int = REPEATS, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """``docs`` with a struct of ``size, source_size, target`` and ``shards``, the output shard of each copy that the mix takes."""
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source))
    place = {"size": size, "source": F.col(source), "hash": key, "block": F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(BLOCKS))}
    thin = stored(docs.select(*[v.alias(k) for k, v in place.items()]))
    blocks = cut(thin.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    sources = cut(targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, repeats))

    same = F.col("b.source").eqNullSafe(F.col("s.source"))
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block")
    passes = (
        blocks.alias("b")
        .join(sources.alias("s"), same)
        .select("b.source", "block", "block_size", "source_size", "sid", "target")
        .withColumn("full", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("upto", F.sum("block_size").over(order))
        .withColumn("room", F.col("rest") - F.col("upto") + F.col("block_size"))
        .withColumn("part", F.when((F.col("room") > 0) & (F.col("block_size") > 0), F.when(F.col("room") >= F.col("block_size"), "whole").otherwise("cut")))
        .withColumn("units", F.col("full") + F.when(F.col("part").isNotNull(), 1).otherwise(0))
    )
    passes = cut(passes)

    # in the block where a source's target lies, documents go in order of their hash while the middle of a document is within the rest
    cuts = passes.where("part = 'cut'").select(F.col("source").alias("s"), F.col("block").alias("c"), "room")
    inside = thin.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("c"))).groupBy("s", "c", "room", "hash").agg(F.sum("size").alias("size"))
    taken = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("s", "c").orderBy("hash")))
    last = taken.where(F.col("upto") - F.col("size") / 2 <= F.col("room")).groupBy("s", "c").agg(F.max("hash").alias("last_hash"))

    units = passes.where("units > 0").select("sid", "block", F.explode(F.expr("sequence(0L, units - 1)")).alias("pass"))
    units = units.withColumn("number", F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 3), "block", "pass"), "block", "pass")).cast("long") - 1)
    quotas = passes.groupBy("sid").agg(F.sum("units").alias("quota"))
    leaves = split_shards(quotas, shards, seed).withColumn("upto", F.sum("quota").over(Window.partitionBy("sid").orderBy("shard")))
    leaves = leaves.where("quota > 0").select("sid", "shard", F.explode(F.expr("sequence(upto - quota, upto - 1)")).alias("number"))
    dealt = (
        units.join(leaves, ["sid", "number"])
        .groupBy("sid", "block")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"].cast("int")).alias("shards"))  # at most ``repeats`` + 1 passes
    )
    plan = passes.join(dealt, ["sid", "block"], "left").join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("c")), "left")
    plan = plan.select(F.struct("source_size", "target", "part", "last_hash", "shards").alias("plan_"), F.coalesce("source", F.lit("")).alias("plan_source_"), F.col("source").isNull().alias("plan_null_"), F.col("block").alias("plan_block_"))

    placed = docs.withColumns({"own_size_": size, "own_hash_": key}).withColumn("own_block_", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("own_hash_")), F.lit(BLOCKS)))
    met = placed.join(
        cut(plan), (F.coalesce(F.col(source), F.lit("")) == F.col("plan_source_")) & (F.col(source).isNull() == F.col("plan_null_")) & (F.col("own_block_") == F.col("plan_block_"))
    )
    some = F.coalesce(F.col("plan_.shards"), F.expr("cast(array() as array<int>)"))
    beyond = F.coalesce((F.col("plan_.part") == "cut") & (F.col("plan_.last_hash").isNull() | (F.col("own_hash_") > F.col("plan_.last_hash"))), F.lit(False))
    shards_of = F.when(beyond, F.slice(some, F.lit(1), F.greatest(F.size(some) - 1, F.lit(0)))).otherwise(some)
    mixed = F.struct(F.col("own_size_").alias("size"), F.col("plan_.source_size").alias("source_size"), F.col("plan_.target").alias("target"), shards_of.alias("shards"))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], mixed.alias(free_name(docs, into)))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", seed: int = SEED, **options) -> DataFrame:
    """The rows of the mix: ``docs``' columns, a row for every copy, dealt by output shard and shuffled inside each."""
    name = free_name(docs, "mix")
    copies = mix_sources(docs, doc_id=doc_id, into=name, seed=seed, **options).select("*", F.posexplode(F.col(f"{name}.shards")).alias("copy_", "shard_"))
    dealt = copies.repartition("shard_").sortWithinPartitions("shard_", F.xxhash64(F.lit(seed + 4), F.col(doc_id), "copy_"))
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir, "doc_id", "text", "source"))
    taken = F.col("mix.size") * F.size("mix.shards")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.cast("long").alias("taken"), "mix.shards")
