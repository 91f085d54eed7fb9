"""Near-deduplication of embeddings by spherical k-means cells and blocked cosine products.

Equal vectors are one first, with their number. Centroids are fitted on a bounded sample (SAMPLE vectors by hash order); every
vector then goes to its nearest cell and to up to SPREAD further cells, nearest first, in which a partner can lie: a partner
within the cosine limit is no further away than a fixed chord, so cells whose border is further than that are left out.
Cells that came out large, as all do where MOST_CELLS are too few for the vectors, are split by centroids of their own, fitted on a
bounded sample of the cell, and vectors go to the nearest of the finer cells; so cells keep their size as vectors grow. Each
cell is dealt in chunks, and each pair of chunks is one matrix product in one task, so a crowded cell is no crowded task.
A pair that meets in several cells counts in the first of them only, so counts are sums and no pairs leave the tasks but the
links of spanning forests. One vector of each component, the one with the smallest id, is kept.

Recall is that of SPREAD: a pair is missed only if the two share none of their nearest cells. The exact way is ``spread=None``: a vector
then goes to every cell that the chord allows, cells are not split, and no pair is missed, at the price of more copies.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without an id, link with nothing
and are their own component; shorter vectors count as padded with zeros; equal vectors under different ids link with each
other; all columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import cut, free_name, small_batches
from tideline.llm.components import components, spanning

COSINE = 0.95
#: Vectors that centroids are fitted on; vectors of a cell, about; most cells; rounds of fitting.
SAMPLE, CELL, MOST_CELLS, ROUNDS = 20_000, 256, 4096, 10
#: A cell with so many times CELL vectors is split; vectors that its centroids are fitted on, about; vectors that are placed at once.
LARGE, PART_SAMPLE, PART = 8, 8192, 16_384
#: Chunks are told by a broadcast up to so many cells with more than one.
TOLD = 100_000
#: Cells of a split cell are numbered from its number times this.
FINE = 1 << 20
#: Further cells of a vector; vectors of a chunk.
SPREAD, CHUNK = 4, 1024


def unit(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    scale = np.abs(out).max(axis=1, keepdims=True)
    out /= scale  # so that squares neither vanish nor overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts are spread evenly over the sample, which is in hash order. An empty cell keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[k : k + 4096] @ centroids.T, axis=1) for k in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 1e-12
        centroids[full] = sums[full] / norms[full, None]
    return centroids


PLACED = "array<struct<cell: long, near: double>>"


def placed_lists(ids: np.ndarray, near: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.float64())], names=["cell", "near"]))


def cells_of(held, width: int, limit: float, spread: int | None):
    """An Arrow function: vectors to the cells of each, the nearest first, with their cosines."""

    def assign(vectors: pa.Array) -> pa.Array:
        centroids, gaps = held.value
        chord = np.sqrt(2 - 2 * limit)
        rows = vectors.to_pylist()
        ids, cosines, sizes = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for at in range(0, len(rows), 1024):
            near = unit(rows[at : at + 1024], width) @ centroids.T
            most = near.shape[1] if spread is None else min(1 + spread, near.shape[1])
            best = np.argpartition(-near, most - 1, axis=1)[:, :most]
            order = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
            best = np.take_along_axis(best, order, 1)
            close = np.take_along_axis(near, best, 1)
            within = close[:, :1] - close <= chord * gaps[best[:, :1], best] + 1e-9
            ids.append(best[within])
            cosines.append(close[within])
            sizes.append(within.sum(1))
        return placed_lists(np.concatenate(ids) * FINE, np.concatenate(cosines), np.concatenate(sizes))

    return F.arrow_udf(assign, PLACED)


def fit_cell(width: int):
    """Of a sample of a large cell: its own centroids."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        parts = min(rows["parts"][0].as_py(), rows.num_rows)
        centroids = spherical_kmeans(unit(rows["embedding"].to_pylist(), width), parts)
        return pa.table({"cell": rows["cell"][:1], "centroids": pa.array([centroids.tobytes()], pa.binary())})

    return run


def place_in_cell(width: int, spread: int):
    """Vectors of a part of a large cell to its nearest finer cells."""

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        out = {"rep": rows["rep"], "placed": placed_lists(np.zeros(0), np.zeros(0), np.zeros(rows.num_rows, int))}
        if rows.num_rows:
            cell = rows["cell"][0].as_py()
            # a cell without a sampled vector stays whole
            centroids = np.frombuffer(held["centroids"][0].as_py()).reshape(-1, width) if held.num_rows else np.zeros((1, width))
            most, vectors, lists = min(1 + spread, len(centroids)), rows["embedding"].to_pylist(), []
            for at in range(0, len(vectors), 1024):
                near = unit(vectors[at : at + 1024], width) @ centroids.T
                best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                lists.append(placed_lists((cell + best).ravel(), np.take_along_axis(near, best, 1).ravel(), np.full(len(best), most)))
            out["placed"] = pa.chunked_array(lists)
        return pa.table(out)

    return run


def split_large(placed: DataFrame, width: int, spread: int, cell_size: int) -> DataFrame:
    """``placed`` with the vectors of large cells moved to finer ones; as many cells for each vector as before."""
    met = placed.select("rep", "embedding", F.explode("placed").alias("p")).select("rep", "embedding", F.col("p.cell").alias("cell"), F.col("p.near").alias("near"))
    large = cut(met.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > LARGE * cell_size).withColumn("parts", F.least(F.lit(FINE - 1), (F.col("n") / cell_size).cast("long"), F.lit(MOST_CELLS).cast("long"))))
    if large.isEmpty():
        return placed
    inside = met.join(F.broadcast(large), "cell")  # MOST_CELLS rows at most
    share = F.least(F.lit(1.0), PART_SAMPLE / F.col("n"))
    sample = inside.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1 << 30)) < share * (1 << 30))
    centroids = cut(sample.select("cell", "parts", "rep", "embedding").groupBy("cell").applyInArrow(fit_cell(width), "cell long, centroids binary"))
    n_parts = F.ceil(F.col("n") / PART).cast("long")
    dealt = inside.withColumn("part", F.pmod(F.xxhash64(F.lit(6), "rep"), n_parts)).select("cell", "part", "rep", "embedding")
    told = centroids.join(large, "cell").select("cell", F.explode(F.expr(f"sequence(0L, cast(ceil(n / {PART}) as long) - 1)")).alias("part"), "centroids")
    finer = dealt.groupBy("cell", "part").cogroup(told.groupBy("cell", "part")).applyInArrow(place_in_cell(width, spread), f"rep long, placed {PLACED}")
    whole = met.join(F.broadcast(large.select("cell")), "cell", "left_anti").select("rep", F.array(F.struct("cell", "near")).alias("placed"))
    both = finer.unionByName(whole).groupBy("rep").agg(F.flatten(F.collect_list("placed")).alias("all"))  # (1 + SPREAD) squared at most
    nearest = F.slice(F.array_sort("all", lambda a, b: F.when(a["near"] > b["near"], -1).when(a["near"] < b["near"], 1).otherwise((a["cell"] - b["cell"]).cast("int"))), 1, 1 + spread)
    return placed.drop("placed").join(both.select("rep", nearest.alias("placed")), "rep")


def first_shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest cell that each pair of cell lists (padded with -1 and -2) shares."""
    same = (one[:, :, None] == two[:, None, :]).any(2)
    return np.where(same, one, np.iinfo(np.int64).max).min(1)


def compare(limit: float, width: int):
    def padded(lists: list, fill: int) -> np.ndarray:
        out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
        for i, x in enumerate(lists):
            out[i, : len(x)] = x
        return out

    def run(rows: pa.Table) -> pa.Table:
        cell = rows["cell"][0].as_py()
        side = rows["side"].to_numpy()
        ids, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        order = np.argsort(side, kind="stable")
        ids, copies, side = ids[order], copies[order], side[order]
        vectors = rows["embedding"].to_pylist()
        lists = rows["cells"].to_pylist()
        matrix = unit([vectors[i] for i in order], width)
        mine, theirs = padded([lists[i] for i in order], -1), padded([lists[i] for i in order], -2)
        split = int((side == 0).sum())
        own = split == len(side)
        left, right = np.arange(split), np.arange(len(side)) if own else np.arange(split, len(side))
        counts, label, links = np.zeros(len(side), np.int64), np.arange(len(side)), []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            hits = matrix[part] @ matrix[right].T >= limit
            if own:
                hits[np.arange(len(part)), part] = False
            a, b = np.nonzero(hits)
            if len(a):
                here = np.concatenate([first_shared(mine[part[a[k : k + 65536]]], theirs[right[b[k : k + 65536]]]) for k in range(0, len(a), 65536)]) == cell
                hits[a[~here], b[~here]] = False
                a, b = a[here], b[here]
                counts += np.bincount(part[a], copies[right[b]], minlength=len(side)).astype(np.int64)
                if not own:
                    counts += np.bincount(right[b], copies[part[a]], minlength=len(side)).astype(np.int64)
                links += spanning(hits, int(part[0]), int(right[0]), label)
        linked = np.flatnonzero(counts)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "a": np.concatenate([ids[linked], ids[pairs[:, 0]]]),
                "b": pa.array([None] * len(linked) + ids[pairs[:, 1]].tolist(), pa.int64()),
                "n": pa.array(counts[linked].tolist() + [None] * len(pairs), pa.int64()),
            }
        )

    return run


def embedding_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", limit: float = COSINE, into: str = "near", spread: int | None = SPREAD, chunk: int = CHUNK, cell_size: int = CELL, most_cells: int = MOST_CELLS) -> DataFrame:
    """``vectors`` with a struct of ``n_links``, ``component_id`` and ``kept``; without a ``spread``, no pair is missed."""
    spark = vectors.sparkSession
    small_batches(spark)
    values = F.col(embedding).cast("array<double>")
    sound = F.col(vec_id).isNotNull() & values.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    marks = [F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(k), values)) for k in (1, 2)]
    groups = cut(
        vectors.where(sound)
        .select(F.col(vec_id).cast("long").alias("id"), marks[0].alias("h1"), marks[1].alias("h2"), F.col(embedding).alias("embedding"))
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )
    count, width = groups.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if count:
        rows = groups.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()  # SAMPLE vectors at most
        sample = unit([r[0] for r in rows], width)
        centroids = spherical_kmeans(sample, int(min(most_cells, len(sample), max(1, count // cell_size))))
    else:
        centroids = np.zeros((1, max(1, width)))
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    held = spark.sparkContext.broadcast((centroids, gaps))  # MOST_CELLS rows at most
    placed = cut(groups.select("rep", "copies", "embedding", cells_of(held, width, limit, spread)("embedding").alias("placed")))
    if spread is not None:
        placed = cut(split_large(placed, width, spread, cell_size))
    met = placed.select("rep", "copies", "embedding", F.transform("placed", lambda p: p["cell"]).alias("cells")).select("*", F.explode("cells").alias("cell"))
    crowded = cut(met.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("long").alias("n_chunks")).where("n_chunks > 1"))
    crowded = F.broadcast(crowded) if crowded.count() <= TOLD else crowded  # else adaptive execution splits the join
    dealt = met.join(crowded, "cell", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n_chunks")))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0L, n_chunks - 1)")).alias("other"))
    dealt = dealt.select(
        "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "copies", "embedding", "cells"
    )
    found = cut(dealt.groupBy("cell", "low", "high").applyInArrow(compare(limit, width), "a long, b long, n long"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b").distinct())
    named = groups.drop("embedding").join(counts, "rep", "left").join(roots, groups["rep"] == roots["id"], "left")
    named = named.select(
        F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links_"), F.coalesce("root", "rep").alias("component_")
    )
    # vectors that link with nothing have no second hash, and a first one of their own, so that they don't meet in one task
    apart = F.xxhash64(F.lit(3), F.coalesce(F.col(vec_id).cast("long"), F.monotonically_increasing_id()))
    out = vectors.withColumns({"own_h1_": F.coalesce(marks[0], apart), "own_h2_": marks[1]}).join(named, (F.col("own_h1_") == F.col("h1_")) & (F.col("own_h2_") == F.col("h2_")), "left")
    component = F.coalesce("component_", F.col(vec_id).cast("long"))
    result = F.struct(F.coalesce("n_links_", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(vec_id), F.lit(True)).alias("kept"))
    return out.select(*[F.col(f"`{c}`") for c in vectors.columns], result.alias(free_name(vectors, into)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_components(vectors).select("vec_id", "near.n_links", "near.component_id", "near.kept")


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_sum(list_transform(CAST(embedding AS DOUBLE[]), x -> x * x)) > 0
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, l.component_id = e.vec_id AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
