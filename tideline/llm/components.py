"""Connected components of a link table, as a bounded loop of joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (undirected links between long ids) to ``id, root``: the smallest id reachable, for every id with a link.

    Rounds alternate two rewritings until nothing changes: every node sends its larger neighbours to the smallest of its
    neighbours, then every node links its smaller neighbours to the smallest of them. Both keep components whole and
    shorten paths, so rounds grow with the logarithm of the longest path. Minima are aggregated before the shuffle, so a
    node with very many links is no hot key there; the join back is one that adaptive execution splits.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("id"), "root").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def spanning(hits: np.ndarray, row: int, column: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest: ``hits`` says which of the items from ``column`` on each item from ``row`` on is linked with.

    ``label`` holds each item's tree so far and is updated; a link is returned only where it joins two trees.
    """
    links = []
    for i in np.flatnonzero(hits.any(1)):
        mine = row + i
        near = np.flatnonzero(hits[i]) + column
        for root in np.unique(label[near]):
            if root != label[mine]:
                links.append((mine, int(near[label[near] == root][0])))
                label[label == root] = label[mine]
    return links
