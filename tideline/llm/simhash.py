"""SimHash near-deduplication with bit-sliced comparison.

Equal fingerprints are one first, so only distinct ones are compared. Fingerprints within RADIUS bits agree exactly on all
but RADIUS of the blocks that the 64 bits are cut into; for every choice of agreeing blocks the fingerprints meet by the
agreeing bits (more, smaller blocks when there are more fingerprints; each choice of blocks finds every pair). What meets is
dealt in chunks, and every pair of chunks is compared in a task of its own, so a crowded key is no crowded task.

In a task the fingerprints stand as 64 bit planes. A comparison of many pairs at once adds the differing bits of plane after
plane with carry-save counters (two bits and an overflow) and gives a block up as soon as all of its pairs overflow. Of the
pairs found only the links of a spanning forest leave the task.

Defined cases: a null or empty text has fingerprint zero; a text of one or two words is one shingle; equal rows share their
component; a null id is carried with the component of its fingerprint; an empty table gives an empty table; other columns stay.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import cut, documents, free_name, small_batches
from tideline.llm.components import components, spanning

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of one chunk; a task compares two chunks.
CHUNK = 512
#: Rows that a task gathers before it compares short groups.
FLUSH = 1 << 15
#: Distinct fingerprints up to which so many blocks are enough for short lists.
BLOCKS_BY_COUNT = ((1 << 22, 4), (1 << 30, 5), (1 << 62, 6))
#: Planes between two looks at whether all pairs have overflowed.
LOOK = 8


def fingerprint(text: bytes | None, words_in: int) -> int:
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= words_in:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: n - words_in + 1].tolist(), ends[words_in - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], np.uint64)
    total = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(words_in: int):
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, words_in) for x in texts.to_pylist()], np.uint64).view(np.int64))

    return F.arrow_udf(prints, "long")


def planes(values: np.ndarray) -> np.ndarray:
    """The 64 bit planes of fingerprints, packed into words of 64."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-max(1, len(values)) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within_radius(values: np.ndarray, sliced: np.ndarray, radius: int) -> np.ndarray:
    """For each value (rows), which of the sliced fingerprints are within ``radius`` (at most 3) bits; packed bits in words."""
    shape = (len(values), sliced.shape[1])
    one, two, over = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(len(values))
    flips = np.where((values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1, full, np.uint64(0))
    for k in range(64):
        if k and k % LOOK == 0:
            open_rows = ~(over[live] == full).all(1)
            if not open_rows.all():
                live = live[open_rows]
                if not len(live):
                    break
        rows = slice(None) if len(live) == len(values) else live
        carry = sliced[k][None, :] ^ flips[rows, k][:, None]
        low = one[rows] & carry
        one[rows] ^= carry
        high = two[rows] & low
        two[rows] ^= low
        over[rows] |= high
    if radius >= 3:
        return ~over
    if radius == 2:
        return ~(over | (one & two))
    return ~(over | two) if radius == 1 else ~(over | two | one)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``radius``: among ``left``, or between ``left`` and ``right``."""
    own = right is None
    block = left if own else right
    names = left if own else np.concatenate([left, right])
    label, links = np.arange(len(names)), []
    sliced = planes(block)
    for at in range(0, len(left), 256):
        found = within_radius(left[at : at + 256], sliced, radius)
        hits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(block)]
        if own:
            hits[np.arange(len(hits)), at + np.arange(len(hits))] = 0
        links += spanning(hits, at, 0 if own else len(left), label)
    return [(int(names[a]), int(names[b])) for a, b in links]


def small_groups(values: np.ndarray, group: np.ndarray, largest: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (by position) within ``radius`` inside short groups that lie one after another: all neighbours at one distance are compared at once."""
    first, second = [], []
    sliced = planes(values)
    width = sliced.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for distance in range(1, largest):
        same = np.zeros(width * 64, np.uint8)
        same[: len(group) - distance] = group[distance:] == group[:-distance]
        if not same.any():
            break
        over = ~np.packbits(same, bitorder="little").view(np.uint64)
        one, two = np.zeros(width, np.uint64), np.zeros(width, np.uint64)
        words, bits = distance // 64, np.uint64(distance % 64)
        live = np.flatnonzero(over != full)
        for k in range(64):
            if k % LOOK == 0:
                live = live[over[live] != full]
                if not len(live):
                    break
            plane = np.concatenate([sliced[k], np.zeros(words + 1, np.uint64)])
            moved = plane[live + words] >> bits
            if bits:
                moved = moved | plane[live + words + 1] << (np.uint64(64) - bits)
            carry = plane[live] ^ moved
            low = one[live] & carry
            one[live] ^= carry
            high = two[live] & low
            two[live] ^= low
            over[live] |= high
        near = ~over if radius >= 3 else ~(over | (one & two)) if radius == 2 else ~(over | two) if radius == 1 else ~(over | two | one)
        at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        first.append(at)
        second.append(at + distance)
    none = np.zeros(0, np.int64)
    return np.concatenate(first or [none]), np.concatenate(second or [none])


#: Groups up to this size are compared by distance, all groups of a batch at once.
SHORT = 32


def compare(radius: int):
    """An Arrow function over rows sorted by group, ``side`` and chunk: fingerprints in, links out."""

    def links_of(values: np.ndarray, group: np.ndarray, side: np.ndarray):
        edges = np.flatnonzero(np.diff(group)) + 1
        begins, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(group)]))
        sizes = ends - begins
        two_sided = np.add.reduceat(side, begins) > 0
        short = (sizes <= SHORT) & ~two_sided
        if short.any():
            rows = np.repeat(short, sizes)
            part = values[rows]
            a, b = small_groups(part, group[rows], int(sizes[short].max()), radius)
            yield part[a].view(np.int64), part[b].view(np.int64)
        for k in np.flatnonzero(~short):
            part, right = values[begins[k] : ends[k]], side[begins[k] : ends[k]] == 1
            pairs = np.array(forest(part[~right], part[right] if right.any() else None, radius), np.uint64).reshape(-1, 2)
            yield pairs[:, 0].view(np.int64), pairs[:, 1].view(np.int64)

    def run(batches):
        held = None
        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("print", "task", "side")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = np.flatnonzero(held[1] != held[1][-1]) if len(held[1]) else []
            if len(last) and last[-1] + 1 >= FLUSH:
                upto = last[-1] + 1
                for a, b in links_of(held[0][:upto].view(np.uint64), held[1][:upto], held[2][:upto]):
                    yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})
                held = [x[upto:].copy() for x in held]
        if held is not None and len(held[0]):
            for a, b in links_of(held[0].view(np.uint64), held[1], held[2]):
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    return run


def near_pairs(distinct: DataFrame, count: int, radius: int, chunk: int) -> DataFrame:
    """``print`` (distinct fingerprints) to the links ``a, b`` that join all fingerprints within ``radius`` bits."""
    blocks = next(b for most, b in BLOCKS_BY_COUNT if count <= most) + radius - RADIUS
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(mask)).alias("agree")) for k, mask in enumerate(masks)])
    met = distinct.select("print", F.inline(keys))
    crowds = met.groupBy("choice", "agree").agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(crowds, ["choice", "agree"])
    n_chunks = F.ceil(F.col("n") / chunk).cast("long")
    own = F.pmod(F.xxhash64("print"), n_chunks)
    # a pair of chunks is a task; a chunk goes to its task with every chunk, and a crowd of one chunk is one task
    other = F.explode(F.expr("sequence(0L, n_chunks - 1)"))
    dealt = met.withColumns({"n_chunks": n_chunks, "own": own}).select("*", other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        F.xxhash64("choice", "agree", low, high).alias("task"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("long").alias("side"), "print"
    )
    return dealt.repartition("task").sortWithinPartitions("task", "side", "print").mapInArrow(compare(radius), "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_in: int = SHINGLE, radius: int = RADIUS, into: str = "near", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with a struct of ``fingerprint`` (hex) and ``component_id``, the smallest id of the documents it is linked with."""
    small_batches(docs.sparkSession)
    marked = cut(docs.select(F.col(doc_id).cast("long").alias("id"), fingerprints(words_in)(F.col(text).cast("binary")).alias("print")))
    distinct = cut(marked.groupBy("print").agg(F.min("id").alias("least")))
    links = cut(near_pairs(distinct.select("print"), distinct.count(), radius, chunk).distinct())
    roots = components(links)
    classes = distinct.join(roots, distinct["print"] == roots["id"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(smallest, "root").select(F.col("print").alias("print_"), F.col("component").alias("component_"))
    out = docs.withColumn("own_print_", fingerprints(words_in)(F.col(text).cast("binary"))) if len(docs.columns) > 2 else None
    if out is None:  # the table has nothing else to carry
        out = marked.select(F.col("id").alias(doc_id), F.col("print").alias("own_print_"))
    result = F.struct(F.lower(F.lpad(F.hex("own_print_"), 16, "0")).alias("fingerprint"), F.col("component_").alias("component_id"))
    kept = [F.col(f"`{c}`") for c in out.columns if c != "own_print_"]
    return out.join(named, F.col("own_print_") == F.col("print_")).select(*kept, result.alias(free_name(docs, into)))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "near.fingerprint", "near.component_id")
