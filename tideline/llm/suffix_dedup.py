"""Removal of repeated byte strings with suffix arrays by two-stage sorting.

Every string of LENGTH bytes has one anchor: its k-gram (GRAM bytes) with the smallest hash, the leftmost of equal ones. Equal strings
have equal anchors, so only strings whose anchor occurs elsewhere can repeat.

1. All anchors of all texts are aggregated by hash: which occur at two places, and how often. Copies of a whole text count as one
   place; their repetition is known from the text's hash alone.
2. A Bloom filter of the repeated anchors (FILTER_BITS at most; an error only costs work) goes to every worker, and texts give the
   stretches of bytes around such anchors.
3. Stretches meet by anchor. Over those of a task's anchors a suffix array is built by two-stage sorting: only suffixes smaller than
   their successors are sorted directly, all others are induced by scanning the buckets of first bytes in order. Neighbours in the
   array with LENGTH or more bytes in common are the repeats.
4. An anchor with very many occurrences (of a very common line, say) would make one task large. Its equal stretches become one row
   before they meet, with two of their places; a stretch at two places is covered whole. The distinct stretches are dealt in chunks,
   each with a suffix array of its own. Only where an anchor has several chunks do these exchange what they hold, one 128-bit hash for
   each distinct string of a chunk.
5. What is covered of a distinct stretch goes back to all its places. Stretches with very many places need no partner for that: they
   are covered whole, and are told to the places by a broadcast of bounded size.
6. Covered bytes are merged by text, and texts lose them.

Defined cases: a null text is empty; matches never cross texts; rows with equal ids or texts are texts of their own, so two equal
rows of LENGTH bytes or more are removed both; all columns stay, with the text replaced (bytes of a broken character are
dropped from the text, not from the counts and hash); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import cut, documents, free_name, small_batches, stored

LENGTH, GRAM = 200, 32
FILTER_BITS, FILTER_SHARDS = 1 << 28, 256
#: An anchor with more occurrences than this, and than one of so many parts of all anchors, is a crowd.
CROWD, CROWD_PARTS = 1 << 14, 1 << 20
#: Distinct stretches of a crowd in one suffix array.
CHUNK = 1 << 13
#: A stretch in more rows than this, and than one of so many parts of all rows, is told to its places by a broadcast.
HOT, HOT_PARTS = 1 << 10, 1 << 16
#: A text with more copies than this, and than one of so many parts of all texts, is read in one of its copies only.
COPIES, COPY_PARTS = 64, 1 << 16
#: Bytes of stretches in one suffix array, about; bytes of texts that are read at once.
ARRAY_BYTES, TEXT_BYTES = 4 << 20, 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(data: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each position on, from hashes of powers of two."""
    parts, done, out, power = data.astype(np.uint64) + np.uint64(1), 0, None, base
    size = 1
    while True:
        if length & size:
            # ``done`` bytes stand to the right of this part
            head = parts[: max(0, len(data) - length + 1) + (length - size - done)]
            if out is None:
                out = head.copy()
            else:
                keep = len(out) - size
                out = head[:keep] * np.uint64(pow(base, done, 1 << 64)) + out[size : size + keep]
            done += size
        if done == length:
            return out[: max(0, len(data) - length + 1)]
        parts = parts[: len(parts) - size] * np.uint64(power) + parts[size:]
        power = power * power % (1 << 64)
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """The anchors of many texts that lie one after another: hash and place of each, and the first and last string that it owns."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(x) for x in texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.bytes = b"".join(texts)
        data = np.frombuffer(self.bytes, np.uint8)
        none = np.zeros(0, np.int64)
        self.gram, self.place, self.first, self.last, self.text = none.astype(np.uint64), none, none, none, none
        if len(data) < LENGTH:
            return
        grams = mix(rolled(data, GRAM, 0x9E3779B97F4A7C15))
        width = LENGTH - GRAM + 1
        least = sliding_min(grams, width)
        owner = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - LENGTH + 1))
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, sizes - LENGTH + 1)) - np.maximum(0, sizes - LENGTH + 1), np.maximum(0, sizes - LENGTH + 1)) + self.begins[owner]
        if not len(starts):
            return
        value = least[starts]
        change = np.flatnonzero((value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) + 1
        a, b = starts[np.concatenate(([0], change))], starts[np.concatenate((change - 1, [len(starts) - 1]))]
        who = owner[np.concatenate(([0], change))]
        place = np.concatenate([a[k : k + 8192] + np.argmin(grams[a[k : k + 8192, None] + np.arange(width)], axis=1) for k in range(0, len(a), 8192)])
        found = [(grams[place], place, a, np.minimum(b, place), who)]
        for k in np.flatnonzero(b > place):  # the same smallest hash again: every further place owns the strings up to it
            again = place[k] + 1 + np.flatnonzero(grams[place[k] + 1 : b[k] + width] == grams[place[k]])
            again = again[: np.searchsorted(again, b[k]) + 1]
            begin = np.concatenate(([place[k] + 1], again[:-1] + 1))
            found.append((grams[again], again, begin, np.minimum(again, b[k]), np.full(len(again), who[k])))
        self.gram, self.place, self.first, self.last, self.text = (np.concatenate(x) for x in zip(*found))


def portions(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts with TEXT_BYTES or one text each."""
    ends = np.cumsum(np.array([len(x) for x in texts], np.int64)) if len(texts) else np.zeros(0, np.int64)
    out, at, done = [], 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + TEXT_BYTES, side="right")))
        out.append((at, to))
        at, done = to, int(ends[to - 1])
    return out


def anchor_rows(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    parts = [anchor_part(texts[a:b], h1[a:b], h2[a:b]) for a, b in portions(texts.to_pylist())]
    return pa.concat_arrays(parts) if parts else anchor_part(texts, h1, h2)


def anchor_part(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = Anchors([x or b"" for x in texts.to_pylist()])
    key = h1.to_numpy(zero_copy_only=False).view(np.uint64) + mix(h2.to_numpy(zero_copy_only=False).view(np.uint64))
    order = np.argsort(found.text, kind="stable")
    text = found.text[order]
    ids = mix(key[text] + mix((found.place[order] - found.begins[text]).astype(np.uint64)))
    offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(found.gram[order].view(np.int64)), pa.array(ids.view(np.int64))], names=["gram", "place"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def filter_spots(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (grams % np.uint64(bits)).astype(np.int64), (mix(grams + np.uint64(1)) % np.uint64(bits)).astype(np.int64)


def filter_part(width: int):
    def run(rows: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        bits[rows["spot"].to_numpy() % width] = 1
        return pa.table({"shard": rows["shard"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def repeated_filter(grams: DataFrame, count: int) -> np.ndarray:
    bits = FILTER_SHARDS * 1024
    while bits < min(FILTER_BITS, 16 * count):
        bits *= 2
    width = bits // FILTER_SHARDS

    def spots(batches):
        for batch in batches:
            both = np.concatenate(filter_spots(batch["gram"].to_numpy().view(np.uint64), bits))
            yield pa.record_batch({"shard": pa.array(both // width), "spot": pa.array(both)})

    out = np.zeros(bits // 8, np.uint8)
    for r in grams.select("gram").mapInArrow(spots, "shard long, spot long").groupBy("shard").applyInArrow(filter_part(width), "shard long, bits binary").collect():  # FILTER_BITS / 8 bytes at most
        out[r["shard"] * width // 8 : (r["shard"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_filter(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    one, two = filter_spots(grams, len(bits) * 8)
    return ((bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)


def stretches_of(held, crowded: bool):
    """Texts to stretches: gram, bytes, number of strings and the places (h1, h2, start) of each anchor that may repeat.

    Those of crowds only, or of all other anchors only. Equal stretches of a portion of texts are one row with all their places.
    """

    def run(batches):
        bits, crowds = held.value
        for batch in batches:
            whole = batch["body"].to_pylist()
            for at, to in portions(whole):
                found = Anchors(whole[at:to])
                if not len(found.gram):
                    continue
                inside = np.isin(found.gram, crowds)
                take = np.flatnonzero(inside if crowded else in_filter(found.gram, bits) & ~inside)
                rows: dict[bytes, int] = {}
                row = np.array([rows.setdefault(found.bytes[a : b + LENGTH], len(rows)) for a, b in zip(found.first[take].tolist(), found.last[take].tolist())], np.int64)
                order = np.argsort(row, kind="stable")
                take, row = take[order], row[order]
                text = found.text[take]
                firsts = np.flatnonzero(np.diff(row, prepend=-1))
                h1, h2 = (batch[c][at:to].to_numpy(zero_copy_only=False)[text] for c in ("h1", "h2"))
                places = pa.StructArray.from_arrays([pa.array(h1), pa.array(h2), pa.array(found.first[take] - found.begins[text])], names=["h1", "h2", "start"])
                sizes = found.last[take] - found.first[take] + 1
                yield pa.record_batch(
                    {
                        "gram": pa.array(found.gram[take][firsts].view(np.int64)),
                        "stretch": pa.array(list(rows), pa.binary()),
                        "n": pa.array(sizes[firsts]),
                        "places": pa.ListArray.from_arrays(pa.array(np.append(firsts, len(row)).astype(np.int32)), places),
                    }
                )

    return run


def two_stage_sort(data: np.ndarray, raw: str, wanted: np.ndarray) -> np.ndarray:
    """The suffixes that ``wanted`` marks, in order of their first LENGTH bytes.

    ``data`` ends in bytes that no suffix of interest reaches; ``raw`` is the same as Latin-1 text. With every wanted suffix that is not
    smaller than its successor, that successor must be wanted.
    """
    n = len(data)
    # smaller than its successor: by the first byte, or as the successor is where the bytes are equal
    nearest = np.where(data[:-1] != data[1:], np.arange(n - 1), n - 2)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = data[nearest] < data[nearest + 1]
    direct = np.flatnonzero(wanted & smaller)
    keys = [raw[i : i + LENGTH] for i in direct.tolist()]
    ordered = direct[sorted(range(len(keys)), key=keys.__getitem__)] if len(direct) else direct
    induced = wanted & ~smaller
    edges = np.searchsorted(data[ordered], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def send(block: np.ndarray, byte: int) -> np.ndarray:
        """Predecessors of a sorted block go to the end of their own buckets, in order; those in this bucket are returned."""
        before = block[block > 0] - 1
        before = before[induced[before]]
        first = data[before]
        for b in np.unique(first):
            if b != byte:
                waiting[b].append(before[first == b])
        return before[first == byte]

    for byte in range(256):
        block = np.concatenate(waiting[byte]) if waiting[byte] else None
        while block is not None and len(block):
            out.append(block)
            block = send(block, byte)
        block = ordered[edges[byte] : edges[byte + 1]]
        if len(block):
            out.append(block)
            send(block, byte)  # a predecessor with the same first byte is smaller too, and so is sorted already
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(raw: bytes, order: np.ndarray) -> np.ndarray:
    """Whether each suffix in order has its first LENGTH bytes in common with the next one."""
    words = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    same = np.zeros(max(0, len(order) - 1), bool)
    for at in range(0, len(same), 1 << 16):
        live = np.arange(at, min(at + (1 << 16), len(same)))
        for k in range(0, LENGTH, 8):
            live = live[words[order[live] + k] == words[order[live + 1] + k]]
            if not len(live):
                break
        same[live] = True
    return same


class SortedStrings:
    """The strings of LENGTH bytes in stretches, in order; a stretch of ``n`` strings has n + LENGTH - 1 bytes.

    ``owner`` and ``start`` say where the strings lie, stretch by stretch, and ``group`` which of them are equal: groups are numbered in
    order of their bytes. ``raw`` holds all stretches, ``at`` where each group's first string begins in it.
    """

    def __init__(self, stretches: list[bytes], counts: np.ndarray):
        self.raw = b"".join([*stretches, b"\xff" * (LENGTH + 8)])  # a byte that no text has, larger than all
        data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(x) for x in stretches], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(stretches)), counts)
        self.start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = begins[self.owner] + self.start
        owned = np.zeros(len(data), bool)
        owned[place] = True
        wanted = owned.copy()
        tail = begins + counts - 1  # a chain of suffixes not smaller than their successors is followed to its end
        while len(tail):
            byte, after = data[tail], data[tail + 1]
            tail = tail[byte >= after] + 1
            tail = tail[~wanted[tail]]
            wanted[tail] = True
        order = two_stage_sort(data, self.raw.decode("latin-1"), wanted)
        order = order[owned[order]]
        first = np.concatenate(([True], ~common_prefixes(self.raw, order))) if len(order) else np.zeros(0, bool)
        self.at = order[first]
        groups = np.zeros(len(data), np.int64)
        groups[order] = np.cumsum(first) - 1
        self.group = groups[place]

    def twice(self) -> np.ndarray:
        """Whether each string occurs twice or more here."""
        return np.bincount(self.group, minlength=1)[self.group] > 1


def runs(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted strings to covered runs of bytes: owner, from and to."""
    if not len(owner):
        return owner, start, start
    edge = np.flatnonzero((np.diff(owner) != 0) | (np.diff(start) > LENGTH)) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge - 1, [len(owner) - 1]))
    return owner[first], start[first], start[last] + LENGTH


def repeated_runs(batches):
    """Stretches sorted by anchor to the covered runs of each text, one suffix array for some MB of them."""

    def solve(gram: np.ndarray, stretch: list, n: np.ndarray, places: list):
        # rows of the same stretch are one; copies of a text name the same place
        one: dict[tuple, int] = {}
        firsts, held = [], []
        for i, key in enumerate(zip(gram.tolist(), stretch)):
            k = one.setdefault(key, len(firsts))
            if k == len(firsts):
                firsts.append(i)
                held.append(set())
            held[k].update((p["h1"], p["h2"], p["start"]) for p in places[i])
        rows = np.array(firsts)
        many = np.array([len(x) > 1 for x in held])
        same = gram[rows][1:] == gram[rows][:-1]
        shared = np.zeros(len(rows), bool)
        shared[1:] |= same
        shared[:-1] |= same
        owner, begin, end = np.flatnonzero(many), np.zeros(many.sum(), np.int64), n[rows[many]] + LENGTH - 1
        array = np.flatnonzero(shared)
        if len(array):
            strings = SortedStrings([stretch[i] for i in rows[array].tolist()], n[rows[array]])
            hit = strings.twice()
            who, a, b = runs(strings.owner[hit], strings.start[hit])
            less = ~many[array[who]]
            owner, begin, end = np.concatenate([owner, array[who[less]]]), np.concatenate([begin, a[less]]), np.concatenate([end, b[less]])
        out = [(h1, h2, start + a, start + b) for k, a, b in zip(owner.tolist(), begin.tolist(), end.tolist()) for h1, h2, start in held[k]]
        if out:
            yield pa.record_batch(dict(zip(("h1", "h2", "from", "to"), (pa.array(c, pa.int64()) for c in zip(*out)))))

    gram, stretch, n, places, size = np.zeros(0, np.int64), [], np.zeros(0, np.int64), [], 0
    for batch in batches:
        gram = np.concatenate([gram, batch["gram"].to_numpy(zero_copy_only=False)])
        n = np.concatenate([n, batch["n"].to_numpy(zero_copy_only=False)])
        stretch += batch["stretch"].to_pylist()
        places += batch["places"].to_pylist()
        size += batch["stretch"].nbytes
        before = np.flatnonzero(gram != gram[-1]) if size >= ARRAY_BYTES else ()
        if len(before):
            k = int(before[-1]) + 1
            yield from solve(gram[:k], stretch[:k], n[:k], places[:k])
            gram, stretch, n, places = gram[k:], stretch[k:], n[k:], places[k:]
            size = sum(map(len, stretch))
    if len(gram):
        yield from solve(gram, stretch, n, places)


def in_hash_order(chunk: pa.Table) -> pa.Table:
    return chunk.sort_by([("s1", "ascending"), ("s2", "ascending")])


def chunk_strings(chunk: pa.Table) -> pa.Table:
    """Of a chunk of a crowd's distinct stretches: a 128-bit hash of each distinct string, by its number in order."""
    chunk = in_hash_order(chunk)
    strings = SortedStrings(chunk["stretch"].to_pylist(), chunk["n"].to_numpy())
    data = np.frombuffer(strings.raw, np.uint8)
    w1, w2 = (mix(rolled(data, LENGTH, base)[strings.at]) for base in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03))
    many = len(strings.at)
    return pa.table({"gram": pa.array(np.full(many, chunk["gram"][0].as_py())), "part": pa.array(np.full(many, chunk["part"][0].as_py())), "k": pa.array(np.arange(many)), "w1": pa.array(w1.view(np.int64)), "w2": pa.array(w2.view(np.int64))})


def chunk_runs(chunk: pa.Table, elsewhere: pa.Table) -> pa.Table:
    """The covered runs of a chunk's stretches, from its own strings and the numbers of those that other chunks hold too."""
    chunk = in_hash_order(chunk)
    out = {"s1": pa.array([], pa.int64()), "s2": pa.array([], pa.int64()), "from": pa.array([], pa.int64()), "to": pa.array([], pa.int64())}
    if chunk.num_rows:
        strings = SortedStrings(chunk["stretch"].to_pylist(), chunk["n"].to_numpy())
        other = np.zeros(len(strings.at), bool)
        other[elsewhere["k"].to_numpy()] = True
        hit = strings.twice() | other[strings.group]
        who, a, b = runs(strings.owner[hit], strings.start[hit])
        out = {"s1": chunk["s1"].take(pa.array(who)), "s2": chunk["s2"].take(pa.array(who)), "from": pa.array(a), "to": pa.array(b)}
    return pa.table(out)


def crowd_runs(stretches: DataFrame, chunk: int) -> DataFrame:
    """Stretches of crowds to the covered runs of each text."""
    place = F.transform("places", lambda p: F.xxhash64(p["h1"], p["h2"], p["start"]))
    rows = stored(stretches.withColumns({"s1": F.xxhash64(F.lit(3), "stretch"), "s2": F.xxhash64(F.lit(4), "stretch"), "one": F.array_min(place), "other": F.array_max(place)}))
    distinct = rows.groupBy("gram", "s1", "s2").agg(F.first("stretch").alias("stretch"), F.first("n").alias("n"), F.count("*").alias("rows"), F.min("one").alias("one"), F.max("other").alias("other"))
    distinct = stored(distinct.withColumn("many", F.col("one") != F.col("other")).drop("one", "other"))
    parts = distinct.groupBy("gram").agg(F.ceil(F.count("*") / chunk).cast("long").alias("parts"))
    dealt = stored(distinct.join(parts, "gram").withColumn("part", F.pmod("s1", "parts")).select("gram", "part", "parts", "s1", "s2", "stretch", "n"))
    strings = stored(dealt.where("parts > 1").groupBy("gram", "part").applyInArrow(chunk_strings, "gram long, part long, k long, w1 long, w2 long"))
    shared = strings.groupBy("w1", "w2").agg(F.count("*").alias("chunks")).where("chunks > 1").select("w1", "w2")
    elsewhere = strings.join(shared, ["w1", "w2"], "left_semi").select("gram", "part", "k")  # a string is in a chunk once
    found = dealt.groupBy("gram", "part").cogroup(elsewhere.groupBy("gram", "part")).applyInArrow(chunk_runs, "s1 long, s2 long, from long, to long")
    end = (F.col("n") + LENGTH - 1).alias("to")
    total = distinct.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = (F.col("rows") > max(HOT, total // HOT_PARTS)) & F.col("many")
    whole = distinct.where(F.col("many") & ~hot).select("s1", "s2", F.lit(0).cast("long").alias("from"), end)
    some = found.join(distinct.where("many").select("s1", "s2"), ["s1", "s2"], "left_anti")
    hottest = F.broadcast(distinct.where(hot).select("s1", "s2"))  # fewer than HOT_PARTS
    place = [F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"), (F.col("p.start") + F.col("from")).alias("from"), (F.col("p.start") + F.col("to")).alias("to")]
    direct = rows.join(hottest, ["s1", "s2"], "left_semi").select(F.explode("places").alias("p"), F.lit(0).cast("long").alias("from"), end)
    met = rows.join(hottest, ["s1", "s2"], "left_anti").select("s1", "s2", "places").join(whole.unionByName(some), ["s1", "s2"]).select(F.explode("places").alias("p"), "from", "to")
    return direct.unionByName(met).select(*place)


def remove_runs(texts: pa.Array, copies: pa.Array, covered: pa.Array) -> pa.Array:
    out = []
    for text, n, pieces in zip(texts.to_pylist(), copies.to_pylist(), covered.to_pylist()):
        data = text or b""
        merged: list[list[int]] = []
        if n and n > 1 and len(data) >= LENGTH:
            merged = [[0, len(data)]]
        else:
            for piece in sorted((p["from"], p["to"]) for p in pieces or ()):
                if merged and piece[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], piece[1])
                else:
                    merged.append(list(piece))
        kept, at = [], 0
        for a, b in merged:
            kept.append(data[at:a])
            at = b
        rest = b"".join([*kept, data[at:]])
        out.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if merged else None))
    columns = list(zip(*out)) if out else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def dedup_strings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "strings", crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with repeated strings removed from the text, and a struct ``n_bytes, n_removed, n_spans, kept_sha256``."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(body.alias("body"), F.col(doc_id).alias("row"))
    texts = texts.select("body", "row", F.xxhash64(F.lit(1), "body").alias("h1"), F.xxhash64(F.lit(2), "body").alias("h2"))
    copies = cut(texts.groupBy("h1", "h2").agg(F.count("*").alias("copies_"), F.min("row").alias("row_")).where("copies_ > 1"))
    all_rows = docs.count()
    often = copies.where(F.col("copies_") > max(COPIES, all_rows // COPY_PARTS)).select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), "row_")  # fewer than COPY_PARTS
    met = texts.join(F.broadcast(often), (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left")
    keyed = met.where("a1 is null or row <=> row_").select("body", "h1", "h2")
    anchors = keyed.select(F.inline(F.arrow_udf(anchor_rows, "array<struct<gram: long, place: long>>")("body", "h1", "h2")))
    grams = anchors.groupBy("gram").agg(F.min("place").alias("one"), F.max("place").alias("other"), F.count("*").alias("n")).where("one <> other")
    repeated = stored(grams.select("gram", "n"))
    count, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(crowd, total // CROWD_PARTS)
    crowds = np.sort(np.array([r["gram"] for r in repeated.where(F.col("n") > limit).select("gram").collect()], np.int64).view(np.uint64))  # fewer than CROWD_PARTS
    held = spark.sparkContext.broadcast((repeated_filter(repeated, count), crowds))
    kinds = "gram long, stretch binary, n long, places array<struct<h1: long, h2: long, start: long>>"
    covered = keyed.mapInArrow(stretches_of(held, False), kinds).repartition("gram").sortWithinPartitions("gram").mapInArrow(repeated_runs, "h1 long, h2 long, from long, to long")
    if len(crowds):
        covered = covered.unionByName(crowd_runs(keyed.mapInArrow(stretches_of(held, True), kinds), chunk))
    pieces = covered.groupBy("h1", "h2").agg(F.collect_list(F.struct("from", "to")).alias("covered_"))
    found = cut(pieces.join(copies.drop("row_"), ["h1", "h2"], "full").select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "copies_", "covered_"))
    marked = docs.withColumn("body_", body)
    marked = marked.withColumns({"own_h1_": F.xxhash64(F.lit(1), "body_"), "own_h2_": F.xxhash64(F.lit(2), "body_")})
    out = marked.join(found, (F.col("own_h1_") == F.col("h1_")) & (F.col("own_h2_") == F.col("h2_")), "left")
    name = free_name(docs, into)
    out = out.withColumn(name, F.arrow_udf(remove_runs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")("body_", "copies_", "covered_"))
    kept = F.coalesce(F.col(f"{name}.text"), F.col(text).cast("string"), F.lit(""))
    return out.withColumns({text: kept, name: F.struct(*[F.col(f"{name}.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])}).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "strings.*")
