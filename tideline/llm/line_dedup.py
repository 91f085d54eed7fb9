"""Line deduplication through a sharded minimal perfect hash.

1. Every text gives the hashes of its distinct line keys; a partial aggregation counts documents and the largest id for
   each key before the shuffle, so a line that every document holds costs one row per task.
2. Keys that documents share (two or more) are dealt over shards by their hash. Each shard becomes a minimal perfect hash with
   arrays of fingerprints, counts and keepers; a count decides at the probe, so one index serves every ``min_docs`` from 2 on.
3. Documents probe the arrays. While the arrays are within ``broadcast_bytes`` (their size is known by then) they go to
   every worker and texts are not shuffled. Beyond that, shards stay where they are: probes go to the shards, over
   several salted copies of each, stream past the arrays in batches, and only found lines return to their documents.

A key of a single document is never dropped and so has no slot; a probe for one fails its 64-bit fingerprint.

Defined cases: a null or empty text is one empty line; rows with the same id are one document and keep or lose a line alike, and so
are rows without an id, which are below all others; all columns of the input stay, with the text replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import BLANKS, cut, documents, free_name, small_batches
from tideline.llm.minimal_hash import MinimalHash

MIN_CHARS, MIN_DOCS = 40, 5
#: Documents that share a key before it has a slot.
SHARED = 2
#: Keys of one shard, about; a shard's arrays then take some 10 MB.
SHARD_KEYS = 400_000
#: Arrays up to this many bytes go to every worker.
BROADCAST_BYTES = 64 << 20
#: Copies of a shard that share the probes for it, when shards are not broadcast.
SALTS = 16
LOWEST = -(1 << 63)


def line_hashes(text: bytes | None, min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of a text, and for those with a long enough key: their numbers and the halves of the key's hash."""
    lines = (text or b"").split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key))
    halves = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return lines, np.array(at, np.int64), halves[:, 0], halves[:, 1]


def _lists(sizes: list[int], values: list[pa.Array], names: list[str]) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names=names))


def keys_of(min_chars: int):
    """An Arrow function: texts to the distinct key hashes of each."""

    def keys(texts: pa.Array) -> pa.Array:
        found = []
        for x in texts.to_pylist():
            _, _, high, low = line_hashes(x, min_chars)
            pairs = np.stack([high, low], 1)
            found.append(np.unique(pairs, axis=0) if len(pairs) > 1 else pairs)
        flat = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        return _lists([len(x) for x in found], [pa.array(flat[:, k].view(np.int64)) for k in (0, 1)], ["high", "low"])

    return F.arrow_udf(keys, "array<struct<high: long, low: long>>")


def build_shard(rows: pa.Table) -> pa.Table:
    high, low = (rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("high", "low"))
    index = MinimalHash(high, low)
    slots = index.slots(high, low)
    prints, counts, keepers = np.empty(len(slots), np.uint64), np.empty(len(slots), np.uint32), np.empty(len(slots), np.int64)
    prints[slots], keepers[slots] = low, rows["keeper"].to_numpy()
    counts[slots] = np.minimum(rows["n_docs"].to_numpy(), 0xFFFFFFFF)
    return pa.table({"shard": rows["shard"][:1].cast(pa.int64()), "arrays": pa.array([pickle.dumps((index, prints, counts, keepers))], pa.binary())})


def probe(shard: tuple, high: np.ndarray, low: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are frequent lines, and the keeper of each."""
    index, prints, counts, keepers = shard
    slots = index.slots(high, low)
    safe = np.maximum(slots, 0)
    found = (slots >= 0) & (prints[safe] == low) & (counts[safe] >= min_docs)
    return found, keepers[safe]


def shared_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int, least: int) -> DataFrame:
    """Keys of ``least`` documents or more, with their number and the largest id."""
    small_batches(docs.sparkSession)
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("id")
    keys = docs.select(own, keys_of(min_chars)(F.col(text).cast("binary")).alias("keys")).select("id", F.inline("keys"))
    again = cut(docs.select(own).groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    if not again.isEmpty():  # rows of one id are one document
        keys = keys.join(again, "id", "left_anti").unionByName(keys.join(again, "id", "left_semi").distinct())
    return keys.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= least)


def _droppers(shards, n_shards: int, min_chars: int, min_docs: int):
    def drop(texts: pa.Array, ids: pa.Array) -> pa.Array:
        tables = shards.value
        parsed = [line_hashes(x, min_chars) for x in texts.to_pylist()]
        sizes = [len(p[1]) for p in parsed]
        high = np.concatenate([p[2] for p in parsed] or [np.zeros(0, np.uint64)])
        low = np.concatenate([p[3] for p in parsed] or [np.zeros(0, np.uint64)])
        own = np.repeat(np.array([LOWEST if v is None else v for v in ids.to_pylist()], np.int64), sizes)
        shard, lost = (high % np.uint64(n_shards)).astype(np.int64), np.zeros(len(high), bool)
        for k in np.unique(shard):
            if k in tables:
                rows = np.flatnonzero(shard == k)
                found, keeper = probe(tables[k], high[rows], low[rows], min_docs)
                lost[rows] = found & (keeper != own[rows])
        return _kept(parsed, np.split(lost, np.cumsum(sizes)[:-1]) if sizes else [])

    return F.arrow_udf(drop, "n_lines long, n_dropped long, text string")


def _kept(parsed: list[tuple], lost: list[np.ndarray]) -> pa.Array:
    """The text is null where no line goes."""
    texts, dropped = [], []
    for (lines, at, _, _), gone in zip(parsed, lost):
        out = set(at[gone].tolist())
        dropped.append(len(out))
        texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in out).decode("utf-8", "replace") if out else None)
    counts = [pa.array([len(p[0]) for p in parsed], pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
    return pa.StructArray.from_arrays(counts, names=["n_lines", "n_dropped", "text"])


def _found_by_shards(docs: DataFrame, arrays: DataFrame, text: str, doc_id: str, n_shards: int, min_chars: int, min_docs: int, salts: int) -> DataFrame:
    """``id`` and the list ``gone`` of key hashes that this id loses, from probes that were sent to the shards."""
    probes = (
        docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("id"), keys_of(min_chars)(F.col(text).cast("binary")).alias("keys"))
        .select("id", F.inline("keys"))
        .select(
            F.expr(f"cast(((high % {n_shards}) + (CASE WHEN high < 0 THEN {(1 << 64) % n_shards} ELSE 0 END) + {n_shards}) % {n_shards} as long)").alias("shard"),
            F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"),
            "id",
            "high",
            "low",
            F.lit(None).cast("binary").alias("arrays"),
        )
    )
    copies = arrays.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("low"), "arrays")

    def stream(batches):
        held, table = None, None
        for batch in batches:
            shard, salt = batch["shard"].to_numpy(zero_copy_only=False), batch["salt"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if held != (shard[a], salt[a]):
                    held, table = (shard[a], salt[a]), None
                if part["arrays"][0].is_valid:
                    table = pickle.loads(part["arrays"][0].as_py())
                    part = part.slice(1)
                if table is None or not part.num_rows:
                    continue
                high, low = (part[c].to_numpy().view(np.uint64) for c in ("high", "low"))
                found, keeper = probe(table, high, low, min_docs)
                lost = found & (keeper != part["id"].to_numpy())
                yield pa.record_batch({"id": part["id"].filter(pa.array(lost)), "high": part["high"].filter(pa.array(lost)), "low": part["low"].filter(pa.array(lost))})

    met = copies.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
    return met.mapInArrow(stream, "id long, high long, low long").groupBy("id").agg(F.collect_set(F.struct("high", "low")).alias("gone"))


def _remover(min_chars: int):
    def remove(texts: pa.Array, gone: pa.Array) -> pa.Array:
        parsed = [line_hashes(x, min_chars) for x in texts.to_pylist()]
        lost = []
        for (_, _, high, low), pairs in zip(parsed, gone.to_pylist()):
            out = {(p["high"], p["low"]) for p in pairs or ()}
            mine = zip(high.view(np.int64).tolist(), low.view(np.int64).tolist())
            lost.append(np.array([x in out for x in mine], bool))
        return _kept(parsed, lost)

    return F.arrow_udf(remove, "n_lines long, n_dropped long, text string")


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "lines", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, salts: int = SALTS
) -> DataFrame:
    """``docs`` with frequent lines removed from its text, and a struct column of the counts ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    shared = cut(shared_lines(docs, text, doc_id, min_chars, min(SHARED, min_docs)))
    n_keys = shared.count()
    n_shards = max(1, -(-n_keys // shard_keys))
    # the shard is the hash as an unsigned number, modulo the number of shards
    shard = F.expr(f"cast(((high % {n_shards}) + (CASE WHEN high < 0 THEN {(1 << 64) % n_shards} ELSE 0 END) + {n_shards}) % {n_shards} as long)")
    arrays = shared.withColumn("shard", shard).groupBy("shard").applyInArrow(build_shard, "shard long, arrays binary")
    result = free_name(docs, into)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    if n_keys * 24 <= broadcast_bytes:
        tables = spark.sparkContext.broadcast({r["shard"]: pickle.loads(r["arrays"]) for r in arrays.collect()})
        out = docs.withColumn(result, _droppers(tables, n_shards, min_chars, min_docs)(body, F.col(doc_id).cast("long")))
    else:
        arrays = cut(arrays)
        own, gone = free_name(docs, "own_id"), free_name(docs, "gone")
        found = _found_by_shards(docs, arrays, text, doc_id, n_shards, min_chars, min_docs, salts).withColumnsRenamed({"id": own, "gone": gone})
        out = docs.withColumn("own_key_", F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))).join(found, F.col("own_key_") == F.col(own), "left")
        out = out.withColumn(result, _remover(min_chars)(body, F.col(gone))).drop("own_key_", own, gone)
    kept = F.coalesce(F.col(f"{result}.text"), F.col(text).cast("string"), F.lit(""))
    return out.withColumns({text: kept, result: F.struct(F.col(f"{result}.n_lines").alias("n_lines"), F.col(f"{result}.n_dropped").alias("n_dropped"))}).select(*docs.columns, result)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE f.key IS NOT NULL AND f.keeper <> k.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL OR f.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON f.key = k.key
GROUP BY k.doc_id
"""
