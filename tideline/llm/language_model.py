"""Language-model scoring with a log-frequency Bloom filter of quantised bigram counts.

1. One pass over the texts cuts them into blocks of BLOCK_TOKENS. A block knows its distinct words and its distinct pairs of neighbouring
   words by hashes, with how often its training texts have them, and for each text the numbers of its words.
2. Training counts of a block go to shards in ranges of the hash, as many as the bytes of the texts ask for. A shard adds them up over all blocks, turns the
   counts of pairs into levels (the logarithm of the count) and enters (pair, 1), ..., (pair, level) into its filter. Filters and counts of words are written once;
   exact counts of pairs end here.
3. A filter has ROOM bits for each entry, so filters follow the counted pairs and err equally often at any size.
4. Texts are scored by membership probes alone: a pair's level is the number of probes that succeed in a row. Filters that together fit BROADCAST_BYTES go to every
   worker; larger ones stay in place, and blocks send their distinct hashes past them, each once, however often the texts have it, so no hash is crowded. Both ways give the same.
5. p(w | h) = (count(h, w) + PRIOR * p(w)) / (count(h) + PRIOR), with p(w) the add-one unigram probability. All words and all pairs take part.

A block has a row for each shard that it asks, so rows grow with blocks times shards until a row holds one pair, and never beyond the distinct pairs of the blocks.

Defined cases: a null or empty text is the end token alone; rows with equal ids or texts are scored on their own; a null id
counts as the text '' for the folds; without training rows all counts are 0; all columns but the text stay; an empty table gives an empty table.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import documents, fields, free_name, held_out, small_batches, stored

LOG = logging.getLogger(__name__)
FOLDS, HELD_FOLD = 7, 2
#: Words whose hash a task keeps at hand; others are hashed again.
HOT = 1 << 18
PAIR_MIN, PRIOR = 1, 500.0
#: Bits for each entry of a filter, and probes: a false level in 150 probed.
ROOM, PROBES = 12, 4
#: A block ends after so many tokens, texts, or bytes of other columns; bytes of text for each shard.
BLOCK_TOKENS, BLOCK_TEXTS, BLOCK_BYTES, SHARD_BYTES = 1_500_000, 200_000, 32_000_000, 16_000_000
LEAST_SHARDS = 32
#: Filters and counts of words of all shards that are sent to every worker, at most; they are measured first.
BROADCAST_BYTES = 4_000_000
WORD_SEED = 42
#: A pair's hash has so many bits more than the tokens need to be told apart, so that of pairs one in 256 at most shares its hash.
SPACIOUS = 8
#: What a shard says of itself: tokens and distinct words of training, distinct training pairs, those with a wrong level, bits.
TOTALS = ("n_tokens", "n_words", "n_pairs", "n_wrong", "bits")
END, BEGIN = b"", b" "


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


class Hashes(dict):
    """Hash of a word, kept by word."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word, WORD_SEED)
        return out


def pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed planes of bytes; ascending ones are best given as differences."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return len(values).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    z = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def spots(keys: np.ndarray, level: int, probe: int, room: int) -> np.ndarray:
    return (mixed(keys, 1 + level * PROBES + probe) % np.uint64(room)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / PAIR_MIN)).astype(np.int64) + 1) * (counts >= PAIR_MIN)


def level_value(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    return np.where(level > 0, (1.5 * PAIR_MIN * np.exp2(level - 1.0)) - 0.5, 0.0)


def room_for(counts: np.ndarray) -> int:
    """Bits of a filter, in whole bytes: in proportion to its entries."""
    return max(512, -(-ROOM * int(levels_of(counts).sum()) // 8) * 8)


def build_filter(keys: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    bits, level = np.zeros(room, np.uint8), levels_of(counts)
    for k in range(1, int(level.max(initial=0)) + 1):
        members = keys[level >= k]
        for probe in range(PROBES):
            bits[spots(members, k, probe, room)] = 1
    return np.packbits(bits, bitorder="little")


def probe_levels(keys: np.ndarray, bits: np.ndarray, room: int) -> np.ndarray:
    """The level of each pair: how many probes in a row find it."""
    level, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for k in range(1, 64):
        for probe in range(PROBES):
            at = spots(keys[live], k, probe, room)
            live = live[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(live):
                return level
        level[live] = k
    return level


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: ranges of equal width, so ascending for ascending hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def spare_bits(tokens: int) -> int:
    """Low bits of a pair's hash that are left out; 32 bits stay at least, since they name the shard."""
    return 64 - min(64, max(32, int(tokens).bit_length() + SPACIOUS))


def pairs_of(words: np.ndarray, word: np.ndarray, sizes: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of texts, given by the numbers of their words: hashes in order, and of each token the word before it and its pair.

    Before a text stands a word of its own, which is as frequent as the end.
    """
    begin, end = (np.uint64(xxhash.xxh64_intdigest(x, WORD_SEED)) for x in (BEGIN, END))
    starts = np.cumsum(sizes) - sizes
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[starts] = np.searchsorted(words, end)
    hashes = words[before]
    hashes[starts] = begin
    whole = mixed(mixed(hashes, 1) + words[word], 2) >> np.uint64(spare) << np.uint64(spare)
    keys, pair = np.unique(whole, return_inverse=True)
    return keys, before, pair


def cut_blocks(text: str, train: str, kept: list[str], schema: T.StructType, shards: int, hot: int, spare: int):
    """Of each block a row for each shard that it asks (never more rows than it has pairs and words), and one row of its own (shard -1) with its texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    asks, owns = ("keys", "seen", "words", "word_seen"), ("word", "sizes")

    def rows(block: str, parts: list[np.ndarray], sizes: np.ndarray, learned: np.ndarray, rest: pa.Table):
        words, word = np.unique(np.concatenate(parts), return_inverse=True)
        keys, _, pair = pairs_of(words, word, sizes, spare)
        training = np.repeat(learned, sizes)
        seen, word_seen = np.bincount(pair[training], minlength=len(keys)), np.bincount(word[training], minlength=len(words))
        which, named_in = shard_of(keys, shards), shard_of(words, shards)
        asked = np.union1d(which, named_in)
        ranges = [np.searchsorted(x, asked, side=side) for x in (which, named_in) for side in ("left", "right")]
        out = {n: [] for n in asks}
        for a, b, c, d in zip(*ranges):
            for n, x in zip(asks, (pack(np.diff(keys[a:b], prepend=np.uint64(0)), "<u8"), pack(seen[a:b], "<u4"), pack(np.diff(words[c:d], prepend=np.uint64(0)), "<u8"), pack(word_seen[c:d], "<u4"))):
                out[n].append(x)
        many = len(asked)
        out = {n: [*x, None] for n, x in out.items()} | {n: [None] * many + [pack(x, "<u4")] for n, x in zip(owns, (word, sizes))}
        columns = [pa.array([block] * (many + 1)), pa.array([*asked.tolist(), -1], pa.int64()), *[pa.array(out[n], pa.binary()) for n in (*asks, *owns)]]
        target = to_arrow_schema(schema).field("rest").type
        held = rest.combine_chunks()
        structs = pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in held.columns], names=kept)
        lists = pa.ListArray.from_arrays(pa.array([0] * (many + 1) + [len(structs)], pa.int32()), structs)
        lists = lists.cast(target) if lists.type != target else lists
        yield pa.RecordBatch.from_arrays([*columns, lists], names=["block", "shard", *asks, *owns, "rest"])

    def run(batches):
        from pyspark import TaskContext

        context, hashes, n = TaskContext.get(), Hashes(), 0
        parts, sizes, learned, rest, size, texts, other = [], [], [], [], 0, 0, 0

        def flush():
            return rows(f"{context.partitionId()}-{n}", parts, np.array(sizes, np.int64), np.concatenate(learned), pa.Table.from_batches(rest))

        for batch in batches:
            whole, flags = batch[text].to_pylist(), batch[train].to_numpy(zero_copy_only=False).astype(bool)
            others, since = batch.select(kept), 0
            for i, x in enumerate(whole):
                found = tokens(x)
                parts.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
                sizes.append(len(found))
                size += len(found)
                if len(hashes) > hot:
                    hashes.clear()
                if size >= BLOCK_TOKENS or i + 1 == len(whole):
                    part = others.slice(since, i + 1 - since)
                    rest.append(part)
                    learned.append(flags[since : i + 1])
                    texts, other, since = texts + part.num_rows, other + part.nbytes, i + 1
                    if size >= BLOCK_TOKENS or texts >= BLOCK_TEXTS or other >= BLOCK_BYTES:
                        yield from flush()
                        parts, sizes, learned, rest, size, texts, other, n = [], [], [], [], 0, 0, 0, n + 1
        if sizes:
            yield from flush()

    return run


def added(rows: pa.Table, hashes: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all rows with a training count, ascending, and their sums."""
    keys, which = np.unique(np.concatenate([np.cumsum(unpack(x, "<u8")) for x in rows[hashes].to_pylist()]), return_inverse=True)
    total = np.bincount(which, np.concatenate([unpack(x, "<u4") for x in rows[counts].to_pylist()]), len(keys)).astype(np.int64)
    return keys[total > 0], total[total > 0]


def build_shard(rows: pa.Table) -> pa.Table:
    """Of one shard's training counts: the filter of its pairs, and its words with their counts."""
    keys, counts = added(rows, "keys", "seen")
    room = room_for(counts)
    bits = build_filter(keys, counts, room)
    wrong = int((probe_levels(keys, bits, room) != levels_of(counts)).sum())
    words, word_counts = added(rows, "words", "word_seen")
    packed = [pack(np.diff(words, prepend=np.uint64(0)), "<u8"), pack(word_counts, "<u8")]
    totals = [int(word_counts.sum()), len(words), len(keys), wrong, room]
    return pa.table([rows["shard"].slice(0, 1), pa.array([bits.tobytes()], pa.binary()), *[pa.array([x], pa.binary()) for x in packed], *[pa.array([x], pa.int64()) for x in totals]], names=["of", "filter", "known", "known_counts", *TOTALS])


class Shard:
    """A shard's filter and counts of words, ready for probes."""

    def __init__(self, row: dict):
        self.bits, self.room = np.frombuffer(row["filter"], np.uint8), row["bits"]
        self.words, self.counts = np.cumsum(unpack(row["known"], "<u8")), unpack(row["known_counts"], "<u8").astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return probe_levels(keys, self.bits, self.room)

    def count(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def probe_shard(rows: pa.Table, told: pa.Table) -> pa.Table:
    """What a shard says to each block that asks; nothing is known of a shard without training counts."""
    shard = Shard(told.to_pylist()[0]) if told.num_rows else None
    answers = {"levels": [], "counts": []}
    for keys, words in zip(rows["keys"].to_pylist(), rows["words"].to_pylist()):
        keys, words = np.cumsum(unpack(keys, "<u8")), np.cumsum(unpack(words, "<u8"))
        answers["levels"].append(pack(shard.levels(keys) if shard else np.zeros(len(keys)), "u1"))
        answers["counts"].append(pack(shard.count(words) if shard else np.zeros(len(words)), "<i8"))
    return pa.table([rows["block"], rows["shard"], *[pa.array(answers[n], pa.binary()) for n in answers]], names=["block", "shard", *answers]).append_column("words", rows["words"])


def scored(block: pa.Table, words: np.ndarray, kept: list[str], total: int, distinct: int, spare: int, ask) -> pa.Table:
    """The texts of one block with their scores; ``ask`` gives levels of ascending pair hashes and counts of ascending word hashes."""
    own = block.combine_chunks().to_batches()[0]
    word, sizes = (unpack(own[n][0].as_py(), "<u4").astype(np.int64) for n in ("word", "sizes"))
    keys, before, pair = pairs_of(words, word, sizes, spare)
    levels, counts = ask(keys, words)
    context, share = counts[before].astype(np.float64), ((counts + 1) / (total + distinct + 1))[word]
    chance = (np.minimum(level_value(levels.astype(np.float64))[pair], context) + PRIOR * share) / (context + PRIOR)
    starts = np.cumsum(sizes) - sizes
    known, base, score = (np.add.reduceat(x, starts) for x in ((counts > 0)[word].astype(np.int64), np.log10(share), np.log10(chance)))
    result = pa.StructArray.from_arrays([pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total, np.int64)), pa.array(base), pa.array(score)], names=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    rest = own["rest"][0].values
    return pa.table([*[x for n, x in zip(rest.type, rest.flatten()) if n.name in kept], result], names=[*kept, "scored_"])


def words_of(rows: pa.Table) -> np.ndarray:
    """The words of a block, from what it asks its shards in their order."""
    return np.concatenate([np.cumsum(unpack(x, "<u8")) for x in rows["words"].to_pylist()])


def score_block(*known):
    """Scores a block by the answers that its shards sent."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")
        told = [np.concatenate([unpack(x, kind) for x in answers[n].to_pylist()]) for n, kind in (("levels", "u1"), ("counts", "<i8"))]
        return scored(block, words_of(answers), *known, lambda keys, words: told)

    return run


def score_at_hand(held, shards: int, *known):
    """Scores a block with all filters at hand."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        def ask(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            levels, counts = np.zeros(len(keys), np.int64), np.zeros(len(words), np.int64)
            for out, hashes, method in ((levels, keys, Shard.levels), (counts, words, Shard.count)):
                which = shard_of(hashes, shards)
                for k in np.unique(which):
                    a, b = np.searchsorted(which, [k, k + 1])
                    if k in held.value:
                        out[a:b] = method(Shard(held.value[k]), hashes[a:b])
            return levels, counts

        return scored(block, words_of(asked.sort_by("shard")), *known, ask)

    return run


def score_language(docs: DataFrame, train, text: str = "text", into: str = "lm", hot: int = HOT) -> DataFrame:
    """``docs`` without its text, with a struct of ``n_tokens, n_known, train_tokens, base_score, score``; learns from the rows where ``train`` holds."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("binary")) + 1), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    kept, flag = [c for c in docs.columns if c != text], free_name(docs, "train_")
    ready = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("binary").alias(text), F.coalesce(train, F.lit(False)).alias(flag))
    # the flag stays with the other columns, so that there is always one
    others, spare = T.StructType([T.StructField(f.name, f.dataType) for f in ready.schema if f.name != text]), spare_bits(size)
    kinds = [("block", T.StringType()), ("shard", T.LongType()), *[(n, T.BinaryType()) for n in ("keys", "seen", "words", "word_seen", "word", "sizes")], ("rest", T.ArrayType(others))]
    blocks = stored(ready.mapInArrow(cut_blocks(text, flag, others.names, fields(*kinds), shards, hot, spare), fields(*kinds)))  # written once, so that a block keeps its texts
    # as many partitions as data, so that a task sees a few shards or blocks, one after another
    asked = blocks.where("shard >= 0")
    filters = stored(asked.select("shard", "keys", "seen", "words", "word_seen").repartition(shards, "shard").groupBy("shard").applyInArrow(build_shard, "of long, filter binary, known binary, known_counts binary, " + ", ".join(f"{n} long" for n in TOTALS)))
    weight = F.octet_length("filter") + F.octet_length("known") + F.octet_length("known_counts")
    held, total, distinct, pairs, wrong, bits = filters.agg(F.coalesce(F.sum(weight), F.lit(0)), *[F.coalesce(F.sum(n), F.lit(0)) for n in TOTALS]).first()
    LOG.info("%d bits of filters; %d of %d training pairs have a wrong level", bits, wrong, pairs)
    own = blocks.where("shard < 0").select("block", "word", "sizes", "rest")
    result = T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")])
    schema, known = T.StructType([*[f for f in others if f.name != flag], T.StructField("scored_", result)]), (kept, total, distinct, spare)
    if held <= BROADCAST_BYTES:
        told = docs.sparkSession.sparkContext.broadcast({r["of"]: r.asDict() for r in filters.collect()})  # ``held`` bytes
        answers, score = asked.select("block", "shard", "words"), score_at_hand(told, shards, *known)
    else:
        probes = asked.select("block", "shard", "keys", "words").repartition(shards, "shard").groupBy("shard")
        answers = probes.cogroup(filters.select("of", "filter", "known", "known_counts", "bits").repartition(shards, "of").groupBy("of")).applyInArrow(probe_shard, "block string, shard long, levels binary, counts binary, words binary")
        score = score_block(*known)
    meet = answers.withColumnRenamed("block", "to").repartition(shards, "to").groupBy("to")
    out = own.repartition(shards, "block").groupBy("block").cogroup(meet).applyInArrow(score, schema)
    return out.withColumnRenamed("scored_", free_name(docs, into))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), FOLDS, HELD_FOLD)
    scored = score_language(documents(spark, sf_dir, "doc_id", "text"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "lm.*")
