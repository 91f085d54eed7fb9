"""Best-fit packing of token pieces into sequences by minimum bin slack.

Texts become tokens in the tasks; a text longer than a sequence is cut so that only its first piece can be short. The
lengths of all pieces are counted: whatever the size of the corpus, that is at most one count per length up to the
sequence length, so the whole packing problem is a table of 2,048 rows. On it, bin after bin, a bitset subset-sum over
the lengths still available finds the fullest combination with the longest piece; the combination is taken as often as
the counts allow. Pieces then find their place from their length and their number among the pieces of that length, which
is counted in hashed buckets, so that a length that many documents share doesn't meet in one task.

Defined cases: a null or empty text is the end token alone; rows with the same id are packed as documents of their own;
ties are dealt by id, piece and checksum; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import documents, small_batches, stored

SEQUENCE, END = 2048, 0
#: Words whose tokens a worker remembers at once.
REMEMBERED = 300_000
#: Pieces of one length that are numbered in one bucket, and the most buckets of a length.
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 16


class WordTokens(dict):
    """Bytes of the ids of a word with the space before it, kept by word."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise LookupError(word)  # the cut before this word's space isn't one of the tokenizer's
        out = self[word] = np.array(self.encode(" " + word), "<u4").tobytes()
        return out


class ByteTokenizer:
    """Ids of the byte-level vocabulary at ``json_path``, the same as the tokenizers library gives.

    A space before a visible character always begins a new part of the tokenizer's split, so most texts can be cut there
    and each word be looked up. Texts with other blanks behind a space are encoded whole.
    """

    def __init__(self, json_path: str):
        import json

        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(json_path)
        with open(json_path, encoding="utf-8") as file:
            stated = json.load(file)
        self.special = [x["content"] for x in stated.get("added_tokens", [])]
        points = _byte_points()
        ranks = {bytes(points[c] for c in token): rank for token, rank in stated["model"]["vocab"].items() if token not in self.special}
        self.ranks = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = WordTokens(self.ranks.encode_ordinary)

    def ids(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        if any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        first, *rest = text.split(" ")
        try:
            return np.array(self.ranks.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))
        except LookupError:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# The split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_points() -> dict[str, int]:
    """The visible character that stands for each byte in the vocabulary file: itself, or the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_made: dict[str, ByteTokenizer] = {}


def _tokenizer(path: str) -> ByteTokenizer:
    if path not in _made:
        _made[path] = ByteTokenizer(path)
    return _made[path]


def cut_lengths(total: int, most: int) -> list[int]:
    """Lengths of the pieces of a document: all are full but the first."""
    first = total % most
    return ([first] if first else []) + [most] * (total // most)


def pieces_of(path: str | None, most: int, keep_ids: bool):
    kind = "array<struct<piece: int, start: long, length: long, ids_crc32: long" + (", ids: array<int>" if keep_ids else "") + ">>"

    def pieces(texts: pa.Array) -> pa.Array:
        tokenizer = _tokenizer(path or default_vocabulary())
        sizes, number, start, length, check, ids = [], [], [], [], [], []
        end = np.array([END], "<u4").tobytes()
        for text in texts.to_pylist():
            data = tokenizer.ids(text or "") + end
            lengths, at = cut_lengths(len(data) // 4, most), 0
            sizes.append(len(lengths))
            for k, n in enumerate(lengths):
                part = data[4 * at : 4 * (at + n)]
                number.append(k)
                start.append(at)
                length.append(n)
                check.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(np.frombuffer(part, "<i4"))
                at += n
        names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
        values = [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())]
        if keep_ids:
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            values.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names=names))

    return F.arrow_udf(pieces, kind)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Pieces of ``lengths`` (longest first, each as often as counted) whose sum is the largest that fits ``room``."""
    reach, steps, limit = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = reach | (reach << length) & limit
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many sequences have each, until no piece is left."""
    counts = {length: n for length, n in counts.items() if n}
    plan = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        chosen = [longest, *fullest([x for x in lengths if counts[x]], counts, capacity - longest)]
        counts[longest] += 1
        uses: dict[int, int] = defaultdict(int)
        for x in chosen:
            uses[x] += 1
        times = min(counts[x] // k for x, k in uses.items())
        plan.append((sorted(chosen, reverse=True), times))
        for x, k in uses.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each combination and length: the first number among the pieces of that length, pieces in a sequence, the first sequence, and the place."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for chosen, times in plan:
        at = 0
        for length in dict.fromkeys(chosen):
            each = chosen.count(length)
            rows.append((length, used[length], each, sequence, at))
            used[length] += each * times
            at += each * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "place"), table.T))


def pack_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, capacity: int = SEQUENCE, keep_ids: bool = False
) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset``; with ``keep_ids`` also their token ids."""
    spark = docs.sparkSession
    small_batches(spark)
    cut_up = docs.select(F.col(doc_id).alias("doc_id"), F.inline(pieces_of(vocabulary, capacity, keep_ids)(F.col(text).cast("string"))))
    pieces = stored(cut_up)
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = places(minimum_slack_plan(counted, capacity))
    lengths = spark.createDataFrame([(x, min(MOST_BUCKETS, -(-n // BUCKET_ROWS))) for x, n in sorted(counted.items())], "length long, buckets long")
    dealt = pieces.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))  # lengths: at most ``capacity`` rows
    ahead = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    )
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("own", F.row_number().over(order)).join(ahead, ["length", "bucket"]).withColumn("number", F.col("ahead") + F.col("own") - 1)
    most = 1 + max(counted.values(), default=0)
    keys = table["length"] * most + table["first"] if len(table) else np.zeros(0, np.int64)
    held = spark.sparkContext.broadcast((keys, table))  # grows with the number of lengths only

    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        keys, table = held.value
        length, number = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        row = np.searchsorted(keys, length * most + number, side="right") - 1
        k = number - table["first"][row]
        each = table["each"][row]
        return pa.StructArray.from_arrays([pa.array(table["sequence"][row] + k // each), pa.array(table["place"][row] + k % each * length)], names=["sequence_id", "offset"])

    placed = ranked.withColumn("at", F.arrow_udf(place, "sequence_id long, offset long")("length", "number"))
    ids = ["ids"] if keep_ids else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces with their ids. A sequence has no more than ``capacity`` ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))
