"""Quality rules by repetition coverage: how much of a text lies in word runs and lines that the text repeats.

Rolling hashes of several n-gram lengths are taken over a text's words in numpy. Every word that lies in an n-gram found
twice or more in the same text (the first copy included) is covered; the covered characters, as a share of all word
characters, are held against a limit per length. The same is done for whole lines. Texts are judged one by one, so the
operator is one pass over the table without a shuffle.

Defined cases: a null or blank text has no words and fails the base rule; ties and repeated rows are judged alike, row by
row; all columns of the input are kept and the verdict's column is renamed when its name is taken; an empty table gives an
empty table. The whole of a very long text is measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, free_name, small_batches

#: n-gram length -> largest share of word characters that may lie in repeated n-grams.
NGRAM_LIMITS = {5: 0.25, 7: 0.20, 10: 0.15}
#: Largest share of word characters that may lie in lines equal to another line.
LINE_LIMIT = 0.30
#: Most symbols of SYMBOLS per word.
SYMBOL_LIMIT = 0.2
#: Largest share of words of two letters or more written in capitals only, in texts of CAPS_WORDS words or more.
CAPS_LIMIT, CAPS_WORDS = 0.6, 10
MIN_WORDS = 10
SYMBOLS = b"#*$%&|<>"

VERDICT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("repeat_share", pa.float64()),
        ("line_share", pa.float64()),
        ("kept", pa.bool_()),
    ]
)
VERDICT_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "repeat_share double, line_share double, kept boolean"
)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(hashes: np.ndarray, n: int, rolled: np.ndarray) -> np.ndarray | None:
    """Which words lie in an n-gram that occurs twice or more; None if there is none. ``rolled``: the n-grams' hashes."""
    ordered = np.sort(rolled)
    twins = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twins):
        return None
    found = np.isin(rolled, twins)
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(found)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The measures and the verdict of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, True, 0.0, 0.0, False
    joined = np.frombuffer(b"".join(words), np.uint8)
    starts_point = (joined & 0xC0) != 0x80
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes)
    points = np.diff(np.concatenate(([0], np.cumsum(starts_point)[ends - 1])))
    word_chars = int(points.sum())
    n_symbols = int(_IS_SYMBOL[joined].sum())

    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup_lines, line_chars = len(lines) - len(set(lines)), 0
    if n_dup_lines:
        seen: dict[bytes, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        line_chars = sum(k * len(b"".join(x.split()).decode("utf-8", "surrogatepass")) for x, k in seen.items() if k > 1)

    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    rolled, n_repeat, share, over = hashes, 0, 0.0, False
    for length in range(2, max(NGRAM_LIMITS) + 1):
        if n < length:
            break
        rolled = rolled[:-1] * _ROLL + hashes[length - 1 :]
        if length in NGRAM_LIMITS:
            covered = repeated_words(hashes, length, rolled)
            if covered is None:  # nor is a longer one repeated
                break
            if length == 5:
                n_repeat = int(covered.sum())
            part = float(points[covered].sum()) / word_chars
            share = max(share, part)
            over |= part > NGRAM_LIMITS[length]
    failed = n < MIN_WORDS or 100 * n_repeat > 20 * n
    line_share = line_chars / word_chars
    capitals = 0
    if n >= CAPS_WORDS:
        letters = [w for w in words if len(w) > 1 and w.upper() != w.lower()]
        capitals = sum(w == w.upper() for w in letters) / max(1, len(letters))
    kept = not (failed or over or line_share > LINE_LIMIT or n_symbols > SYMBOL_LIMIT * n or capitals > CAPS_LIMIT)
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, failed, share, line_share, kept


def judge(texts: pa.Array) -> pa.Array:
    rows = [measure(x) for x in texts.to_pylist()]
    columns = list(zip(*rows)) if rows else [[] for _ in range(VERDICT.num_fields)]
    return pa.StructArray.from_arrays(
        [pa.array(c, VERDICT.field(i).type) for i, c in enumerate(columns)], names=[VERDICT.field(i).name for i in range(VERDICT.num_fields)]
    )


def quality_rules(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column of measures and the verdict ``kept``."""
    small_batches(docs.sparkSession)
    judged = F.arrow_udf(judge, VERDICT_DDL)
    return docs.withColumn(free_name(docs, into), judged(F.col(text).cast("string")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir, "doc_id", "text"))
    return judged.select("doc_id", "quality.*")
