"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``times`` periods long, that no neighbouring word
extends. All runs of a text come from one pass over its words:

* The suffix automaton of the words gives a tree of suffix links, whose node of a prefix stands for the suffixes that end there. Appending word i is the
  access of its node: the path to the root is recoloured with i. Before that, each segment of one colour on the path says that its longest suffix
  ended last at that colour, e. If the distance d = i - e is within the segment's length, the words up to i hold a square of period d, and d is the
  smallest period there. The longest common suffix gives the run's start, comparing forward gives its end; each run is followed once.
* The tree is complete before the first access and is not cut or linked afterwards, so preferred paths need no rebalancing: each heavy path keeps
  its segments as a stack, the shallowest on top, and an access pops what it recolours. Segments popped stay within n log n.
* Two occurrences of a run's words, a period apart, share ``least - least // times`` words at least. Stretches of a text that no such repeated word group
  covers, with a repeat near enough, hold no run; hashes leave them out before an automaton is built. A clash of hashes only leaves more in.

Texts are read whole and one by one, so the operator is one pass over the table without a shuffle; memory follows the longest text.

Defined cases: a null or blank text has no words and no runs, its ``strongest`` is null and its collapsed text empty; rows with equal texts or ids are
judged alike, row by row; of equally strong runs the one that starts first, then the shorter period is named; all columns stay and the result's column
is renamed where its name is taken; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, free_name, small_batches

#: Fewest words of a run, and fewest periods.
LEAST, TIMES = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("strongest", RUN), ("collapsed", pa.string())])
RUN_DDL = "struct<start: long, length: long, period: long>"
RESULT_DDL = f"n_words long, runs array<{RUN_DDL}>, strongest {RUN_DDL}, collapsed string"
_ROLL = 0x9E3779B97F4A7C15


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all groups of ``size`` neighbouring words, put together by doubling."""
    out, have = hashes, 1
    for bit in bin(size)[3:]:
        out, have = out[:-have] * np.uint64((_ROLL * (2 * have + 1)) % (1 << 64)) + out[have:], 2 * have
        if bit == "1":
            out, have = out[:-1] * np.uint64(_ROLL) + hashes[have:], have + 1
    return out


def stretches(hashes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of words outside of which no run can lie: covered by word groups that are repeated within a ``times``-th of the stretch."""
    size, out, todo = least - least // times, [], [(0, len(hashes))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        found = grams(hashes[low:high], size)
        order = np.argsort(found, kind="stable")
        ordered = found[order]
        twins = np.flatnonzero(ordered[1:] == ordered[:-1])
        if not len(twins):
            continue
        one, two = order[twins], order[twins + 1]
        near = two - one <= (high - low) // times
        edges = np.zeros(high - low + 1, np.int64)
        for at in (one[near], two[near]):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
        covered = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        parts = list(zip((turns[::2] + low).tolist(), (turns[1::2] + low).tolist()))
        if parts == [(low, high)]:
            out.append((low, high))
        else:
            todo += parts
    return sorted(out)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton: of each state the length of its longest string and its suffix link, and the state of each prefix."""
    length, link, moves, states, last = [0], [-1], [{}], [], 0
    for n, word in enumerate(words, 1):
        state, at = len(length), last
        length.append(n)
        link.append(0)
        moves.append({})
        while at >= 0 and word not in moves[at]:
            moves[at][word] = state
            at = link[at]
        if at >= 0:
            to = moves[at][word]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                moves.append(moves[to].copy())
                link[to] = link[state] = copy
                while at >= 0 and moves[at].get(word) == to:
                    moves[at][word] = copy
                    at = link[at]
        states.append(state)
        last = state
    return length, link, states


def heavy_paths(length: list[int], link: list[int]) -> list[int]:
    """The topmost node of each node's heavy path in the tree of suffix links."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    weight, heavy, head = [1] * len(length), [-1] * len(length), list(range(len(length)))
    for node in reversed(order[1:]):
        above = link[node]
        weight[above] += weight[node]
        if heavy[above] < 0 or weight[node] > weight[heavy[above]]:
            heavy[above] = node
    for node in order:
        if heavy[node] >= 0:
            head[heavy[node]] = head[node]
    return head


def find_runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs of a list of word numbers as (start, length, period)."""
    length, link, states = automaton(words)
    head, segments, ends, runs, many = heavy_paths(length, link), {}, {}, [], len(words)
    for i, node in enumerate(states):
        while node > 0:  # the access: each heavy path on the way to the root, from below
            top, depth = head[node], length[node]
            stack = segments.get(top)
            if stack is None:
                stack = segments[top] = []
            while stack:
                reach, end = stack[-1]
                if reach <= depth:
                    stack.pop()
                else:
                    reach = depth
                period = i - end
                if period <= reach and ends.get(period, -1) < i:
                    after = i + 1
                    while after < many and words[after] == words[after - period]:
                        after += 1
                    ends[period] = after - 1
                    start = i - reach - period + 1
                    if after - start >= least and after - start >= times * period:
                        runs.append((start, after - start, period))
                if reach == depth:
                    break
            stack.append((depth, i))
            node = link[top]
    return runs


def text_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for low, high in stretches(hashes, least, times):
        number: dict[bytes, int] = {}
        part = [number.setdefault(w, len(number)) for w in words[low:high]]
        out += [(start + low, length, period) for start, length, period in find_runs(part, least, times)]
    return sorted(out, key=lambda run: (run[0], run[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period, exactly; the first of equal ones."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def judge(least: int, times: int):
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").split()
            runs = text_runs(words, least, times)
            name = lambda r: dict(zip(("start", "length", "period"), r))
            best = strongest(runs)
            rows.append({"n_words": len(words), "runs": [name(r) for r in runs], "strongest": best and name(best), "collapsed": collapsed(words, runs).decode("utf-8", "surrogatepass")})
        return pa.array(rows, RESULT)

    return run


def periodic_runs(docs: DataFrame, text: str = "text", into: str = "periodic", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with a struct of ``n_words``, the array ``runs``, the ``strongest`` of them and the ``collapsed`` text."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, into), F.arrow_udf(judge(least, times), RESULT_DDL)(F.col(f"`{text}`").cast("string")))


def planted(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Texts with their words joined by one space; those whose id's CRC-32 is divisible by 10 become periodic from some word on."""
    out = []
    for key, text in zip(ids.to_pylist(), texts.to_pylist()):
        code = zlib.crc32(("" if key is None else str(key)).encode())
        if code % 10 == 0 and text:
            words = text.encode("utf-8", "surrogatepass").split()
            many, draw = len(words), code // 10
            if many:
                begin = draw % many
                period = 1 + (many - begin) // (3 + draw % 8)
                text = b" ".join(words[:begin] + [words[begin + k % period] for k in range(many - begin)]).decode("utf-8", "surrogatepass")
        out.append(text)
    return pa.array(out, pa.string())


def as_lines(runs: Column) -> Column:
    return F.concat_ws("", F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    small_batches(spark)
    docs = docs.select("doc_id", F.arrow_udf(planted, "string")("doc_id", "text").alias("text"))
    best, found = F.col("periodic.strongest"), periodic_runs(docs)
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * periodic.strongest.length) div periodic.strongest.period").alias("exponent_milli"),
        F.sha2(as_lines(F.col("periodic.runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )
