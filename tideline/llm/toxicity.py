"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and their first letters (several lengths, so that inflected forms share a term), hashed into
BUCKETS. A bounded sample of the labelled rows (TRAIN_ROWS and TRAIN_TERMS at most, in hash order) trains the machine: a weight for
each term and FACTORS numbers for each, whose products weigh pairs of terms, so that two terms can mean more together than each alone.

Terms take part if they tell the labels apart alone, or in a pair: a first machine is trained on those that do alone, and what it
leaves unexplained is added up over the texts with each pair of the PAIR_TERMS most frequent terms, neutral ones among them. Pairs
with a sum far from chance bring their terms into the second machine. (With all frequent terms and no such test, a machine of this
size learns noise: see the README.) The model is small and goes to every worker; texts are scored where they lie, one pass without a shuffle.

Defined cases: a null or empty text scores as a text without terms; rows with the same id train and score as rows of their own;
a null id counts as the text '' for the folds; without usable labels every score is the prior; all columns stay; an empty
table gives an empty table. The whole of a very long text is read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, free_name, held_out, small_batches, stored

FOLDS, HELD_FOLD = 5, 0
TRAIN_ROWS, TRAIN_TERMS = 20_000, 24_000_000
BUCKETS, FACTORS = 1 << 20, 4
STARTS = (3, 4, 5, 6)
#: A term takes part if so many texts of the sample have it and its rate differs from the prior by so many deviations.
LEAST_TEXTS, LEAST_DEVIATIONS = 5, 4.0
#: Most frequent terms whose pairs are tested; texts that a term of a pair needs; deviations from chance; least variance of a text.
PAIR_TERMS, PAIR_TEXTS, PAIR_DEVIATIONS, LEAST_VARIANCE = 2048, 20, 6.5, 0.02
EPOCHS, BATCH, RATE, DECAY, FACTOR_RATE, FACTOR_DECAY, SEED = 15, 256, 0.1, 1e-4, 0.05, 1e-3, 7
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_"
REMEMBERED = 400_000


def term_buckets(word: str) -> list[int]:
    core = word.strip(EDGES)
    terms = ["w" + core] if core else []
    terms += [f"{n}{core[:n]}" for n in STARTS if len(core) > n]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms]


class Terms(dict):
    """The model's terms of a word, kept by word."""

    def __init__(self, rows: dict[int, int] | None):
        super().__init__()
        self.rows = rows

    def __missing__(self, word: str) -> tuple:
        buckets = term_buckets(word)
        if self.rows is not None:
            buckets = [self.rows[b] for b in buckets if b in self.rows]
        out = self[word] = tuple(buckets)
        return out


def text_terms(text: str | None, terms: Terms) -> np.ndarray:
    if len(terms) > REMEMBERED:
        terms.clear()
    found = set()
    for x in set(map(terms.__getitem__, set((text or "").lower().split()))):
        found.update(x)
    return np.fromiter(found, np.int64, len(found))


def extract_terms(texts: pa.Array) -> pa.Array:
    terms = Terms(None)
    found = [np.sort(text_terms(x, terms)) for x in texts.to_pylist()]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0), pa.int32()))


class Machine:
    """Bias, weights and factors of the terms that take part; ``buckets`` are their hashed terms."""

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.buckets, self.weights, self.factors = bias, buckets, weights, factors

    def margins(self, items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts whose terms (rows of the model) lie one after another."""
        out = np.full(len(sizes), self.bias)
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            sums = np.add.reduceat(self.factors[items], starts)
            squares = np.add.reduceat((self.factors**2)[items], starts)
            out[some] += np.add.reduceat(self.weights[items], starts) + 0.5 * (sums**2 - squares).sum(1)
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sample:
    """Labelled texts as terms that lie one after another."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.flat, self.sizes, self.labels = flat, sizes, labels
        self.begins = np.cumsum(sizes) - sizes
        self.prior = (labels.sum() + 0.5) / (len(labels) + 1)

    def only(self, buckets: np.ndarray) -> Sample:
        """With these terms only, numbered as they stand in ``buckets``."""
        row = np.full(BUCKETS, -1, np.int32)
        row[buckets] = np.arange(len(buckets))
        items = row[self.flat]
        kept = items >= 0
        ends = np.concatenate(([0], np.cumsum(kept)))
        return Sample(items[kept], ends[self.begins + self.sizes] - ends[self.begins], self.labels)

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[rows]
        return self.flat[np.repeat(self.begins[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every term: texts with it, and those labelled 1."""
        bad = np.concatenate([self.rows(k)[0] for k in np.array_split(np.flatnonzero(self.labels == 1), 8)])
        return np.bincount(self.flat, minlength=BUCKETS), np.bincount(bad, minlength=BUCKETS)


def telling_terms(sample: Sample, seen: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Whether each term's rate differs from the prior."""
    with np.errstate(divide="ignore", invalid="ignore"):
        deviations = np.abs(bad - sample.prior * seen) / np.sqrt(seen * sample.prior * (1 - sample.prior))
    return (seen >= LEAST_TEXTS) & (deviations >= LEAST_DEVIATIONS)


def telling_pairs(sample: Sample, seen: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Whether each term stands in a pair whose texts a machine that gives them ``chance`` misjudges in one direction."""
    terms = np.argsort(-seen, kind="stable")[:PAIR_TERMS]
    terms = terms[seen[terms] >= PAIR_TEXTS]
    out, few = np.zeros(BUCKETS, bool), sample.only(terms)
    rest = (sample.labels - chance).astype(np.float32)
    spread = np.maximum(chance * (1 - chance), LEAST_VARIANCE).astype(np.float32)
    sums, squares = np.zeros((2, len(terms), len(terms)), np.float32)
    for at in range(0, len(rest), 2048):
        part, n = few.rows(np.arange(at, min(at + 2048, len(rest))))
        has = np.zeros((len(n), len(terms)), np.float32)
        has[np.repeat(np.arange(len(n)), n), part] = 1
        sums += has.T @ (has * rest[at : at + 2048, None])
        squares += has.T @ (has * spread[at : at + 2048, None])
    np.fill_diagonal(sums, 0)
    out[terms] = (np.abs(sums) >= PAIR_DEVIATIONS * np.sqrt(squares + 1)).any(1)
    return out


def descend(sample: Sample, buckets: np.ndarray) -> Machine:
    """Adagrad on the logistic loss over the sample, for the terms in ``buckets``."""
    own, random = sample.only(buckets), np.random.default_rng(SEED)
    machine = Machine(float(np.log(sample.prior / (1 - sample.prior))), buckets, np.zeros(len(buckets)), random.normal(0, 0.01, (len(buckets), FACTORS)))
    past_w, past_v, past_b = np.full(len(buckets), 1e-6), np.full(machine.factors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(len(own.labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            part, n = own.rows(rows)
            error = (logistic(machine.margins(part, n)) - own.labels[rows]) / len(rows)
            each, used = np.repeat(error, n), np.flatnonzero(np.bincount(part, minlength=len(buckets)))
            vectors = machine.factors[part]
            sums, some = np.zeros((len(rows), FACTORS)), n > 0
            if some.any():
                sums[some] = np.add.reduceat(vectors, (np.cumsum(n) - n)[some])
            slopes = (np.repeat(sums, n, axis=0) - vectors) * each[:, None]
            slope_w = np.bincount(part, each, minlength=len(buckets))[used] + DECAY * machine.weights[used]
            slope_v = np.stack([np.bincount(part, slopes[:, k], minlength=len(buckets))[used] for k in range(FACTORS)], 1) + FACTOR_DECAY * machine.factors[used]
            slope_b = error.sum()
            past_w[used] += slope_w**2
            past_v[used] += slope_v**2
            past_b += slope_b**2
            machine.weights[used] -= RATE * slope_w / np.sqrt(past_w[used])
            machine.factors[used] -= FACTOR_RATE * slope_v / np.sqrt(past_v[used])
            machine.bias -= RATE * slope_b / np.sqrt(past_b)
    return machine


def train_machine(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Machine:
    """``flat``: the buckets of the texts' terms, one text after another."""
    sample = Sample(flat, sizes, labels)
    if not len(labels) or not 0 < labels.sum() < len(labels):
        return Machine(float(np.log(sample.prior / (1 - sample.prior))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    seen, bad = sample.counts()
    alone = telling_terms(sample, seen, bad)
    machine = descend(sample, np.flatnonzero(alone))
    own = sample.only(machine.buckets)
    paired = telling_pairs(sample, seen, logistic(machine.margins(own.flat, own.sizes)))
    return descend(sample, np.flatnonzero(alone | paired)) if (paired & ~alone).any() else machine


def scorer(held):
    def score(texts: pa.Array) -> pa.Array:
        machine = held.value
        terms = Terms({int(b): k for k, b in enumerate(machine.buckets)})
        found = [text_terms(x, terms) for x in texts.to_pylist()]
        sizes = np.array([len(x) for x in found], np.int64)
        items = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.array(logistic(machine.margins(items, sizes)))

    return F.arrow_udf(score, "double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = TRAIN_ROWS, most_terms: int = TRAIN_TERMS) -> Machine:
    """Trains on at most ``most`` labelled rows, with ``most_terms`` terms in all, where ``train`` (of the id) holds."""
    small_batches(docs.sparkSession)
    usable = labels.where(train & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("own_"), F.col(label).cast("double").alias("label_"))
    usable = usable.groupBy("own_").agg(F.max("label_").alias("label_"))
    count = usable.count()
    share = min(1.0, most / max(1, count))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(SEED), "own_"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64(F.lit(SEED), "own_")).limit(most)
    if not count:
        return train_machine(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    met = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("own_"))  # ``most`` rows at most
    terms = met.select(F.xxhash64(F.lit(SEED), "own_").alias("key_"), "label_", F.arrow_udf(extract_terms, "array<int>")(F.col(text).cast("string")).alias("terms_"))
    terms = stored(terms.withColumns({"size_": F.size("terms_"), "print_": F.xxhash64("terms_")}))
    keys = terms.select("key_", "print_", "size_").toArrow().sort_by([("key_", "ascending"), ("print_", "ascending"), ("size_", "ascending")])  # rows of the sample only
    fits = np.flatnonzero(np.cumsum(keys["size_"].to_numpy()) <= most_terms)
    if not len(fits):
        return train_machine(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    rows = terms.where(F.col("key_") <= keys["key_"][int(fits[-1])].as_py()).toArrow().sort_by([("key_", "ascending"), ("print_", "ascending"), ("size_", "ascending"), ("label_", "ascending")])  # rows arrive in any order
    lists = rows["terms_"].combine_chunks()
    return train_machine(lists.flatten().to_numpy(), rows["size_"].to_numpy().astype(np.int64), rows["label_"].to_numpy())


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # as many terms as take part, BUCKETS at most
    return docs.withColumn(free_name(docs, into), scorer(held)(F.col(text).cast("string")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), FOLDS, HELD_FOLD)
    docs = documents(spark, sf_dir, "doc_id", "text")
    machine = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    scored = score_toxicity(docs, machine)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
