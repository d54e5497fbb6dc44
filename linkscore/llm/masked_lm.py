"""Masked pseudo-likelihood of documents.

A network reads the words on both sides of a place (never the word itself) and gives the probability
of the word there. A document's score is the sum of the log probabilities of all of its words.

* The words of all documents are counted; the table of counts grows with the corpus.
* Words are numbered by these counts: the most frequent ones have a number each, the others share
  ``BUCKETS`` numbers by hash.
* The network sums one embedding per place of the window, applies tanh, and predicts a number in two
  steps, its group and its place in the group given the group; the product is a proper distribution
  over all numbers, at the cost of two small softmaxes.
* A word that shares its number has the probability of the number times its own given the number:
  n / (N + 1), of n occurrences of the word and N of all words of the number. The rest, 1 / (N + 1), is
  for words that are not in the corpus, as if they were one more than the distinct words of the number.
* Training is data-parallel: every task goes over all words of its documents in minibatches (numpy,
  Adagrad), starting from the same weights; Spark averages the tasks' weights, weighted by words. A
  first round over a share of the documents gives the common start of the second one, which is over
  all of them.

What reaches the driver is the frequent words' counts and one set of weights, whatever the corpus. Up to
``MAX_KNOWN`` counts are broadcast; the words of documents that are not among these are joined with the
table of counts. That decides the speed, never the result.

Defined cases: null texts and texts without words have 0 words, sum 0 and no mean; rows with null or
repeated ids are scored each; an empty table gives an empty result; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.llm.text_arrays import bytes_and_offsets, chunks, slice_hashes, word_bounds
from linkscore.storage import materialized, new_folder

#: Numbers of words: frequent ones, then buckets of the others; together ``GROUP`` squared.
GROUP, BUCKETS = 32, 64
NUMBERS = GROUP * GROUP
PAD = NUMBERS  # beyond the ends of a document
#: Places of the window, and the length of embeddings.
PLACES, WIDTH = (-2, -1, 1, 2), 24
BATCH, RATE = 8_192, 0.08
#: One in so many documents, by hash, is in the first round.
FIRST_ROUND = 8
#: Counts of words that are broadcast, at most; the others are joined.
MAX_KNOWN = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Vocabulary:
    """Hashes of the frequent words, sorted, and their numbers; what is known of the words that share one."""

    hashes: np.ndarray
    numbers: np.ndarray
    more: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # hashes of such words, sorted
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    totals: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.int64))  # occurrences by bucket
    distinct: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.int64))
    below: int = 0  # words of fewer occurrences are not in ``more`` but in the table of counts
    folder: str = ""  # of the table of counts

    @classmethod
    def of(cls, hashes: list[int]) -> Vocabulary:
        """From the most frequent on."""
        values = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(values)
        return cls(values[order], order.astype(np.int32))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        buckets = (NUMBERS - BUCKETS + (hashes >> np.uint64(58))).astype(np.int32)
        if not len(self.hashes):
            return buckets
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], buckets)

    def log_shares(self, hashes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word given its number, and the places of words that are not at hand
        (and count as not in the corpus)."""
        logs = np.zeros(len(hashes))
        sharing = np.flatnonzero(numbers >= NUMBERS - BUCKETS)
        bucket, wanted = numbers[sharing] - (NUMBERS - BUCKETS), hashes[sharing]
        own = np.full(len(sharing), -1.0)
        if len(self.more):
            at = np.minimum(np.searchsorted(self.more, wanted), len(self.more) - 1)
            own = np.where(self.more[at] == wanted, self.counts[at], own)
        unseen = own < 0
        value = np.where(unseen, -np.log(self.distinct + 1.0)[bucket], np.log(np.abs(own)))
        logs[sharing] = value - np.log(self.totals + 1.0)[bucket]
        return logs, sharing[unseen]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z), and the number of each text's first word, and the end."""
    data, offsets = bytes_and_offsets(texts)
    starts, ends, first = word_bounds(data, offsets)
    return slice_hashes(_LOWER[data], starts, ends), first


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): hashes of the words of each slice of a batch and how often they are there.

    Hashing takes some 50 bytes per byte of a slice, so slices are small.
    """
    for whole in batches:
        for batch in chunks(whole):
            values, counts = np.unique(word_hashes(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "n"])


def vocabulary(docs: DataFrame) -> Vocabulary:
    counted = docs.select("text").mapInArrow(word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    folder = new_folder(docs.sparkSession, "words")
    counted.write.parquet(folder)
    counted = docs.sparkSession.read.schema(counted.schema).parquet(folder)
    most = [r["h"] for r in counted.orderBy(F.desc("n"), "h").limit(NUMBERS - BUCKETS).collect()]
    known = Vocabulary.of(most)
    known.folder = folder
    sharing = counted.filter(~F.col("h").isin(most)) if most else counted
    # By bucket and steps of counts, to choose how many of the more frequent ones are broadcast.
    step = F.floor(4 * F.log2("n")).alias("step")
    sums = sharing.groupBy(F.shiftrightunsigned("h", 58).alias("bucket"), step).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("n").alias("least")
    )
    steps: dict[int, list[int]] = {}
    for r in sums.collect():
        known.totals[r["bucket"]] += r["n"]
        known.distinct[r["bucket"]] += r["k"]
        words, least = steps.get(r["step"], (0, r["least"]))
        steps[r["step"]] = [words + r["k"], min(least, r["least"])]
    words = 0
    for number in sorted(steps, reverse=True):
        words += steps[number][0]
        if words > MAX_KNOWN:
            # The least count of the step before, or more than any.
            known.below = known.below or 1 << 62
            break
        known.below = steps[number][1]
    else:
        known.below = 0
    table = sharing.filter(F.col("n") >= known.below).toArrow()
    hashes = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    known.more, known.counts = hashes[order], table.column("n").to_numpy()[order]
    return known


def _shapes() -> dict[str, tuple[int, ...]]:
    return {
        "embed": (len(PLACES), NUMBERS + 1, WIDTH),
        "hidden": (WIDTH,),
        "group": (WIDTH, GROUP),
        "group_bias": (GROUP,),
        "given": (GROUP, WIDTH),
        "place": (WIDTH, GROUP),
        "place_bias": (GROUP, GROUP),
    }


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    squares: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls({k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in _shapes().items()})

    @classmethod
    def of_vector(cls, flat: np.ndarray) -> Network:
        weights, at = {}, 0
        for k, shape in _shapes().items():
            n = int(np.prod(shape))
            weights[k] = flat[at : at + n].astype(np.float32).reshape(shape)
            at += n
        return cls(weights)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in _shapes()])

    def _forward(self, context: np.ndarray, target: np.ndarray):
        w = self.weights
        total = w["hidden"] + w["embed"][0][context[0]]
        for p in range(1, len(PLACES)):
            total += w["embed"][p][context[p]]
        hidden = np.tanh(total)
        group, place = target // GROUP, target % GROUP
        second = hidden + w["given"][group]
        p_group = _softmax(hidden @ w["group"] + w["group_bias"])
        p_place = _softmax(second @ w["place"] + w["place_bias"][group])
        rows = np.arange(len(target))
        logs = np.log(p_group[rows, group] + 1e-12) + np.log(p_place[rows, place] + 1e-12)
        return logs, hidden, second, p_group, p_place, group, place

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self._forward(context, target)[0]

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad on a minibatch."""
        _, hidden, second, p_group, p_place, group, place = self._forward(context, target)
        w, n = self.weights, len(target)
        rows = np.arange(n)
        p_group[rows, group] -= 1
        p_place[rows, place] -= 1
        p_group /= n
        p_place /= n
        d_second = p_place @ w["place"].T
        d_total = (p_group @ w["group"].T + d_second) * (1 - hidden * hidden)
        change = {
            "group": hidden.T @ p_group,
            "group_bias": p_group.sum(axis=0),
            "place": second.T @ p_place,
            "place_bias": _summed(p_place, group, GROUP),
            "given": _summed(d_second, group, GROUP),
            "hidden": d_total.sum(axis=0),
            "embed": np.stack([_summed(d_total, c, NUMBERS + 1) for c in context]),
        }
        for k, g in change.items():
            s = self.squares.setdefault(k, np.zeros_like(w[k]))
            s += g * g
            w[k] -= rate * g / (np.sqrt(s) + 1e-6)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _summed(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each row number."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(rows.astype(np.int16), kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def windows(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The padded stream of several texts' words, and where each word is in it."""
    gap = max(PLACES)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(numbers)) + gap * (text + 1)
    stream = np.full(len(numbers) + gap * len(first), PAD, np.int32)
    stream[at] = numbers
    return stream, at


def train_round(docs: DataFrame, known, start: Network) -> Network:
    """Every task trains on its documents from ``start``; the mean of all, weighted by words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(start.vector())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, words = Network.of_vector(shared.value), 0
        for whole in batches:
            for batch in chunks(whole):
                hashes, first = word_hashes(batch.column("text"))
                numbers = known.value.number(hashes)
                stream, at = windows(numbers, first)
                # In another order, so that a minibatch has words of many texts.
                order = np.random.default_rng(len(numbers)).permutation(len(numbers))
                for a in range(0, len(order), BATCH):
                    part = order[a : a + BATCH]
                    network.learn(np.stack([stream[at[part] + o] for o in PLACES]), numbers[part])
                words += len(numbers)
        if words:
            flat = network.vector().astype(np.float64) * words
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), words))],
                ["i", "v", "n"],
            )

    parts = docs.select("text").mapInArrow(each, "i int, v double, n long")
    mean = parts.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
    if not mean:
        return start
    flat = np.empty(len(mean))
    flat[[r["i"] for r in mean]] = [r["v"] for r in mean]
    return Network.of_vector(flat)


def train(docs: DataFrame) -> tuple[object, Network]:
    """The broadcast vocabulary and the network of all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(docs))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(FIRST_ROUND)) == 0)
    return known, train_round(docs, known, train_round(some, known, Network.start()))


def score(docs: DataFrame, known, network: Network) -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum) and mean_log_probability of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network.vector())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.of_vector(shared.value)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in chunks(whole):
                hashes, first = word_hashes(batch.column("text"))
                numbers = known.value.number(hashes)
                stream, at = windows(numbers, first)
                shares, absent = known.value.log_shares(hashes, numbers)
                logs = np.zeros(len(numbers) + 1)
                for a in range(0, len(numbers), BATCH):
                    part = at[a : a + BATCH]
                    context = np.stack([stream[part + o] for o in PLACES])
                    logs[a + 1 : a + 1 + len(part)] = network.log_probabilities(context, numbers[a : a + BATCH])
                logs[1:] += shares
                total = np.cumsum(logs)
                n = np.diff(first)
                sums = np.where(n > 0, total[first[1:]] - total[first[:-1]], 0.0)
                bounds = pa.array(np.searchsorted(absent, first).astype(np.int32))
                absent_words = pa.ListArray.from_arrays(bounds, pa.array(hashes[absent].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(n), dtype=np.int64)), batch.column("doc_id"),
                        pa.array(n.astype(np.int64)), pa.array(sums), absent_words,
                    ],
                    ["row", "doc_id", "n_words", "log_likelihood", "absent"],
                )
                row += len(n)

    schema = f"row long, doc_id {kind}, n_words long, log_likelihood double, absent array<long>"
    scored = docs.select("doc_id", "text").mapInArrow(each, schema)
    if known.value.below:
        scored = _with_counts(materialized(scored, "scored"), known.value)
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_probability"))


def _with_counts(scored: DataFrame, known: Vocabulary) -> DataFrame:
    """Words that were not at hand, but are in the table of counts, no longer count as unseen."""
    counts = scored.sparkSession.read.schema("h long, n long").parquet(known.folder)
    unseen = F.array(*(F.lit(math.log(int(k) + 1)) for k in known.distinct))
    more = (F.log("n") + unseen[F.shiftrightunsigned("h", 58).cast("int")]).alias("more")
    rare = counts.filter(F.col("n") < known.below).select("h", more)
    words = scored.select("row", F.explode("absent").alias("h"))
    sums = words.join(rare, "h").groupBy("row").agg(F.sum("more").alias("more"))
    found = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
    return scored.drop("absent").join(sums, "row", "left").withColumn("log_likelihood", found)


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, *train(docs))
