import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkscore.llm import masked_lm as M


def language(rng, n):
    """Words that their neighbours tell: each follows from the one before, mostly."""
    out = [rng.randrange(40)]
    for _ in range(n - 1):
        out.append((out[-1] * 7 + 3) % 40 if rng.random() < 0.9 else rng.randrange(40))
    return " ".join(f"w{i}" for i in out)


def test_distribution_sums_to_one():
    network = M.Network.start()
    context = np.array([[5], [1023], [M.PAD], [0]])
    every = np.arange(M.NUMBERS)
    logs = network.log_probabilities(np.repeat(context, M.NUMBERS, axis=1), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_gradient():
    rng = np.random.default_rng(1)
    context, target = rng.integers(0, M.NUMBERS, (4, 6)), rng.integers(0, M.NUMBERS, 6)
    network = M.Network.start()
    before = {k: v.copy() for k, v in network.weights.items()}
    # With the squares at one beforehand and a small rate, a step is nearly the plain gradient.
    network.squares = {k: np.full_like(v, 1e6) for k, v in before.items()}
    network.learn(context, target, rate=1.0)
    for k in before:
        step = (before[k] - network.weights[k]) * 1e3
        i = np.unravel_index(np.abs(step).argmax(), step.shape)
        sides = []
        for e in (1e-2, -1e-2):
            moved = M.Network({n: v.copy() for n, v in before.items()})
            moved.weights[k][i] += e
            sides.append(-moved.log_probabilities(context, target).astype(np.float64).mean())
        assert abs((sides[0] - sides[1]) / 2e-2 - step[i]) < 0.05 * abs(step[i]) + 1e-3, k


def test_held_out_texts_score_better_than_by_counts(spark, make_docs):
    rng = random.Random(2)
    docs = make_docs(*(language(rng, 300) for _ in range(200))).repartition(3)
    known, network = M.train(docs)
    fresh = make_docs(*(language(rng, 300) for _ in range(10)), *(" ".join(rng.sample(language(rng, 300).split(), 300)) for _ in range(10)))
    out = {r["doc_id"]: r for r in M.score(fresh, known, network).collect()}
    told = np.mean([out[i]["mean_log_probability"] for i in range(10)])
    mixed = np.mean([out[i]["mean_log_probability"] for i in range(10, 20)])
    assert told > -math.log(40) + 0.8 and told > mixed + 1


def test_scores_word_by_word(make_docs):
    rng = random.Random(3)
    texts = [None, "", "one", language(rng, 50), language(rng, 20000), "A\tb  C\n"]
    docs = make_docs(*texts, (None, "x y"), (3, "x y")).withColumn("n_words", F.lit("clash"))
    known, network = M.train(docs)
    out = M.score(docs, known, network).collect()
    assert len(out) == 8
    by_id = {r["doc_id"]: r for r in out[: len(texts)]}
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        r = by_id[i]
        assert r["n_words"] == len(words)
        if not words:
            assert r["log_likelihood"] == 0 and r["mean_log_probability"] is None
            continue
        numbers = known.value.number(M.word_hashes(pa.array([text]))[0])
        around = [M.PAD] * 2 + numbers.tolist() + [M.PAD] * 2
        # Each word by itself, of the long text some of them; then all with the contexts side by side.
        side_by_side = np.array([around[2 + o : 2 + o + len(words)] for o in M.PLACES])
        each = network.log_probabilities(side_by_side, numbers)
        for k in range(0, len(words), 1 + len(words) // 300):
            context = np.array([[around[k + 2 + o]] for o in M.PLACES])
            assert abs(float(network.log_probabilities(context, numbers[k : k + 1])[0]) - each[k]) < 1e-3
        total = float(each.astype(np.float64).sum())
        assert abs(total - r["log_likelihood"]) < 1e-2 + 1e-5 * len(words)


def test_empty_table(make_docs):
    none = make_docs("x").filter("false")
    assert M.score(none, *M.train(none)).collect() == []


def test_every_word_has_its_own_probability(make_docs, monkeypatch):
    """Words beyond the numbered ones: by their counts in the corpus, whatever part of these is broadcast."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(1_500)] * 3 + [f"r{i}" for i in range(600)] * 2 + [f"s{i}" for i in range(600)]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 60]) for i in range(0, len(words), 60)]
    docs = make_docs(*texts, None, "r1 r1 s2")
    known, network = M.train(docs)
    fresh = docs.unionByName(make_docs((None, "never seen s1"), (None, "w3"), (7, "r5")))
    out = sorted(map(str, M.score(fresh, known, network).select("doc_id", "n_words", F.round("log_likelihood", 6)).collect()))

    counts = {}
    for word in words + ["r1", "r1", "s2"]:
        counts[word] = counts.get(word, 0) + 1
    hashes = M.word_hashes(pa.array([" ".join(counts)]))[0]
    numbers = known.value.number(hashes)
    logs, absent = known.value.log_shares(hashes, numbers)
    assert not len(absent)
    n = np.array(list(counts.values()))
    for number in range(M.NUMBERS):
        here = numbers == number
        want = 1 if number < M.NUMBERS - M.BUCKETS else n[here] / (n[here].sum() + 1)
        assert np.allclose(np.exp(logs[here]), want), number
    new, at = known.value.log_shares(*(lambda h: (h, known.value.number(h)))(M.word_hashes(pa.array(["qqzx"]))[0]))
    assert len(at) == 1 and new[0] < logs.min()

    for most in (800, 0):
        monkeypatch.setattr(M, "MAX_KNOWN", most)
        less = docs.sparkSession.sparkContext.broadcast(M.vocabulary(docs))
        assert less.value.below and len(less.value.more) <= most
        again = M.score(fresh, less, network).select("doc_id", "n_words", F.round("log_likelihood", 6))
        assert sorted(map(str, again.collect())) == out


def test_words_of_large_batches_are_counted_in_little_memory():
    text = " ".join(f"word{random.Random(1).randrange(20_000)} w{k}" for k in range(1_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * (16_000_000 // len(text)))], ["text"])
    tracemalloc.start()
    counts = [sum(part.column("n").to_pylist()) for part in M.word_counts(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(counts) == 2_000 * batch.num_rows
    assert peak < 300_000_000
