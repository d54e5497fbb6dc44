"""Runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkscore.llm import periodic_runs as P


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def some_words(rng, n, letters):
    words = []
    while len(words) < n:
        piece = [rng.choice(letters) for _ in range(rng.randint(1, 5))]
        words += piece * rng.choice([1, 1, 2, 3, 4, 5, 9])
    return words[:n]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_runs_against_all_periods(letters):
    rng = random.Random(len(letters))
    texts = [some_words(rng, rng.randint(0, 120), letters) for _ in range(150)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.array([ord(w) for t in texts for w in t], np.int64)
    begin, end, period = P.runs_of_words(words, first)
    text = np.searchsorted(first, begin, side="right") - 1
    got = [[] for _ in texts]
    for t, s, e, q in zip(text, begin - first[text], end - begin, period):
        got[t].append((s, e, q))
    assert got == [plain_runs(t) for t in texts]


def test_long_texts():
    """All words the same, Fibonacci words, and a long period: no quadratic work."""
    fib = ["a", "b"]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(3)
    phrase = [rng.randint(0, 10**6) for _ in range(30_000)]
    for words, wanted in (
        ([1] * 200_000, [(0, 200_000, 1)]),
        ([*range(5), *phrase * 5], [(5, 150_000, 30_000)]),
        ([ord(c) for c in fib[-1]], None),
    ):
        x = np.array(words, np.int64)
        begin, end, period = P.runs_of_words(x, np.array([0, len(x)]))
        if wanted:
            assert list(zip(begin, end - begin, period)) == wanted
        else:
            assert not len(begin)  # Fibonacci words have no fourth powers


def test_operator_and_defined_cases(spark, make_docs):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "é é é é é é x", "x a\tb\na b  a b a b a y",
             *(" ".join(some_words(rng, rng.randint(0, 60), "abc")) + " \n" for _ in range(60)), "q " * 3000]
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    docs = make_docs(*rows).withColumn("runs", F.lit("clash"))
    out = P.periodic_runs(docs).collect()
    wanted = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words)
        wanted.append((str(i), len(words), runs, plain_collapsed(words, runs)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out) == sorted(wanted)
    assert P.periodic_runs(docs.filter("false")).collect() == []


def plain_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, length, q in runs), plain_collapsed(words, runs),
    )]
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, *sha)


def test_query(spark, make_docs, tmp_path):
    rng = random.Random(7)
    texts = [None, "", *(" ".join(some_words(rng, rng.randint(1, 150), "abcd")) for _ in range(400))]
    make_docs(*texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.columns == names
    assert sorted(tuple(r) for r in out.collect()) == [plain_query(i, t) for i, t in enumerate(texts)]
