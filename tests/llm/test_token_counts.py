import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_tokens import PARTS, plain_ids

from linkscore.llm import token_counts as C
from linkscore.llm.encoding import tokenizer_path

NAME = "byte_bpe_50k.json"


def some_texts(n, longest, seed):
    random.seed(seed)
    parts = PARTS + ["r", "v", "l", "e", "s", "'", "ll", "the", "tion", "ed"]
    return ["".join(random.choices(parts, k=random.randint(0, longest))) for _ in range(n)]


def test_counts_of_the_library(monkeypatch):
    texts = [*some_texts(4000, 60, 3), None, "", "'", "'r", "a'", "\n", " \n ", "ab" * 20000, " " * 3000]
    counter = C.Counter(tokenizer_path(NAME))
    expected = [len(ids) for ids in plain_ids(texts, NAME)]
    for limit in (C.MAX_STATES, 10):  # with states kept, and forgotten after every batch
        monkeypatch.setattr(C, "MAX_STATES", limit)
        n_bytes, n_tokens = C.count_texts(pa.array(texts), counter)
        assert n_tokens.tolist() == expected
        assert n_bytes.tolist() == [len((t or "").encode()) for t in texts]


def test_chunks_do_not_matter():
    """Reading in chunks, whose maps are composed, marks what reading in one go does."""
    random.seed(5)
    classes = np.array(random.choices(range(C.CLASSES), k=5000), np.uint8)
    classes[1000:2500] = C.LETTER  # maps stay apart for long
    state, expected = C.START, np.zeros(5000, bool)
    for i, c in enumerate(classes.tolist()):
        mark = C.MARKS[state, c]
        expected[i] |= bool(mark & C.HERE)
        expected[i - 1] |= bool(mark & C.BEFORE)
        state = C.NEXT[state, c]
    for chunk in (7, 64, 512, 10000):
        assert (C.split_marks(classes, chunk) == expected).all()


def test_prefix_scan_composes_in_order():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, C.STATES, (37, C.STATES)).astype(np.uint8)
    so_far = np.arange(C.STATES)
    for row, scanned in zip(maps, C.prefix_scan(maps)):
        so_far = row[so_far]
        assert (scanned == so_far).all()


def test_query_form(make_docs):
    rows = [(None, "x y"), (3, None), (3, "x y"), (4, "")]
    docs = make_docs(*rows).withColumn("n_tokens", F.lit("clash"))
    out = C.count_tokens(docs, tokenizer_path(NAME)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(None, 3, 2), (3, 0, 0), (3, 3, 2), (4, 0, 0)]))
    assert C.count_tokens(docs.filter("false"), tokenizer_path(NAME)).collect() == []


def test_long_pretokens_are_read_by_themselves():
    """Random letters, other scripts and runs of one character, next to short ones, against the library."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (399, 400, 401, 5_000, 60_000)]
    words += ["".join(rng.choices("日本語学校電車時間東京", k=20_000)), "=" * 9_000, "the" * 4_000, "é" * 3_000]
    texts = [*words, " ".join(words), "short " + words[3] + " short"]
    counter = C.Counter(tokenizer_path(NAME))
    _, n_tokens = C.count_texts(pa.array(texts), counter)
    assert n_tokens.tolist() == [len(ids) for ids in plain_ids(texts, NAME)]
    assert len(counter.states) < 50_000
