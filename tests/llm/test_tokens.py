"""Encoding, packing and token files against the tokenizers library used plainly."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkscore.llm import packing as K
from linkscore.llm import token_files as T
from linkscore.llm.encoding import Encoder, tokenizer_path

PARTS = ["a", "é", " ", "\n", "'s", "'re", "''", "<|endoftext|>", "<|startoftext|>", " ", "　", "\x85", "日本",
         "9", "12", " the", "ing", "!?", "  ", "\t", "Ǆ", "́", "Σ", "\x1c", "\x0b", "İ", "🙂", "x" * 70, "\r\n", "ﬁ",
         "\x01", ".", "###", "é.", "×.", "the,"]


def some_texts(n, longest=40, seed=1):
    random.seed(seed)
    return [None, "", *("".join(random.choices(PARTS, k=random.randint(0, longest))) for _ in range(n))]


def plain_ids(texts, name):
    library = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    texts = some_texts(3000)
    encoder = Encoder(tokenizer_path(name))
    for _ in range(2):  # without and with pieces kept
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == plain_ids(texts, name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_pass_the_normalizer_by(name, monkeypatch):
    random.seed(3)
    letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    words = ["".join(random.choices(letters, k=random.randint(1, 20))) for _ in range(5000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 5000, 50)]
    texts += ["Eins, Été ×é µm ªº", "a\tb\nc É é", " don't  stop", "é̈ <|endoftext|> x É"]
    encoder = Encoder(tokenizer_path(name))
    seen, ids_of = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda part: seen.extend(part) or ids_of(part))
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == plain_ids(texts, name)
    # Only what is no blank and a word is read as text: the first words, and the few odd pieces.
    assert sum(map(len, seen)) < sum(map(len, texts)) / 10


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(make_docs):
    texts = [*some_texts(120, 900), "word " * 3000, *["copy"] * 30]
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    docs = make_docs(*rows).withColumn("start", F.lit("clash"))
    cut = K.pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=256).cache()
    out = K.assign_sequences(cut, capacity=256, group_documents=40).collect()
    wanted = sorted(
        ((str(i), s, crc((ids + [0])[s : s + 256]), len(ids) + 1))
        for (i, _), ids in zip(rows, plain_ids(texts, "byte_bpe_50k.json"))
        for s in range(0, len(ids) + 1, 256)
    )
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["doc_tokens"]) for r in out) == wanted
    sequences = {}
    for r in out:
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    tokens = sum(r["length"] for r in out)
    assert tokens / (256 * len(sequences)) > 0.9
    cut.unpersist()


def test_first_fit_decreasing_against_a_plain_search():
    random.seed(4)
    lengths = np.array(sorted((random.randint(1, 100) for _ in range(500)), reverse=True))
    bins, offsets = K.first_fit_decreasing(lengths, 128)
    used = []
    for length, b, o in zip(lengths.tolist(), bins, offsets):
        first = next((k for k, u in enumerate(used) if u + length <= 128), len(used))
        if first == len(used):
            used.append(0)
        assert (b, o) == (first, used[first])
        used[first] += length


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_grammar_round_trip(n):
    random.seed(n)
    phrases = [[random.randint(0, 99) for _ in range(random.randint(1, 6))] for _ in range(20)]
    ids = np.array([t for _ in range(n) for t in random.choice(phrases)][:20000] + [7] * (50 if n else 0))
    g = T.compress(ids.astype(np.int64))
    assert g.expand().tolist() == ids.tolist()
    assert n < 5000 or len(g.sequence) + 2 * len(g.rules) < len(ids) / 2
    for _ in range(30 if n else 0):
        a, b = sorted(random.randint(0, len(ids)) for _ in range(2))
        assert g.decode_range(a, b).tolist() == ids[a:b].tolist()


def test_token_files(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 500)
    texts = [*some_texts(200, 60, seed=9), "long " * 4000, *["same text"] * 20]
    rows = [((7 * i) % 1000 if i % 60 else None, t) for i, t in enumerate(texts)]
    docs = make_docs(*rows).repartition(5).withColumn("n_tokens", F.lit("clash"))
    folder = str(tmp_path / "tokens")
    T.write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"))
    out = T.read_token_files(spark, folder).collect()
    out.sort(key=lambda r: r["start"])
    wanted = [(i, ids + [2]) for (i, _), ids in zip(rows, plain_ids(texts, "word_bpe_49k.json"))]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == sorted((str(i), ids) for i, ids in wanted)
    end = 0
    for r in out:
        assert r["start"] == end and len(r["ids"]) == r["n_tokens"]
        end += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert ids == sorted(ids)
    digest = {r["start"]: r["ids_crc32"] for r in T.read_token_files(spark, folder, digest=True).collect()}
    assert digest == {r["start"]: crc(r["ids"]) for r in out}


def test_empty_tables(spark, make_docs, tmp_path):
    none = make_docs("x").filter("false")
    assert K.packed(none).collect() == []
    T.write_token_files(none, str(tmp_path / "t"), tokenizer_path("word_bpe_49k.json"))
    assert T.read_token_files(spark, str(tmp_path / "t")).collect() == []


def test_grammar_goes_on_until_no_pair_is_frequent():
    """A long passage in many copies is a few symbols each; no pair is left out for its hash or its round."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 40_000, 3_000)
    ids = np.concatenate([part for k in range(40) for part in (passage, [50_000 + k])])
    g = T.compress(ids)
    assert g.expand().tolist() == ids.tolist()
    assert len(g.sequence) < 200
    for ids in (rng.integers(0, 90, 60_000), np.full(5_000, 7)):
        g = T.compress(ids)
        assert g.expand().tolist() == ids.tolist()
        code = g.sequence[:-1].astype(np.int64) << 32 | g.sequence[1:]
        assert np.unique(code, return_counts=True)[1].max(initial=0) < T.LEAST_COUNT


def plain_re_pair(ids, least):
    """One pair at a time: the most frequent one, its places from the left."""
    x, symbol, n_rules = list(ids), max(ids) + 1, 0
    while True:
        counts, last = {}, {}
        for i, pair in enumerate(zip(x, x[1:])):
            if last.get(pair) != i - 1:  # overlapping places of one pair count once
                counts[pair] = counts.get(pair, 0) + 1
                last[pair] = i
            else:
                last[pair] = None
        best = max(counts, key=counts.get, default=None)
        if best is None or counts[best] < least:
            return len(x), n_rules
        out, i = [], 0
        while i < len(x):
            if tuple(x[i : i + 2]) == best:
                out.append(symbol)
                i += 2
            else:
                out.append(x[i])
                i += 1
        x, symbol, n_rules = out, symbol + 1, n_rules + 1


@pytest.mark.parametrize("seed", range(4))
def test_grammar_against_a_plain_re_pair(seed):
    rng = random.Random(seed)
    phrases = [[rng.randint(0, 30 * (seed + 1)) for _ in range(rng.randint(1, 12))] for _ in range(30)]
    ids = [t for _ in range(600) for t in rng.choice(phrases)]
    n_symbols, n_rules = plain_re_pair(ids, T.LEAST_COUNT)
    g = T.compress(np.array(ids))
    assert g.expand().tolist() == ids
    assert len(g.sequence) + 2 * len(g.rules) <= 1.1 * (n_symbols + 2 * n_rules)
