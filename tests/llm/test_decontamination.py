import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkscore.llm import decontamination as D
from linkscore.llm.text_arrays import bytes_and_offsets


def plain(text):
    data, offsets = bytes_and_offsets(pa.array([text], pa.large_string()))
    return "".join(map(chr, D.normalised(data, offsets)[0]))


def edits_within(pattern, text):
    """Least edits between a pattern and any stretch of a text, row by row."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    found = set()
    for d, text in enumerate(docs):
        text = plain(text or "")
        for i, item in enumerate(items):
            item = plain(item or "").rstrip(" ")
            if len(item) < D.Q:
                continue
            for s in range(max(1, len(item) - D.WINDOW + 1)):
                w = item[s : s + D.WINDOW]
                if edits_within(w, text) <= int(D.budget(len(w))):
                    found.add((d, i))
                    break
    return found


def words(rng, n):
    return " ".join("".join(rng.choices("aeinorst", k=rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, share):
    out = []
    for c in text:
        x = rng.random()
        out.append(c if x > share else rng.choice(["", "x", c + "y"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, make_docs, seed):
    rng = random.Random(seed)
    items = [words(rng, rng.choice([2, 4, 9, 18, 25])) for _ in range(9)] + ["short", None, "éèà " * 12, "日本語 テスト🙂" * 3]
    docs = [None, "", "word"]
    for _ in range(30):
        item = rng.choice([i for i in items if i])
        start = rng.randint(0, max(0, len(item) - 70))
        cut = rng.choice([item, item[start : start + 70], item[:60]])
        share = rng.choice([0, 0.03, 0.06, 0.1, 0.15])
        docs.append(words(rng, rng.randint(0, 25)) + rng.choice([" ", "\n| ", ""]) + edited(rng, cut, share).upper() + " " + words(rng, rng.randint(0, 15)))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    out = D.find_passages(make_docs(*docs), table).collect()
    got = [(r["doc_id"], r["item_id"]) for r in out]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items)
    for r in out:
        raw = docs[r["doc_id"]].encode()
        assert 0 <= r["start"] < r["end"] <= len(raw)
        if r["edits"] == 0 and len(items[r["item_id"]]) <= D.WINDOW:
            assert plain(items[r["item_id"]]).strip() in plain(raw[r["start"] : r["end"]].decode())


def test_blocks_and_copies(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    items = [words(rng, 30) for _ in range(9)]
    docs = [items[0]] * 50 + [f"{words(rng, 2000)} {items[i % 9]} {words(rng, 2000)}" for i in range(20)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in D.find_passages(make_docs(*docs), table).collect()}
    assert whole == {(i, 0) for i in range(50)} | {(50 + i, i % 9) for i in range(20)}
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_passages(make_docs(*docs), table).collect()} == whole


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "some item that is long enough")], "item_id long, text string")
    assert D.find_passages(make_docs("some item that is long enough"), none).collect() == []
    assert D.find_passages(make_docs("x").filter("false"), some).collect() == []


@pytest.mark.parametrize("n", [8, 9, 12, 19, 21])
def test_texts_of_a_short_item_only(n):
    """Also the first and the last of several texts, and one that two texts have half of each."""
    item = "abcdefghijklmnopqrstu"[:n]
    long = "an item of some length sets how broad the bands of diagonals are, whatever the others " * 2
    indexes = D.indexes_of([item, long])
    for texts, want in (
        ([item, "some other text", "and one more"], [0]),
        (["some other text", item, "and one more"], [1]),
        ([item, item, item], [0, 1, 2]),
        (["", item, "", "x", item], [1, 4]),
        ([item[: n // 2], item[n // 2 :]], []),
    ):
        codes, offsets, _ = D.normalised(*bytes_and_offsets(pa.array(texts, pa.large_string())))
        out = D.occurrences(codes, offsets, indexes)
        assert out["text"].tolist() == want and set(out["item"].tolist()) <= {0}
        assert ["".join(map(chr, codes[x:y])) for x, y in zip(out["start"], out["end"])] == [item] * len(want)


@pytest.mark.parametrize(("n", "share", "least"), [(60, 0, 1.0), (75, 0, 1.0), (110, 0.02, 0.99), (160, 0.04, 0.99)])
def test_excerpts_are_found(n, share, least):
    """Stretches of a long item from anywhere, verbatim and with some characters changed."""
    rng = random.Random(n)
    items = [words(rng, 400) for _ in range(20)]
    indexes = D.indexes_of(items)
    texts = []
    for i in range(300):
        item = plain(items[i % 20]).strip()
        start = rng.randrange(len(item) - n)
        texts.append(f"{words(rng, 40)} {edited(rng, item[start : start + n], share)} {words(rng, 40)}")
    codes, offsets, _ = D.normalised(*bytes_and_offsets(pa.array(texts, pa.large_string())))
    out = D.occurrences(codes, offsets, indexes)
    found = set(zip(out["text"].tolist(), out["item"].tolist()))
    assert len(found & {(i, i % 20) for i in range(300)}) >= least * 300
    assert found <= {(i, i % 20) for i in range(300)}


def test_characters():
    texts = ["aé日🙂", "", "ÿĀ\u07ff\u0800\uffff\U0010ffff", "plain"]
    data, offsets = bytes_and_offsets(pa.array(texts))
    codes, at, begin = D.characters(data, offsets)
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(at, at[1:])] == texts
    assert len(begin) == sum(map(len, texts))
