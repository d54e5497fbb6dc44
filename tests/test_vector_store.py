"""Vectors kept from run to run, and runs scored with them."""

import math
import os
from functools import partial

import pytest
from pyspark.sql import functions as F

from linkscore import commits
from linkscore.operators import providers, vector_store
from linkscore.operators.vector_store import VectorStore
from linkscore.plans import runs

load = partial(providers.letter_count_encoder, "aeko")


def texts_of(spark, *texts):
    return providers.distinct_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t")


def files_of(path):
    return {(d, f, os.stat(f"{d}/{f}").st_mtime_ns) for d, _, names in os.walk(path) for f in names}


def test_only_new_texts_are_encoded_and_appended(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "vectors"))
    assert store.vectors().collect() == []
    assert store.add(texts_of(spark, "a", "b", "b", None, "ü"), load) == 3
    before = files_of(tmp_path)
    assert store.add(texts_of(spark, "b", "a"), load) == 0
    assert files_of(tmp_path) == before
    assert store.add(texts_of(spark, "koala", "a"), load) == 1
    assert before <= files_of(tmp_path)
    found = {r["text_key"]: list(r["vec"]) for r in store.vectors().collect()}
    keys = {t: k for k, t in texts_of(spark, "a", "b", "ü", "koala").collect()}
    assert {t: found[k] for t, k in keys.items()} == {t: load()([t])[0] for t in keys}
    wanted = texts_of(spark, "koala", "nowhere")
    assert [r["text_key"] for r in store.vectors(wanted).collect()] == [keys["koala"]]


def test_writers_that_meet_and_writes_that_fail(spark, tmp_path, monkeypatch):
    """Both writers see the store without the text; the earlier vector counts. What is not recorded is not there."""
    store = VectorStore(spark, str(tmp_path / "vectors"))
    empty = store.stored()
    assert store.add(texts_of(spark, "a", "b"), load, "one") == 2
    with monkeypatch.context() as m:
        m.setattr(VectorStore, "stored", lambda self: empty)
        assert store.add(texts_of(spark, "b", "c"), partial(providers.letter_count_encoder, "zzzz"), "two") == 2
    assert store.stored().count() == 4
    found = {r["text_key"]: list(r["vec"]) for r in store.vectors().collect()}
    keys = {t: k for k, t in texts_of(spark, "b", "c").collect()}
    assert len(found) == 3 and found[keys["b"]] == load()(["b"])[0] and found[keys["c"]] == [0.5] * 4

    def fails(*_, **__):
        raise RuntimeError("the job died")

    with monkeypatch.context() as m:
        m.setattr(commits, "record", fails)
        with pytest.raises(RuntimeError):
            store.add(texts_of(spark, "d"), load)
    assert store.stored().count() == 4
    assert store.add(texts_of(spark, "d"), load) == 1


def plain_score(text, keyword):
    def cosine(a, b):
        a, b = load()([a, b])
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    def squash(x):
        return 1 / (1 + math.exp(-8 * x))

    exact, context = float(keyword in text.lower()), 0.0
    words = text.lower().split()
    for i, word in enumerate(words):
        if exact and word == keyword:
            context = squash(cosine(" ".join(words[max(0, i - 3) : i + 4]), keyword))
    return 1 / (1 + math.exp(-10 * (0.5 * exact + 0.3 * squash(cosine(text, keyword)) + 0.2 * context - 0.6)))


@pytest.mark.parametrize("few", [True, False])
def test_runs_with_an_encoder(spark, tmp_path, monkeypatch, few):
    """Two runs; the second one encodes the new keyword and its windows only."""
    if not few:
        monkeypatch.setattr(runs.tg, "MAX_BROADCAST_URLS", 0)
    body = "<body><p>About koala care</p><a href='/koala'>Koala care and food</a><a href='/x'>other ok</a></body>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", body) for i in range(3)], "page_id bigint, url string, html string")
    store = VectorStore(spark, str(tmp_path / "vectors"))
    counts = []
    for keywords in (["Koala"], ["Koala", "care"], ["Koala", "care"]):
        targets = pages.select("url", F.explode(F.array(*map(F.lit, keywords))).alias("keyword"))
        items = runs.run(pages, targets, vectors=store, load_encoder=load).items.collect()
        assert len(items) == 6 * len(keywords)
        for r in items:
            wanted = plain_score(r["processed_text"], r["keyword"].lower())
            assert r["relevance_analysis"]["score"] == pytest.approx(wanted, abs=1e-6)
        counts.append(store.stored().count())
    assert counts[0] < counts[1] == counts[2]
    written = [r["n_rows"] for r in commits.recorded(spark, store.log)]
    assert sum(written) == counts[2] and len(written) == 2


def test_needed_texts(spark):
    rows = [("One kw Two", "KW"), ("kwkw", "KW"), ("nothing", "KW"), (None, "KW"), ("x", None)]
    items = spark.createDataFrame(rows, "processed_text string, keyword string")
    found = {r["text"] for r in vector_store.needed_texts(items).collect()}
    assert found == {"One kw Two", "kwkw", "nothing", "x", "kw", "one kw two"}
