"""The stages one by one against plain versions of their decisions, on made-up documents."""

import random
import re

from pyspark.sql import functions as F
from test_decontamination import brute as passages
from test_jaccard_join import brute as near_copies
from test_tokens import crc, plain_ids

import corpus_pipeline as C
from linkscore.llm import quality_classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    common = "the of and to in is that it for on".split()
    return " ".join(
        rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("aeinorst", k=rng.randint(3, 8))) for _ in range(n)
    )


def corpus(rng):
    items = [prose(rng, 30) for _ in range(3)]
    texts = [prose(rng, rng.randint(60, 150)) for _ in range(60)]
    junk = [" ".join(w.upper() + "###" for w in prose(rng, 80).split()) for _ in range(30)]
    copies = [texts[1], texts[1] + " more", texts[2], re.sub(r"^\w+", "other", texts[2])]
    leaks = [f"{prose(rng, 40)} {items[i]} {prose(rng, 40)}" for i in range(3)]
    private = [f"{prose(rng, 50)} mail a.b@mail.example.com or +1 (437) 555-0689 {prose(rng, 20)}" for _ in range(2)]
    return items, texts, junk, copies, leaks, private


def test_stages(spark, make_docs, tmp_path):
    rng = random.Random(1)
    items, texts, junk, copies, leaks, private = corpus(rng)
    rows = list(enumerate([*texts, *junk, *copies, *leaks, *private]))
    folder = str(tmp_path)
    make_docs(*rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marked = [(i, int(i < 60)) for i in range(90)]
    spark.createDataFrame(marked, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text_of = dict(rows)
    now = list(text_of)
    results = []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        results.append(docs.collect())
        assert name == "packing" or docs.columns == COLUMNS

    scored = quality_classifier.score_quality(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    ).collect()
    now = [r["doc_id"] for r in scored if r["predicted"]]
    assert sorted(r["doc_id"] for r in results[0]) == sorted(now)
    assert not any(60 <= i < 90 for i in now) and sum(i < 60 for i in now) >= 57

    component = {d: c for d, _, c in near_copies([(i, text_of[i]) for i in now])}
    now = [i for i in now if component[str(i)] == str(i)]
    assert sorted(r["doc_id"] for r in results[1]) == sorted(now)
    assert not any(90 <= i < 94 for i in now)

    hit = {d for d, _ in passages([text_of[i] for i in now], items)}
    now = [i for k, i in enumerate(now) if k not in hit]
    assert {r["doc_id"]: r["text"] for r in results[2]} == {i: text_of[i] for i in now}
    assert not any(94 <= i < 97 for i in now)

    replaced = {r["doc_id"]: r["text"] for r in results[3]}
    assert sorted(replaced) == sorted(now)
    for i in now:
        assert (replaced[i] == text_of[i]) == (i < 97)
        assert "mail.example.com" not in replaced[i] and "555-0689" not in replaced[i]

    ids = {i: x + [0] for i, x in zip(now, plain_ids([replaced[i] for i in now], "byte_bpe_50k.json"))}
    pieces = {(r["doc_id"], r["start"]): r for r in results[4]}
    assert len(pieces) == len(results[4])
    assert {k: r["ids_crc32"] for k, r in pieces.items()} == {
        (i, s): crc(x[s : s + 1024]) for i, x in ids.items() for s in range(0, len(x), 1024)
    }
    assert len({r["sequence_id"] for r in results[4]}) < len(now)


def test_odd_tables(spark, make_docs, tmp_path):
    folder = str(tmp_path)
    rows = [(None, None), (None, "same"), (None, "same"), (3, "same"), (3, "other words"), (3, "same"), (4, "")]
    make_docs(*rows).withColumn("text", F.col("text")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    out = C.run(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["3", "4", "None", "None", "None"]


def test_empty_documents(spark, make_docs, tmp_path):
    folder = str(tmp_path)
    make_docs("x").filter("false").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert C.run(spark, folder).collect() == []
