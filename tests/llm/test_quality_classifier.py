import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkscore.llm import quality_classifier as Q
from linkscore.llm.quality_statistics import NAMES, statistics
from linkscore.llm.text_arrays import bytes_and_offsets


def good(rng):
    return " ".join("".join(rng.choices("aeinorst", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 120))) + "."


def bad(rng):
    words = good(rng).split()
    return rng.choice([lambda: " ".join(w + "###" for w in words), lambda: " ".join(w.upper() + "!!" for w in words), lambda: " ".join(words[:2] * 30)])()


def labelled(spark, make_docs, n=400):
    rng = random.Random(5)
    marks = [int(rng.random() < 0.7) for _ in range(n)]
    docs = make_docs(*(good(rng) if m else bad(rng) for m in marks))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    return docs, labels, marks


def test_held_out_accuracy(spark, make_docs):
    docs, labels, marks = labelled(spark, make_docs)
    out = Q.score_quality(docs.repartition(3), labels).collect()
    assert len(out) == len(marks)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r["predicted"] == marks[r["doc_id"]] for r in out if r["held_out"]]
    assert np.mean(held) > 0.95


def test_held_out_labels_are_not_learned_from(spark, make_docs):
    docs, labels, _ = labelled(spark, make_docs, 120)
    turned = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = ({r["doc_id"]: r["score"] for r in Q.score_quality(docs, x).collect()} for x in (labels, turned))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_density_against_the_plain_formula():
    rng = np.random.default_rng(2)
    x = {c: rng.normal(c, 1 + c, (50, 3)) for c in (0, 1)}
    sums = {c: (50.0, v.sum(axis=0), v.T @ v) for c, v in x.items()}
    model = Q.fit(sums)
    probe = rng.normal(0, 2, (9, 3))
    covs = [v.T @ v / 50 - np.outer(v.mean(0), v.mean(0)) for v in x.values()]
    pooled = (covs[0] + covs[1]) / 2
    logs = []
    for c, own in enumerate(covs):
        s = (1 - Q.POOLED - Q.DIAGONAL) * own + Q.POOLED * pooled + Q.DIAGONAL * np.diag(np.diag(own))
        s += Q.RIDGE * np.trace(pooled) / 3 * np.eye(3)
        d = probe - x[c].mean(0)
        logs.append(-0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_statistics_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "a", "é\né", *(rng.choice([good, bad])(rng) for _ in range(30)), "w " * 50000]
    together = statistics(*bytes_and_offsets(pa.array(texts)))
    assert together.shape == (len(texts), len(NAMES)) and np.isfinite(together).all()
    for t, row in zip(texts, together):
        assert np.allclose(statistics(*bytes_and_offsets(pa.array([t], pa.string())))[0], row)


def test_odd_tables(spark, make_docs):
    docs = make_docs((None, None), (1, "a b"), (1, "a b"), (2, "")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 0)], "doc_id long, quality int")
    out = Q.score_quality(docs, labels).collect()
    assert len(out) == 4 and len({r["score"] for r in out}) == 1
    assert Q.score_quality(docs, labels.filter("false")).first()["score"] == 1.0
    assert Q.score_quality(docs.filter("false"), labels).collect() == []
    assert Q.of_good_quality(docs, labels.filter("false")).count() == 4


def test_rows_of_one_id_are_learned_from_once(spark, make_docs):
    """Which of them does not depend on their order."""
    docs, labels, _ = labelled(spark, make_docs, 120)
    again = docs.withColumn("text", F.concat("text", F.lit(" other words here"))).filter("doc_id < 60")
    probe = docs.filter("doc_id >= 60")
    first, second = docs.unionByName(again), again.repartition(5).unionByName(docs.repartition(7))
    a, b = (
        {r["doc_id"]: r["score"] for r in Q.score_quality(d, labels).join(probe, "doc_id").collect()} for d in (first, second)
    )
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_triangular_solves():
    rng = np.random.default_rng(4)
    factor = np.tril(rng.normal(0, 1, (6, 6))) + 3 * np.eye(6)
    b = rng.normal(0, 1, (6, 9))
    assert np.allclose(factor @ Q.solved(factor, b), b)
