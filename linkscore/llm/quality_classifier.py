"""Quality classifier: regularised quadratic discriminant.

Every text becomes some statistics, transformed (logarithms, logits) towards normal distributions. A
class is a mean and a covariance that is shrunk towards its own diagonal and towards the pooled one. A
text's score is the posterior of class 1: the difference of the two log densities, from Mahalanobis
distances by triangular solves with Cholesky factors that are computed once and sent to the tasks.

Fitting needs the number, sum and sum of outer products of the statistics per class. Spark sums these
over all labelled rows that may be learned from, so nothing is sampled and only a few hundred numbers
reach the driver.

Defined cases: a null text is an empty one and is scored, too; labels for unknown documents and null
labels or ids in them are ignored; a document labelled twice counts once, with the mean label rounded
up; repeated documents are scored alike; of rows with one id and different texts the one of the smallest
statistics is learned from, all are scored; without labels of both classes every score is the share of
class 1 so far (1 without any label); empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.llm.quality_statistics import NAMES, statistics
from linkscore.llm.text_arrays import bytes_and_offsets, chunks
from linkscore.storage import materialized

THRESHOLD = 0.7
#: Bytes of texts worked on at once (or one longer text): places and marks take some 40 times it.
TEXT_BYTES = 1_000_000
#: Shares of the pooled covariance and of its own diagonal in the covariance of a class.
POOLED, DIAGONAL, RIDGE = 0.3, 0.1, 1e-3


def solved(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z with factor z = b for a lower triangular factor, all columns of b at once, row by row."""
    z = np.empty_like(b)
    for i, row in enumerate(factor):
        z[i] = (b[i] - row[:i] @ z[:i]) / row[i]
    return z


@dataclass
class Model:
    """Means, Cholesky factors, log determinants and log prior per class (0, 1)."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_priors: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, log_det, prior in zip(self.means, self.factors, self.log_dets, self.log_priors):
            z = solved(factor, (x - mean).T)
            logs.append(prior - 0.5 * log_det - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


@dataclass
class Constant:
    """What is left to say without labels of both classes."""

    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model | Constant:
    """Class to (rows, sum of x, sum of x xᵀ)."""
    rows = {c: s[0] for c, s in sums.items()}
    total = sum(rows.values())
    if not total or min(rows.get(0, 0), rows.get(1, 0)) < 2:
        return Constant(rows.get(1, 0) / total if total else 1.0)
    means, covariances = [], []
    for c in (0, 1):
        n, first, second = sums[c]
        means.append(first / n)
        covariances.append(second / n - np.outer(means[-1], means[-1]))
    pooled = sum(rows[c] / total * covariances[c] for c in (0, 1))
    size = np.trace(pooled) / len(pooled) + 1e-12
    factors = []
    for own in covariances:
        shrunk = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(own))
        factors.append(np.linalg.cholesky(shrunk + RIDGE * size * np.eye(len(own))))
    return Model(
        means,
        factors,
        [2 * np.log(np.diag(f)).sum() for f in factors],
        [np.log(rows[c] / total) for c in (0, 1)],
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): the statistics of every text, written down for the passes to come."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, TEXT_BYTES):
                x = statistics(*bytes_and_offsets(batch.column("text")))
                ids = batch.column("doc_id")
                # A null id is held out of learning: no label can name it.
                held = [i is None or zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
                flat = pa.array(x.astype(np.float64).ravel())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat
                )
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held, pa.bool_()), lists], ["doc_id", "held_out", "x"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, x array<double>"
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows with ``label`` and ``x`` to what ``fit`` needs: summed in the tasks, then by Spark."""
    d = len(NAMES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for c in np.unique(y):
                rows = np.column_stack([np.ones((y == c).sum()), x[y == c]])
                found[int(c)] = found.get(int(c), 0) + rows.T @ rows
        out = [(c, i, float(v)) for c, m in found.items() for i, v in enumerate(m.ravel())]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(col)) for col in zip(*out)], ["label", "i", "v"]
            )

    parts = labelled.select("label", "x").mapInArrow(each, "label long, i long, v double")
    cells = parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    sums = {}
    for c in {r["label"] for r in cells}:
        m = np.zeros((d + 1) * (d + 1))
        for r in cells:
            if r["label"] == c:
                m[r["i"]] = r["v"]
        m = m.reshape(d + 1, d + 1)
        sums[int(c)] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return sums


def learn(stated: DataFrame, labels: DataFrame) -> Model | Constant:
    """From rows of ``with_statistics`` that are not held out, and labels (doc_id, quality 0 or 1)."""
    known = (
        labels.select("doc_id", F.col("quality").cast("double"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("long").alias("label"))
    )
    labelled = stated.filter(~F.col("held_out")).join(known, "doc_id")
    return fit(class_sums(labelled.groupBy("doc_id", "label").agg(F.min("x").alias("x"))))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    stated = materialized(with_statistics(docs), "statistics")
    model = learn(stated, labels)
    d = len(NAMES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int"
    return stated.mapInArrow(each, schema)


def of_good_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with all columns. Texts are read again, not shuffled."""
    model = learn(materialized(with_statistics(docs), "statistics"), labels)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, TEXT_BYTES):
                score = model.score(statistics(*bytes_and_offsets(batch.column("text"))))
                yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(each, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
