"""Vectors of texts, kept from run to run, and scoring with them.

The store is append-only: a run encodes the texts that no recorded write has, puts their vectors in a
folder of its own, sorted by bucket and key, and records it (:mod:`linkscore.commits`). No file is ever written
again. Two writers that encode a text at the same time both keep their vector; the earlier version
counts.

Texts are looked for by key alone, which reads one column of the store. Vectors are read for the keys of
a run only: the keys' Bloom filter, or the keys themselves when they are few, drop the other rows before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore import commits
from linkscore.operators.providers import (
    Encoder,
    VectorSimilarity,
    distinct_texts,
    encode_texts,
    missing_texts,
)
from linkscore.operators.score import score_links, with_window
from linkscore.schemas import struct
from linkscore.storage import materialized

# Keys hash into so many folders of a write. The number is part of the layout.
KEY_BUCKETS = 64
STORED = "text_key string, vec array<float>, version bigint, writer string, bucket int"


class VectorStore:
    """Vectors by text key below ``path``; one encoder per store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), f"{path.rstrip('/')}_commits"

    def stored(self) -> DataFrame:
        """All rows of the recorded writes, a text more than once if two writers met."""
        folders = [r["folder"] for r in commits.recorded(self.spark, self.log)]
        if not folders:
            return self.spark.createDataFrame([], struct(STORED))
        return self.spark.read.schema(struct(STORED)).option("basePath", self.path).parquet(*folders)

    def vectors(self, wanted: DataFrame | None = None) -> DataFrame:
        """``(text_key, vec)``, unique in the key; with ``wanted`` (unique ``text_key``) only of those."""
        rows = self.stored()
        if wanted is not None:
            rows = rows.join(wanted.select("text_key"), "text_key", "left_semi")
        first = F.min_by("vec", F.struct("version", "writer"))
        return rows.groupBy("text_key").agg(first.alias("vec"))

    def add(self, texts: DataFrame, load_encoder: Callable[[], Encoder], writer: str = "run") -> int:
        """Encode those of ``texts`` (``text_key, text``) that the store does not have, and append them.

        Gives the number of texts encoded. The texts are written down and put in order before they are
        encoded, so that none is encoded twice for a look at the order.
        """
        missing = materialized(missing_texts(texts, self.stored()), "missing")
        n_rows = missing.count()
        if n_rows:
            version = commits.now()
            folder = f"{self.path}/version={version}/writer={writer}"
            bucket = F.pmod(F.xxhash64("text_key"), F.lit(KEY_BUCKETS)).cast("int")
            placed = missing.withColumn("bucket", bucket).repartitionByRange("bucket", "text_key")
            encoded = encode_texts(placed.sortWithinPartitions("bucket", "text_key"), load_encoder, "bucket")
            encoded.write.partitionBy("bucket").parquet(folder)
            commits.record(
                self.spark, self.log, f"{version}-{writer}",
                folder=folder, version=version, writer=writer, n_rows=n_rows,
            )
        return n_rows


def needed_texts(items: DataFrame, text: str = "processed_text", keyword: str = "keyword") -> DataFrame:
    """``(text_key, text)`` of everything that the scores of ``items`` need a vector of: their texts, the
    lowercased keywords, and the windows around them."""
    windowed = with_window(items, text, keyword)
    has_window = F.when(F.col("exact") > 0, F.col("context_text")).alias("_context")
    return distinct_texts(windowed.select(text, "_keyword", has_window), text, "_keyword", "_context")


def score_with_vectors(
    items: DataFrame, store: VectorStore, load_encoder: Callable[[], Encoder], writer: str = "run"
) -> DataFrame:
    """Items with their ``relevance_analysis`` by an encoder's vectors: those in the store, and new ones for
    texts that it does not have, which are added to it.

    Works on a table and in a queue stage alike. Items, texts and vectors are written down between the
    steps, so a step that fails is done again by itself.
    """
    items = materialized(items, "items")
    texts = materialized(needed_texts(items), "texts")
    store.add(texts, load_encoder, writer)
    vectors = materialized(store.vectors(texts), "vectors")
    return score_links(items, VectorSimilarity(vectors))
