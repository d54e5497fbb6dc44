"""Where similarities come from: term frequencies, stored vectors, or a sentence model.

A provider adds one column, the similarity of two text columns, null where one of them is null.

* :class:`LexicalSimilarity` (default) compares term frequencies. It is computed in the row, with
  no shuffle. Its scores are *not* numerically those of a sentence model.
* :class:`VectorSimilarity` looks both texts up in an embedding table by key and takes the cosine
  of the vectors. With vectors of a sentence model in the table, so are the scores.
* :func:`refresh_embeddings` fills that table: it encodes only distinct texts that are not in it.
  :mod:`linkscore.operators.vector_store` keeps it from run to run.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscore.functions import similarity as sim
from linkscore.functions import text as tx
from linkscore.operators.skew import LEAST_PIECE, lookup_join
from linkscore.storage import materialized

Encoder = Callable[[list[str]], "list[list[float]]"]

# Workers get this module's code inside the pickled UDF, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The sentence model that the score formula is made for.
SENTENCE_MODEL = "all-MiniLM-L6-v2"


class Similarity(Protocol):
    def attach(
        self,
        table: DataFrame,
        left: str,
        right: str,
        name: str,
        tokens: str | None = None,
        norm2: str | None = None,
    ) -> DataFrame:
        """``table`` with the similarity of columns ``left`` and ``right`` as ``name``.

        ``tokens`` and ``norm2`` name columns with the tokens of ``left`` and their
        :func:`~linkscore.functions.similarity.term_norm2`, if there are such columns.
        """


class LexicalSimilarity:
    """Cosine of term frequencies of the lowercased tokens; 0 for a text without tokens."""

    def attach(
        self,
        table: DataFrame,
        left: str,
        right: str,
        name: str,
        tokens: str | None = None,
        norm2: str | None = None,
    ) -> DataFrame:
        terms = F.col(tokens) if tokens else tx.tokens(F.col(left))
        prepared = table.withColumns(
            {"_left_terms": terms, "_right_terms": tx.tokens(F.col(right))}
        )
        similarity = sim.term_cosine(
            F.col("_left_terms"), F.col("_right_terms"), F.col(norm2) if norm2 else None
        )
        return prepared.withColumn(name, similarity).drop("_left_terms", "_right_terms")


class VectorSimilarity:
    """Cosine of stored vectors; null when a text has no vector yet.

    ``embeddings`` has ``text_key, vec`` and is unique in ``text_key``. Similarities are looked up
    for the distinct pairs of texts only, by key, so neither texts nor repeats are joined.
    """

    def __init__(self, embeddings: DataFrame, hot_rows: int = LEAST_PIECE):
        self.embeddings = embeddings.select("text_key", "vec")
        self.hot_rows = hot_rows

    def _vectors(self, table: DataFrame, key: str, name: str) -> DataFrame:
        vectors = self.embeddings.select(F.col("text_key").alias(key), F.col("vec").alias(name))
        return lookup_join(table, vectors, key, self.hot_rows)

    def attach(
        self,
        table: DataFrame,
        left: str,
        right: str,
        name: str,
        tokens: str | None = None,
        norm2: str | None = None,
    ) -> DataFrame:
        pair_key = F.when(
            F.col(left).isNotNull() & F.col(right).isNotNull(),
            F.concat(text_key(F.col(left)), text_key(F.col(right))),
        )
        # Both tables below are read several times by the joins; writing them down is cheaper than
        # extracting and scoring the links again.
        keyed = materialized(table.withColumn("_pair", pair_key), "keyed")
        pairs = keyed.select("_pair").filter(F.col("_pair").isNotNull()).distinct()
        split = materialized(
            pairs.select(
                "_pair",
                F.substring("_pair", 1, 32).alias("_left"),
                F.substring("_pair", 33, 32).alias("_right"),
            ),
            "pairs",
        )
        with_left = self._vectors(split, "_left", "_left_vec")
        with_both = self._vectors(with_left, "_right", "_right_vec")
        similarities = with_both.select(
            "_pair", sim.cosine(F.col("_left_vec"), F.col("_right_vec")).alias(name)
        )
        return lookup_join(keyed, similarities, "_pair", self.hot_rows).drop("_pair")


def text_key(text: Column) -> Column:
    """Key of a text in the embedding table: MD5 of its UTF-8 bytes, in hex."""
    return F.md5(text.cast("binary"))


def distinct_texts(table: DataFrame, *columns: str) -> DataFrame:
    """``(text_key, text)`` of all texts in the given columns, each once.

    Repeats are dropped before the shuffle by the partial aggregate, however frequent a text is.
    """
    texts = None
    for column in columns:
        part = table.select(F.col(column).alias("text")).filter(F.col("text").isNotNull())
        texts = part if texts is None else texts.unionByName(part)
    return texts.select(text_key(F.col("text")).alias("text_key"), "text").distinct()


def missing_texts(texts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The texts that have no vector yet; both sides are unique in the key."""
    return texts.join(embeddings.select("text_key"), "text_key", "left_anti")


def encode_texts(texts: DataFrame, load_encoder: Callable[[], Encoder], *kept: str) -> DataFrame:
    """``(text_key, vec)`` and the columns ``kept``, the encoder being loaded once per Python worker, not
    per batch."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for batch in batches:
            yield pd.Series(list(encoder(batch.tolist())))

    return texts.select("text_key", encode("text").alias("vec"), *kept)


def refresh_embeddings(
    texts: DataFrame, embeddings: DataFrame, load_encoder: Callable[[], Encoder]
) -> DataFrame:
    """The embedding table with the missing texts encoded and added."""
    encoded = encode_texts(missing_texts(texts, embeddings), load_encoder)
    return embeddings.select("text_key", "vec").unionByName(encoded)


def letter_count_encoder(letters: str) -> Encoder:
    """Stands in for a sentence model where there is none: a text's vector is the number of each letter in
    it, and a half. The numbers can be checked by other means."""
    return lambda texts: [[text.count(letter) + 0.5 for letter in letters] for text in texts]


def sentence_model_encoder(model: str = SENTENCE_MODEL) -> Encoder:
    """Encoder of the sentence model; the library is optional and only needed on the workers."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as missing:
        raise RuntimeError("the sentence model needs the sentence_transformers package") from missing
    loaded = SentenceTransformer(model)
    return lambda texts: loaded.encode(texts, convert_to_numpy=True).tolist()
