"""Packing documents into sequences of a fixed number of tokens.

A document's ids (with an end id) are cut at multiples of the capacity. Full pieces are sequences of
their own. What remains of each document is packed by first-fit decreasing: the longest first, each
into the first sequence with room, which a tournament tree over the sequences' free room finds in
logarithmic time. This runs independently in randomised groups of documents, so no task sees more than
a group, and groups are large enough that little is lost at their ends.

A document's group comes from its place in the input (partition and row), not from its id or text: no
hot id, source or text makes a group large.

Defined cases: null and empty texts are one end id; rows with null or repeated ids are documents of
their own; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.llm.encoding import Encoder, tokenizer_path
from linkscore.llm.text_arrays import chunks
from linkscore.storage import materialized

CAPACITY = 1024
END_ID = 0
#: Documents that are packed together, about.
GROUP_DOCUMENTS = 8192


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several documents with the end id after each; the offsets of the result."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, its ``place`` in the input, and ``ids``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in chunks(whole, 8_000_000):
                ids, offsets = with_end(*encoder.encode(batch.column("text")), end_id)
                tokens = np.diff(offsets)
                count = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(tokens)), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(tokens[doc] - start, capacity)
                at = offsets[doc] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                places = row + np.arange(len(doc), dtype=np.int64)
                row += len(doc)
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(doc)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(sums, pa.int64()),
                    "doc_tokens": pa.array(tokens[doc]),
                    "place": pa.array(places),
                }
                if with_ids:
                    # Pieces lie one after the other, so the ids are in their order.
                    bounds = np.append(at, len(ids)).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, place long"
    return docs.select("doc_id", "text").mapInArrow(each, schema + ", ids array<int>" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, the items given longest first.

    ``room`` is a tournament tree: node i has the larger free room of nodes 2i and 2i + 1; the leaves
    are the bins, all empty at first. The way down prefers the left child, so it ends at the first bin
    with room.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def assign_sequences(cut: DataFrame, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Add sequence_id and offset to pieces. ``cut`` is read several times: hand in a table.

    Sequences of full pieces have odd numbers, those of groups even ones.
    """
    columns = [c for c in cut.columns if c != "place"]
    full = F.col("length") >= capacity
    alone = cut.filter(full).select(
        *columns, (F.col("place") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = cut.filter(~full)
    groups = max(1, -(-rest.count() // group_documents))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "place"], ascending=[False, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        ids = rows.pop("group").to_numpy() * (1 << 32) + bins
        return rows.drop(columns="place").assign(sequence_id=2 * ids, offset=offsets)

    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in columns)
    packed = (
        rest.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(pack, f"{kinds}, sequence_id long, offset long")
    )
    return alone.unionByName(packed)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their sequences, by the tokenizer and limits of the registered query."""
    cut = pieces(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=with_ids)
    return assign_sequences(materialized(cut, "pieces"))
