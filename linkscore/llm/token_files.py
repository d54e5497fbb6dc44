"""Token ids in files, compressed by a grammar.

Documents are range-partitioned and sorted by doc_id; each partition is a shard. A shard's ids are
compressed in blocks by Re-Pair: in every round the frequent pairs of adjacent symbols get a new symbol
(a nonterminal) each, until no pair occurs ``LEAST_COUNT`` times. A block is the unit of a grammar: it
keeps its rules, the length that every nonterminal expands to, the remaining symbols, and the ids and
token counts of its documents. With the
expansion lengths, any stretch of tokens is found and decoded without the rest (``decode_range``).

The blocks are rows of a Parquet table, so any store that Spark writes to will do; it has the columns
of ``BLOCK``. Readers decode blocks independently; the number of tokens before a document comes from
sums per block and per shard, not from one pass over all.

Defined cases: null and empty texts are one end id; documents with one doc_id follow each other in the
order of a hash of their texts, null ids come first; an empty table gives a folder without blocks and
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscore.llm.encoding import Encoder, tokenizer_path
from linkscore.llm.packing import with_end
from linkscore.llm.text_arrays import chunks
from linkscore.storage import new_folder

END_ID = 2
#: Token ids in a block, about: what a task compresses and a reader decodes at once.
BLOCK_IDS = 2_000_000
#: A pair is replaced when it occurs so often; in a round, those at least one in so many times as often as
#: the most frequent one.
LEAST_COUNT, STEP_DOWN = 12, 32
_BITS = 20


@dataclass
class Grammar:
    """Symbols below ``base`` are ids; symbol base + k stands for the two symbols of rule k."""

    base: int
    rules: np.ndarray  # (k, 2), of earlier symbols
    sequence: np.ndarray
    pool: tuple | None = None

    def lengths(self) -> np.ndarray:
        """Tokens of each nonterminal."""
        out = np.empty(len(self.rules), np.int64)
        known = out.tolist()
        for k, (a, b) in enumerate(self.rules.tolist()):
            known[k] = sum(1 if s < self.base else known[s - self.base] for s in (a, b))
        return np.array(known, np.int64)

    def symbol_lengths(self, sequence: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        lengths = self.lengths() if lengths is None else lengths
        if not len(lengths):
            return np.ones(len(sequence), np.int64)
        return np.where(sequence < self.base, 1, lengths[np.maximum(sequence - self.base, 0)])

    def expand(self, sequence: np.ndarray | None = None) -> np.ndarray:
        """All tokens of a sequence of symbols.

        The tokens of every nonterminal are written down once, after those of the symbols it stands
        for; a sequence is then put together from these stretches.
        """
        x = self.sequence if sequence is None else sequence
        if not len(self.rules):
            return x.astype(np.int64)
        if self.pool is None:
            known: list[list[int]] = []
            for a, b in self.rules.tolist():
                front = [a] if a < self.base else known[a - self.base]
                known.append(front + ([b] if b < self.base else known[b - self.base]))
            lengths = np.array([len(k) for k in known], np.int64)
            at = np.cumsum(lengths) - lengths + self.base
            # In front of them every id stands for itself.
            flat = np.fromiter(chain.from_iterable(known), np.int32, int(lengths.sum()))
            self.pool = (
                np.concatenate([np.arange(self.base, dtype=np.int32), flat]),
                np.concatenate([np.arange(self.base), at]),
                np.concatenate([np.ones(self.base, np.int64), lengths]),
            )
        pool, at, lengths = self.pool
        width = lengths[x]
        ends = np.cumsum(width)
        return pool[np.repeat(at[x] - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]

    def decode_range(self, start: int, end: int, lengths: np.ndarray | None = None) -> np.ndarray:
        """Tokens start to end, expanding only the symbols that have some of them."""
        ends = np.cumsum(self.symbol_lengths(self.sequence, lengths))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left") + 1
        if start >= end:
            return np.empty(0, np.int64)
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.sequence[a:b])[start - before : end - before]


def _mixed_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    bucket = left.astype(np.uint32) * np.uint32(0x9E3779B1)
    bucket ^= right.astype(np.uint32) * np.uint32(0x85EBCA77)
    return (bucket * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - _BITS)


def _together(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both in the order of the first, then the second, which has so many bits at most. Sorting numbers made
    of both is several times faster than finding the order of one."""
    if len(first) and int(first.max()) >> (63 - bits):
        order = np.lexsort((second, first))
        return first[order], second[order]
    packed = (first.astype(np.int64) << bits) | second
    packed.sort()
    return packed >> bits, packed & ((1 << bits) - 1)


class _Pairs:
    """Places of the pairs that occur often enough, by pair; places that changed since are left out on use.

    A pair is one number, its left symbol times 2^``symbol_bits`` and its right one.
    """

    def __init__(self, n: int, base: int):
        # Every rule saves some symbols, so there are fewer rules than symbols at first.
        self.symbol_bits, self.place_bits = (base + n // (LEAST_COUNT // 2)).bit_length(), n.bit_length()
        self.places = np.empty(0, np.int32)  # with room behind the first ``held``
        self.held = 0
        self.codes, self.first, self.count = (np.empty(0, np.int64) for _ in range(3))

    def add(self, codes: np.ndarray, places: np.ndarray) -> None:
        """Pairs of these places; those with fewer than ``LEAST_COUNT`` are not kept."""
        if len(codes) < LEAST_COUNT:
            return
        codes, places = _together(codes, places, self.place_bits)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.diff(np.append(starts, len(codes)))
        often = counts >= LEAST_COUNT
        if not often.any():
            return
        kept = places[np.repeat(often, counts)]
        counts = counts[often]
        self.codes = np.concatenate([self.codes, codes[starts[often]]])
        self.first = np.concatenate([self.first, self.held + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        if self.held + len(kept) > len(self.places):
            room = np.empty(self.held // 2 + len(kept), np.int32)
            self.places = np.concatenate([self.places[: self.held], room])
        self.places[self.held : self.held + len(kept)] = kept
        self.held += len(kept)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of some pairs, pair by pair in ascending order, and for each the pair's place among them."""
        counts = self.count[numbers]
        which = np.repeat(np.arange(len(numbers)), counts)
        at = np.repeat(self.first[numbers] - (np.cumsum(counts) - counts), counts)
        at += np.arange(len(which))
        return self.places[at].astype(np.int64), which

    def keep(self, numbers: np.ndarray, places: np.ndarray, which: np.ndarray) -> None:
        """From now on, these are the places of these pairs, in the order of :meth:`of`."""
        counts = np.bincount(which, minlength=len(numbers))
        self.count[numbers] = counts
        at = np.repeat(self.first[numbers] - (np.cumsum(counts) - counts), counts)
        at += np.arange(len(places))
        self.places[at] = places

    def code(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << self.symbol_bits) | right

    def drop(self) -> None:
        alive = self.count >= LEAST_COUNT
        if not alive.all():
            self.codes, self.first, self.count = self.codes[alive], self.first[alive], self.count[alive]


def _frequent_pairs(x: np.ndarray, n: int, base: int) -> _Pairs:
    """The pairs of symbols that are left (not -1)."""
    pairs = _Pairs(n, base)
    left = np.flatnonzero(x[:-1] >= 0)
    if len(left) < 2:
        return pairs
    symbols = x[left]
    # A pair is at most as frequent as its bucket; those of the other buckets are not looked at.
    bucket = _mixed_pairs(symbols[:-1], symbols[1:])
    at = np.flatnonzero((np.bincount(bucket, minlength=1 << _BITS) >= LEAST_COUNT)[bucket])
    pairs.add(pairs.code(symbols[at], symbols[at + 1]), left[at])
    return pairs


def compress(ids: np.ndarray) -> Grammar:
    """Re-Pair, with the frequent pairs of a round replaced together. Of overlapping pairs the more
    frequent one is replaced, of equal ones the leftmost; so the most frequent pair always is.

    Pairs are counted once. After that a round touches only the places it replaces and their neighbours, which
    are found by the number of the next and the previous symbol that is left.
    """
    n = len(ids)
    x = np.append(ids, -1).astype(np.int32)
    base = symbol = int(x.max(initial=0)) + 1
    following, previous = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    rules: list[np.ndarray] = []
    while True:
        pairs = _frequent_pairs(x, n, base)
        # Places that waited may have become frequent pairs anew: counted again until there are none.
        if not len(pairs.codes):
            break
        before = symbol
        symbol = _replace_all(x, following, previous, pairs, rules, symbol)
        if symbol == before:
            break
    return Grammar(base, np.concatenate(rules) if rules else np.empty((0, 2), np.int32), x[:-1][x[:-1] >= 0])


def _replace_all(x, following, previous, pairs: _Pairs, rules: list, symbol: int) -> int:
    """Rounds of replacement until none of the pairs is frequent; gives the next free symbol."""
    while len(pairs.codes):
        often = np.flatnonzero(pairs.count >= max(LEAST_COUNT, int(pairs.count.max()) // STEP_DOWN))
        often = often[np.argsort(-pairs.count[often], kind="stable")]
        by_pair, ranks = pairs.of(often)
        left, right = (c.astype(np.int32) for c in np.divmod(pairs.codes[often], 1 << pairs.symbol_bits))
        # From the left; ``order`` leads back to the order by pair.
        at, order = _together(by_pair, np.arange(len(by_pair)), len(by_pair).bit_length())
        rank, behind = ranks[order], following[at]
        there = np.flatnonzero((x[at] == left[rank]) & (x[behind] == right[rank]))
        at, order, rank, behind = at[there], order[there], rank[there], behind[there]
        # Places of pairs that overlap a more frequent one wait for a later round.
        touch = behind[:-1] == at[1:]
        stays = np.ones(len(at), bool)
        stays[1:] &= ~(touch & (rank[1:] > rank[:-1]))
        stays[:-1] &= ~(touch & (rank[:-1] > rank[1:]))
        chosen = np.flatnonzero(stays)
        in_run = behind[chosen[:-1]] == at[chosen[1:]]
        if in_run.any():
            number = np.arange(len(chosen))
            first = number.copy()
            first[1:][in_run] = 0
            chosen = chosen[(number - np.maximum.accumulate(first)) % 2 == 0]
        # So do pairs of which too few places are left.
        enough = np.bincount(rank[chosen], minlength=len(often)) >= LEAST_COUNT
        if not enough.any() and len(chosen):
            counts = np.bincount(rank, minlength=len(often))
            enough[0] = counts[0] >= LEAST_COUNT
        chosen = chosen[enough[rank[chosen]]]
        waits = np.zeros(len(by_pair), bool)
        waits[order] = True
        waits[order[chosen]] = False
        pairs.keep(often, by_pair[waits], ranks[waits])
        at, rank, gone = at[chosen], rank[chosen], behind[chosen]
        if len(at):
            is_used = np.bincount(rank, minlength=len(often)) > 0
            used = np.flatnonzero(is_used)
            rules.append(np.column_stack([left[used], right[used]]))
            behind = following[gone]
            x[at], x[gone] = (symbol - 1 + np.cumsum(is_used))[rank], -1
            following[at] = behind
            previous[behind] = at
            symbol += len(used)
            # New pairs: with the symbol before, unless that is a replaced one, and with the one behind.
            before = previous[at]
            fresh = before >= 0
            fresh[1:] &= before[1:] != at[:-1]
            changed = np.concatenate([before[fresh], at[x[behind] >= 0]])
            pairs.drop()
            pairs.add(pairs.code(x[changed], x[following[changed]]), changed)
        else:
            pairs.drop()
    return symbol


BLOCK = (
    "shard int, block int, doc_ids array<{kind}>, tokens array<long>, n_tokens long, base int, "
    "rules binary, expansion_lengths binary, width int, sequence binary"
)


def _block_row(shard: int, number: int, doc_ids: list, tokens: np.ndarray, ids: np.ndarray) -> dict:
    grammar = compress(ids)
    width = 2 if grammar.sequence.max(initial=0) < 1 << 16 else 4
    return {
        "shard": shard,
        "block": number,
        "doc_ids": doc_ids,
        "tokens": tokens.tolist(),
        "n_tokens": len(ids),
        "base": grammar.base,
        "rules": grammar.rules.astype("<u4").tobytes(),
        "expansion_lengths": grammar.lengths().astype("<u4").tobytes(),
        "width": width,
        "sequence": grammar.sequence.astype(f"<u{width}").tobytes(),
    }


def grammar_of(row: dict) -> Grammar:
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    sequence = np.frombuffer(row["sequence"], f"<u{row['width']}").astype(np.int64)
    return Grammar(row["base"], rules, sequence)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write the blocks, in ascending order of doc_id over shards and blocks."""
    schema = BLOCK.format(kind=docs.schema["doc_id"].dataType.simpleString())
    kinds = [
        pa.int32(), pa.int32(), None, pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(),
        pa.binary(), pa.int32(), pa.binary(),
    ]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        shard, number = TaskContext.get().partitionId(), 0
        waiting: list[tuple[list, np.ndarray, np.ndarray]] = []

        def row(id_kind: pa.DataType) -> pa.RecordBatch:
            doc_ids = [i for part in waiting for i in part[0]]
            tokens, ids = (np.concatenate([part[k] for part in waiting]) for k in (1, 2))
            values = _block_row(shard, number, doc_ids, tokens, ids)
            types = [pa.list_(id_kind) if k is None else k for k in kinds]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values.values(), types, strict=True)], list(values)
            )

        id_kind = pa.int64()
        for whole in batches:
            id_kind = whole.column("doc_id").type
            for batch in chunks(whole, 8_000_000):
                ids, offsets = with_end(*encoder.encode(batch.column("text")), end_id)
                waiting.append((batch.column("doc_id").to_pylist(), np.diff(offsets), ids))
                if sum(len(part[2]) for part in waiting) >= BLOCK_IDS:
                    yield row(id_kind)
                    waiting, number = [], number + 1
        if waiting:
            yield row(id_kind)

    text_hash = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text", text_hash.alias("_h"))
        .repartitionByRange("doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h")
    )
    ordered.drop("_h").mapInArrow(each, schema).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, and the ``ids`` themselves or, for
    ``digest``, their unsigned CRC-32 as little-endian 32-bit numbers (``ids_crc32``)."""
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "block", "base", "rules", "width", "sequence")}
                doc_ids, tokens = (batch.column(c)[i].values for c in ("doc_ids", "tokens"))
                ids = grammar_of(row).expand().astype("<u4")
                ends = np.cumsum(tokens.to_numpy())
                starts = ends - tokens.to_numpy()
                n = len(ends)
                if digest:
                    raw = memoryview(ids).cast("B")
                    last = pa.array(
                        [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()
                    )
                else:
                    bounds = pa.array(np.append(0, ends).astype(np.int32))
                    last = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["shard"], np.int32)),
                        pa.array(np.full(n, row["block"], np.int32)),
                        doc_ids,
                        pa.array(starts),
                        tokens,
                        last,
                    ],
                    ["shard", "block", "doc_id", "_start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    last = "ids_crc32 long" if digest else "ids array<int>"
    decoded = blocks.select("shard", "block", "doc_ids", "tokens", "base", "rules", "width", "sequence").mapInArrow(
        each, f"shard int, block int, doc_id {kind}, _start long, n_tokens long, {last}"
    )
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_block"))
    offsets = sizes.join(shards, "shard").select(
        "shard", "block", (F.col("_shard") + F.col("_block")).alias("_before")
    )
    start = (F.col("_before") + F.col("_start")).alias("start")
    return decoded.join(offsets, ["shard", "block"]).select("doc_id", start, "n_tokens", last.split()[0])


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "tokens")
    write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, folder, digest=True)
