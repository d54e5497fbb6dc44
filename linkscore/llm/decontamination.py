"""Passages of benchmark items in documents, up to a budget of edits.

Texts are compared by characters: ASCII letters in lower case, all ASCII that is neither letter nor digit
as one space, the rest as it is. A passage of an item occurs when some stretch of a text is within
``EDIT_SHARE`` of its characters in edits; passages are all windows of ``WINDOW`` characters, wherever they
begin in the item, and whole items where those are shorter.

Q-gram lemma: with k edits, at least n - q + 1 - k*q of a window's q-grams remain, all of them on
diagonals (place in the text minus place in the item) that differ by at most k. So

1. places whose q-gram is in no item are dropped, and those around which even all hits are too few;
2. hits are sorted by band of diagonals and place in the item; bands overlap by half, so every
   occurrence lies within one of them. A hit stays if enough different places follow it within a window;
3. of what is left, windows are verified by alignment within the band: for each text and item first the
   one with the most hits, and only if that fails the others that may begin there.

The first two lose nothing, and of the windows that the third may pass over none is needed: one passage of an
item is enough. Surely found is every verbatim excerpt of ``WINDOW`` characters or more.

Documents stay where they are; an index of a block of items is broadcast. Blocks are bounded in bytes. One
block, the usual case, is one pass over the documents; of several, each is a pass by itself, whose result is
written down and whose index is given up before the next one is made.

Defined cases: null and empty texts have no passages; items that are null or have fewer than q characters
are ignored, items of fewer than 20 must occur exactly; repeated rows are reported each; several passages of
one item in a text are one row; empty tables give an empty result; columns other than doc_id, text, item_id
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.llm.text_arrays import bytes_and_offsets, chunks
from linkscore.storage import materialized

Q = 8
WINDOW = 60
EDIT_SHARE = 0.08
#: Bytes of item texts that are broadcast at once.
BLOCK_BYTES = 8_000_000
#: Bytes of texts worked on at once (or one longer text): characters, hashes and places take some 70 times it.
TEXT_BYTES = 1_000_000
#: Hits and windows worked on at once.
HITS, ALIGNED = 200_000, 2_000
_BITS = 22

_MAP = np.full(128, 32, np.uint32)
for _b in range(128):
    if chr(_b).isalnum():
        _MAP[_b] = ord(chr(_b).lower())


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, offsets of the texts in them, and the byte each one begins at."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[begin]
    codes = lead.astype(np.uint32)
    longer = np.flatnonzero(lead >= 0xC0)
    at, first = begin[longer], codes[longer]
    width = 2 + (first >= 0xE0) + (first >= 0xF0)
    value = first & (0x7F >> width).astype(np.uint32)
    for k in (1, 2, 3):
        more = data[np.minimum(at + k, len(data) - 1)] & np.uint8(0x3F)
        value = np.where(width > k, (value << np.uint32(6)) | more, value)
    codes[longer] = value
    return codes, np.searchsorted(begin, offsets), begin


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters to compare, offsets of the texts in them, and the bytes they begin at, and the end."""
    codes, offsets, begin = characters(data, offsets)
    plain = np.where(codes < 128, _MAP[np.minimum(codes, 127)], codes)
    space = plain == 32
    keep = np.ones(len(plain), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1][offsets[:-1] < len(plain)]
    keep[starts] = ~space[starts]
    source = np.flatnonzero(keep)
    return plain[source], np.searchsorted(source, offsets), np.append(begin, len(data))[np.append(source, len(codes))]


def q_grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 8 characters from each place on (fewer places than characters by 7)."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    h = codes.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = h[:-step] * np.uint64(factor) + h[step:]
    return h ^ (h >> np.uint64(29))


def budget(n):
    """Edits allowed in a window of n characters."""
    return np.where(np.asarray(n) < 20, 0, (np.asarray(n) * EDIT_SHARE).astype(np.int64))


def least_shared(n):
    """Q-grams of a window of n characters that remain within its budget, at least."""
    return np.maximum(1, n - Q + 1 - budget(n) * Q)


@dataclass
class Index:
    """Items of similar length, one after the other, and where each q-gram is in them."""

    items: np.ndarray  # position of each item in the block
    starts: np.ndarray  # of the items in ``codes``, and the end
    codes: np.ndarray
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram in ``places``, and the end
    places: np.ndarray
    table: np.ndarray  # by the upper bits of a hash: whether some q-gram has them
    lengths: np.ndarray  # of the windows of each item

    @classmethod
    def of(cls, items: list[int], texts: list[np.ndarray]) -> Index:
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.concatenate(texts)
        every = q_grams(codes)
        inside = np.ones(len(codes), bool)
        inside[(starts[1:, None] - np.arange(1, Q)).ravel()] = False
        place = np.flatnonzero(inside[: len(every)])
        order = np.argsort(every[place], kind="stable")
        place = place[order]
        grams, first = np.unique(every[place], return_index=True)
        table = np.zeros(1 << _BITS, bool)
        table[_hashed(grams)] = True
        return cls(
            np.array(items), starts, codes, grams, np.append(first, len(place)), place, table,
            np.minimum(sizes, WINDOW),
        )

    def item_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _hashed(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def indexes_of(texts: list[str]) -> list[Index]:
    """An index of the items that are to occur exactly, of the other short ones, and of the long ones: what
    is needed of a short item would let too much of the others through."""
    codes, offsets, _ = normalised(*bytes_and_offsets(pa.array(texts, pa.large_string())))
    kinds: dict[int, tuple[list, list]] = {}
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        while b > a and codes[b - 1] == 32:
            b -= 1
        if b - a >= Q:
            items, found = kinds.setdefault((b - a >= 20) + (b - a >= WINDOW), ([], []))
            items.append(i)
            found.append(codes[a:b])
    return [Index.of(*kind) for kind in kinds.values()]


_NAMES = ("text", "item", "start", "end", "edits")


def _nothing() -> dict[str, np.ndarray]:
    return {n: np.empty(0, np.int64) for n in _NAMES}


def occurrences(codes: np.ndarray, offsets: np.ndarray, indexes: list[Index]) -> dict[str, np.ndarray]:
    """All (text, item) with a window within budget: text, item, start and end of its hits in ``codes``, edits."""
    grams = q_grams(codes)
    whole = np.ones(len(codes), bool)
    last = offsets[1:, None] - np.arange(1, Q)
    whole[last[last >= offsets[:-1, None]]] = False  # q-grams that go on in the next text are in no passage
    parts = [_in_index(codes, offsets, grams, whole[: len(grams)], index) for index in indexes]
    if not parts:
        return _nothing()
    joined = {n: np.concatenate([p[n] for p in parts]) for n in _NAMES}
    order = np.lexsort((joined["item"], joined["text"]))
    return {n: v[order] for n, v in joined.items()}


def _in_index(codes, offsets, grams, whole, index: Index) -> dict[str, np.ndarray]:
    hits = np.flatnonzero(index.table[_hashed(grams)] & whole)
    if not len(hits):
        return _nothing()
    found = np.minimum(np.searchsorted(index.grams, grams[hits]), len(index.grams) - 1)
    same = index.grams[found] == grams[hits]
    hits, found = hits[same], found[same]
    # Within the reach of a window there must be as many hits as the least demanding one needs.
    need = int(least_shared(index.lengths).min())
    reach = int((index.lengths + budget(index.lengths)).max()) - Q
    if len(hits) < need:
        return _nothing()
    first = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] <= reach)
    marks = np.zeros(len(hits) + 1, np.int32)
    np.add.at(marks, first, 1)
    np.add.at(marks, first + need, -1)
    dense = np.cumsum(marks[:-1]) > 0
    hits, found = hits[dense], found[dense]
    parts = []
    a = 0
    while a < len(hits):
        # Hits of an occurrence may lie on both sides of a border, so parts overlap by its reach.
        end = min(len(hits), a + HITS)
        to = int(np.searchsorted(hits, hits[end - 1] + 2 * (reach + Q), side="right"))
        parts.append(_verified(codes, offsets, index, hits[a:to], found[a:to]))
        a = end
    if not parts:
        return _nothing()
    joined = {n: np.concatenate([p[n] for p in parts]) for n in _NAMES}
    # One row per text and item.
    order = np.lexsort((joined["start"], joined["item"], joined["text"]))
    joined = {n: v[order] for n, v in joined.items()}
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(joined["text"]) != 0) | (np.diff(joined["item"]) != 0)
    at = np.flatnonzero(new)
    if not len(at):
        return _nothing()
    return {
        "text": joined["text"][at],
        "item": index.items[joined["item"][at]],
        "start": joined["start"][at],
        "end": np.maximum.reduceat(joined["end"], at),
        "edits": np.minimum.reduceat(joined["edits"], at),
    }


def _verified(codes, offsets, index: Index, hits, found) -> dict[str, np.ndarray]:
    width = int(budget(index.lengths).max()) + 1
    total = len(index.codes) + 2 * WINDOW  # no window goes from one band into the next
    bits = int(2 * width - 1).bit_length()
    count = index.first[found + 1] - index.first[found]
    at = np.repeat(index.first[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    place, position = index.places[at], np.repeat(hits, count)
    diagonal = position - place
    low = int(diagonal.min()) - width
    band, inside = np.divmod(diagonal - low, width)
    # Each hit counts in the band that starts at or before its diagonal and in the one before that.
    keys = np.concatenate([
        ((band * total + place) << bits) | inside,
        (((band - 1) * total + place) << bits) | (inside + width),
    ])
    keys.sort()
    cell = keys >> bits
    once = np.ones(len(cell), bool)
    once[1:] = cell[1:] != cell[:-1]
    keys, cell = keys[once], cell[once]
    band, place = np.divmod(cell, total)
    position = low + band * width + place + (keys & ((1 << bits) - 1))
    item = index.item_of(place)
    length = index.lengths[item]
    # Hits that follow within a window of the same item; a short item is one window.
    short = np.diff(index.starts)[item] < WINDOW
    until = np.where(short, index.starts[item + 1] - Q, np.minimum(place + WINDOW - Q, index.starts[item + 1] - Q))
    shared = np.searchsorted(cell, band * total + until, side="right") - np.arange(len(cell))
    enough = np.flatnonzero(shared >= least_shared(length))
    if not len(enough):
        return _nothing()
    final = enough + shared[enough] - 1
    text = np.searchsorted(offsets, position[enough], side="right") - 1
    other = np.searchsorted(offsets, position[final], side="right") - 1
    # Windows that have all hits needed, from the earliest to the latest start.
    item, needed = item[enough], enough + least_shared(length[enough]) - 1
    start, end = index.starts[item], index.starts[item + 1]
    length = length[enough]
    latest = np.clip(place[enough], start, end - length)
    earliest = np.clip(np.minimum(place[needed] + Q - length, latest), start, end - length)
    candidates = {
        "text": text, "item": item, "band": band[enough], "latest": latest, "earliest": earliest,
        "length": length, "shared": shared[enough], "start": position[enough], "end": position[final] + Q,
    }
    across = text != other
    if across.any():
        # Hits of two texts: the window may be in either.
        more = {k: v[across] for k, v in candidates.items()} | {"text": other[across]}
        candidates = {k: np.concatenate([v, more[k]]) for k, v in candidates.items()}
    return _best_windows(codes, offsets, index, candidates, low, width)


def _best_windows(codes, offsets, index: Index, c: dict[str, np.ndarray], low: int, width: int):
    """For each text and item with a window within budget: the extent of its hits and the window's edits."""
    order = np.lexsort((-c["shared"], c["item"], c["text"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(c["text"]) != 0) | (np.diff(c["item"]) != 0)
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    edits = np.full(len(at), 1 << 20)

    def align(rows: np.ndarray, starts: np.ndarray) -> None:
        for a in range(0, len(rows), ALIGNED):
            r, s = rows[a : a + ALIGNED], starts[a : a + ALIGNED]
            found = _aligned(
                codes, offsets, index, s, c["length"][r], low + c["band"][r] * width, c["text"][r], width
            )
            fits = found <= budget(c["length"][r])
            np.minimum.at(edits, group[r[fits]], found[fits])

    align(at, c["latest"][at])
    rows = np.flatnonzero(edits[group] > WINDOW)
    rows = rows[~new[rows]]
    align(rows, c["latest"][rows])
    # Windows that begin before the first hit; the same one may be told by several hits.
    rows = np.flatnonzero(edits[group] > WINDOW)
    count = c["latest"][rows] - c["earliest"][rows]
    rows = np.repeat(rows, count)
    starts = c["earliest"][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    if len(rows):
        which = np.lexsort((starts, c["band"][rows], group[rows]))
        rows, starts = rows[which], starts[which]
        differ = np.ones(len(rows), bool)
        differ[1:] = (np.diff(starts) != 0) | (np.diff(c["band"][rows]) != 0) | (np.diff(group[rows]) != 0)
        align(rows[differ], starts[differ])
    good = edits <= WINDOW
    # The extent is that of all hits that may belong to a window, in their text.
    first = np.minimum.reduceat(c["start"], at)[good]
    last = np.maximum.reduceat(c["end"], at)[good]
    text = c["text"][at][good]
    return {
        "text": text,
        "item": c["item"][at][good],
        "start": np.maximum(first, offsets[text]),
        "end": np.minimum(last, offsets[text + 1]),
        "edits": edits[good],
    }


def _aligned(codes, offsets, index: Index, starts, lengths, first, text, width) -> np.ndarray:
    """Least edits between windows of items and stretches of their texts within a band of diagonals.

    Column j of row i stands for the text's character first - margin + start + i + j: the band moves along
    with the window, so all candidates take the same steps. Going on in the text within a row is a running
    minimum of cost minus column.
    """
    margin = width - 1
    columns = 2 * width + 2 * margin + 1
    n = len(starts)
    j = np.arange(columns)
    begin, end = offsets[text][:, None], offsets[text + 1][:, None]
    corner = (first + starts - margin)[:, None] + j
    cost = np.zeros((n, columns), np.int32)
    best = np.full(n, 1 << 20)
    longest = int(lengths.max(initial=0))
    for i in range(longest):
        place = corner + i
        inside = (place >= begin) & (place < end)
        char = codes[np.clip(place, 0, len(codes) - 1)]
        mine = index.codes[np.minimum(starts + i, len(index.codes) - 1)][:, None]
        # Matched or replaced: from the same column; left out of the text: from the next one.
        across = cost + np.where(inside, (char != mine).astype(np.int32), 1 << 16)
        across[:, :-1] = np.minimum(across[:, :-1], cost[:, 1:] + 1)
        # More of the text: from the column to the left.
        cost = np.minimum.accumulate(across - j, axis=1) + j
        over = lengths == i + 1
        if over.any():
            best[over] = cost[over].min(axis=1)
    return best


def blocks_of(benchmark: DataFrame) -> Iterator[tuple[list, list[Index], bool]]:
    """Item ids and indexes of each block of items, and whether it is the only one."""
    texts = benchmark.select("item_id", "text").dropna(subset=["text"])
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // BLOCK_BYTES))
    texts = texts.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    for number in range(n_blocks):
        rows = texts.filter(F.col("_block") == number).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], indexes_of([r["text"] for r in rows]), n_blocks == 1


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item with a passage of it: doc_id, item_id, start and end (bytes of the
    document's UTF-8 text, from the first hit of a window to the last), and edits of the best window."""
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id"))}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start long, end long, edits long"

    def one_block(ids: list, shared) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = shared.value
            for whole in batches:
                for batch in chunks(whole, TEXT_BYTES):
                    data, raw = bytes_and_offsets(batch.column("text"))
                    codes, offsets, source = normalised(data, raw)
                    found = occurrences(codes, offsets, indexes)
                    if not len(found["text"]):
                        continue
                    begin = raw[found["text"]]
                    last = source[found["end"] - 1]
                    width = 1 + (data[last] >= 0xC0).astype(int) + (data[last] >= 0xE0) + (data[last] >= 0xF0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(found["text"])),
                            pa.array([ids[i] for i in found["item"].tolist()]),
                            pa.array(source[found["start"]] - begin),
                            pa.array(last + width - begin),
                            pa.array(found["edits"]),
                        ],
                        ["doc_id", "item_id", "start", "end", "edits"],
                    )

        return docs.select("doc_id", "text").mapInArrow(each, schema)

    parts = []
    for ids, indexes, only in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        parts.append(one_block(ids, shared))
        if not only:
            parts[-1] = materialized(parts[-1], "passages")
            shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no item occurs, with all columns."""

    def one_block(rows: DataFrame, shared) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = shared.value
            for whole in batches:
                for batch in chunks(whole, TEXT_BYTES):
                    codes, offsets, _ = normalised(*bytes_and_offsets(batch.column("text")))
                    clean = np.ones(batch.num_rows, bool)
                    clean[occurrences(codes, offsets, indexes)["text"]] = False
                    yield batch.filter(pa.array(clean))

        return rows.mapInArrow(each, rows.schema)

    for _, indexes, only in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        docs = one_block(docs, shared)
        if not only:
            docs = materialized(docs, "clean")
            shared.destroy()
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
