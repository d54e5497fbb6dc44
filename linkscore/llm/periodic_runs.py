"""Runs of repeating words inside documents, and texts with the repetitions taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no
neighbouring word extends; runs of at least ``max(LEAST_WORDS, LEAST_PERIODS * q)`` words are reported.
They are found by the branching-tandem test over an enhanced suffix array, without tree nodes:

1. A word of a reported run is repeated: the word four times in its document, the two and three words
   from it on three times. Only stretches of such words go on; the others are in no run.
2. Suffixes of the stretches are sorted by prefix doubling. The ranks of all rounds give the lengths of
   the prefixes that neighbours share (LCP).
3. Every LCP value d parts an interval of suffixes that share d words in two. For each suffix i of the
   smaller part, ISA[i + d] or ISA[i - d] in the larger one tells a square of period d that the next
   word ends: the last square of a run. Smaller parts add up to at most n log n suffixes.
4. Squares are rotated to the left, word by word while it matches, to the start of their run. Squares
   of a multiple of a run's period that lie in the run are merged with it.

All documents of a slice of an Arrow batch are worked on together; their words have different numbers, so
nothing is shared between documents. Memory is in proportion to the slice, or to its longest text.
Documents stay where they are: no shuffle.

Defined cases: null and empty texts and texts of white space have no words, no runs and an empty
collapsed text; repeated rows and null ids are handled row by row; an empty table gives an empty
result; columns other than doc_id and text are not read, so extra columns do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.llm.text_arrays import bytes_and_offsets, chunks, space_mask, word_bounds

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Suffixes tested at once.
TESTS = 2_000_000


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers, from 0 on."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = data[~space_mask(data)]
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters))]
    )
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key among the distinct ones, and how often each of these occurs."""
    _, ranks, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return ranks, counts


def _stretches(good: np.ndarray, least: int) -> np.ndarray:
    """``good`` without its stretches of fewer than ``least`` places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    short = ends - starts < least
    marks = np.zeros(len(good) + 1, np.int32)
    marks[starts[short]] += 1
    marks[ends[short]] -= 1
    return good & (np.cumsum(marks[:-1]) == 0)


def candidates(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word may be in a run: stretches of words, pairs and triples that repeat in their text.

    A pair or triple over the border of two texts occurs once, so it is in no stretch.
    """
    ranks, counts = _ranked(text * (int(words.max(initial=0)) + 1) + words)
    good = _stretches(counts[ranks] >= LEAST_PERIODS, LEAST_WORDS)
    for width in (2, 3):
        at = np.flatnonzero(good[:-1] & good[1:])
        number, counts = _ranked(ranks[at] * (int(ranks.max(initial=0)) + 1) + ranks[at + 1])
        good = np.zeros(len(good), bool)
        good[at[counts[number] >= LEAST_PERIODS - 1]] = True
        good = _stretches(good, LEAST_WORDS - width + 1)
        ranks[at] = number
    for shift in (1, 1):
        good[shift:] |= good[:-shift]
    return good


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, their ranks, and the LCP of each with the one before it (0 for the first).

    Stretches in ``x`` end with a number that occurs once.
    """
    n = len(x)
    levels = [_ranked(x)[0]]
    while levels[-1].max() < n - 1:
        last, width = levels[-1], 1 << (len(levels) - 1)
        behind = np.zeros(n, np.int64)
        behind[: n - width] = last[width:] + 1
        levels.append(_ranked(last * np.int64(n + 1) + behind)[0])
    isa = levels[-1]
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1], sa[1:]
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 2, -1, -1):
        rank = levels[k]
        same = rank[np.minimum(a + shared, n - 1)] == rank[np.minimum(b + shared, n - 1)]
        shared += same.astype(np.int64) << k
    lcp[1:] = shared
    return sa, isa, lcp


def intervals(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places ``at``: the last place before with an LCP no greater, and the first one behind with a
    smaller one (or the end). Minima over 2^k places tell how far to go; as many of them are made as some
    place needs."""
    n = len(lcp)
    minima = [np.concatenate([[-1], lcp[1:], [-1]])]
    d = lcp[at]
    while True:
        last, width = minima[-1], 1 << (len(minima) - 1)
        if 2 * width > n or not ((last[at + 1] >= d) | (last[np.maximum(at - width, 0)] > d)).any():
            break
        following = np.full(n + 1, -1, np.int64)
        following[: n + 1 - width] = last[width:]
        minima.append(np.minimum(last, following))
    right, left = at + 1, at - 1
    for k in range(len(minima) - 1, -1, -1):
        width = 1 << k
        right = np.where(minima[k][np.minimum(right, n)] >= d, right + width, right)
        begin = left - width + 1
        left = np.where((begin >= 0) & (minima[k][np.maximum(begin, 0)] > d), left - width, left)
    return left, right


def branching_squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares in ``x`` that the word behind them ends."""
    sa, isa, lcp = suffix_order(x)
    n = len(x)
    at = np.flatnonzero(lcp > 0)
    left, right = intervals(lcp, at)
    first, second = at - left, right - at
    from_left = first <= second
    low = np.where(from_left, left, at)
    count = np.where(from_left, first, second)
    other = np.where(from_left, at, left), np.where(from_left, right, at)
    starts, periods = [], []
    total = np.cumsum(count)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + TESTS, side="right")))
        c = count[a:b]
        which = np.repeat(np.arange(a, b), c)
        place = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        i, d = sa[place], lcp[at[which]]
        for j, start in ((i + d, i), (i - d, i - d)):
            rank = isa[np.clip(j, 0, n - 1)]
            hit = (j >= 0) & (j < n) & (rank >= other[0][which]) & (rank < other[1][which])
            starts.append(start[hit])
            periods.append(d[hit])
        a = b
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *periods])


def rotated(x: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each square goes to the left with its period; the step grows while words match."""
    start = start.copy()
    active = np.arange(len(start))
    width = 1
    while len(active):
        back = np.arange(1, width + 1)
        place = start[active][:, None] - back
        same = (place >= 0) & (x[np.maximum(place, 0)] == x[np.maximum(place, 0) + period[active][:, None]])
        steps = np.where(same.all(axis=1), width, same.argmin(axis=1))
        start[active] -= steps
        active = active[steps == width]
        width = min(2 * width, max(1, 1_000_000 // max(1, len(active))), 4096)
    return start


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs in ``x``, whose stretches end with a number that occurs once."""
    start, period = branching_squares(x)
    end = start + 2 * period
    order = np.lexsort((period, end))
    start, period, end = start[order], period[order], end[order]
    found = []
    while len(end):
        new = np.concatenate([[True], end[1:] != end[:-1]])
        begin = rotated(x, start[new], period[new])
        found.append((begin, end[new], period[new]))
        # Squares with the same end: a multiple of the period within the run is the same run.
        run = np.cumsum(new) - 1
        same = (period % period[new][run] == 0) & (start >= begin[run])
        rest = ~same & ~new
        start, period, end = start[rest], period[rest], end[rest]
    if not found:
        return start, end, period
    begin, end, period = (np.concatenate(c) for c in zip(*found))
    enough = end - begin >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return begin[enough], end[enough], period[enough]


def runs_of_words(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by text, start and period.

    ``words`` has the words' numbers of all texts, ``first`` where each text's begin, and the end.
    """
    nothing = (np.empty(0, np.int64),) * 3
    if len(words) < LEAST_WORDS:
        return nothing
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    good = candidates(words, text)
    at = np.flatnonzero(good)
    if not len(at):
        return nothing
    # Stretches one after the other, each with a number of its own behind it; texts share no number.
    size = int(words.max()) + 1
    gap = np.concatenate([(np.diff(at) > 1) | (np.diff(text[at]) > 0), [True]])
    ends = np.flatnonzero(gap)
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(gap[:-1])])
    x = np.empty(len(at) + len(ends), np.int64)
    source = np.empty(len(x), np.int64)
    x[place], source[place] = text[at] * size + words[at], at
    x[place[ends] + 1] = len(first) * size + np.arange(len(ends))
    source[place[ends] + 1] = at[ends] + 1
    begin, end, period = runs_of(x)
    begin, end = source[begin], source[end - 1] + 1
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def collapsed_texts(data, starts, ends, first, keep: np.ndarray) -> pa.Array:
    """The words to keep of each text, joined by one space."""
    kept = np.flatnonzero(keep)
    text = np.searchsorted(first, kept, side="right") - 1
    followed = np.concatenate([text[1:] == text[:-1], [False]])[: len(kept)]
    # A kept word's bytes and, where another one follows, the byte of white space behind it.
    marks = np.zeros(len(data) + 2, np.int32)
    marks[starts[kept]] = 1
    marks[ends[kept] + followed] -= 1
    chosen = np.cumsum(marks)[: len(data)] > 0
    out = np.where(space_mask(data), np.uint8(32), data)[chosen]
    sizes = np.bincount(text, weights=ends[kept] - starts[kept] + followed, minlength=len(first) - 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length and period in words, by start, then period) and
    ``collapsed``: the text's words joined by one space, of every run only the first period."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                data, offsets = bytes_and_offsets(batch.column("text"))
                starts, ends, first = word_bounds(data, offsets)
                begin, end, period = runs_of_words(word_numbers(data, starts, ends), first)
                marks = np.zeros(len(starts) + 1, np.int64)
                np.add.at(marks, begin + period, 1)
                np.add.at(marks, end, -1)
                keep = np.cumsum(marks)[:-1] == 0
                text = np.searchsorted(first, begin, side="right") - 1
                runs = pa.StructArray.from_arrays(
                    [pa.array(v) for v in (begin - first[text], end - begin, period)], fields=list(_RUN)
                )
                bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(bounds), runs),
                        collapsed_texts(data, starts, ends, first, keep),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the ends of every tenth text (by a hash of its id) replaced by a periodic one."""
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.filter((h % 10 == 0) & (F.length(F.col("text")) > 0)).select("doc_id", "text")
    rest = docs.filter(~F.coalesce((h % 10 == 0) & (F.length(F.col("text")) > 0), F.lit(False)))
    g = F.floor(h / 10)
    cut = chosen.select("doc_id", "text", words.alias("_w"), g.alias("_g"))
    cut = cut.select("doc_id", "text", "_w", F.size("_w").alias("_n"), "_g")
    n, some = F.col("_n"), F.greatest(F.col("_n"), F.lit(1))
    cut = cut.withColumn("_a", (F.col("_g") % some).cast("int"))
    cut = cut.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = n - F.col("_a")
    period = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    copies = F.flatten(F.array_repeat(period, F.ceil(tail / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(copies, F.lit(1), tail)), " ")
    planted = cut.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))
    return rest.select("doc_id", "text").unionByName(planted)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth of which gets a periodic tail first; digests of the results.

    Lengths over periods are compared as doubles: the quotients of different fractions of numbers below
    2^26 are different doubles.
    """
    docs = with_planted_tails(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = periodic_runs(docs)
    keyed = F.transform(
        "runs",
        lambda r: F.struct(
            (r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"),
            r["length"].alias("l"),
        ),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(keyed)
    digests = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    period = -F.col("_best.p")
    return digests.select(
        "doc_id", "n_runs", (-F.col("_best.s")).alias("start"), F.col("_best.l").alias("length"),
        period.alias("period"), F.floor(1000 * F.col("_best.l") / period).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


#: Pairs of equal words of a text, up to a quarter of its length apart, in stretches without a gap.
ORACLE_SQL = r"""
WITH numbered AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    -- unsigned CRC-32: eight steps a byte, each one shift and one exclusive or
    xor(4294967295::UBIGINT, list_reduce(
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
      lambda crc, b: list_reduce(range(8)::UBIGINT[],
        lambda x, k: xor(x >> 1, (x & 1) * 3988292384::UBIGINT), xor(crc, b)),
      4294967295::UBIGINT)) AS h
  FROM documents),
sized AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a
  FROM numbered),
words AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
      list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
    ELSE w END AS w
  FROM (SELECT doc_id, w, n::BIGINT AS n, h::BIGINT AS h, g::BIGINT AS g, a::BIGINT AS a FROM sized)),
placed AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM words),
-- pairs of equal words, by their distance; those without a gap are one stretch
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i,
    x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS stretch
  FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
runs AS (
  SELECT doc_id, start, length, min(q) AS period
  FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM pairs GROUP BY doc_id, q, stretch)
  WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
  FROM placed ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
best AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_max({'start': start, 'length': length, 'period': period},
            {'x': length / period, 's': -start, 'p': -period}) AS r
  FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period,
  (1000 * r.length) // r.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM words LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
