"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers count the tokens of a byte-level BPE tokenizer without producing them:

* The *splitter* reads characters by class and marks where pretokens start. It has 13 states. A stream
  of texts is cut into chunks of a fixed length; the map from entry to exit state of each chunk is
  found for all chunks at once, maps are composed by a parallel prefix scan, and with the entry states
  known all chunks are read again side by side.
* The *counter* reads the bytes of a pretoken; every transition carries the number of tokens that the
  byte adds (or takes back). A prefix of a pretoken has exactly one encoding, whose last token is the
  only vocabulary token that ends there and is compatible with the last token before it. A state is
  therefore the longest suffix that a longer token starts with, and the last tokens and relative counts
  at the places within it where a token can start: finitely many, built when first reached. It starts anew at every mark, so a
  chunk's map is constant after its first mark and pretokens can be read side by side. A pretoken of more
  than ``LONG`` bytes is read by itself: the last tokens are found place by place, without building
  states that nothing else will reach.

A worker forgets the counter's states when there are more than a limit, so memory is bounded.

Defined cases: a null text has 0 bytes and 0 tokens; special strings in texts count as one token where
they stand; rows with null or repeated ids are counted each; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.llm.encoding import tokenizer_path
from linkscore.llm.text_arrays import bytes_and_offsets, chunks

LIMIT = 1024
#: Characters in a chunk of the splitter.
CHUNK = 512
#: States of the counter that a worker keeps.
MAX_STATES = 95_000
#: Verdicts on pairs of tokens that a worker keeps.
MAX_PAIRS = 600_000
#: Pretokens of more bytes are read one by one.
LONG = 400

# Classes of characters.
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, S, R, V, L_, E_, END = range(12)
CLASSES = 12
# States of the splitter: the kind of run it is in; white space by whether there is one character and
# by the last; a quote that may start a contraction, and its letter; a finished contraction.
(
    START, IN_LETTERS, IN_NUMBERS, IN_OTHER, SPACE_1, WHITE_1, SPACE_N, WHITE_N,
    QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED,
) = range(13)
STATES = 13
#: Marks that a transition sets: a pretoken starts at this character; at the one before.
HERE, BEFORE = 1, 2
LETTERS = (LETTER, S, R, V, L_, E_)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state and class."""
    following = np.zeros((STATES, CLASSES), np.uint8)
    marks = np.zeros((STATES, CLASSES), np.uint8)

    def fresh(c: int) -> tuple[int, int]:
        """A pretoken starts with a character of class c."""
        if c in LETTERS:
            return IN_LETTERS, HERE
        return {
            NUMBER: (IN_NUMBERS, HERE), OTHER: (IN_OTHER, HERE), QUOTE: (QUOTED, HERE),
            SPACE: (SPACE_1, HERE), WHITE: (WHITE_1, HERE), END: (START, 0),
        }[c]

    def step(state: int, c: int) -> tuple[int, int]:
        if state in (START, CONTRACTED):
            return fresh(c)
        if state == IN_LETTERS:
            return (IN_LETTERS, 0) if c in LETTERS else fresh(c)
        if state == IN_NUMBERS:
            return (IN_NUMBERS, 0) if c == NUMBER else fresh(c)
        if state == IN_OTHER:
            return (IN_OTHER, 0) if c in (OTHER, QUOTE) else fresh(c)
        if state in (SPACE_1, WHITE_1, SPACE_N, WHITE_N):
            if c in (SPACE, WHITE):
                return (SPACE_N if c == SPACE else WHITE_N), 0
            if c == END:
                return START, 0
            # The last white space leaves a longer run; a space goes with what follows.
            split = BEFORE if state in (SPACE_N, WHITE_N) else 0
            if state in (SPACE_1, SPACE_N):
                return (IN_OTHER if c == QUOTE else fresh(c)[0]), split
            return fresh(c)[0], fresh(c)[1] | split
        if state == QUOTED:
            if c == S:
                return CONTRACTED, 0
            if c in (R, V, L_):
                return {R: QUOTE_R, V: QUOTE_V, L_: QUOTE_L}[c], 0
            return (IN_OTHER, 0) if c in (OTHER, QUOTE) else fresh(c)
        # A quote and a letter that needs another one to be a contraction.
        if c == (L_ if state == QUOTE_L else E_):
            return CONTRACTED, 0
        after, mark = step(IN_LETTERS, c)
        return after, mark | BEFORE

    for state in range(STATES):
        for c in range(CLASSES):
            following[state, c], marks[state, c] = step(state, c)
    return following, marks


NEXT, MARKS = _splitter()
_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of every code point."""
    if not _TABLE:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                gap = 0x800  # surrogates are left out of the text
                a, b = (p if p < 0xD800 else p + gap for p in (m.start(), m.end() - 1))
                table[a : b + 1] = kind
        for characters, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", S), ("r", R), ("v", V), ("l", L_), ("e", E_)):
            table[[ord(c) for c in characters]] = kind
        _TABLE.append(table)
    return _TABLE[0]


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Maps of states, row by row: first one, then the other."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of rows 0 to i, in a number of steps logarithmic in the rows."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = compose(maps[:-reach], maps[reach:])
        reach *= 2
    return maps


def split_marks(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a pretoken starts, for every character of a stream that begins in ``START``."""
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    flat, flat_marks = NEXT.ravel(), MARKS.ravel()

    # Maps of the chunks: from every entry state until all have met, then from the one that is left.
    states = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    k, apart = 0, np.arange(rows)
    exits = np.empty((rows, STATES), np.uint8)
    single = np.zeros(rows, np.uint8)
    met_at = np.full(rows, chunk)
    current = states
    while k < chunk and len(apart):
        current = flat[current.astype(np.uint16) * CLASSES + columns[k, apart, None]]
        k += 1
        if k % 8 == 0 or k == chunk:
            met = (current == current[:, :1]).all(axis=1)
            single[apart[met]], met_at[apart[met]] = current[met, 0], k
            apart, current = apart[~met], current[~met]
    exits[apart] = current
    for k in range(8, chunk):
        now = np.flatnonzero(met_at <= k) if k < 128 else np.flatnonzero(met_at < chunk)
        if k >= 128 and len(now) and met_at[now].max() > k:
            now = now[met_at[now] <= k]
        single[now] = flat[single[now].astype(np.uint16) * CLASSES + columns[k, now]]
    done = met_at <= chunk
    done[apart] = False
    exits[done] = single[done, None]

    entry = np.empty(rows, np.uint8)
    if rows:
        entry[0] = START
        entry[1:] = prefix_scan(exits)[:-1, START]
    here, before = np.empty((chunk, rows), bool), np.empty((chunk, rows), bool)
    state = entry
    for k in range(chunk):
        index = state.astype(np.uint16) * CLASSES + columns[k]
        found = flat_marks[index]
        here[k], before[k] = found & HERE, found & BEFORE
        state = flat[index]
    starts = here.T.ravel()[:n].copy()
    earlier = before.T.ravel()[:n]
    starts[:-1] |= earlier[1:]
    return starts


def _byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in vocabularies: visible Latin-1 ones for themselves, the
    others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The transducer over bytes of pretokens; one per worker process and tokenizer file."""

    _held: dict[str, Counter] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = [t["content"] for t in model["added_tokens"] if t["special"]]
        of = _byte_of_character()
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in self.specials}
        self.tokens = {i: bytes(of[c] for c in t) for t, i in vocabulary.items()}
        self.ids = {b: i for i, b in self.tokens.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = (bytes(of[c] for c in x) for x in (a, b))
            self.ranks[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.compatible: dict[tuple[int, int], bool] = {}
        #: What tokens start with, without the tokens themselves.
        self.open = {b[:n] for b in self.ids for n in range(len(b))}
        self.forget()

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _longest_open(self, suffix: bytes) -> bytes:
        """The longest suffix that a longer token starts with."""
        while suffix not in self.open:
            suffix = suffix[1:]
        return suffix

    def encode(self, piece: bytes) -> list[int]:
        """Plain BPE: the pair of lowest rank first, the leftmost of equals."""
        parts = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(
                ((self.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks), default=None
            )
            if best is None:
                break
            (_, merged), i = best
            parts[i : i + 2] = [merged]
        return parts

    def _fits(self, last: int, token: int) -> bool:
        """Whether a token may follow another (-1: the start) in an encoding."""
        key = (last, token)
        if key not in self.compatible:
            if last < 0:
                self.compatible[key] = self.encode(self.tokens[token]) == [token]
            else:
                self.compatible[key] = self.encode(self.tokens[last] + self.tokens[token]) == [last, token]
        return self.compatible[key]

    def forget(self) -> None:
        """Back to the start state alone. A state is (suffix, last tokens and relative counts)."""
        start = (b"", ((-1, 0),))
        self.numbers = {start: 0}
        self.states = [start]
        self.column = np.full(256, -1, np.int32)  # of the table, by byte
        self.width, self.size = 64, 1024
        self.used = 0
        self.table = np.full((self.size, self.width), -1, np.int32)
        self.added = np.zeros((self.size, self.width), np.int16)

    def _grow(self, byte: int) -> None:
        if self.column[byte] < 0:
            self.column[byte] = self.used
            self.used += 1
        rows, width = self.size, self.width
        while self.used > width:
            width *= 2
        while len(self.states) >= rows:
            rows *= 2
        if (rows, width) != (self.size, self.width):
            table = np.full((rows, width), -1, np.int32)
            added = np.zeros((rows, width), np.int16)
            table[: self.size, : self.width], added[: self.size, : self.width] = self.table, self.added
            self.table, self.added, self.size, self.width = table, added, rows, width

    def _transition(self, state: int, byte: int) -> None:
        """Build the transition of a state on a byte."""
        suffix, places = self.states[state]
        end = bytes([byte])
        # A place is k bytes back; it is None where no token can go on from it.
        for k in range(len(suffix), -1, -1):
            token = places[k] and self.ids.get(suffix[len(suffix) - k :] + end)
            if token is not None and self._fits(places[k][0], token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        delta = places[k][1] + 1
        longer = suffix + end
        suffix = self._longest_open(longer)
        after = ((token, 0),) + tuple(
            (places[n - 1][0], places[n - 1][1] - delta) if suffix[len(suffix) - n :] in self.open else None
            for n in range(1, len(suffix) + 1)
        )
        key = (suffix, after)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        self._grow(byte)
        self.table[state, self.column[byte]] = number
        self.added[state, self.column[byte]] = delta

    def count_long(self, piece: bytes) -> int:
        """Tokens of one pretoken: the last token at each place and the number of tokens up to it, of which
        as many places are kept as a token has bytes."""
        lasts, counts, suffix, kept = [-1], [0], b"", 4 * max(map(len, self.ids))
        ids, fits = self.ids, self._fits
        for byte in piece:
            longer = suffix + bytes((byte,))
            for n in range(len(longer), 0, -1):
                token = ids.get(longer[-n:])
                if token is not None and fits(lasts[-n], token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            lasts.append(token)
            counts.append(counts[-n] + 1)
            suffix = self._longest_open(longer)
            if len(lasts) > 2 * kept:
                del lasts[:kept], counts[:kept]
                if len(self.compatible) > MAX_PAIRS:
                    self.compatible.clear()
        return counts[-1]

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pretoken, the short ones read side by side."""
        if len(self.states) > MAX_STATES:
            self.forget()
        if len(self.compatible) > MAX_PAIRS:
            self.compatible.clear()
        out = np.zeros(len(starts), np.int64)
        lengths = ends - starts
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            short = np.flatnonzero(lengths <= LONG)
            out[short] = self.count(data, starts[short], ends[short])
            out[long] = [self.count_long(data[starts[k] : ends[k]].tobytes()) for k in long.tolist()]
            return out
        order = np.argsort(-lengths, kind="stable")
        state = np.zeros(len(starts), np.int32)
        total = np.zeros(len(starts), np.int64)
        at, longest_first = starts[order], lengths[order]
        k = 0
        live = len(order)
        while live:
            live = int(np.searchsorted(-longest_first, -k, side="left")) if k else int((longest_first > 0).sum())
            if not live:
                break
            byte = data[at[:live] + k]
            s = state[:live]
            column = self.column[byte]
            following = np.where(column < 0, -1, self.table[s, column])
            missing = np.flatnonzero(following < 0)
            if len(missing):
                for pair in np.unique(s[missing].astype(np.int64) * 256 + byte[missing]).tolist():
                    self._transition(pair >> 8, pair & 255)
                column = self.column[byte]
                following = self.table[s, column]
            total[:live] += self.added[s, column]
            state[:live] = following
            k += 1
        out[order] = total
        return out


def count_texts(texts: pa.Array, counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of every text."""
    texts = pc.fill_null(texts, "")
    n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, extra = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    special = "|".join(map(re.escape, sorted(counter.specials, key=len, reverse=True)))
    if special and pc.any(pc.match_substring_regex(texts, special)).as_py():
        parts = [re.split(special, t) for t in texts.to_pylist()]
        extra = np.array([len(p) - 1 for p in parts])
        owner = np.repeat(owner, extra + 1)
        texts = pa.array([x for p in parts for x in p], pa.large_string())
    data, offsets = bytes_and_offsets(texts)
    # One stream of characters, with an end after each text.
    stream = np.insert(data, offsets[1:], 0xFF)
    is_end = np.zeros(len(stream), bool)
    is_end[offsets[1:] + np.arange(len(offsets) - 1)] = True
    leads = np.flatnonzero((stream & 0xC0) != 0x80)
    stream[is_end] = 10
    points = np.frombuffer(stream.tobytes().decode().encode("utf-32-le"), np.uint32)
    classes = class_table()[points]
    classes[is_end[leads]] = END
    starts = leads[split_marks(classes)]
    text = np.searchsorted(offsets[1:] + np.arange(len(offsets) - 1), starts)
    # A pretoken ends where the next one starts, or at the end of its text.
    ends = np.append(starts[1:], len(stream))
    ends -= np.append(text[1:] != text[:-1], True) if len(starts) else 0
    last_of_text = np.append(text[1:] != text[:-1], True) if len(starts) else np.zeros(0, bool)
    text_ends = offsets[1:] + np.arange(len(offsets) - 1)
    ends[: len(starts)][last_of_text] = text_ends[text[last_of_text]]
    ends = ends[: len(starts)]
    # Pretokens that a batch has more than once are read once.
    lengths = ends - starts
    packed = np.concatenate([[0], np.cumsum(lengths)])
    gather = np.repeat(starts - packed[:-1], lengths) + np.arange(packed[-1])
    dense = np.ascontiguousarray(stream[gather])
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(packed.astype(np.int64)), pa.py_buffer(dense)]
    ).dictionary_encode()
    codes = coded.indices.to_numpy()
    once, at = bytes_and_offsets_of_binary(coded.dictionary)
    tokens = counter.count(once, at[:-1], at[1:])
    per_part = np.bincount(text, weights=tokens[codes], minlength=len(offsets) - 1).astype(np.int64)
    total = np.bincount(owner, weights=per_part, minlength=len(n_bytes)).astype(np.int64)
    return n_bytes, total + extra


def bytes_and_offsets_of_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for whole in batches:
            for batch in chunks(whole):
                n_bytes, n_tokens = count_texts(batch.column("text"), counter)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
