"""Token ids of whole texts by the tokenizers library, each distinct piece of a batch encoded once.

Texts are cut into pieces where white space follows a visible character, or a mark a letter. For the
tokenizers used here no token spans such a place and nothing before it changes what comes after (see
``cuts``), so a text's ids are those of its pieces, one after the other. The pieces of a batch are counted by Arrow as they
lie in the buffer; the library sees each distinct piece once, and a bounded memory of the worker
keeps the ids of pieces across batches. Most pieces are a blank and a word of small letters, which the library's
normalizer leaves as they are and its pre-tokenizer in one; these go to its model directly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from linkscore.llm.text_arrays import bytes_and_offsets

#: Pieces whose ids a worker keeps in each of two generations; the older one is forgotten when the newer
#: one is full, except for what has been used since.
MAX_KEPT = 200_000
#: Stands between pieces that the library encodes together: white space and a character that none has.
_MARK = b" \x01"
#: Pieces with a cut before and after them, by the rule of ``cuts``: safe to put next to each other.
_JOINABLE = re.compile(rb"[ \t-\r][^\x00-\x20<|]*(?:[!-;=-{}~]|[\xc3-\xdf][\x80-\xbf])")
#: A blank and small letters below U+0100.
_WORD = re.compile(rb" (?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LETTERS = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start (and the end): at the first byte of every text; before ASCII white space
    that follows a visible ASCII character or a two-byte one from U+00C0 on; and before an ASCII mark
    that follows a letter below U+0100.

    The characters in front are no white space of any kind, which keeps runs of white space whole, and
    letters and marks are never in one token. After other characters there is no cut, only longer
    pieces.
    """
    n = len(data)
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    fits = np.zeros(n, bool)
    allowed = kind >> _BEFORE
    allowed[1:] |= (kind[:-1] >> _EARLIER) & (kind[1:] >> _BETWEEN)
    fits[1:] = (kind[1:] & allowed[:-1] & (_SPACE | _MARK_BYTE)) > 0
    starts = offsets[:-1]
    fits[starts[starts < n]] = True
    return np.append(np.flatnonzero(fits), n)


_FOLDED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))

# Bits of a byte: whether a piece starts at it, as white space or as a mark, where the bytes before it allow that; then,
# in further pairs of bits, what it allows as the byte before, as the first of two, and as the second of two.
_SPACE, _MARK_BYTE = 1, 2
_BEFORE, _EARLIER, _BETWEEN = 2, 4, 6


def _kinds() -> bytes:
    kind = np.zeros(256, np.uint8)
    letters = [*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    kind[[*b" \t\n\x0b\x0c\r"]] |= _SPACE
    kind[[*b".,;:!?#*$%&=+"]] |= _MARK_BYTE
    kind[33:127] |= _SPACE << _BEFORE
    kind[letters] |= _MARK_BYTE << _BEFORE
    kind[0xC3:0xE0] |= _SPACE << _EARLIER
    kind[0xC3] |= _MARK_BYTE << _EARLIER
    kind |= (_SPACE | _MARK_BYTE) << _BETWEEN
    kind[[0x97, 0xB7]] &= 0xFF ^ (_MARK_BYTE << _BETWEEN)
    return kind.tobytes()


_KINDS = _kinds()


def _byte_letters() -> list[str]:
    """The characters by which byte-level tokenizers write the 256 bytes."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b if b in plain else 256 + others.index(b)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Of a tokenizers file; one per worker process and path."""

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.folds = self._folds()
        self.mark = self._ids([_MARK.decode()])[0]
        self.model = self.library.model
        self.direct = self._direct()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _folds(self) -> bool:
        """Whether capitals and kinds of white space make no difference to this tokenizer."""
        pairs = [(chr(c), chr(c + 32)) for c in range(65, 91)] + [(f"{w}a", " a") for w in "\t\n\x0b\x0c\r"]
        found = self._ids([f"x{side}" for pair in pairs for side in pair])
        return all(a.tolist() == b.tolist() for a, b in zip(found[::2], found[1::2]))

    def _direct(self) -> dict[int, str] | None:
        """How the model is given the characters of a blank and a word (its bytes, and a line break between
        words), if its ids of words so written are those of the library."""
        words = [*_LETTERS, *(a + b for a in _LETTERS for b in "aeé"), *(b + a for a in _LETTERS for b in "sß")]
        words += ["the", "dont", "straße", "naïveté", "there" * 20, "".join(_LETTERS)]
        wanted = [x.tobytes() for x in self._ids([f" {w}" for w in words])]
        for blank in ("", _BYTE_LETTERS[32]):
            table = {**dict(enumerate(_BYTE_LETTERS)), 32: blank, 10: "\n"}
            if self._of_words([f" {w}".encode() for w in words], table) == wanted:
                return table
        return None

    def _of_words(self, pieces: list[bytes], table: dict[int, str] | None = None) -> list[bytes]:
        """Ids of pieces that are a blank and a word."""
        ids, bounds = [], [0]
        tokenize = self.model.tokenize
        for word in b"\n".join(pieces).decode("latin-1").translate(table or self.direct).split("\n"):
            ids += [token.id for token in tokenize(word)]
            bounds.append(4 * len(ids))
        raw = np.array(ids, np.int32).tobytes()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that start and end at cuts, encoded as one text with a mark after each."""
        ids = self._ids([_MARK.join([*pieces, b""]).decode()])[0]
        # Only marks have the byte in them, so their last id is nowhere else.
        ends = np.flatnonzero(ids == self.mark[-1]) + 1
        raw, m = ids.tobytes(), 4 * len(self.mark)
        bounds = [0, *(4 * ends).tolist()]
        return [raw[a : b - m] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.kept) > MAX_KEPT:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        out = list(map(kept.get, pieces))
        words, joint, rest = [], [], []
        is_word = _WORD.fullmatch if self.direct else (lambda p: None)
        missing = [i for i, ids in enumerate(out) if ids is None]
        for p in map(pieces.__getitem__, missing):
            ids = older.get(p)
            if ids is not None:
                kept[p] = ids
            elif is_word(p):
                words.append(p)
            else:
                (joint if _JOINABLE.fullmatch(p) else rest).append(p)
        fresh = {}
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            fresh.update(zip(part, self._of_words(part), strict=True))
        for a in range(0, len(joint), 2_000):
            part = joint[a : a + 2_000]
            fresh.update(zip(part, self._joined(part), strict=True))
        for a in range(0, len(rest), 1_000):
            part = rest[a : a + 1_000]
            fresh.update((p, x.tobytes()) for p, x in zip(part, self._ids([p.decode() for p in part])))
        for i in missing:
            p = pieces[i]
            out[i] = fresh[p] if p in fresh else kept[p]
        # Long pieces are rare; they would fill the memory.
        kept.update((p, ids) for p, ids in fresh.items() if len(p) <= 64)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's start, and the end. Null is empty."""
        data, offsets = bytes_and_offsets(texts)
        if self.folds and not ((data[:-1] == 60) & (data[1:] == 124)).any():
            # No special string ("<|...|>") can come to be by this.
            data = np.frombuffer(data.tobytes().translate(_FOLDED), np.uint8)
        bounds = cuts(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        codes = pieces.indices.to_numpy()
        _, at, raw = pieces.dictionary.buffers()
        at = np.frombuffer(at, np.int64)[: len(pieces.dictionary) + 1].tolist() if at else []
        raw = raw.to_pybytes() if raw else b""
        each = self._of_pieces([raw[a:b] for a, b in zip(at, at[1:])])
        sizes = np.array([len(x) // 4 for x in each], np.int64)
        pool = np.frombuffer(b"".join(each), np.int32)
        at = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(at[codes] - (ends - lengths), lengths) + np.arange(total)]
        first = np.searchsorted(bounds[:-1], offsets)
        return ids, np.concatenate([[0], ends])[first]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
