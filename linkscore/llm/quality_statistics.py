"""Statistics of texts for the quality classifier, for all texts of a batch at once."""

from __future__ import annotations

import numpy as np

from linkscore.llm.text_arrays import mixed, slice_hashes, word_bounds

NAMES = (
    "words", "word length", "long words", "symbols", "capitals", "digits", "punctuation", "pipes",
    "marks", "lines", "words a line", "distinct words", "most frequent word", "same word again",
    "distinct pairs", "distinct lines",
)


def _classes() -> dict[str, np.ndarray]:
    def of(characters: str) -> np.ndarray:
        table = np.zeros(256, np.int8)
        table[list(characters.encode())] = 1
        return table

    return {
        "symbols": of("#*$%&<>|~^_=+{}[]\\/@"),
        "capitals": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": of("0123456789"),
        "punctuation": of(".,;:"),
        "pipes": of("|"),
        "marks": of("!?"),
    }


_CLASSES = _classes()


def _logit(share: np.ndarray) -> np.ndarray:
    p = np.clip(share, 0.0, 1.0)
    return np.log((p + 0.03) / (1 - p + 0.03))


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of slices of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys per text, and how often the most frequent one occurs."""
    salted = keys ^ mixed(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(salted, kind="stable")
    same = np.concatenate([[True], salted[order][1:] != salted[order][:-1]]) if len(keys) else np.zeros(0, bool)
    firsts = np.flatnonzero(same)
    runs = np.diff(np.append(firsts, len(keys)))
    owner = text[order[firsts]] if len(keys) else text
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, runs)
    return np.bincount(owner, minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    text = np.repeat(np.arange(n), np.diff(first))
    words = np.diff(first)
    lengths = ends - starts
    in_words = np.maximum(_per_text(lengths, first), 1)
    some = np.maximum(words, 1)
    hashes = slice_hashes(data, starts, ends)
    different, most = _distinct(hashes, text, n)
    pairs = len(hashes) and (hashes[:-1] * np.uint64(3) + hashes[1:])[text[:-1] == text[1:]]
    pair_text = text[:-1][text[:-1] == text[1:]] if len(hashes) else text
    different_pairs, _ = _distinct(pairs if len(hashes) else hashes, pair_text, n)
    again = np.zeros(len(hashes), np.int8)
    if len(hashes):
        again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])

    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    edges = edges[edges < len(data)]
    line_ends = np.append(edges[1:], len(data))
    line_text = np.searchsorted(offsets, edges, side="right") - 1
    lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    different_lines, _ = _distinct(slice_hashes(data, edges, line_ends), line_text, n)

    def share(name: str) -> np.ndarray:
        return _logit(_per_text(_CLASSES[name][data], offsets) / (in_words + 50))

    columns = (
        np.log1p(words),
        np.log1p(in_words / some),
        _logit(_per_text(lengths > 14, first) / some),
        *(share(c) for c in ("symbols", "capitals", "digits", "punctuation", "pipes", "marks")),
        np.log1p(lines),
        np.log1p(words / lines),
        _logit(different / some) / (1 + 0.2 * np.log1p(words)),
        _logit(most / (words + 10)),
        _logit(_per_text(again, first) / (words + 30)),
        _logit(different_pairs / np.maximum(words - 1, 1)),
        _logit(different_lines / lines),
    )
    return np.column_stack(columns)
