"""Text expressions: cleaning, case folding, tokens, keyword positions, context windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as whitespace when text is trimmed or tokenized.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Link texts that say nothing about the target, and script notices.
BOILERPLATE_TEXTS = ("more information...", "click here", "read more")
SCRIPT_NOTICES = (
    "javascript is not essential",
    "turn javascript on",
    "interaction with the content will be limited",
)

# Words taken on each side of a keyword hit.
WORDS_BEFORE = 3
WORDS_AFTER = 3

# The same set for splitting: Unicode white space and the four separators it leaves out. A class
# of the single characters matches the same and takes twice the time.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def trim_spaces(text: Column) -> Column:
    """Trim Unicode whitespace; a character-set trim, so linear in the text (no regex backtracking)."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean_text(text: Column) -> Column:
    """Trimmed text; null for missing or empty text, boilerplate and script notices.

    Text of whitespace only becomes ``''``, not null.
    """
    trimmed = trim_spaces(text)
    lowered = F.lower(trimmed)
    unwanted = lowered.isin(*BOILERPLATE_TEXTS)
    for notice in SCRIPT_NOTICES:
        unwanted = unwanted | lowered.contains(notice)
    return F.when((text != "") & ~unwanted, trimmed)


def words(text: Column) -> Column:
    """Whitespace-separated words of ``text`` as an array, never with an empty word."""
    trimmed = trim_spaces(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, _SPACES)
    )


def tokens(text: Column) -> Column:
    """Words of the lowercased text."""
    return words(F.lower(text))


def keyword_positions(token_array: Column, keyword: Column) -> Column:
    """0-based positions of the tokens that equal the (lowercased) keyword."""
    hits = F.transform(token_array, lambda t, i: F.when(t == keyword, i))
    return F.array_compact(hits)


def last_position(token_array: Column, keyword: Column) -> Column:
    """0-based position of the last token equal to ``keyword``, null when there is none."""
    from_end = F.array_position(F.reverse(token_array), keyword)
    return F.when(from_end > 0, F.size(token_array) - from_end.cast("int"))


def window_tokens(token_array: Column, position: Column) -> Column:
    """Tokens around ``position``: three on each side, clipped at the ends."""
    start = F.greatest(position - WORDS_BEFORE, F.lit(0))
    length = position + WORDS_AFTER + 1 - start
    return F.slice(token_array, start + 1, length)


def context_window(token_array: Column, keyword: Column) -> Column:
    """Window around the last hit of ``keyword``; null when no token equals it.

    Every hit overwrites the score of the one before, so only the last window can matter: one
    window per row instead of one per hit.
    """
    return F.array_join(window_tokens(token_array, last_position(token_array, keyword)), " ")
