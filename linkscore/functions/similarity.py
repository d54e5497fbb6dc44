"""Similarity and score expressions; all row-local, so they add no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steepness of the similarity curve, weights, and the final curve.
SIMILARITY_STEEPNESS = 8.0
EXACT_WEIGHT, SEMANTIC_WEIGHT, CONTEXT_WEIGHT = 0.5, 0.3, 0.2
FINAL_STEEPNESS, FINAL_MIDPOINT = 10.0, 0.6


def squash(similarity: Column) -> Column:
    """Similarity in [-1, 1] to (0, 1)."""
    return 1.0 / (1.0 + F.exp(-SIMILARITY_STEEPNESS * similarity))


def weighted_score(exact: Column, semantic: Column, context: Column) -> Column:
    return EXACT_WEIGHT * exact + SEMANTIC_WEIGHT * semantic + CONTEXT_WEIGHT * context


def final_squash(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-FINAL_STEEPNESS * (score - FINAL_MIDPOINT)))


def exact_match(text: Column, keyword: Column) -> Column:
    """1.0 when the keyword is a substring of the text, ignoring case; an empty keyword always is."""
    return F.when(F.contains(F.lower(text), F.lower(keyword)), 1.0).when(
        text.isNotNull() & keyword.isNotNull(), 0.0
    )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _ratio(dot: Column, norm2_a: Column, norm2_b: Column) -> Column:
    """``dot`` over the norms, 0 for a zero norm; every argument appears, and is computed, once."""
    norms = F.sqrt(norm2_a.cast("double")) * F.sqrt(norm2_b.cast("double"))
    return F.coalesce(F.try_divide(dot.cast("double"), norms), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 when one of them has no length, null when one is null."""
    return F.when(a.isNotNull() & b.isNotNull(), _ratio(_dot(a, b), _dot(a, a), _dot(b, b)))


def term_norm2(token_array: Column) -> Column:
    """Sum of squared term frequencies, in one pass over the sorted tokens.

    A term seen for the k-th time adds k^2 - (k-1)^2 = 2k - 1.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("term"),
        F.lit(0).cast("bigint").alias("run"),
        F.lit(0).cast("bigint").alias("total"),
    )

    def add(acc: Column, term: Column) -> Column:
        run = F.when(acc["term"].eqNullSafe(term), acc["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(
            term.alias("term"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total")
        )

    return F.aggregate(F.sort_array(token_array), start, add, lambda acc: acc["total"])


def term_dot(text_tokens: Column, keyword_tokens: Column) -> Column:
    """Dot product of term-frequency vectors: for each keyword token, its count in the text."""
    return F.aggregate(
        keyword_tokens,
        F.lit(0).cast("bigint"),
        lambda acc, t: acc + F.size(text_tokens) - F.size(F.array_remove(text_tokens, t)),
    )


def term_cosine(
    text_tokens: Column, keyword_tokens: Column, text_norm2: Column | None = None
) -> Column:
    """Cosine of term-frequency vectors; no explode and no join, the work stays in the row.

    ``text_norm2`` is the :func:`term_norm2` of the text, where it is known already.
    """
    if text_norm2 is None:
        text_norm2 = term_norm2(text_tokens)
    value = _ratio(term_dot(text_tokens, keyword_tokens), text_norm2, term_norm2(keyword_tokens))
    return F.when(text_tokens.isNotNull() & keyword_tokens.isNotNull(), value)
