"""Link records and keywords to scored items.

A score is ``squash(0.5 exact + 0.3 text similarity + 0.2 window similarity)``. The formula is the
same for every similarity provider; where the similarity comes from is the provider's business
(:mod:`linkscore.operators.providers`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscore.functions import similarity as sim
from linkscore.functions import text as tx
from linkscore.functions import urls as ux
from linkscore.operators.providers import LexicalSimilarity, Similarity

_SCORE_COLUMNS = (
    "exact", "semantic_sim", "context_text", "context_sim", "context_score", "score",
)

# Columns of :func:`with_text_terms`.
TEXT_TERMS = ("_tokens", "_norm2")


def computed_once(table: DataFrame, *columns: str) -> DataFrame:
    """``table`` with these columns shielded from filters that come later.

    The optimizer pushes a filter below the projections its columns come from and repeats their
    expressions there; for a score that is the whole computation, many times over. It does not
    push a filter below the generator its columns come from. One row in, one row out, no shuffle.
    """
    others = [c for c in table.columns if c not in columns]
    return table.select(*others, F.inline(F.array(F.struct(*columns))))


def with_text_terms(table: DataFrame, text: str = "processed_text") -> DataFrame:
    """``table`` with what scoring needs of each text, whatever the keyword.

    Worth doing before the texts are multiplied by keywords: tokenizing is the larger part of the
    lexical work. :func:`score_text` uses the columns when they are there and drops them.
    """
    with_tokens = table.withColumn("_tokens", tx.tokens(F.col(text)))
    return with_tokens.withColumn("_norm2", sim.term_norm2(F.col("_tokens")))


def with_window(table: DataFrame, text: str = "processed_text", keyword: str = "keyword") -> DataFrame:
    """Adds ``_keyword`` (lowercased), ``exact``, and the window around the keyword's last occurrence as
    ``_window`` and ``context_text``, null when no token equals the keyword."""
    if "_tokens" not in table.columns:
        table = with_text_terms(table, text)
    located = table.withColumn("_keyword", F.lower(F.col(keyword))).withColumns({
        "exact": sim.exact_match(F.col(text), F.col(keyword)),
        "_position": tx.last_position(F.col("_tokens"), F.col("_keyword")),
    })
    windowed = located.withColumn("_window", tx.window_tokens(F.col("_tokens"), F.col("_position")))
    return windowed.withColumn("context_text", F.array_join("_window", " ")).drop("_position")


def score_text(
    table: DataFrame,
    text: str = "processed_text",
    keyword: str = "keyword",
    similarity: Similarity | None = None,
) -> DataFrame:
    """Adds the score of ``text`` for ``keyword`` and the parts it is made of.

    Adds ``exact, semantic_sim, context_text, context_sim, context_score, score``. The context part
    counts only when some token equals the keyword, and then for its last occurrence.
    """
    similarity = similarity or LexicalSimilarity()
    named = with_window(table, text, keyword)
    with_text = similarity.attach(named, text, "_keyword", "semantic_sim", "_tokens", "_norm2")
    with_both = similarity.attach(with_text, "context_text", "_keyword", "context_sim", "_window")
    scored = with_both.withColumn("context_score", context_score()).withColumn(
        "score", combined_score()
    )
    return computed_once(scored.drop(*TEXT_TERMS, "_keyword", "_window"), *_SCORE_COLUMNS)


def context_score() -> Column:
    """Squashed similarity of the window; 0 without a window, whatever the exact match."""
    has_window = (F.col("exact") > 0) & F.col("context_text").isNotNull()
    return F.when(has_window, sim.squash(F.col("context_sim"))).otherwise(0.0)


def combined_score() -> Column:
    return sim.final_squash(
        sim.weighted_score(
            F.col("exact"), sim.squash(F.col("semantic_sim")), F.col("context_score")
        )
    )


def analysis(keyword: Column, source_url: Column, href: Column, score: Column) -> Column:
    """The analysis record; null when the item could not be scored or its target is unknown."""
    href_url = ux.resolve_href(source_url, href)
    record = F.struct(
        F.lower(keyword).alias("keyword"),
        source_url.alias("source_url"),
        href_url.alias("href_url"),
        score.alias("score"),
    )
    return F.when(score.isNotNull() & href_url.isNotNull(), record)


def score_links(items: DataFrame, similarity: Similarity | None = None) -> DataFrame:
    """Items with their ``relevance_analysis``.

    An item that cannot be scored (no text, keyword, or target) flows on with a null analysis, so
    that a bad item neither fails the job nor vanishes.
    """
    scored = score_text(items, similarity=similarity)
    record = analysis(F.col("keyword"), F.col("source_url"), F.col("href"), F.col("score"))
    return scored.withColumn("relevance_analysis", record).drop(*_SCORE_COLUMNS)


def unscored(items: DataFrame) -> DataFrame:
    """Items that passed through scoring without an analysis."""
    return items.filter(F.col("relevance_analysis").isNull())
