"""End to end: pages and keywords or targets to scored items, catalog and ranked links."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscore.operators import catalog, rank
from linkscore.operators.elements import elements
from linkscore.operators.links import (
    ITEM_COLUMNS,
    extract_links,
    links_from_elements,
    malformed_links,
    with_keywords,
)
from linkscore.operators.providers import Encoder, Similarity
from linkscore.operators.score import TEXT_TERMS, score_links, with_text_terms
from linkscore.operators.vector_store import VectorStore, score_with_vectors
from linkscore.sources import robots, targets as tg
from linkscore.sources.pages import error_records, page_error, valid_pages
from linkscore.storage import materialized

DEFAULT_CONTAINERS = ("body",)


def scored_items(
    pages: DataFrame,
    keywords: Sequence[str],
    containers: Sequence[str] = DEFAULT_CONTAINERS,
    similarity: Similarity | None = None,
) -> DataFrame:
    """Every link of every valid page, scored for every keyword of the list."""
    links = with_text_terms(extract_links(valid_pages(pages), containers))
    each = with_keywords(links, keywords)
    return score_links(each.select(*ITEM_COLUMNS, *TEXT_TERMS), similarity)


def ranked_links(
    pages: DataFrame, keywords: Sequence[str], similarity: Similarity | None = None
) -> DataFrame:
    """Ranked links per page and keyword, straight from the pages."""
    best = rank.best_links(scored_items(pages, keywords, similarity=similarity))
    return rank.rank_links(best)


@dataclass
class Run:
    """Outputs of :func:`run`, both lazy; reading them does not parse the pages again, nor encode texts."""

    items: DataFrame
    errors: DataFrame


def run(
    pages: DataFrame,
    targets: DataFrame,
    robots_files: DataFrame | None = None,
    containers: Sequence[str] = DEFAULT_CONTAINERS,
    similarity: Similarity | None = None,
    vectors: VectorStore | None = None,
    load_encoder: Callable[[], Encoder] | None = None,
) -> Run:
    """Scored items of all targets, and the error records of what could not be processed.

    With ``vectors`` and ``load_encoder`` the similarities are those of the encoder: texts that the store
    does not have are encoded and added to it.

    ``targets`` is ``(url, keyword[, container])``. Pages are parsed here, once, into a table of
    element rows: parsing is the larger part of the work, and the rows are a small part of the
    markup. Rules of ``robots_files`` are applied before parsing when they are small, and otherwise
    to the rows: markup is never shuffled.
    """
    targets = tg.with_default_container(targets)
    urls, few = tg.target_urls(targets)
    # All error records are of pages that some target names, however many targets there are. With
    # few, the other pages are dropped at the scan; with many, slim rows are compared instead.
    looked_at = tg.of_targets(pages, urls, few, F.col("page_id")) if few else pages
    slim = pages.select("page_id", "url", page_error().alias("error"))
    named = tg.of_targets(slim, urls, few, F.col("page_id"))
    valid = valid_pages(looked_at)
    errors = (
        tg.target_errors(targets, containers)
        .unionByName(tg.absent_pages(targets, pages))
        .unionByName(error_records(named.select("error", "url")))
    )

    refused = None
    if robots_files is not None:
        rules = robots.agent_rules(robots_files)
        small = robots.rules_are_small(rules)
        decided = robots.with_decision(named.filter("error IS NULL").select("page_id", "url"), rules, small)
        errors = errors.unionByName(robots.robots_errors(decided))
        if small:
            valid = robots.with_decision(valid, rules, small).filter("allowed").drop("allowed")
        else:
            refused = decided.filter(~F.col("allowed")).select("page_id")

    rows = materialized(elements(valid, containers, for_links=True), "elements")
    if refused is not None:
        rows = rows.join(refused, "page_id", "left_anti")
    malformed = malformed_links(rows)
    errors = errors.unionByName(tg.of_targets(malformed, urls, few, F.col("message")))
    # Texts are made into terms before the keywords of targets multiply the links.
    listed = rows.filter("tag = 'a'").select(F.col("url").alias("source_url"), F.inline("scopes"))
    listed = listed.select("source_url", "container")
    links = tg.links_of_targets(with_text_terms(links_from_elements(rows)), targets, few, listed)
    items = links.select(*ITEM_COLUMNS, *TEXT_TERMS)
    if vectors is not None:
        return Run(score_with_vectors(items, vectors, load_encoder), errors)
    return Run(score_links(items, similarity), errors)


def store(run_output: Run, path: str, batch_id: int, writer: str = "run") -> None:
    """Upsert the scored items into the catalog at ``path``, as a batch of ``writer``."""
    catalog.append_batch(catalog.catalog_rows(run_output.items), path, batch_id, writer)
