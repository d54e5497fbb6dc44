"""Elements to link records: context, metadata, link order, first mentions, text assembly.

One shuffle, of slim element rows by page; every window below partitions by the page and so shares
it. Markup and article text are gone by then: of the blocks only the neighbours of a link are left.
A page is one row of the input, so a window never holds more than one document, however many pages
a site or a URL has.

The windows sort and number rows without texts. The last one hands the page's text to each link as it passes,
and the link's own texts are cut out of it. So what is held at a time is in proportion to the page, also
where thousands of links lie in one heading that has no end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscore.functions import text as tx
from linkscore.functions import urls as ux
from linkscore.operators.elements import BLOCK_TAGS, elements, parsed_pages

# A page description must be longer than the one and is cut at the other.
DESCRIPTION_LONGER_THAN = 10
DESCRIPTION_LENGTH = 300
# Rel values that say nothing when they stand alone.
PLAIN_RELS = ("nofollow", "noopener")

# The links of a page are numbered, and first mentions counted, for each container by itself.
LISTING = ("page_id", "container")
ITEM_COLUMNS = (
    "page_id", "link_pos", "seq", "href", "keyword", "text", "title", "aria_label", "rel",
    "context", "metadata", "source_url", "processed_text",
)


def page_title(raw: Column) -> Column:
    return tx.clean_text(raw)


def page_description(raw: Column) -> Column:
    """Cleaned description: absent when short, cut with an ellipsis when long."""
    cleaned = tx.clean_text(raw)
    shortened = F.concat(F.substring(cleaned, 1, DESCRIPTION_LENGTH), F.lit("..."))
    kept = F.when(F.length(cleaned) > DESCRIPTION_LENGTH, shortened).otherwise(cleaned)
    return F.when(F.length(cleaned) > DESCRIPTION_LONGER_THAN, kept)


def normalize_rel(rel: Column) -> Column:
    """Values joined by one space; null when only ``nofollow`` or only ``noopener`` is left."""
    joined = F.nullif(F.array_join(tx.words(rel), " "), F.lit(""))
    return F.when(~F.lower(joined).isin(*PLAIN_RELS), joined)


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title and description of every page: the first of each in document order, then cleaned.

    Both are picked from the page's own element array, so this needs no shuffle.
    """
    first_title = _first_element("title")["text"]
    first_description = _first_element("meta")["attrs"]["content"]
    return parsed_pages(pages, containers=()).select(
        "page_id",
        "url",
        page_title(first_title).alias("title"),
        page_description(first_description).alias("description"),
    )


def _first_element(tag: str) -> Column:
    return F.get(F.filter("elements", lambda e: e["tag"] == tag), F.lit(0))


def _slim_rows(rows: DataFrame) -> DataFrame:
    """What goes into the shuffle: attributes as columns, texts as places, nulls elsewhere."""
    attrs = F.col("attrs")
    is_link = F.col("tag") == "a"
    # The first description counts even when it has no content: no null for missing content.
    description = F.struct(page_description(F.coalesce(attrs["content"], F.lit(""))).alias("text"))
    return rows.select(
        "page_id", "pos", "scopes", "headings", "page_text", "page_stripped",
        F.when(is_link, F.col("url")).alias("url"),
        F.when(is_link, attrs["href"]).alias("href"),
        F.when(is_link, F.col("span")).alias("text_span"),
        F.when(is_link, tx.clean_text(attrs["title"])).alias("title"),
        F.when(is_link, tx.clean_text(attrs["aria-label"])).alias("aria_label"),
        F.when(is_link, normalize_rel(attrs["rel"])).alias("rel"),
        F.when(F.col("tag").isin(*BLOCK_TAGS), F.col("span")).alias("block_span"),
        F.when(F.col("tag") == "title", F.col("span")).alias("title_span"),
        F.when(F.col("tag") == "meta", description).alias("description"),
    )


def _links_in_context(rows: DataFrame) -> DataFrame:
    """Links with the places of their neighbour blocks and of the page title, and the rows of page texts.

    The nearest block is chosen here and cleaned later: boilerplate gives null, not the block behind it.
    """
    page = Window.partitionBy("page_id")
    before = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # "The next block" is the last one seen walking backwards: a frame that grows is linear,
    # while Spark recomputes a frame that shrinks (1 .. unboundedFollowing) for every row.
    after = page.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    is_link = F.col("href").isNotNull() & ux.is_splittable(F.col("href"))
    return (
        rows.withColumns({
            "previous_span": F.last("block_span", ignorenulls=True).over(before),
            "title_span": F.first("title_span", ignorenulls=True).over(whole),
            "description": F.first("description", ignorenulls=True).over(whole),
        })
        .withColumn("next_span", F.last("block_span", ignorenulls=True).over(after))
        .filter(is_link | F.col("page_text").isNotNull())
    )


def _cut(text: Column, span: Column) -> Column:
    """The text at a place of a page's bytes."""
    return F.substring(text, span["first"] + 1, span["last"] - span["first"]).cast("string")


def sequence(page_id: Column, page_pos: Column) -> Column:
    """Arrival order of a link as one number: by page, then by its number on the page over all containers.

    A decimal holds every 64-bit page id next to every 32-bit position, and unlike a struct it can
    be the buffer of a hash aggregate.
    """
    return (page_id.cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + page_pos).cast(
        "decimal(38,0)"
    )


def _present(*parts: Column) -> Column:
    return F.array_remove(F.array_compact(F.array(*parts)), "")


def processed_text() -> Column:
    """All the text known about a link: ordered, without repeats, joined by a space.

    The domain of the target is part of it for the first link of the page that has this domain.
    """
    parts = F.concat(
        _present(*(F.col(c) for c in (
            "text", "title", "aria_label", "rel", "page_title", "page_description",
        ))),
        _present(F.when(F.col("link_pos") == F.col("first_pos"), F.col("domain"))),
        ux.meaningful_words(F.col("path")),
        _present(F.col("previous_text"), F.col("next_text")),
        F.coalesce(F.col("heading_hierarchy"), F.array().cast("array<string>")),
    )
    return F.array_join(F.array_distinct(parts), " ")


def links_from_elements(rows: DataFrame) -> DataFrame:
    """Link records from the element rows of :func:`elements` with ``for_links``."""
    in_context = _links_in_context(_slim_rows(rows))
    # A link is listed once for every container it is in; the row of the page's text is in none.
    scoped = in_context.withColumn("scope", F.explode_outer("scopes")).drop("scopes")
    scoped = scoped.filter(F.col("scope").isNotNull() | F.col("page_text").isNotNull())
    listing = Window.partitionBy(*LISTING)
    on_page = Window.partitionBy("page_id").orderBy(
        F.col("href").isNull(), "scope_pos", "pos", "container"
    )
    numbered = scoped.withColumns(
        {"container": F.col("scope.container"), "scope_pos": F.col("scope.pos")}
    ).withColumn("page_pos", F.row_number().over(on_page)).withColumn(
        "link_pos", F.row_number().over(listing.orderBy("scope_pos", "pos"))
    )
    # As columns of their own, so that the expressions reading them do not split the URL again.
    split = numbered.withColumns(
        {"domain": ux.domain_component(F.col("href")), "path": ux.url_path(F.col("href"))}
    )
    mentions = split.withColumn(
        "first_pos", F.min("link_pos").over(Window.partitionBy(*LISTING, "domain"))
    )
    # The condition is always true; by it this window depends on the ones before and stays behind them.
    page = Window.partitionBy("page_id")
    last = F.col("first_pos") > 0
    with_page = mentions.withColumns({
        name: F.first(F.when(last, F.col(name)), ignorenulls=True).over(page)
        for name in ("page_text", "page_stripped")
    }).filter(F.col("href").isNotNull())
    text, stripped = F.col("page_text"), F.col("page_stripped")
    raw = with_page.withColumns({
        "text": _cut(text, F.col("text_span")),
        "page_title": _cut(text, F.col("title_span")),
        "previous_text": _cut(text, F.col("previous_span")),
        "next_text": _cut(text, F.col("next_span")),
        "heading_hierarchy": F.when(
            F.size("headings") > 0, F.transform("headings", lambda h: _cut(stripped, h))
        ),
    })
    cleaned = raw.withColumns({
        "text": tx.clean_text(F.col("text")),
        "page_title": page_title(F.col("page_title")),
        "page_description": F.col("description.text"),
        "previous_text": tx.clean_text(F.col("previous_text")),
        "next_text": tx.clean_text(F.col("next_text")),
    })
    return cleaned.select(
        "page_id",
        "link_pos",
        sequence(F.col("page_id"), F.col("page_pos")).alias("seq"),
        "href",
        "text",
        "title",
        "aria_label",
        "rel",
        F.struct("previous_text", "next_text", "heading_hierarchy").alias("context"),
        F.struct(
            F.col("page_title").alias("title"), F.col("page_description").alias("description")
        ).alias("metadata"),
        F.col("url").alias("source_url"),
        processed_text().alias("processed_text"),
        "container",
    )


def extract_links(pages: DataFrame, containers: Sequence[str] = ("body",)) -> DataFrame:
    """Link records of all pages; a link inside two matching containers is there twice.

    ``containers`` are tag names, ``""`` stands for the whole document.
    """
    return links_from_elements(elements(pages, containers, for_links=True))


def malformed_links(rows: DataFrame) -> DataFrame:
    """Error records for the links that extraction leaves out: their URL cannot be split.

    ``rows`` are element rows, as for :func:`links_from_elements`.
    """
    href = F.col("attrs")["href"]
    links = rows.filter((F.col("tag") == "a") & (F.size("scopes") > 0))
    return links.filter(~ux.is_splittable(href)).select(
        F.lit("invalid_link").alias("error"),
        F.concat(F.lit("Link cannot be split into parts: "), href).alias("message"),
        "url",
    )


def with_keywords(links: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Every link once per keyword of a list the caller spells out; stays in the row, no join."""
    if len(keywords) == 1:
        return links.withColumn("keyword", F.lit(keywords[0]))
    return links.withColumn("keyword", F.explode(F.array(*map(F.lit, keywords))))


def link_items(links: DataFrame) -> DataFrame:
    """The nested record that goes to the next stage, fields in their published order."""
    return links.select(*ITEM_COLUMNS)


def first_item(links: DataFrame) -> DataFrame:
    """The oldest item of each source page and keyword, without consuming it."""
    oldest = F.min_by(F.struct("href", "text", "processed_text", "link_pos"), F.col("seq"))
    return links.groupBy("source_url", "keyword").agg(oldest.alias("first")).select(
        "source_url", "keyword", "first.*"
    )
