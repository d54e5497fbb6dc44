"""Targets: which keywords are looked for on which pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscore.operators.skew import fits, matching_join, pieces, salted_join

# Up to this many target URLs the pages are cut down to them before they are parsed.
MAX_BROADCAST_URLS = 1_000_000

_TAG_NAME = r"^[A-Za-z][A-Za-z0-9-]*$"


def is_supported_container(container: Column) -> Column:
    """Containers are tag names; an empty one stands for the whole document."""
    return (container == "") | container.rlike(_TAG_NAME)


def with_default_container(targets: DataFrame) -> DataFrame:
    """Targets ``(url, keyword, container)``; without a container column links of the body count."""
    if "container" not in targets.columns:
        return targets.select("url", "keyword", F.lit("body").alias("container"))
    return targets.select(
        "url", "keyword", F.lower(F.coalesce("container", F.lit("body"))).alias("container")
    )


def target_urls(targets: DataFrame) -> tuple[DataFrame, bool]:
    """The distinct URLs of targets, and whether they are few enough to be broadcast.

    Pages without URL are no target's pages: a target without URL is an error of its own.
    """
    urls = targets.select("url").filter(F.coalesce("url", F.lit("")) != "").distinct()
    return urls, fits(urls, MAX_BROADCAST_URLS)


def of_targets(rows: DataFrame, urls: DataFrame, few: bool, spread: Column, column: str = "url") -> DataFrame:
    """Rows whose URL some target names. With many URLs the rows are shuffled and their URLs counted:
    hand in slim rows of a scan or a written table."""
    named = urls.withColumnRenamed("url", column)
    if few:
        return rows.join(F.broadcast(named), column, "left_semi").select(*rows.columns)
    dealt = pieces(rows.select(column), [column])
    return salted_join(rows, named, [column], spread, "left_semi", dealt).select(*rows.columns)


def links_of_targets(
    links: DataFrame, targets: DataFrame, few: bool, listed: DataFrame | None = None
) -> DataFrame:
    """Links once per keyword of their page and container.

    Few targets are broadcast. Otherwise the links of a page are spread over as many tasks as they need,
    so a URL with very many links is no straggler; only the targets are copied for that. ``listed`` has
    the source_url and container of each link and is cheaper to count than ``links``.
    """
    wanted = targets.filter(F.col("url").isNotNull()).select(
        F.col("url").alias("source_url"), "keyword", "container"
    )
    on = ["source_url", "container"]
    if few and fits(wanted, MAX_BROADCAST_URLS):
        return matching_join(links, F.broadcast(wanted), on, "inner")
    dealt = pieces((links if listed is None else listed).select(*on), on)
    return salted_join(links, wanted, on, F.col("seq"), "inner", dealt)


def absent_pages(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Error records of target URLs that no page has, and of a list without targets."""
    urls, _ = target_urls(targets)
    seen = pages.select("url").distinct()
    missing = urls.join(seen, "url", "left_anti").select(
        F.lit("fetch_failed").alias("error"), F.concat(F.lit("There is no page of "), F.col("url")).alias("message"), "url"
    )
    none = targets.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("missing_targets").alias("error"), F.lit("There are no targets").alias("message"),
        F.lit(None).cast("string").alias("url"),
    )
    return missing.unionByName(none)


def target_errors(targets: DataFrame, containers: Sequence[str]) -> DataFrame:
    """Error records of targets that no link can come from."""
    error = F.when(F.coalesce("url", F.lit("")) == "", "missing_url").when(
        ~is_supported_container(F.col("container")) | ~F.col("container").isin(*containers),
        "unsupported_selector",
    )
    message = F.when(F.col("error") == "missing_url", "A target has no URL").otherwise(
        F.concat(F.lit("Container is not searched: "), F.col("container"))
    )
    return (
        targets.withColumn("error", error)
        .filter(F.col("error").isNotNull())
        .select("error", message.alias("message"), F.nullif("url", F.lit("")).alias("url"))
    )
