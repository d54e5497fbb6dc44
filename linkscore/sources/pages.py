"""Page source and page validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.schemas import PAGE, struct


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages ``(page_id, url, html)`` from Parquet.

    ``page_id`` is unique. An input with few scan splits for the cores there are (a small or an
    unsplittable file) is spread over them. Anything larger is read as it lies: markup is the bulk
    of the data and is never shuffled.
    """
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return spread_if_narrow(pages, "page_id")


def read_page_stream(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """Stream of the pages in a landing directory of Parquet files."""
    reader = spark.readStream.schema(struct(PAGE)).option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def spread_if_narrow(table: DataFrame, key: str) -> DataFrame:
    """Repartition a plain table scan by ``key`` only when it would leave most cores idle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() * 2 <= cores:
        return table.repartition(cores, key)
    return table


def page_error() -> Column:
    """Error code of a page, null for a page that can be processed."""
    return F.when(F.coalesce(F.col("url"), F.lit("")) == "", "missing_url").when(
        F.coalesce(F.col("html"), F.lit("")) == "", "empty_response"
    )


def valid_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(page_error().isNull())


def page_errors(pages: DataFrame) -> DataFrame:
    """Error records ``(error, message, url)`` of the pages that cannot be processed."""
    # Emptiness is all that counts here, so the markup is not carried along.
    return error_records(pages.select(page_error().alias("error"), "url"))


def error_records(judged: DataFrame) -> DataFrame:
    """Error records of ``(error, url)``; rows without error are left out."""
    failed = judged.filter(F.col("error").isNotNull())
    missing = F.col("error") == "missing_url"
    return failed.select(
        "error",
        F.when(missing, "A page has no URL")
        .otherwise(F.concat(F.lit("Nothing was received from "), F.col("url")))
        .alias("message"),
        F.when(~missing, F.col("url")).alias("url"),
    )
