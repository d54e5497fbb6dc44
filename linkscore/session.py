"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linkscore")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that does not have it installed.

    The queries of ``linkscore.llm`` need it there; the other Python functions carry their code along.
    """
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="linkscore-")  # read by the driver, which hands the file out
    archive = shutil.make_archive(f"{folder}/linkscore", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
