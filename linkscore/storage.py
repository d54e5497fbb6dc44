"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Folders of local sessions without the setting, by application; a session's setting cannot be changed.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and tables passed between jobs.

    Only a local session, where all tasks share one machine, may do without the setting; it then
    gets a temporary folder of its own.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{SETTING} must name a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="linkscore-")
    return _LOCAL[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(table: DataFrame, name: str) -> DataFrame:
    """``table``, computed now and read back from the shared folder.

    For results that several later steps read. A written table cuts the lineage, outlives executors
    and, being columnar, lets each reader scan only the columns it needs.
    """
    folder = new_folder(table.sparkSession, name)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)
