"""Records of finished writes.

A write goes to a folder of its own. When it is complete, one small record of it is put into a log: one
file, which the committer moves into place. Readers take only what is recorded, so a write that failed
half-way, or whose job died, is in no result; and a batch that is recorded need not be written again.
"""

from __future__ import annotations

import time
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from linkscore.schemas import struct

RECORD = (
    "folder string, version bigint, writer string, batch_id bigint, attempt int, layout string, "
    "buckets array<int>, covers array<string>, n_rows bigint"
)


def now() -> int:
    """A commit version: microseconds."""
    return time.time_ns() // 1000


def record(spark: SparkSession, log: str, name: str, **fields) -> None:
    """Put a record under ``name``; there is at most one of a name."""
    schema = struct(RECORD)
    row = tuple(fields.get(f.name) for f in schema.fields)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("errorifexists").json(_place(log, name))


def recorded(spark: SparkSession, log: str) -> list[Row]:
    """All records, with their names as ``commit``: a row per write, so they are as few as batches."""
    found = _read(spark, log)
    return found.collect() if found is not None else []


def is_recorded(spark: SparkSession, log: str, name: str) -> bool:
    return _read(spark, _place(log, name)) is not None


def _place(log: str, name: str) -> str:
    return f"{log}/commit={quote(name, safe='')}"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The records below a path; None if there is no such path, which is found out without a job."""
    try:
        return spark.read.schema(struct(RECORD + ", commit string")).json(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def record_stream(spark: SparkSession, log: str, per_batch: int) -> DataFrame:
    """Stream of the records of a log, at most so many in a micro-batch."""
    reader = spark.readStream.schema(struct(RECORD + ", commit string"))
    return reader.option("maxFilesPerTrigger", per_batch).json(log)
