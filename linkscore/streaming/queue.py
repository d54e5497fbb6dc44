"""Work queues between stages: JSON directories read and written by Structured Streaming.

A queue is a directory of JSON lines. Publishing appends files, a stage reads the files it has not
read yet (its checkpoint knows which), applies a DataFrame function, and writes its output as the
next queue. First in, first out within a page is the ``seq`` column: rows of a Spark table have no
arrival order.

Between stages every item is handed on exactly once. A stage records a batch when it is written
(:mod:`linkscore.commits`), and the next stage reads the stream of records: a batch that failed half-way is
not recorded, and one that is recorded is not written again when the stage is retried.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore import commits
from linkscore.operators import catalog
from linkscore.operators.links import extract_links, link_items, with_keywords
from linkscore.schemas import LINK_ITEM, struct
from linkscore.sources.pages import page_errors, valid_pages

# Input a stage takes per micro-batch when not told otherwise.
BATCH_BYTES = 16 << 30

CORRUPT = "malformed"
# Directory levels below a stage's output.
STAGE_PARTITIONS = ", writer string, batch_id bigint, outcome string"
_FOLDERS = ("writer", "batch_id", "outcome")


@dataclass
class StageQueue:
    """The output of a stage as the queue of the next one: batches that the stage has recorded."""

    spark: SparkSession
    path: str
    schema: str
    outcome: str = "ok"
    per_batch: int = 1

    def records(self) -> DataFrame:
        return commits.record_stream(self.spark, _log(self.path), self.per_batch)

    def items(self, records: DataFrame) -> DataFrame:
        """Items of recorded batches; of a batch of records there are ``per_batch`` at most."""
        folders = sorted({r["folder"] for r in records.select("folder").collect()})
        return _items_of(self.spark, self.path, folders, self.schema, self.outcome)


def _log(output: str) -> str:
    return f"{output.rstrip('/')}_commits"


def _items_of(spark: SparkSession, output: str, folders: list[str], schema: str, outcome: str) -> DataFrame:
    fields = struct(f"{schema}, {CORRUPT} string" + STAGE_PARTITIONS)
    written = spark.read.schema(fields).option("columnNameOfCorruptRecord", "_none")
    items = written.option("basePath", output).json(folders)
    # A stage without outcomes has only items.
    return items.filter(F.coalesce("outcome", F.lit("ok")) == outcome).drop(*_FOLDERS)


def publish(items: DataFrame, queue: str) -> None:
    """Append items to a queue."""
    items.write.mode("append").json(queue)


def to_messages(items: DataFrame) -> DataFrame:
    """Items as JSON messages, as they are written to a queue."""
    return items.select(F.to_json(F.struct(*(F.col(c) for c in items.columns))).alias("message"))


def from_messages(messages: DataFrame, schema: str = LINK_ITEM) -> DataFrame:
    """Items read back from JSON messages."""
    return messages.select(F.from_json("message", struct(schema)).alias("item")).select("item.*")


def read_queue(
    spark: SparkSession,
    queue: str,
    schema: str = LINK_ITEM,
    max_files: int | None = None,
    archive: str | None = None,
    from_stage: bool = False,
) -> DataFrame | StageQueue:
    """Stream of a queue's items; lines that are no items come as ``malformed``.

    ``from_stage`` tells that the queue is the output of :func:`run_stage` or :func:`run_extract_stage`:
    the batches it recorded are read, the processed items of each, not its dead letters; ``max_files`` is
    then the number of batches taken together. With ``archive`` the files of finished batches are moved
    there, which clears the queue.
    """
    if from_stage:
        if archive:
            raise ValueError("archive is for queues that items are published to")
        return StageQueue(spark, queue, schema, per_batch=max_files or 1)
    reader = (
        spark.readStream.schema(struct(f"{schema}, {CORRUPT} string"))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(queue)


def stage_items(
    spark: SparkSession, output: str, schema: str, outcome: str = "ok"
) -> DataFrame:
    """Items a stage has recorded: the processed ones, or with ``failed`` its dead letters."""
    folders = [r["folder"] for r in commits.recorded(spark, _log(output))]
    if not folders:
        return spark.createDataFrame([], struct(f"{schema}, {CORRUPT} string"))
    return _items_of(spark, output, folders, schema, outcome)


def peek(items: DataFrame) -> DataFrame:
    """The oldest item, which stays in the queue."""
    return items.orderBy("seq").limit(1)


def succeeded(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), "ok").otherwise("failed")


def run_stage(
    source: DataFrame | StageQueue,
    process: Callable[[DataFrame], DataFrame],
    result_column: str,
    output: str,
    checkpoint: str,
) -> None:
    """Process everything in the source queue and stop.

    ``process`` must give a null ``result_column`` for items it cannot handle. A batch is computed
    and written once, split by outcome: ``output/writer=W/batch_id=N/outcome=ok`` is for the next
    stage, ``outcome=failed`` holds the dead letters. W belongs to the checkpoint, so stages that share
    an output do not meet. A batch that is retried before it was recorded overwrites its own folder, which
    nobody has read; one that is recorded is left alone. Nothing is dropped and there is no item limit.
    """

    def write(batch: DataFrame, folder: str) -> None:
        done = process(batch).withColumn("outcome", succeeded(result_column))
        done.write.mode("overwrite").partitionBy("outcome").json(folder)

    _hand_on(source, write, output, checkpoint)


def _hand_on(
    source: DataFrame | StageQueue, write: Callable[[DataFrame, str], None], output: str, checkpoint: str
) -> None:
    """Run ``write`` on every batch of the source, with the batch's folder, and record what it wrote."""
    spark = _session(source)
    writer = writer_id(spark, checkpoint)

    def hand_on(batch: DataFrame, batch_id: int) -> None:
        name = f"{writer}-{batch_id}"
        if commits.is_recorded(spark, _log(output), name):
            return
        folder = f"{output.rstrip('/')}/writer={writer}/batch_id={batch_id}"
        write(batch, folder)
        commits.record(spark, _log(output), name, folder=folder, writer=writer, batch_id=batch_id)

    _run_to_end(source, hand_on, checkpoint)


def _session(source: DataFrame | StageQueue) -> SparkSession:
    return source.spark if isinstance(source, StageQueue) else source.sparkSession


def run_extract_stage(
    pages: DataFrame, keywords: Sequence[str], output: str, checkpoint: str
) -> None:
    """Turn everything in a stream of pages into items for the scoring stage and stop.

    ``output/writer=W/batch_id=N`` holds the items of a micro-batch and the same folder below
    ``output_errors`` the error records of its pages; a retry replaces both. ``output`` is a queue
    for the next stage.
    """

    def write(batch: DataFrame, folder: str) -> None:
        page_errors(batch).write.mode("overwrite").json(folder.replace(output.rstrip("/"), f"{output.rstrip('/')}_errors", 1))
        links = extract_links(valid_pages(batch))
        link_items(with_keywords(links, keywords)).write.mode("overwrite").json(folder)

    _hand_on(pages, write, output, checkpoint)


def run_store_stage(source: DataFrame | StageQueue, path: str, checkpoint: str) -> None:
    """Upsert everything in a queue of scored items into the catalog at ``path`` and stop.

    Each micro-batch is one catalog batch of the checkpoint's writer under the same number, so a
    retry replaces it, and nothing else does.
    """
    writer = writer_id(_session(source), checkpoint)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        catalog.append_batch(catalog.catalog_rows(batch.drop(CORRUPT)), path, batch_id, writer)

    _run_to_end(source, store_batch, checkpoint)


def writer_id(spark: SparkSession, checkpoint: str) -> str:
    """The name under which a checkpoint's stage writes: made up once, and kept in the checkpoint."""
    kept = f"{checkpoint}/writer"
    try:
        return spark.read.text(kept).first()[0]
    except AnalysisException:  # the first run
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(kept)
        return spark.read.text(kept).first()[0]


def _run_to_end(
    source: DataFrame | StageQueue,
    batch_function: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> None:
    if isinstance(source, StageQueue):
        stream = source.records()

        def each(records: DataFrame, batch_id: int) -> None:
            batch_function(source.items(records), batch_id)
    else:
        stream, each = source, batch_function
    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()
