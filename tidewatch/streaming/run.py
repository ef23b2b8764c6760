"""Run a stream over what is available now and hand the result on as a table."""
from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import stage_folder
from tidewatch.streaming.live import refuse_late


def as_stream(rows: DataFrame, name: str, files_per_trigger: int | None = None, end: Mapping[str, Column] | None = None) -> DataFrame:
    """Stage a table in the shared folder and read it back as a file stream.

    `end` states the event-time column (and whatever else a row needs) of one last row that
    lies beyond all data: it moves the watermark past every window, so a bounded stream
    gives its last windows too. That row's own window stays open and is never given out.
    """
    spark = rows.sparkSession
    folder = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    if end is not None:
        last = spark.range(1).select(*[
            end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
        last.write.mode("append").parquet(folder)
    return stream_folder(spark, folder, rows.schema, files_per_trigger)


def stream_folder(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """Process everything available, write it in append mode, refuse late rows, return the written table."""
    return stream.sparkSession.read.schema(stream.schema).parquet(_run(stream, name, strict))


def relay(stream: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """As `run_available`, but the written table comes back as the next stage's stream."""
    return stream_folder(stream.sparkSession, _run(stream, name, strict), stream.schema)


def _run(stream: DataFrame, name: str, strict: bool) -> str:
    spark = stream.sparkSession
    folder = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    dropped = dropped_rows(query)
    if query.exception() is not None:
        raise query.exception()
    if strict:
        refuse_late(dropped)
    return f"{folder}/rows"


def dropped_rows(query, every: float = 0.5) -> int:
    """Wait for the query's end and add up the rows it dropped behind its watermark.

    Spark keeps the progress of the last hundred triggers only, so it is read while the
    query runs; a trigger that was missed all the same is an error.
    """
    counted: dict[int, int] = {}
    running = True
    while running:
        running = not query.awaitTermination(every)
        for p in query.recentProgress:
            late = sum(int(op.get("numRowsDroppedByWatermark", 0)) for op in p["stateOperators"])
            counted[p["batchId"]] = max(late, counted.get(p["batchId"], 0))
    if counted and len(counted) < max(counted) - min(counted) + 1 or min(counted, default=0) > 0:
        raise RuntimeError("the progress of some triggers was lost")
    return sum(counted.values())
