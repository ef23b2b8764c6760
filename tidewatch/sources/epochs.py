"""A stream sink that leaves every row once, whatever is killed and started again.

Tasks write Parquet files under `rows`; the driver names those of a finished trigger in one
list under `epochs`, put in place by a rename. A trigger that Spark runs again after a restart finds
its list and drops its new files, so the first result stays. Readers join the
files with the lists: files of failed tasks and of triggers that never ended are not seen.
"""
from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "epoch_files"


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


def _storage(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class EpochWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path
        store, root = _storage(path)
        for name in ("rows", "epochs"):
            store.create_dir(f"{root}/{name}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file a task, batch by batch; a task without rows writes none."""
        store, root = _storage(self.path)
        out, name = None, f"part-{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(f"{root}/rows/{name}", batch.schema, filesystem=store)
                    out.write_batch(batch)
        finally:
            if out is not None:
                out.close()
        return Written([name] if out is not None else [])

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, root = _storage(self.path)
        listed = f"{root}/epochs/{batchId}.json"
        if store.get_file_info(listed).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        lines = "".join(json.dumps({"epoch": batchId, "file": name}) + "\n" for m in messages if m for name in m.files)
        draft = f"{root}/epochs/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(lines.encode())
        store.move(draft, listed)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Drop what this run of the trigger wrote."""
        store, root = _storage(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(f"{root}/rows/{name}")


class EpochFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> EpochWriter:
        if overwrite:
            raise ValueError("epochs are only appended")
        return EpochWriter(self.options["path"])


def write_epochs(stream: DataFrame, path: str, progress: str):
    """Start the stream into `path` over all that is available; `progress` is its checkpoint folder."""
    stream.sparkSession.dataSource.register(EpochFiles)
    return (stream.writeStream.format(FORMAT).outputMode("append").option("checkpointLocation", progress)
            .trigger(availableNow=True).start(path))


def read_epochs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of finished triggers, with their epoch."""
    listed = spark.read.schema("epoch long, file string").json(f"{path}/epochs")
    rows = spark.read.schema(schema).parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(listed, "file").drop("file")
