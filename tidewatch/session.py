"""Session settings and the shared stage folder."""
from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")  # quartiles of many small flows without a sort
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def stage_folder(spark: SparkSession) -> str:
    """The folder all executors share; only a local session makes its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder:
            sc.setCheckpointDir(folder)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder or sc.getCheckpointDir()


def shared_stage(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Later stages see one fixed result even when executors are lost, and read only
    the columns they need. The folder's owner decides how long stages are kept.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most: int) -> list:
    """Rows of a table that must stay small (a model, a boundary list).

    Refuses instead of truncating when the table has more than `most` rows.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"expected at most {most} rows, found more")
    return rows


def local_table(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A bounded list of rows as a table; it goes over as Arrow, so that no Python worker starts for it."""
    return spark.createDataFrame(pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], schema=to_arrow_schema(schema)), schema)
