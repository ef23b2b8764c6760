"""Packet tables, packet labels and capture manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.ordered import running_sums

PACKET_SCHEMA = T.StructType([
    T.StructField("capture_id", T.StringType()), T.StructField("frame_number", T.LongType()),
    T.StructField("ts", T.DoubleType()), T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.StringType()),
    T.StructField("wire_length", T.IntegerType()),
])


def read_packets(
    spark: SparkSession, path: str, fmt: str = "parquet",
    start_frame: int | None = None, end_frame: int | None = None,
) -> DataFrame:
    """Packet table with an optional inclusive frame range, pushed to the scan."""
    reader = spark.read.schema(PACKET_SCHEMA)
    rows = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return frame_range(rows.where(F.col("protocol").isin("tcp", "udp")), start_frame, end_frame)


def frame_range(packets: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        packets = packets.where(F.col("frame_number") >= start)
    if end is not None:
        packets = packets.where(F.col("frame_number") <= end)
    return packets


LAYOUTS = ("header", "indexed", "vector")


def label_layout(first_line: str) -> str:
    """Which of the three label layouts a file has, from its first line."""
    cells = [c.strip().strip('"').lower() for c in first_line.lstrip("﻿").split(",")]
    if "frame_number" in cells and "binary_label" in cells:
        return "header"
    if len(cells) >= 2 and cells[-1] == "x":
        return "indexed"
    if len(cells) == 1 and cells[0] in ("0", "1"):
        return "vector"
    raise ValueError("label file has none of the three known layouts")


def parse_labels(lines: DataFrame, layout: str, header: str | None = None) -> DataFrame:
    """lines[value, line_number from 1, header excluded] -> frame_number, binary_label.

    A label that is not 0 or 1, or a row without it, comes back as null.
    """
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    if layout == "vector":
        frame, label = F.col("line_number"), F.get(cells, 0)
    elif layout == "indexed":
        frame, label = F.get(cells, 0).try_cast("long"), F.element_at(cells, -1)
    else:
        names = [c.strip().strip('"').lower() for c in (header or "frame_number,binary_label").lstrip("﻿").split(",")]
        frame = F.get(cells, names.index("frame_number")).try_cast("long")
        label = F.get(cells, names.index("binary_label"))
    number = label.try_cast("double").cast("int")
    return lines.select(
        frame.cast("long").alias("frame_number"), F.when(number.isin(0, 1), number).alias("binary_label")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with 1-based numbers, without moving the lines.

    The file is read in blocks; a row knows its block and its place in the task.
    One row per block carries the number of lines before it.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("_block").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_lines"))
    offsets = running_sums(blocks, [], ["_block"], {"_before": F.col("_lines")}).drop("_lines")
    return rows.join(offsets, "_block").select("value", (F.col("_id") - F.col("_low") + F.col("_before") + 1).alias("line_number"))


def packet_labels(spark: SparkSession, path: str) -> DataFrame:
    """Packet labels of one file in any of the three layouts."""
    head = spark.read.text(path).head(1)
    if not head:
        raise ValueError(f"label file {path} is empty")
    layout = label_layout(head[0][0])
    lines = numbered_lines(spark, path)
    if layout != "vector":
        lines = lines.where(F.col("line_number") > 1)
    return parse_labels(lines, layout, head[0][0])


def convert_labels(lines: DataFrame) -> DataFrame:
    """Two-column export -> canonical layout; short rows are skipped, labels cast through float."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    return lines.where(F.size(cells) >= 2).select(
        F.get(cells, 0).try_cast("double").cast("long").alias("frame_number"),
        F.get(cells, 1).try_cast("double").cast("int").alias("binary_label"),
    ).where(F.col("frame_number").isNotNull())


# Accepted splits and their aliases.
SPLITS = ["train", "calibration", "test", "train_calibration"]
SPLIT_ALIASES = {"validation": "calibration", "val": "calibration"}


def split_name(split: Column) -> Column:
    """Canonical split; null marks an unsupported one."""
    low = F.lower(F.trim(split))
    for alias, name in SPLIT_ALIASES.items():
        low = F.when(low == alias, name).otherwise(low)
    return F.when(low.isin(SPLITS), low)


SOURCE_FIELDS = "path string, label string, split string, labels string, dataset string, start_frame long, end_frame long, role string"


def sources_from_table(manifest: DataFrame) -> DataFrame:
    """manifest[pcap, label, split] -> capture sources."""
    return manifest.select(
        F.trim("pcap").alias("path"), F.trim("label").alias("label"), split_name(F.col("split")).alias("split"),
        F.lit(None).cast("string").alias("labels"), F.lit(None).cast("string").alias("dataset"),
        F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"),
        F.lit("manifest").alias("role"),
    )


JSON_MANIFEST = (
    "training struct<source_dataset: string, start_packet: long, end_packet: long>, "
    "evaluation struct<datasets: array<string>>, "
    "datasets map<string, struct<pcap: string, labels: string, total_packets: long, test_start_packet: long, test_end_packet: long>>"
)


def sources_from_json(manifest: DataFrame) -> DataFrame:
    """Manifest with one training range and test ranges per dataset -> capture sources."""
    each = manifest.select("training", "evaluation", F.explode("datasets").alias("dataset", "d"))
    no_end = lambda c: F.nullif(c, F.lit(0).cast("long"))
    train = each.where(F.col("dataset") == F.col("training.source_dataset")).select(
        F.col("d.pcap").alias("path"), F.lit("normal").alias("label"), F.lit("train_calibration").alias("split"),
        F.lit(None).cast("string").alias("labels"), "dataset",
        F.coalesce("training.start_packet", F.lit(1)).alias("start_frame"),
        no_end(F.coalesce("training.end_packet", "d.total_packets")).alias("end_frame"), F.lit("training").alias("role"),
    )
    test = each.where(F.array_contains("evaluation.datasets", F.col("dataset"))).select(
        F.col("d.pcap").alias("path"), F.lit("normal").alias("label"), F.lit("test").alias("split"),
        F.col("d.labels").alias("labels"), "dataset",
        F.coalesce("d.test_start_packet", F.lit(1)).alias("start_frame"),
        no_end(F.coalesce("d.test_end_packet", "d.total_packets")).alias("end_frame"), F.lit("evaluation").alias("role"),
    )
    return train.unionByName(test)


def resolve_sources(sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Drop duplicates by (path, dataset, role); refuse bad splits and missing files.

    `files[path]` lists what exists; leave it out to skip that check.
    """
    out = sources.dropDuplicates(["path", "dataset", "role"])
    if out.where(F.col("split").isNull()).limit(1).count():
        raise ValueError("manifest has an unsupported split")
    if files is not None:
        wanted = out.select("path").unionByName(out.where("labels IS NOT NULL").select(F.col("labels").alias("path")))
        missing = wanted.join(files, "path", "left_anti").distinct().limit(5).collect()
        if missing:
            raise FileNotFoundError(f"capture files do not exist: {[r[0] for r in missing]}")
    return out


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths that match a glob; only metadata is read."""
    return spark.read.format("binaryFile").load(pattern).select(F.regexp_replace("path", "^file:", "").alias("path"))
