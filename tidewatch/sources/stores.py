"""Flow tables, segment store, reference profiles and score sinks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.keys import FLOW_IDENTITY, UNLABELED, finite
from tidewatch.operators.flows import FLOW_STATISTICS
from tidewatch.operators.ordered import previous_row

FLOW_TABLE = ["row_id", "timestamp_second", *FLOW_IDENTITY, *FLOW_STATISTICS]


def flow_contract(df: DataFrame) -> DataFrame:
    """Refuse a flow table that lacks a contract column; project to the contract."""
    missing = sorted(set(FLOW_TABLE) - set(df.columns))
    if missing:
        raise ValueError(f"missing flow columns: {missing}")
    extra = [c for c in ("capture_id", "binary_label") if c in df.columns]
    return df.select(*extra, *FLOW_TABLE)


# Fixed types of the text form; what a file has beyond them is not read.
FLOW_TYPES = {
    "capture_id": "string", "binary_label": "int", "row_id": "long", "timestamp_second": "long", "src_ip": "string", "dst_ip": "string",
    "src_port": "int", "dst_port": "int", "protocol": "string", **{c: "double" for c in FLOW_STATISTICS},
}


def read_flows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Flow table under the column contract; consumers order by (second, row_id) where they need it."""
    if fmt != "csv":
        return flow_contract(spark.read.format(fmt).load(path))
    plain = spark.read.option("header", "true").csv(path)  # names only: all columns are text
    return flow_contract(plain.select(*[F.col(c).cast(FLOW_TYPES[c]).alias(c) for c in plain.columns if c in FLOW_TYPES]))


def validate_capture(flows: DataFrame, training: bool = False) -> DataFrame:
    """One row per rule with the number of violations, in one pass plus one order check."""
    stats = [F.col(c).cast("double") for c in FLOW_STATISTICS]
    bad_number, negative = F.lit(False), F.lit(False)
    for c in stats:
        bad_number, negative = bad_number | ~finite(c), negative | (c < 0)
    ordered = previous_row(flows, ["capture_id"], ["row_id"], ["timestamp_second"], "_prev")
    rules = {
        "not_finite": F.count_if(bad_number),
        "negative": F.count_if(negative),
        "no_packet": F.count_if(F.col("packet_count") < 1),
        "unordered_seconds": F.count_if(F.col("timestamp_second") < F.col("_prev.timestamp_second")),
        "duplicate_rows": F.count(F.lit(1)) - F.count_distinct("capture_id", "row_id"),
        "duplicate_events": F.count(F.lit(1)) - F.count_distinct("event_id"),
        "bin_packets_differ": F.count_if(F.abs(F.col("bin_packets_mean") * 10 - F.col("packet_count")) > 1e-6 * F.col("packet_count")),
        "bin_bytes_differ": F.count_if(F.abs(F.col("bin_bytes_mean") * 10 - F.col("byte_count")) > 1e-6 * F.col("byte_count")),
    }
    if training:
        rules["labels_in_training"] = F.count_if(F.lit("binary_label" in flows.columns))
    counts = ordered.agg(*[v.alias(k) for k, v in rules.items()])
    gaps = flows.groupBy("capture_id").agg((F.max("row_id") + 1 - F.count(F.lit(1)) + F.min("row_id")).alias("g"))
    # Unpivot of one row; row numbering gaps come from the per-capture table.
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("violations")) for k in rules])
    first = counts.select(F.inline(pairs))
    return first.unionByName(gaps.agg(F.coalesce(F.sum(F.abs("g")), F.lit(0)).cast("long").alias("violations")).select(F.lit("row_id_gaps").alias("rule"), "violations"))


def write_segments(segments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Segment store, one folder per split and capture."""
    segments.write.mode(mode).partitionBy("split", "capture_id").parquet(path)


def segment_metadata(segments: DataFrame) -> DataFrame:
    """Counts of segments, packets and bytes per split and label, with subtotals."""
    return segments.cube("split", "label_name").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("segments"),
        F.sum("packet_count").alias("packets"), F.sum("byte_count").alias("bytes"),
    )


def with_label_ids(segments: DataFrame, names: Sequence[str]) -> DataFrame:
    """Numeric label and split ids; -1 for unlabeled."""
    label = F.lit(-1)
    for i, name in enumerate(sorted(names)):
        label = F.when(F.col("label_name") == name, i).otherwise(label)
    # Split ids.
    split = F.when(F.col("split") == "train", 0).when(F.col("split") == "calibration", 1).when(F.col("split") == "test", 2)
    return segments.withColumns({"label_id": label, "split_id": split})


def save_reference(pairs: DataFrame, entities: DataFrame, path: str, mode: str = "errorifexists") -> None:
    pairs.write.mode(mode).parquet(f"{path}/pairs")
    entities.write.mode(mode).parquet(f"{path}/entities")


def load_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/entities")


def score_rows(scores: DataFrame, labels: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Scores with their label name; rows without one are marked unlabeled."""
    if labels is None:
        return scores.withColumn("label_name", F.lit(UNLABELED))
    return scores.join(labels, list(key), "left").withColumn("label_name", F.coalesce("label_name", F.lit(UNLABELED)))


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = scores.write.mode(mode)
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)
