"""Alignment joins and their checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import FLOW_IDENTITY, canonical_key
from tidewatch.operators.ordered import last_known

FRAME = ["capture_id", "frame_number"]


def attach_labels(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of every packet by frame; null where the label table has no such frame."""
    return packets.join(labels, FRAME, "left")


def label_violations(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """Eligible packets without a label; must be empty."""
    return packets.select(*FRAME).join(labels.where("binary_label IS NOT NULL"), FRAME, "left_anti")


def require_labels(packets: DataFrame, labels: DataFrame) -> DataFrame:
    if not label_violations(packets, labels).isEmpty():
        raise ValueError("packet labels do not cover every eligible frame")
    return attach_labels(packets, labels)


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def align(scores: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Outer join with a side indicator: both, left_only, right_only."""
    left, right = scores.withColumn("_l", F.lit(1)), labels.withColumn("_r", F.lit(1))
    joined = left.join(right, list(key), "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return joined.withColumn("side", side).drop("_l", "_r")


def require_aligned(scores: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """One-to-one join; refuses duplicate keys and differing populations."""
    for side in (scores, labels):
        if not duplicates(side, key).isEmpty():
            raise ValueError(f"duplicate {list(key)}")
    joined = align(scores, labels, key)
    if not joined.where("side <> 'both'").isEmpty():
        raise ValueError("scores and labels have different rows")
    return joined.drop("side")


def population_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one table that the other lacks, with multiplicity; empty when aligned."""
    count = lambda df, name: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    both = count(a, "_a").join(count(b, "_b"), list(columns), "full").fillna(0, ["_a", "_b"])
    return both.select(*columns, (F.col("_a") - F.col("_b")).alias("surplus")).where("surplus <> 0")


def reverse_flows(flows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Each flow with the flow of the exact reverse key in the same second, if there is one."""
    swapped = flows.select(
        "capture_id", "timestamp_second", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
        F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"), "protocol",
        *[F.col(v).alias(f"reverse_{v}") for v in values])
    return flows.join(swapped, ["capture_id", "timestamp_second", *FLOW_IDENTITY], "left")


def causal_response(packets: DataFrame, tolerance: float) -> DataFrame:
    """Attack packets, and packets that answer one on the exact reverse key within `tolerance` seconds.

    The last attack time per direction is carried along the shared two-way key.
    """
    keyed = canonical_key(packets)
    shared = ["capture_id", "endpoint_a_ip", "endpoint_a_port", "endpoint_b_ip", "endpoint_b_port", "protocol"]
    attack = F.col("binary_label") == 1
    # A self-addressed key has one direction only and answers itself.
    loop = (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") == F.col("dst_port"))
    heads = F.struct(*[
        F.when(attack & ((F.col("direction") == d) | loop), F.col("ts")).alias(f"d{d}") for d in (0, 1)])
    rows = keyed.withColumn("_h", heads)
    rows = last_known(rows, shared, ["ts", "frame_number"], {f"_last{d}": F.col(f"_h.d{d}") for d in (0, 1)})
    other = F.when(F.col("direction") == 0, F.col("_last1")).otherwise(F.col("_last0"))
    answer = ~attack & other.isNotNull() & (F.col("ts") - other <= F.lit(float(tolerance)))
    return rows.withColumns({
        "response": F.coalesce(answer, F.lit(False)),
        "causal_label": F.when(attack | answer, 1).otherwise(0),
    }).drop("_h", "_last0", "_last1", *[c for c in shared if c.startswith("endpoint")], "direction")


def causal_summary(relabelled: DataFrame) -> DataFrame:
    return relabelled.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("binary_label").cast("long").alias("original_attack_packets"),
        F.count_if("response").alias("response_packets"), F.sum("causal_label").cast("long").alias("causal_attack_packets"))
