"""The whole chain: packets -> flows -> behaviour -> activity -> calibrated score -> flag."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.vectors import vector_mean
from tidewatch.operators import activity, calibration
from tidewatch.operators.flows import FLOW_STATISTICS, flow_statistics
from tidewatch.session import bounded_rows, shared_stage

KEY = ["capture_id", "row_id"]


def seeded_prototypes(rows: DataFrame, seed: str, vector: str, dims: int) -> list[list[float]]:
    """One prototype per value of a column with few values: the mean vector."""
    means = rows.groupBy(seed).agg(vector_mean(F.col(vector), dims).alias("c")).orderBy(seed)
    return [list(r["c"]) for r in bounded_rows(means, calibration.MOST_PROTOTYPES)]


def detect(
    packets: DataFrame, window: int = 1, *, history: int = 16, prototypes: int = 8,
    seed_column: Column | None = None, normal: Column | None = None,
) -> DataFrame:
    """Score every flow by its distance from normal prototypes and by the mass of its sender's behaviour.

    Fits on normal rows only; both parts are aligned on their normal q50 and q95 and
    summed, and a flow is flagged strictly above the normal q99 of the sum.
    """
    normal = F.col("binary_label") == 0 if normal is None else normal
    flows = flow_statistics(packets, window, number=True)
    if seed_column is not None:
        flows = flows.withColumn("_seed", seed_column)
    flows = shared_stage(flows.withColumn("_normal", normal))  # read by the fits and by the scoring
    scaler = calibration.fit_robust(flows.where("_normal"), FLOW_STATISTICS, 0.05)
    scaled = calibration.apply_scaler(flows, scaler, FLOW_STATISTICS)
    scaled = scaled.withColumn("_z", F.array(*[f"z_{c}" for c in FLOW_STATISTICS])).drop(*[f"z_{c}" for c in FLOW_STATISTICS])
    fit = scaled.where("_normal")
    if seed_column is not None:
        centers = seeded_prototypes(fit, "_seed", "_z", len(FLOW_STATISTICS))
    else:
        centers = calibration.fit_prototypes(fit, "_z", prototypes)
    near = calibration.nearest_prototype(scaled, "_z", centers).drop("_z", "distance")
    near = near.withColumnsRenamed({"prototype": "behaviour", "scaled_distance": "prototype_raw"})
    cells = activity.intensity_score(activity.activity(near), history, tick=window)
    senders = cells.where(F.col("direction") == activity.SENDER).select(
        "capture_id", F.col("node").alias("src_ip"), "timestamp_second", "behaviour", "mass_raw", "history_length",
        F.col("flows").alias("group_flow_count"), F.col("packets").alias("group_packet_count"), F.col("bytes").alias("group_byte_count"))
    scored = near.join(senders, ["capture_id", "src_ip", "timestamp_second", "behaviour"])
    scored = shared_stage(scored.select(
        *KEY, "timestamp_second", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "behaviour", "prototype_raw", "mass_raw",
        "history_length", "group_flow_count", "group_packet_count", "group_byte_count", "binary_label", "_normal"))
    parts = {r["component"]: r for r in bounded_rows(calibration.fit_affine(scored.where("_normal"), ["prototype_raw", "mass_raw"]), 2)}
    aligned = lambda c: calibration.affine_scaled(F.col(c), F.lit(parts[c]["q50"]), F.lit(parts[c]["q95"]))
    scored = scored.withColumns({"prototype_scaled": aligned("prototype_raw"), "mass_scaled": aligned("mass_raw")})
    scored = scored.withColumn("final_score", calibration.fuse([F.col("prototype_scaled"), F.col("mass_scaled")], "sum"))
    limit = bounded_rows(calibration.fit_affine(scored.where("_normal"), ["final_score"]), 1)[0]["q99"]
    return scored.withColumn("flag", F.col("final_score") > F.lit(limit)).drop("_normal")
