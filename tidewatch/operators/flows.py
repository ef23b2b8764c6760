"""From packets to flow rows: segments, micro-bin tensors and flow statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.keys import (
    ENDPOINTS, FLOW_IDENTITY, canonical_key, directional_key, eligible,
    enough_packets, flow_key, micro_bin, tenth_bin, window_coords, with_ids,
)
from tidewatch.operators.calibration import unpivot
from tidewatch.operators.ordered import (
    SLICE, exact_quantiles, gather_cut, previous_row, row_positions, same_keys, slice_groups, sliced_positions, weighted_quantiles,
)
from tidewatch.session import shared_stage

SEGMENT = ["capture_id", "window_index", *ENDPOINTS]
FLOW = ["capture_id", "timestamp_second", *FLOW_IDENTITY]

# The 25 flow statistics in their published order.
FLOW_STATISTICS = [
    "packet_count", "byte_count", "active_duration",
    "packet_len_mean", "packet_len_std", "packet_len_min", "packet_len_max",
    "packet_len_p25", "packet_len_p50", "packet_len_p75",
    "iat_mean", "iat_std", "iat_min", "iat_max", "iat_p25", "iat_p50", "iat_p75", "iat_cv",
    "active_bin_count", "bin_bytes_mean", "bin_bytes_std", "bin_bytes_max",
    "bin_packets_mean", "bin_packets_std", "bin_packets_max",
]


def segments(
    packets: DataFrame,
    window: float,
    *,
    orientation: str = "bidirectional",
    alignment: str = "epoch",
    min_packets: int = 1,
    default_label: str = "normal",
) -> DataFrame:
    """One row per capture, window and flow key, with stable ids."""
    keyed = flow_key(window_coords(eligible(packets), window, alignment), orientation)
    grouped = keyed.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.col("wire_length").cast("long")).alias("byte_count"),
        F.min("window_start").alias("segment_start"),
        F.max("binary_label").alias("attack"),
    )
    named = grouped.withColumn("label_name", F.when(F.col("attack") == 1, "attack").otherwise(default_label))
    kept = enough_packets(named, min_packets).withColumn("capture", F.col("capture_id"))
    ids = with_ids(kept).select("capture", "flow_id", "segment_id", *[c for c in kept.columns if c != "capture"])
    return ids.drop("attack", "capture_id").withColumnRenamed("capture", "capture_id")


def _tensor(long: DataFrame, keys: list[str], bins: int, fields: list[str]) -> DataFrame:
    """Fold per-bin rows (at most `bins` per key) into a dense bins x fields array."""
    cell = F.struct("bin", F.array(*[F.col(f).cast("double") for f in fields]).alias("v"))
    filled = F.map_from_entries(F.collect_list(cell))
    empty = F.array(*[F.lit(0.0)] * len(fields))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("_cells", b), empty)
    )
    return long.groupBy(*keys).agg(filled.alias("_cells")).select(*keys, dense.alias("features"))


def microbins_bidir(packets: DataFrame, window: float, bins: int, alignment: str = "epoch") -> DataFrame:
    """Per bin: packets A/B, bytes A/B, mean length A/B; zero where empty."""
    placed = canonical_key(window_coords(eligible(packets), window, alignment))
    placed = placed.withColumn("bin", micro_bin(F.col("offset"), window / bins, bins))
    side = lambda d: F.col("direction") == d
    length = F.col("wire_length").cast("double")
    long = placed.groupBy(*SEGMENT, "bin").agg(
        F.count_if(side(0)).alias("packets_a"), F.count_if(side(1)).alias("packets_b"),
        F.coalesce(F.sum(F.when(side(0), length)), F.lit(0.0)).alias("bytes_a"),
        F.coalesce(F.sum(F.when(side(1), length)), F.lit(0.0)).alias("bytes_b"),
        F.coalesce(F.avg(F.when(side(0), length)), F.lit(0.0)).alias("mean_a"),
        F.coalesce(F.avg(F.when(side(1), length)), F.lit(0.0)).alias("mean_b"),
    )
    return _tensor(long, SEGMENT, bins, ["packets_a", "packets_b", "bytes_a", "bytes_b", "mean_a", "mean_b"])


def microbins_iat(packets: DataFrame, window: float, bins: int, alignment: str = "epoch") -> DataFrame:
    """Per bin: packets, bytes, length mean/std, inter-arrival mean/std in ms.

    The gap runs over the whole directed key in arrival order, across windows.
    """
    placed = directional_key(window_coords(eligible(packets), window, alignment))
    placed = placed.withColumn("bin", micro_bin(F.col("offset"), window / bins, bins))
    slim = placed.select(*SEGMENT, "bin", "frame_number", "ts", "wire_length")
    key = ["capture_id", *ENDPOINTS]
    gaps = previous_row(slim, key, ["frame_number"], ["ts"], "_prev")
    gaps = gaps.withColumn("gap_ms", F.greatest(F.lit(0.0), (F.col("ts") - F.col("_prev.ts")) * 1000.0))
    gaps = gaps.withColumn("gap_ms", F.when(F.col("_prev").isNotNull(), F.col("gap_ms")))
    length = F.col("wire_length").cast("double")
    long = gaps.groupBy(*SEGMENT, "bin").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(length).alias("bytes"),
        F.avg(length).alias("mean_length"), F.stddev_pop(length).alias("std_length"),
        F.coalesce(F.avg("gap_ms"), F.lit(0.0)).alias("mean_iat_ms"),
        F.coalesce(F.stddev_pop("gap_ms"), F.lit(0.0)).alias("std_iat_ms"),
    )
    return _tensor(long, SEGMENT, bins, ["packets", "bytes", "mean_length", "std_length", "mean_iat_ms", "std_iat_ms"])


def _mean_std_max(values: list[Column], name: str) -> list[Column]:
    n = len(values)
    total = values[0]
    for v in values[1:]:
        total = total + v
    mean = total / F.lit(float(n))
    spread = F.sqrt(F.aggregate(F.array(*values), F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.lit(float(n)))
    return [mean.alias(f"{name}_mean"), spread.alias(f"{name}_std"), F.greatest(*values).alias(f"{name}_max")]


def mergeable_aggregates() -> list[Column]:
    """Everything a flow needs but the spread of its gaps; a length has at most 1500 values."""
    length = F.col("wire_length").cast("double")
    quarter = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return [
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("wire_length").cast("long")).alias("_bytes"),
        F.min("ts").alias("first_packet_time"), F.max("ts").alias("_last"),
        F.min("frame_number").alias("event_id"), F.max("binary_label").alias("binary_label"),
        F.stddev_pop(length).alias("packet_len_std"), F.min("wire_length").alias("_min"),
        F.max("wire_length").alias("_max"), F.percentile(F.col("wire_length"), quarter).alias("_lq"),
        *[F.coalesce(F.sum(F.when(F.col("bin") == b, length)), F.lit(0.0)).alias(f"_b{b}") for b in range(10)],
        *[F.count_if(F.col("bin") == b).cast("double").alias(f"_p{b}") for b in range(10)],
    ]


def size_columns() -> list[Column]:
    """Counts, duration and length statistics from `mergeable_aggregates`."""
    return [
        F.col("_n").cast("double").alias("packet_count"), F.col("_bytes").cast("double").alias("byte_count"),
        (F.col("_last") - F.col("first_packet_time")).alias("active_duration"),
        (F.col("_bytes") / F.col("_n")).alias("packet_len_mean"), F.col("packet_len_std"),
        F.col("_min").cast("double").alias("packet_len_min"), F.col("_max").cast("double").alias("packet_len_max"),
        *[F.col("_lq")[i].alias(f"packet_len_p{q}") for i, q in enumerate((25, 50, 75))],
    ]


def bin_columns() -> list[Column]:
    """Active bins and the spread over all ten bins from `mergeable_aggregates`."""
    bin_bytes, bin_packets = ([F.col(f"_{k}{b}") for b in range(10)] for k in "bp")
    active = F.lit(0.0)
    for p in bin_packets:
        active = active + F.when(p > 0, 1.0).otherwise(0.0)
    return [active.alias("active_bin_count"), *_mean_std_max(bin_bytes, "bin_bytes"), *_mean_std_max(bin_packets, "bin_packets")]


def flow_statistics(packets: DataFrame, window: int = 1, keep_bins: bool = False, number: bool = False) -> DataFrame:
    """The 25 statistics of every directional flow of `window` seconds.

    Gaps come from slices of (flow, time). A flow within one slice is aggregated where it
    lies; one of more rows than a slice should hold is combined over its slices, its quartiles
    from sketches and counts, so that no flow has to fit into one task. With `number`, the same
    slices also give row_id, the position of the flow in its capture by (second, key).
    """
    w = F.lit(float(window))
    start = F.floor(F.col("ts") / w)
    rows = eligible(packets).select(
        "capture_id", (start * F.lit(int(window))).alias("timestamp_second"), *FLOW_IDENTITY,
        "ts", "frame_number", F.col("wire_length").cast("int").alias("wire_length"), "binary_label",
        tenth_bin(F.col("ts") - start * w, window).alias("bin"),
    )
    order = ["ts", "frame_number"]
    sliced, large = gather_cut(slice_groups(rows, FLOW, order), FLOW)
    quarters = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    gap_parts = [F.avg("gap").alias("_gm"), F.stddev_pop("gap").alias("_gs"), F.min("gap").alias("_g0"), F.max("gap").alias("_g1")]
    whole = sliced if large is None else same_keys(sliced, F.broadcast(large), FLOW).where("_several IS NULL").drop("_several")
    whole = whole.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy(*FLOW, SLICE).orderBy(*order)))
    flows = whole.groupBy(*FLOW, SLICE).agg(
        *mergeable_aggregates(), F.percentile("gap", F.array(*map(F.lit, quarters.values()))).alias("_gq"), *gap_parts).withColumnRenamed(SLICE, "_home")
    if large is not None:
        rest = same_keys(sliced, F.broadcast(large), FLOW, "inner").drop("_several")
        rest = previous_row(rest, FLOW, order, ["ts"], "_prev", sliced=True).withColumn("gap", F.col("ts") - F.col("_prev.ts"))
        sums = rest.groupBy(*FLOW).agg(*mergeable_aggregates(), *gap_parts, F.min(SLICE).alias("_home"))
        quartiles = exact_quantiles(rest, FLOW, "gap", quarters, few_groups=True).select(*FLOW, F.array(*quarters).alias("_gq"))
        flows = flows.unionByName(same_keys(sums, quartiles, FLOW))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bin_bytes = [F.col(f"_b{b}") for b in range(10)]
    bin_packets = [F.col(f"_p{b}") for b in range(10)]
    extra = [
        "event_id", "first_packet_time", "binary_label",
        *([F.array(*bin_packets).alias("bin_packets"), F.array(*bin_bytes).alias("bin_bytes")] if keep_bins else []),
    ]
    flows = flows.select(
        *FLOW, *size_columns(),
        zero(F.col("_gm")).alias("iat_mean"), zero(F.col("_gs")).alias("iat_std"),
        zero(F.col("_g0")).alias("iat_min"), zero(F.col("_g1")).alias("iat_max"),
        *[zero(F.get("_gq", i)).alias(f"iat_p{q}") for i, q in enumerate((25, 50, 75))],
        F.when(F.col("_gm") > 0, F.col("_gs") / F.col("_gm")).otherwise(0.0).alias("iat_cv"),
        *bin_columns(), *extra, "_home",
    )
    if not number:
        return flows.drop("_home")
    return sliced_positions(flows, sliced, FLOW[:1], FLOW[1:], "_home", "row_id")


def number_flows(flows: DataFrame) -> DataFrame:
    """row_id: position of the flow in its capture by (second, key); `flow_statistics` gives it at less cost."""
    order = ["timestamp_second", *FLOW_IDENTITY]
    return row_positions(flows, ["capture_id"], order, "row_id")


def flow_labels(flows: DataFrame) -> DataFrame:
    return flows.select("capture_id", "row_id", "binary_label")


def with_dense_ids(flows: DataFrame, order: str = "row_id") -> DataFrame:
    """Anonymous node, endpoint, connection and reverse-connection ids (equality only)."""
    side = lambda cols, tag: [F.col(c).alias(n) for c, n in cols] + [(F.col(order) * 2 + tag).alias("_at")]
    nodes = flows.select(*side([("src_ip", "ip")], 0)).union(flows.select(*side([("dst_ip", "ip")], 1)))
    node_ids = _first_seen(nodes, ["ip"], "node")
    ends = flows.select(*side([("src_ip", "ip"), ("src_port", "port")], 0)).union(
        flows.select(*side([("dst_ip", "ip"), ("dst_port", "port")], 1)))
    end_ids = _first_seen(ends, ["ip", "port"], "endpoint")
    plain = [(c, c) for c in FLOW_IDENTITY]
    turned = [("dst_ip", "src_ip"), ("src_ip", "dst_ip"), ("dst_port", "src_port"), ("src_port", "dst_port"), ("protocol", "protocol")]
    links = flows.select(*side(plain, 0)).union(flows.select(*side(turned, 1)))
    link_ids = _first_seen(links, FLOW_IDENTITY, "connection")
    back = link_ids.select(*[F.col(n).alias(c) for c, n in turned], F.col("connection").alias("reverse_connection"))
    rename = lambda ids, pairs: ids.select(*[F.col(a).alias(b) for a, b in pairs])
    out = flows.join(rename(node_ids, [("ip", "src_ip"), ("node", "source_node")]), ["src_ip"])
    out = out.join(rename(node_ids, [("ip", "dst_ip"), ("node", "destination_node")]), ["dst_ip"])
    out = out.join(rename(end_ids, [("ip", "src_ip"), ("port", "src_port"), ("endpoint", "source_endpoint")]), ["src_ip", "src_port"])
    out = out.join(rename(end_ids, [("ip", "dst_ip"), ("port", "dst_port"), ("endpoint", "destination_endpoint")]), ["dst_ip", "dst_port"])
    return out.join(link_ids, FLOW_IDENTITY).join(back, FLOW_IDENTITY)


def _first_seen(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Dense 0-based id per distinct key, in order of first appearance."""
    seen = rows.groupBy(*columns).agg(F.min("_at").alias("_at"))
    return row_positions(seen, [], ["_at", *columns], name).drop("_at")


def flow_slices(packets: DataFrame, seconds: int = 1) -> DataFrame:
    """Variable-length slices with ten-bin arrays, first bin and first-packet time."""
    flows = flow_statistics(packets, seconds, keep_bins=True)
    origin = flows.groupBy("capture_id").agg(F.min("timestamp_second").alias("_origin"))
    first = F.col("first_packet_time")
    return flows.join(origin, "capture_id").withColumns({
        "first_bin": tenth_bin(first - F.col("timestamp_second"), seconds),
        "first_packet_time": first - F.col("_origin"),
    }).drop("_origin")


def refuse_short(rows: DataFrame, unit: str, least: int, what: str) -> None:
    """Raise when a capture has fewer than `least` distinct values of `unit`; names up to twenty of them."""
    sizes = rows.groupBy("capture_id").agg(F.count_distinct(unit).alias("n"))
    short = sizes.where(F.col("n") < least)
    names = [str(r["capture_id"]) for r in short.orderBy("capture_id").limit(21).collect()]
    if names:
        more = " and others" if len(names) > 20 else ""
        raise ValueError(f"{what}: fewer than {least} active in {', '.join(names[:20])}{more}")


def split_calibration(rows: DataFrame, fraction: float) -> DataFrame:
    """Per capture: the last max(1, round(f*n)) active windows become calibration.

    A capture with one active window leaves nothing to train on and is refused.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("calibration fraction must lie between zero and one")
    refuse_short(rows, "window_index", 2, "calibration split needs windows for both parts")
    windows = rows.select("capture_id", "window_index").distinct()
    counts = windows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_positions(windows, ["capture_id"], [F.desc("window_index")], "_back")
    take = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("long"))
    cutoff = ranked.join(counts, "capture_id").where(F.col("_back") == take - 1)
    cutoff = cutoff.select("capture_id", F.col("window_index").alias("_cut"))
    return rows.join(cutoff, "capture_id").withColumn(
        "split", F.when(F.col("window_index") >= F.col("_cut"), "calibration").otherwise("train")
    ).drop("_cut")


def _second_at(rows: DataFrame, by: list[str], position: Column) -> DataFrame:
    seconds = rows.select(*by, "timestamp_second").distinct()
    counts = seconds.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_positions(seconds, by, ["timestamp_second"], "_at")
    return ranked.join(counts, by).where(F.col("_at") == position).select(*by, F.col("timestamp_second").alias("_cut"))


def split_seconds(rows: DataFrame, validation: float, halves: bool = True) -> DataFrame:
    """Chronological train / held-out split; the held-out half calibrates parts, then the joint score.

    A capture with one active second cannot be split and is refused.
    """
    refuse_short(rows, "timestamp_second", 2, "chronological split needs seconds for both parts")
    at = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(1.0 - validation)))
    cut = _second_at(rows, ["capture_id"], at)
    marked = rows.join(cut, "capture_id").withColumn(
        "part", F.when(F.col("timestamp_second") < F.col("_cut"), "train").otherwise("heldout")
    ).drop("_cut")
    if not halves:
        return marked
    half = _second_at(marked.where(F.col("part") == "heldout"), ["capture_id"], F.floor(F.col("_n") / 2))
    return marked.join(half, "capture_id", "left").withColumn(
        "part",
        F.when(F.col("part") == "train", "train")
        .when(F.col("timestamp_second") < F.col("_cut"), "component_calibration")
        .otherwise("joint_calibration"),
    ).drop("_cut")


def reuse_split(rows: DataFrame) -> DataFrame:
    """Use the training rows for calibration as well, under suffixed segment ids."""
    again = F.concat("segment_id", F.lit("::reused_for_calibration"))
    train = rows.withColumn("split", F.lit("train"))
    return train.unionByName(rows.withColumns({"split": F.lit("calibration"), "segment_id": again}))


def load_summary(flows: DataFrame, tick: int = 1) -> DataFrame:
    """Per capture: mean, p95, p99 and peak of flows, packets and bytes per tick, silent ticks included.

    Silent ticks are one run of zeros a capture, weighted by their number: a timestamp far off
    costs nothing.
    """
    busy = flows.groupBy("capture_id", F.floor(F.col("timestamp_second") / tick).alias("tick")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packet_count").cast("long").alias("packets"),
        F.sum("byte_count").cast("long").alias("bytes"),
    )
    busy = shared_stage(busy)
    measures = ("flows", "packets", "bytes")
    duration = F.max("tick") - F.min("tick") + 1
    out = busy.groupBy("capture_id").agg(
        duration.alias("duration"), (duration - F.count(F.lit(1))).alias("silent"),
        *[c for m in measures for c in ((F.sum(m) / duration).alias(f"{m}_mean"), F.max(m).alias(f"{m}_peak"))])
    zeros = out.select("capture_id", F.explode(F.array(*map(F.lit, measures))).alias("component"), F.lit(0.0).alias("value"), F.col("silent").alias("weight"))
    loads = unpivot(busy, ["capture_id"], measures).select("capture_id", "component", F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("weight"))
    q = weighted_quantiles(loads.unionByName(zeros), ["capture_id", "component"], "value", "weight", {"p95": 0.95, "p99": 0.99})
    out = same_keys(out.drop("silent"), q.groupBy("capture_id").agg(
        *[F.max(F.when(F.col("component") == m, F.col(n))).alias(f"{m}_{n}") for m in measures for n in ("p95", "p99")]), ["capture_id"], "inner")
    scale = F.lit(8e-6 / tick)
    return out.withColumns({f"mbps_{n}": F.col(f"bytes_{n}") * scale for n in ("mean", "p95", "p99", "peak")})
