"""Flow keys, window coordinates, identifiers and row classes as columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW_IDENTITY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
ENDPOINTS = ["endpoint_a_ip", "endpoint_a_port", "endpoint_b_ip", "endpoint_b_port", "protocol"]


def address_bytes(ip: Column) -> Column:
    """Packed form of an IPv4 or fully written IPv6 address, comparable as text in hex."""
    v4 = F.concat(*[F.lpad(F.hex(F.get(F.split(ip, r"\."), i).cast("int")), 2, "0") for i in range(4)])
    halves = F.split(ip, "::")
    left = F.when(F.get(halves, 0) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, 0), ":"))
    tail = F.coalesce(F.get(halves, 1), F.lit(""))
    right = F.when(tail == "", F.array().cast("array<string>")).otherwise(F.split(tail, ":"))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    v6 = F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(F.upper(g), 4, "0")), "")
    return F.when(ip.contains(":"), v6).otherwise(v4)


def endpoint_order(ip: Column, port: Column) -> Column:
    """Sort key of an endpoint: IP version, packed address, port."""
    version = F.when(ip.contains(":"), 6).otherwise(4)
    return F.struct(version.alias("version"), address_bytes(ip).alias("packed"), port.cast("int").alias("port"))


def directional_key(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "endpoint_a_ip": F.col("src_ip"), "endpoint_a_port": F.col("src_port"),
        "endpoint_b_ip": F.col("dst_ip"), "endpoint_b_port": F.col("dst_port"),
        "direction": F.lit(0),
    })


def canonical_key(df: DataFrame) -> DataFrame:
    src = endpoint_order(F.col("src_ip"), F.col("src_port"))
    dst = endpoint_order(F.col("dst_ip"), F.col("dst_port"))
    marked = df.withColumn("direction", F.when(src <= dst, 0).otherwise(1))
    forward = F.col("direction") == 0
    pick = lambda one, other: F.when(forward, F.col(one)).otherwise(F.col(other))
    return marked.withColumns({
        "endpoint_a_ip": pick("src_ip", "dst_ip"), "endpoint_a_port": pick("src_port", "dst_port"),
        "endpoint_b_ip": pick("dst_ip", "src_ip"), "endpoint_b_port": pick("dst_port", "src_port"),
    })


def flow_key(df: DataFrame, orientation: str) -> DataFrame:
    if orientation == "directional":
        return directional_key(df)
    if orientation == "bidirectional":
        return canonical_key(df)
    raise ValueError(f"unknown flow orientation {orientation!r}")


def window_coords(df: DataFrame, seconds: float, alignment: str = "epoch") -> DataFrame:
    """Window index, window start and offset inside the window."""
    ts = F.col("ts")
    if alignment == "epoch":
        index = F.floor(ts / F.lit(float(seconds)))
        return df.withColumn("window_index", index).withColumns({
            "window_start": F.col("window_index") * F.lit(float(seconds)),
            "offset": F.greatest(F.lit(0.0), ts - F.col("window_index") * F.lit(float(seconds))),
        })
    if alignment != "capture":
        raise ValueError(f"unknown window alignment {alignment!r}")
    origin = df.groupBy("capture_id").agg(F.min_by("ts", "frame_number").alias("_origin"))
    index = F.floor(F.greatest(F.lit(0.0), ts - F.col("_origin")) / F.lit(float(seconds)) + F.lit(1e-12))
    placed = df.join(origin, "capture_id").withColumn("window_index", index)
    start = F.col("_origin") + F.col("window_index") * F.lit(float(seconds))
    return placed.withColumns({
        "window_start": start, "offset": F.greatest(F.lit(0.0), ts - start),
    }).drop("_origin")


def micro_bin(offset: Column, width: float, bins: int) -> Column:
    """Micro-bin of an offset, clamped into the window."""
    return F.greatest(
        F.lit(0), F.least(F.lit(bins - 1), F.floor(offset / F.lit(float(width)) + F.lit(1e-12)))
    ).cast("int")


def tenth_bin(offset: Column, window: float) -> Column:
    """The ten-bin variant: truncate offset * 10 / window, clamped."""
    return F.greatest(
        F.lit(0), F.least(F.lit(9), F.floor(offset * F.lit(10.0) / F.lit(float(window))))
    ).cast("int")


def pair_key(a: Column, b: Column) -> Column:
    """Unordered IP pair; ports are left out on purpose."""
    return F.array_sort(F.array(a, b))


def channel_id(fields: Sequence[str]) -> Column:
    if not fields or len(set(fields)) != len(fields) or set(fields) - set(FLOW_IDENTITY):
        raise ValueError("channel fields must be distinct flow identity fields")
    return F.concat_ws("|", *[F.col(f).cast("string") for f in fields])


def with_ids(df: DataFrame, capture: str = "capture") -> DataFrame:
    """Stable SHA-1 identifiers of capture, flow and segment."""
    identity = F.concat_ws("|", F.col(capture), *[F.col(c).cast("string") for c in ENDPOINTS])
    return df.withColumns({
        "capture_id": F.substring(F.sha1(F.col(capture).cast("binary")), 1, 16),
        "flow_id": F.sha1(identity.cast("binary")),
        "segment_id": F.sha1(F.concat_ws("|", identity, F.col("window_index").cast("string")).cast("binary")),
    })


def eligible(df: DataFrame, protocols: Sequence[str] = ("tcp", "udp")) -> DataFrame:
    return df.where(F.col("protocol").isin(*protocols))


def enough_packets(flows: DataFrame, min_packets: int) -> DataFrame:
    return flows.where(F.col("packet_count") >= min_packets)


def normal_rows(df: DataFrame, split: str, label: str = "label_class") -> DataFrame:
    """Rows a normal-only fit may see."""
    return df.where((F.col("split") == split) & (F.col(label) == "normal"))


def normal_counts(df: DataFrame, split: str, label: str = "label_class") -> DataFrame:
    """One row: rows of the split that a normal-only fit may see, and those it may not."""
    normal = F.coalesce(F.col(label) == "normal", F.lit(False))
    return df.where(F.col("split") == split).agg(F.count_if(normal).alias("kept"), F.count_if(~normal).alias("excluded"))


def require_normal(df: DataFrame, split: str, label: str = "label_class") -> DataFrame:
    """As `normal_rows`, and an error that tells the excluded count when nothing is left."""
    counts = normal_counts(df, split, label).first()
    if not counts["kept"]:
        raise ValueError(f"no normal rows in split {split!r}; {counts['excluded']} others were excluded")
    return normal_rows(df, split, label)


UNLABELED = "__unlabeled__"


def label_class(label: Column, normal: Sequence[str], attack: Sequence[str]) -> Column:
    """normal, attack, unlabeled; null marks an unknown label."""
    low = F.lower(F.trim(label))
    return (
        F.when(label.isNull() | (label == UNLABELED), "unlabeled")
        .when(low.isin(*[n.lower() for n in normal]), "normal")
        .when(low.isin(*[a.lower() for a in attack]), "attack")
    )


def reject_unknown_labels(df: DataFrame, label: str, normal: Sequence[str], attack: Sequence[str]) -> DataFrame:
    unknown = df.where(label_class(F.col(label), normal, attack).isNull()).select(label).distinct()
    found = unknown.agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(label)), 1, 5).alias("first")).first()
    if found["n"]:
        more = f" and {found['n'] - 5} more" if found["n"] > 5 else ""
        raise ValueError(f"labels that are neither normal nor attack: {found['first']}{more}")
    return df


def service_name(df: DataFrame, detailed: bool = True) -> Column:
    """Service names for reports; scoring never reads them."""
    # Well-known ports of the monitored services.
    ports = F.array("endpoint_a_port", "endpoint_b_port")
    on = lambda proto, port: (F.lower(F.col("protocol")) == proto) & F.array_contains(ports, port)
    if not detailed:
        return (
            F.when(on("udp", 8000), "RTP").when(on("udp", 8001), "RTCP")
            .when(on("tcp", 8554), "RTSP").when(on("tcp", 8080), "ONVIF").otherwise("other")
        )
    rtsp = F.when(F.col("packet_count") > 100, "TCP interleaved video").otherwise("RTSP control")
    return (
        F.when(on("udp", 123), "NTP").when(on("udp", 8000), "RTP/UDP video").when(on("udp", 8001), "RTCP")
        .when(on("tcp", 8554), rtsp).when(on("tcp", 8080), "HTTP/ONVIF").otherwise("other")
    )


def phase_overlap(start: Column, begin: Column, end: Column, window: float) -> Column:
    """A window that overlaps the attack interval belongs to it."""
    return (
        F.when(start + F.lit(float(window)) <= begin, "pre_attack")
        .when(start <= end, "attack_window").otherwise("post_attack")
    )


def phase_half_open(start: Column, begin: Column, end: Column) -> Column:
    return F.when(start < begin, "before").when(start >= end, "after").otherwise("attack")


def entity_side(df: DataFrame, entity: str, fields: Sequence[str]) -> DataFrame:
    """Project the side of `entity` to `selected_<field>`; other rows are left out."""
    at_a = F.col("endpoint_a_ip") == entity
    at_b = F.col("endpoint_b_ip") == entity
    return df.where(at_a | at_b).withColumns({
        f"selected_{f}": F.when(at_a, F.col(f"entity_a_{f}")).otherwise(F.col(f"entity_b_{f}")) for f in fields
    })


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def log1p_vector(values: Column, log_dimensions: int) -> Column:
    """log1p of the first dimensions, negatives lifted to zero; the rest unchanged."""
    return F.transform(
        values, lambda x, i: F.when(i < log_dimensions, F.log1p(F.greatest(F.lit(0.0), x))).otherwise(x)
    )


def log1p_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p of non-negative finite columns; null marks a value that is neither."""
    return df.withColumns({
        f"log_{c}": F.when(finite(F.col(c).cast("double")) & (F.col(c) >= 0), F.log1p(F.col(c).cast("double")))
        for c in cols
    })
