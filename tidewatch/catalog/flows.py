"""Flow building."""
from pyspark.sql import functions as F

from tidewatch.catalog.registry import IDENTITY_SQL, ctes, grid, grid_sql, grids, grids_sql, query
from tidewatch.operators import flows as ops
from tidewatch.plans.views import SHORT_WINDOW, TICK, WINDOW, packets

BINS = 30  # of the micro-bin tensors
STAT_SQL = grids_sql(*ops.FLOW_STATISTICS, digits=4)


@query("a1_segments", ctes("packets", ("keyed", f"""
SELECT capture_id, CAST(floor(ts / {WINDOW}.0) AS BIGINT) AS window_index, protocol, wire_length, binary_label,
  (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS fwd, src_ip, src_port, dst_ip, dst_port
FROM packets"""), ("seg", """
SELECT capture_id, window_index,
  CASE WHEN fwd THEN src_ip ELSE dst_ip END AS endpoint_a_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS endpoint_a_port,
  CASE WHEN fwd THEN dst_ip ELSE src_ip END AS endpoint_b_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS endpoint_b_port,
  protocol, count(*) AS packet_count, CAST(sum(wire_length) AS BIGINT) AS byte_count, max(binary_label) AS attack
FROM keyed GROUP BY ALL""")) + f"""
SELECT capture_id, window_index, endpoint_a_ip, endpoint_b_ip, CAST(endpoint_a_port AS BIGINT) AS endpoint_a_port,
  CAST(endpoint_b_port AS BIGINT) AS endpoint_b_port, protocol, packet_count, byte_count,
  window_index * {WINDOW}.0::DOUBLE AS segment_start,
  CASE WHEN attack = 1 THEN 'attack' ELSE 'normal' END AS label_name,
  sha1(concat_ws('|', capture_id, endpoint_a_ip, endpoint_a_port, endpoint_b_ip, endpoint_b_port, protocol)) AS flow_id,
  sha1(concat_ws('|', capture_id, endpoint_a_ip, endpoint_a_port, endpoint_b_ip, endpoint_b_port, protocol, window_index)) AS segment_id
FROM seg""")
def a1_segments(spark, sf):
    out = ops.segments(packets(spark, sf), WINDOW)
    return out.withColumns({c: F.col(c).cast("long") for c in ("endpoint_a_port", "endpoint_b_port")})


def _long_tensor(df, names):
    rows = df.select(*ops.SEGMENT, F.posexplode("features").alias("bin", "v"))
    return rows.select(
        "capture_id", "window_index", "endpoint_a_ip", "endpoint_b_ip",
        F.col("endpoint_a_port").cast("long").alias("endpoint_a_port"),
        F.col("endpoint_b_port").cast("long").alias("endpoint_b_port"), "protocol",
        F.col("bin").cast("long").alias("bin"), *[grid(F.col("v")[i], 4).alias(n) for i, n in enumerate(names)],
    )


_A2 = ["packets_a", "packets_b", "bytes_a", "bytes_b", "mean_a", "mean_b"]


def _tensor_sql(keyed: str, cells: str, names) -> str:
    keys = "capture_id, window_index, endpoint_a_ip, endpoint_a_port, endpoint_b_ip, endpoint_b_port, protocol"
    return ctes("packets", ("keyed", keyed), ("cells", f"SELECT {keys}, bin, {cells} FROM keyed GROUP BY ALL"),
                ("axis", f"SELECT DISTINCT {keys}, unnest(range({BINS})) AS bin FROM keyed")) + f"""
SELECT capture_id, window_index, endpoint_a_ip, endpoint_b_ip, CAST(endpoint_a_port AS BIGINT) AS endpoint_a_port,
  CAST(endpoint_b_port AS BIGINT) AS endpoint_b_port, protocol, CAST(bin AS BIGINT) AS bin,
  {", ".join(f"{grid_sql(f'coalesce({n}, 0)', 4)} AS {n}" for n in names)}
FROM axis LEFT JOIN cells USING ({keys}, bin)"""


_BIN = f"""CAST(floor(ts / {WINDOW}.0) AS BIGINT) AS window_index,
  greatest(0, least({BINS - 1}, CAST(floor((ts - floor(ts / {WINDOW}.0) * {WINDOW}.0) / {WINDOW / BINS} + 1e-12) AS BIGINT))) AS bin"""


@query("a2_microbins_bidir", _tensor_sql(f"""
SELECT capture_id, protocol, wire_length, {_BIN}, fwd,
  CASE WHEN fwd THEN src_ip ELSE dst_ip END AS endpoint_a_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS endpoint_a_port,
  CASE WHEN fwd THEN dst_ip ELSE src_ip END AS endpoint_b_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS endpoint_b_port
FROM (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS fwd FROM packets)""",
    """count(*) FILTER (WHERE fwd) AS packets_a, count(*) FILTER (WHERE NOT fwd) AS packets_b,
  sum(CASE WHEN fwd THEN wire_length END) AS bytes_a, sum(CASE WHEN NOT fwd THEN wire_length END) AS bytes_b,
  avg(CASE WHEN fwd THEN wire_length END) AS mean_a, avg(CASE WHEN NOT fwd THEN wire_length END) AS mean_b""", _A2))
def a2_microbins_bidir(spark, sf):
    return _long_tensor(ops.microbins_bidir(packets(spark, sf), WINDOW, BINS), _A2)


_A3 = ["packets", "bytes", "mean_length", "std_length", "mean_iat_ms", "std_iat_ms"]


@query("a3_microbins_iat", _tensor_sql(f"""
SELECT capture_id, protocol, wire_length, {_BIN}, src_ip AS endpoint_a_ip, src_port AS endpoint_a_port,
  dst_ip AS endpoint_b_ip, dst_port AS endpoint_b_port,
  greatest(0, (ts - lag(ts) OVER (PARTITION BY capture_id, {IDENTITY_SQL} ORDER BY frame_number)) * 1000.0)
    + CASE WHEN lag(ts) OVER (PARTITION BY capture_id, {IDENTITY_SQL} ORDER BY frame_number) IS NULL THEN NULL ELSE 0 END AS gap
FROM packets""",
    """count(*) AS packets, sum(wire_length) AS bytes, avg(wire_length) AS mean_length,
  stddev_pop(wire_length) AS std_length, avg(gap) AS mean_iat_ms, stddev_pop(gap) AS std_iat_ms""", _A3))
def a3_microbins_iat(spark, sf):
    return _long_tensor(ops.microbins_iat(packets(spark, sf), WINDOW, BINS), _A3)


_KEY = ["capture_id", "timestamp_second", "src_ip", "dst_ip", "protocol"]


def _flow_columns(df):
    return [*_KEY, *[F.col(c).cast("long").alias(c) for c in ("src_port", "dst_port")]]


_FLOW_KEY_SQL = "capture_id, timestamp_second, src_ip, dst_ip, protocol, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port"


@query("a4_flow_features", ctes("flows") + f"SELECT {_FLOW_KEY_SQL}, {STAT_SQL} FROM flows")
def a4_flow_features(spark, sf):
    flows = ops.flow_statistics(packets(spark, sf), WINDOW)
    return flows.select(*_flow_columns(flows), *grids(*ops.FLOW_STATISTICS, digits=4))


@query("a5_single_packet_flows", ctes("packets", ("one", f"""
SELECT capture_id, CAST(floor(ts / 600.0) AS BIGINT) * 600 AS timestamp_second, {IDENTITY_SQL}, max(wire_length)::DOUBLE AS len
FROM packets GROUP BY ALL HAVING count(*) = 1""")) + f"""
SELECT {_FLOW_KEY_SQL}, 1.0::DOUBLE AS packet_count, len AS byte_count, 0.0::DOUBLE AS active_duration,
  len AS packet_len_mean, 0.0::DOUBLE AS packet_len_std, len AS packet_len_min, len AS packet_len_max,
  len AS packet_len_p25, len AS packet_len_p50, len AS packet_len_p75,
  {", ".join(f"0.0::DOUBLE AS {n}" for n in ops.FLOW_STATISTICS[10:18])}, 1.0::DOUBLE AS active_bin_count,
  {grid_sql("len / 10", 4)} AS bin_bytes_mean, {grid_sql("len * 0.3", 4)} AS bin_bytes_std, len AS bin_bytes_max,
  {grid_sql("0.1", 4)} AS bin_packets_mean, {grid_sql("0.3", 4)} AS bin_packets_std, 1.0::DOUBLE AS bin_packets_max
FROM one""")
def a5_single_packet_flows(spark, sf):
    flows = ops.flow_statistics(packets(spark, sf), 600).where("packet_count = 1")
    return flows.select(*_flow_columns(flows), *grids(*ops.FLOW_STATISTICS, digits=4))


@query("a6_numbered_flows", ctes("flows") + f"SELECT {_FLOW_KEY_SQL}, row_id, binary_label FROM flows")
def a6_numbered_flows(spark, sf):
    flows = ops.flow_statistics(packets(spark, sf), WINDOW, number=True)
    return flows.select(*_flow_columns(flows), "row_id", "binary_label")


@query("a7_flow_slices", ctes("sflows") + f"""
SELECT {_FLOW_KEY_SQL}, event_id, CAST(b.bin AS BIGINT) AS bin, {grid_sql("f.bin_packets[b.bin + 1]", 3)} AS bin_packets,
  {grid_sql("f.bin_bytes[b.bin + 1]", 3)} AS bin_bytes,
  CAST(greatest(0, least(9, floor((first_ts - timestamp_second) * 10.0 / {SHORT_WINDOW}.0))) AS BIGINT) AS first_bin,
  {grid_sql("first_ts - min(timestamp_second) OVER (PARTITION BY capture_id)", 4)} AS first_packet_time
FROM sflows f, (SELECT unnest(range(10)) AS bin) b""")
def a7_flow_slices(spark, sf):
    s = ops.flow_slices(packets(spark, sf), SHORT_WINDOW)
    cells = F.arrays_zip("bin_packets", "bin_bytes")
    s = s.select("*", F.posexplode(cells).alias("bin", "cell"))
    return s.select(
        *_flow_columns(s), "event_id", F.col("bin").cast("long").alias("bin"),
        grid("cell.bin_packets", 3).alias("bin_packets"), grid("cell.bin_bytes", 3).alias("bin_bytes"),
        F.col("first_bin").cast("long").alias("first_bin"), grid("first_packet_time", 4).alias("first_packet_time"),
    )


@query("a8_calibration_split", ctes("packets", ("seg", f"""
SELECT DISTINCT capture_id, CAST(floor(ts / {SHORT_WINDOW}.0) AS BIGINT) AS window_index, {IDENTITY_SQL} FROM packets"""), ("w", """
SELECT capture_id, window_index, row_number() OVER (PARTITION BY capture_id ORDER BY window_index DESC) AS back,
  count(*) OVER (PARTITION BY capture_id) AS n FROM (SELECT DISTINCT capture_id, window_index FROM seg)"""), ("cut", """
SELECT capture_id, window_index AS cut FROM w WHERE back = greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT))""")) + """
SELECT capture_id, window_index, CASE WHEN window_index >= cut THEN 'calibration' ELSE 'train' END AS split, count(*) AS flows
FROM seg JOIN cut USING (capture_id) GROUP BY ALL""")
def a8_calibration_split(spark, sf):
    seg = ops.segments(packets(spark, sf), SHORT_WINDOW, orientation="directional")
    return ops.split_calibration(seg, 0.2).groupBy("capture_id", "window_index", "split").agg(F.count("*").alias("flows"))


@query("a9_second_split", ctes("sflows", ("s", """
SELECT capture_id, timestamp_second, row_number() OVER (PARTITION BY capture_id ORDER BY timestamp_second) - 1 AS pos,
  count(*) OVER (PARTITION BY capture_id) AS n FROM (SELECT DISTINCT capture_id, timestamp_second FROM sflows)"""), ("held", """
SELECT *, pos < greatest(1, floor(n * (1.0::DOUBLE - 0.25::DOUBLE))) AS train,
  greatest(1, floor(n * (1.0::DOUBLE - 0.25::DOUBLE))) AS cut FROM s""")) + """
SELECT h.capture_id, h.timestamp_second, CASE WHEN train THEN 'train'
    WHEN pos - cut < floor((n - cut) / 2) THEN 'component_calibration' ELSE 'joint_calibration' END AS part, count(*) AS flows
FROM held h JOIN sflows f ON h.capture_id = f.capture_id AND h.timestamp_second = f.timestamp_second GROUP BY ALL""")
def a9_second_split(spark, sf):
    flows = ops.flow_statistics(packets(spark, sf), SHORT_WINDOW)
    parts = ops.split_seconds(flows, 0.25)
    return parts.groupBy("capture_id", "timestamp_second", "part").agg(F.count("*").alias("flows"))


@query("a10_reused_split", ctes("packets", ("seg", f"""
SELECT DISTINCT capture_id, CAST(floor(ts / {WINDOW}.0) AS BIGINT) AS window_index, {IDENTITY_SQL} FROM packets"""), ("ids", """
SELECT *, sha1(concat_ws('|', capture_id, src_ip, src_port, dst_ip, dst_port, protocol, window_index)) AS segment_id FROM seg""")) + """
SELECT capture_id, window_index, segment_id, 'train' AS split FROM ids UNION ALL
SELECT capture_id, window_index, segment_id || '::reused_for_calibration', 'calibration' FROM ids""")
def a10_reused_split(spark, sf):
    seg = ops.segments(packets(spark, sf), WINDOW, orientation="directional")
    return ops.reuse_split(seg).select("capture_id", "window_index", "segment_id", "split")


_LOAD = [f"{m}_{n}" for m in ("flows", "packets", "bytes", "mbps") for n in ("mean", "p95", "p99", "peak")]


@query("a11_load_summary", ctes("packets", ("f", f"""
SELECT capture_id, CAST(floor(ts / {TICK}.0) AS BIGINT) AS tick, {IDENTITY_SQL}, count(*) AS p, sum(wire_length) AS b
FROM packets GROUP BY ALL"""), ("busy", "SELECT capture_id, tick, count(*) AS flows, sum(p) AS packets, sum(b) AS bytes FROM f GROUP BY ALL"),
    ("axis", "SELECT capture_id, max(tick) - min(tick) + 1 AS duration, unnest(range(min(tick), max(tick) + 1)) AS tick FROM busy GROUP BY capture_id"),
    ("dense", """SELECT capture_id, duration, coalesce(flows, 0) AS flows, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes
FROM axis LEFT JOIN busy USING (capture_id, tick)"""), ("s", "SELECT capture_id, duration, " + ", ".join(
        f"avg({m}) AS {m}_mean, quantile_cont({m}, 0.95) AS {m}_p95, quantile_cont({m}, 0.99) AS {m}_p99, max({m}) AS {m}_peak"
        for m in ("flows", "packets", "bytes")) + " FROM dense GROUP BY ALL"),
    ("t", "SELECT *, " + ", ".join(f"bytes_{n} * (8e-6 / {TICK}) AS mbps_{n}" for n in ("mean", "p95", "p99", "peak")) + " FROM s")) + f"""
SELECT capture_id, CAST(duration AS BIGINT) AS duration, {grids_sql(*_LOAD, digits=4)} FROM t""")
def a11_load_summary(spark, sf):
    flows = ops.flow_statistics(packets(spark, sf), TICK)
    return ops.load_summary(flows, TICK).select("capture_id", "duration", *grids(*_LOAD, digits=4))
