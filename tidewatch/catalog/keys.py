"""Keys, windows, classes and row predicates."""
from pyspark.sql import functions as F

from tidewatch.catalog.registry import ctes, grid, grid_sql, query
from tidewatch.functions import keys
from tidewatch.operators import flows as ops
from tidewatch.plans.views import SHORT_WINDOW, WINDOW, embedding_flows, packets, table

_PORT_SQL = "CAST(endpoint_a_port AS BIGINT) AS endpoint_a_port, CAST(endpoint_b_port AS BIGINT) AS endpoint_b_port"


def _endpoints(df):
    ports = [F.col(c).cast("long").alias(c) for c in ("endpoint_a_port", "endpoint_b_port")]
    return df.select("frame_number", "endpoint_a_ip", "endpoint_b_ip", *ports, "protocol", F.col("direction").cast("long").alias("direction"))


@query("p1_directional_key", ctes("packets") + """
SELECT frame_number, src_ip AS endpoint_a_ip, dst_ip AS endpoint_b_ip, CAST(src_port AS BIGINT) AS endpoint_a_port,
  CAST(dst_port AS BIGINT) AS endpoint_b_port, protocol, CAST(0 AS BIGINT) AS direction FROM packets""")
def p1_directional_key(spark, sf):
    return _endpoints(keys.directional_key(packets(spark, sf)))


# Addresses of different text length, so that numeric and string order differ.
_NUM = "CAST(split_part({c}, '.', 3) AS INT) * 1000 + CAST(split_part({c}, '.', 4) AS INT)"
_CANON_SQL = ctes("packets", ("w", """
SELECT frame_number, protocol, src_port, dst_port, '10.0.' || CAST(frame_number % 150 AS VARCHAR) || split_part(src_ip, '10.0.0', 2) AS s,
  '10.0.' || CAST((frame_number // 150) % 150 AS VARCHAR) || split_part(dst_ip, '10.0.0', 2) AS d FROM packets"""), ("o", f"""
SELECT *, ({_NUM.format(c="s")} < {_NUM.format(c="d")} OR (s = d AND src_port <= dst_port)) AS fwd FROM w"""), ("k", """
SELECT frame_number, CASE WHEN fwd THEN s ELSE d END AS endpoint_a_ip, CASE WHEN fwd THEN d ELSE s END AS endpoint_b_ip,
  CASE WHEN fwd THEN src_port ELSE dst_port END AS endpoint_a_port, CASE WHEN fwd THEN dst_port ELSE src_port END AS endpoint_b_port,
  protocol, CAST(CASE WHEN fwd THEN 0 ELSE 1 END AS BIGINT) AS direction FROM o"""))


def _wide(spark, sf):
    rows = packets(spark, sf)
    third = lambda e, c: F.concat(F.lit("10.0."), e.cast("string"), F.expr(f"substr({c}, 7)"))
    return rows.withColumns({
        "src_ip": third(F.col("frame_number") % 150, "src_ip"),
        "dst_ip": third(F.floor(F.col("frame_number") / 150) % 150, "dst_ip"),
    })


@query("p2_canonical_key", _CANON_SQL + f"SELECT frame_number, endpoint_a_ip, endpoint_b_ip, {_PORT_SQL}, protocol, direction FROM k")
def p2_canonical_key(spark, sf):
    return _endpoints(keys.canonical_key(_wide(spark, sf)))


@query("p3_flow_key", _CANON_SQL + f"""
SELECT 'bidirectional' AS orientation, frame_number, endpoint_a_ip, endpoint_b_ip, {_PORT_SQL}, protocol, direction FROM k
UNION ALL SELECT 'directional', frame_number, s, d, src_port, dst_port, protocol, 0 FROM w""")
def p3_flow_key(spark, sf):
    rows = _wide(spark, sf)
    part = lambda o: _endpoints(keys.flow_key(rows, o)).withColumn("orientation", F.lit(o))
    return part("bidirectional").unionByName(part("directional"))


@query("p4_window_coords", ctes("packets", ("o", "SELECT capture_id, arg_min(ts, frame_number) AS origin FROM packets GROUP BY 1"), ("k", f"""
SELECT 'epoch' AS alignment, frame_number, floor(ts / {WINDOW}.0) AS i, floor(ts / {WINDOW}.0) * {WINDOW}.0 AS s, ts FROM packets
UNION ALL SELECT 'capture', frame_number, floor(greatest(0, ts - origin) / {WINDOW}.0 + 1e-12),
  origin + floor(greatest(0, ts - origin) / {WINDOW}.0 + 1e-12) * {WINDOW}.0, ts FROM packets JOIN o USING (capture_id)""")) + f"""
SELECT alignment, frame_number, CAST(i AS BIGINT) AS window_index, {grid_sql("s", 4)} AS window_start,
  {grid_sql("greatest(0, ts - s)", 4)} AS "offset" FROM k""")
def p4_window_coords(spark, sf):
    rows = packets(spark, sf)
    part = lambda a: keys.window_coords(rows, WINDOW, a).select(
        F.lit(a).alias("alignment"), "frame_number", "window_index", grid("window_start", 4).alias("window_start"), grid("offset", 4).alias("offset"))
    return part("epoch").unionByName(part("capture"))


@query("p5_micro_bin", ctes("packets") + f"""
SELECT frame_number, CAST(greatest(0, least(29, floor((ts - floor(ts / {WINDOW}.0) * {WINDOW}.0) / {WINDOW / 30} + 1e-12))) AS BIGINT) AS bin30,
  CAST(greatest(0, least(9, floor((ts - floor(ts / {WINDOW}.0) * {WINDOW}.0) * 10.0 / {WINDOW}.0))) AS BIGINT) AS bin10 FROM packets""")
def p5_micro_bin(spark, sf):
    rows = keys.window_coords(packets(spark, sf), WINDOW)
    return rows.select("frame_number", keys.micro_bin(F.col("offset"), WINDOW / 30, 30).cast("long").alias("bin30"),
                       keys.tenth_bin(F.col("offset"), WINDOW).cast("long").alias("bin10"))


@query("p6_pair_key", ctes("packets") + """
SELECT frame_number, least(src_ip, dst_ip) || '~' || greatest(src_ip, dst_ip) AS pair FROM packets""")
def p6_pair_key(spark, sf):
    return packets(spark, sf).select("frame_number", F.array_join(keys.pair_key(F.col("src_ip"), F.col("dst_ip")), "~").alias("pair"))


@query("p7_channel_id", ctes("packets") + """
SELECT concat_ws('|', src_ip, dst_ip, protocol, dst_port) AS channel_id, count(*) AS packets FROM packets GROUP BY 1""")
def p7_channel_id(spark, sf):
    ids = packets(spark, sf).select(keys.channel_id(["src_ip", "dst_ip", "protocol", "dst_port"]).alias("channel_id"))
    return ids.groupBy("channel_id").agg(F.count("*").alias("packets"))


@query("p8_stable_ids", ctes("packets", ("s", f"""
SELECT DISTINCT capture_id AS capture, CAST(floor(ts / {SHORT_WINDOW}.0) AS BIGINT) AS window_index, src_ip, src_port, dst_ip, dst_port, protocol FROM packets""")) + """
SELECT capture, window_index, substr(sha1(capture), 1, 16) AS capture_id,
  sha1(concat_ws('|', capture, src_ip, src_port, dst_ip, dst_port, protocol)) AS flow_id,
  sha1(concat_ws('|', capture, src_ip, src_port, dst_ip, dst_port, protocol, window_index)) AS segment_id FROM s""")
def p8_stable_ids(spark, sf):
    rows = keys.directional_key(keys.window_coords(packets(spark, sf), SHORT_WINDOW))
    rows = rows.withColumnRenamed("capture_id", "capture").select("capture", "window_index", *keys.ENDPOINTS).distinct()
    return keys.with_ids(rows).select("capture", "window_index", "capture_id", "flow_id", "segment_id")


def _ids_sql():
    seen = lambda name, a, b: f"""SELECT {a}, row_number() OVER (ORDER BY min(p)) - 1 AS id FROM (
SELECT {a}, rid * 2 AS p FROM g UNION ALL SELECT {b}, rid * 2 + 1 FROM g) GROUP BY {a}"""
    return ctes("flows", ("g", "SELECT *, row_number() OVER (ORDER BY capture_id, row_id) - 1 AS rid FROM flows"),
        ("n", seen("n", "src_ip", "dst_ip")), ("e", seen("e", "src_ip, src_port", "dst_ip, dst_port")),
        ("c", seen("c", "src_ip, dst_ip, src_port, dst_port, protocol", "dst_ip, src_ip, dst_port, src_port, protocol"))) + """
SELECT g.rid AS row_id, n1.id AS source_node, n2.id AS destination_node, e1.id AS source_endpoint, e2.id AS destination_endpoint,
  c1.id AS connection, c2.id AS reverse_connection
FROM g JOIN n n1 ON n1.src_ip = g.src_ip JOIN n n2 ON n2.src_ip = g.dst_ip
JOIN e e1 ON e1.src_ip = g.src_ip AND e1.src_port = g.src_port JOIN e e2 ON e2.src_ip = g.dst_ip AND e2.src_port = g.dst_port
JOIN c c1 ON c1.src_ip = g.src_ip AND c1.dst_ip = g.dst_ip AND c1.src_port = g.src_port AND c1.dst_port = g.dst_port AND c1.protocol = g.protocol
JOIN c c2 ON c2.src_ip = g.dst_ip AND c2.dst_ip = g.src_ip AND c2.src_port = g.dst_port AND c2.dst_port = g.src_port AND c2.protocol = g.protocol"""


@query("p9_dense_ids", _ids_sql())
def p9_dense_ids(spark, sf):
    from tidewatch.operators.ordered import row_positions
    flows = ops.flow_statistics(packets(spark, sf), WINDOW)
    flows = row_positions(flows, [], ["capture_id", "timestamp_second", *keys.FLOW_IDENTITY], "row_id")
    return ops.with_dense_ids(flows).select(
        "row_id", "source_node", "destination_node", "source_endpoint", "destination_endpoint", "connection", "reverse_connection")


@query("p10_eligible", ctes("packets") + f"""
SELECT capture_id, CAST(floor(ts / {WINDOW}.0) AS BIGINT) AS window_index, src_ip, dst_ip, count(*) AS packet_count
FROM packets WHERE protocol IN ('tcp') GROUP BY ALL HAVING count(*) >= 20""")
def p10_eligible(spark, sf):
    rows = keys.window_coords(keys.eligible(packets(spark, sf), ["tcp"]), WINDOW)
    flows = rows.groupBy("capture_id", "window_index", "src_ip", "dst_ip").agg(F.count("*").alias("packet_count"))
    return keys.enough_packets(flows, 20)


@query("p11_normal_only", ctes("packets") + """
SELECT frame_number, capture_id FROM packets WHERE capture_id <> 'c2' AND binary_label = 0""")
def p11_normal_only(spark, sf):
    rows = packets(spark, sf).withColumns({
        "split": F.when(F.col("capture_id") == "c2", "test").otherwise("train"),
        "label_class": F.when(F.col("binary_label") == 1, "attack").otherwise("normal"),
    })
    return keys.require_normal(rows, "train").select("frame_number", "capture_id")


@query("p12_label_class", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'attack' WHEN 'view' THEN 'unlabeled' WHEN 'click' THEN 'normal'
  WHEN 'purchase' THEN 'normal' END AS label_class FROM events""")
def p12_label_class(spark, sf):
    name = F.when(F.col("event_type") == "view", keys.UNLABELED).otherwise(F.concat(F.lit(" "), F.upper("event_type")))
    rows = table(spark, sf, "events").select("event_id", name.alias("label"))
    return rows.select("event_id", keys.label_class(F.col("label"), ["click", "purchase"], ["Error"]).alias("label_class"))


_SERVED = """SELECT frame_number, CASE WHEN frame_number % 2 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
  [8000, 8001, 8554, 8080, 123][CAST(frame_number % 5 AS INT) + 1] AS a, wire_length AS packet_count FROM packets"""


@query("p13_service_name", ctes("packets", ("s", _SERVED)) + """
SELECT frame_number, CASE WHEN protocol = 'udp' AND a = 123 THEN 'NTP' WHEN protocol = 'udp' AND a = 8000 THEN 'RTP/UDP video'
  WHEN protocol = 'udp' AND a = 8001 THEN 'RTCP' WHEN protocol = 'tcp' AND a = 8554 AND packet_count > 100 THEN 'TCP interleaved video'
  WHEN protocol = 'tcp' AND a = 8554 THEN 'RTSP control' WHEN protocol = 'tcp' AND a = 8080 THEN 'HTTP/ONVIF' ELSE 'other' END AS detailed,
  CASE WHEN protocol = 'udp' AND a = 8000 THEN 'RTP' WHEN protocol = 'udp' AND a = 8001 THEN 'RTCP' WHEN protocol = 'tcp' AND a = 8554 THEN 'RTSP'
  WHEN protocol = 'tcp' AND a = 8080 THEN 'ONVIF' ELSE 'other' END AS plain FROM s""")
def p13_service_name(spark, sf):
    frame = F.col("frame_number")
    ports = F.array(*[F.lit(p) for p in (8000, 8001, 8554, 8080, 123)])
    rows = packets(spark, sf).select(
        frame, F.when(frame % 2 == 0, "udp").otherwise("tcp").alias("protocol"), F.lit(40000).alias("endpoint_b_port"),
        F.get(ports, (frame % 5).cast("int")).alias("endpoint_a_port"), F.col("wire_length").alias("packet_count"))
    return rows.select("frame_number", keys.service_name(rows).alias("detailed"), keys.service_name(rows, detailed=False).alias("plain"))


_SPAN_SQL = "SELECT min(ts) AS b, max(ts) AS e FROM packets WHERE binary_label = 1 AND capture_id = 'c1'"


@query("p14_phase", ctes("packets", ("a", _SPAN_SQL)) + f"""
SELECT frame_number, CASE WHEN floor(ts / {SHORT_WINDOW}.0) * {SHORT_WINDOW}.0 + {SHORT_WINDOW}.0 <= b THEN 'pre_attack'
    WHEN floor(ts / {SHORT_WINDOW}.0) * {SHORT_WINDOW}.0 <= e THEN 'attack_window' ELSE 'post_attack' END AS overlap,
  CASE WHEN ts < b THEN 'before' WHEN ts >= e THEN 'after' ELSE 'attack' END AS half_open FROM packets, a""")
def p14_phase(spark, sf):
    rows = keys.window_coords(packets(spark, sf), SHORT_WINDOW)
    attack = rows.where("binary_label = 1 AND capture_id = 'c1'").agg(F.struct(F.min("ts").alias("b"), F.max("ts").alias("e")))
    rows = rows.withColumn("attack", attack.scalar())
    b, e = F.col("attack.b"), F.col("attack.e")
    return rows.select("frame_number", keys.phase_overlap(F.col("window_start"), b, e, SHORT_WINDOW).alias("overlap"),
                       keys.phase_half_open(F.col("ts"), b, e).alias("half_open"))


@query("p15_entity_side", ctes("eflows") + """
SELECT row_id, CASE WHEN endpoint_a_ip = 'n3' THEN packet_count ELSE byte_count END AS selected_load
FROM eflows WHERE endpoint_a_ip = 'n3' OR endpoint_b_ip = 'n3'""")
def p15_entity_side(spark, sf):
    rows = embedding_flows(spark, sf).withColumns({"entity_a_load": F.col("packet_count"), "entity_b_load": F.col("byte_count")})
    return keys.entity_side(rows, "n3", ["load"]).select("row_id", "selected_load")


@query("p16_log1p", ctes("eflows", ("x", "SELECT row_id, unnest(range(64)) AS dim, unnest(embedding) AS v, byte_count FROM eflows")) + f"""
SELECT row_id, dim, {grid_sql("CASE WHEN dim < 16 THEN ln(1 + greatest(0, v)) ELSE v END")} AS value, {grid_sql("ln(1 + byte_count)")} AS log_byte_count FROM x""")
def p16_log1p(spark, sf):
    rows = keys.log1p_cols(embedding_flows(spark, sf), ["byte_count"])
    rows = rows.select("row_id", F.posexplode(keys.log1p_vector(F.col("embedding"), 16)).alias("dim", "value"), "log_byte_count")
    return rows.select("row_id", F.col("dim").cast("long").alias("dim"), grid("value").alias("value"), grid("log_byte_count").alias("log_byte_count"))
