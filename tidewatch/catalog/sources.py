"""Scans, sources and sinks."""
import uuid

from pyspark.sql import functions as F

from tidewatch.catalog.flows import _FLOW_KEY_SQL, _flow_columns
from tidewatch.catalog.registry import ctes, grid, grid_sql, query
from tidewatch.operators import context, flows as ops
from tidewatch.plans.views import SHORT_WINDOW, WINDOW, embedding_flows, packets, table
from tidewatch.session import shared_stage, stage_folder
from tidewatch.sources import packets as src, stores
from tidewatch.sources.frames import decode_frames, wire_length

_PACKET_SQL = """SELECT capture_id, frame_number, CAST(floor(ts * 1e6 + 0.5) AS BIGINT) AS micros, src_ip, dst_ip,
  CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, protocol"""


def _packet_columns():
    ports = [F.col(c).cast("long").alias(c) for c in ("src_port", "dst_port")]
    micros = F.floor(F.col("ts") * 1e6 + 0.5).alias("micros")
    return ["capture_id", "frame_number", micros, "src_ip", "dst_ip", *ports, "protocol"]


@query("s1_packet_scan", ctes("packets") + _PACKET_SQL + ", CAST(wire_length AS BIGINT) AS wire_length FROM packets")
def s1_packet_scan(spark, sf):
    rows = src.frame_range(packets(spark, sf), 0, None)
    return rows.select(*_packet_columns(), F.col("wire_length").cast("long").alias("wire_length"))


def _frames(spark, sf):
    """Frames of seven link types built from the packet view, one type per packet."""
    rows = packets(spark, sf)
    hex_of = lambda c, n: F.lpad(F.hex(c), n, "0")
    address = lambda c: F.concat(*[hex_of(F.split(c, r"\.")[i].cast("int"), 2) for i in range(4)])
    tcp = F.col("protocol") == "tcp"
    l4 = F.concat(
        hex_of("src_port", 4), hex_of("dst_port", 4),
        F.when(tcp, "000000000000000050000000" + "00000000").otherwise("00080000"),
    )
    number = F.when(tcp, "06").otherwise("11")
    v4 = F.concat(F.lit("4500"), hex_of("wire_length", 4), F.lit("0000400040"), number, F.lit("0000"), address("src_ip"), address("dst_ip"), l4)
    v6_at = lambda c: F.concat(F.lit("20010DB8" + "0" * 16), address(c))
    chain = F.concat(number, F.lit("00" * 7))  # one hop-by-hop header in front of the transport header
    v6 = F.concat(F.lit("600000000000" + "0040"), v6_at("src_ip"), v6_at("dst_ip"), chain, l4)
    kind = F.col("frame_number") % 8
    macs = "AA" * 12
    ether = lambda tags, body, t: F.concat(F.lit(macs + tags + t), body)
    frame = (
        F.when(kind == 0, ether("", v4, "0800")).when(kind == 1, ether("81000001", v4, "0800"))
        .when(kind == 2, ether("88A8000181000002", v4, "0800")).when(kind == 3, F.concat(F.lit("00" * 14 + "0800"), v4))
        .when(kind == 4, F.concat(F.lit("0800" + "00" * 18), v4)).when(kind == 5, v4)
        .when(kind == 6, F.concat(F.lit("02000000"), v4))
        .otherwise(ether("", v6, "86DD"))
    )
    link = F.when(kind.isin(0, 1, 2, 7), 1).when(kind == 3, 113).when(kind == 4, 276).when(kind == 5, 101).otherwise(0)
    return rows.select("capture_id", "frame_number", "ts", link.alias("linktype"), F.unhex(frame).alias("bytes"))


_V6_SQL = """CASE WHEN frame_number % 8 = 7 THEN
  '2001:db8::a00:' || CAST(CAST(split_part({c}, '.', 4) AS INT) AS VARCHAR) ELSE {c} END AS {c}"""


@query("s2_decoded_frames", ctes("packets", ("p", f"""
SELECT capture_id, frame_number, ts, {_V6_SQL.format(c="src_ip")}, {_V6_SQL.format(c="dst_ip")}, src_port, dst_port, protocol FROM packets""")) + _PACKET_SQL + " FROM p")
def s2_decoded_frames(spark, sf):
    return decode_frames(_frames(spark, sf)).select(*_packet_columns())


@query("s3_wire_length", ctes("packets", ("v", "SELECT *, frame_number % 8 = 7 AS ipv6 FROM packets")) + """
SELECT frame_number, CAST(greatest(1, least(1500, wire_length)) AS BIGINT) AS wire_length FROM v WHERE wire_length >= 20 AND NOT ipv6""")
def s3_wire_length(spark, sf):
    rows = wire_length(decode_frames(_frames(spark, sf)))
    return rows.select("frame_number", F.col("wire_length").cast("long").alias("wire_length"))


@query("s4_packet_labels", ctes("packets") + """
SELECT layout, frame_number, CAST(binary_label AS BIGINT) AS binary_label
FROM packets, (SELECT unnest(['header', 'indexed', 'vector']) AS layout)""")
def s4_packet_labels(spark, sf):
    rows = packets(spark, sf)
    label, frame = F.col("binary_label").cast("string"), F.col("frame_number").cast("string")
    lines = {
        "header": F.concat_ws(",", label, frame), "indexed": F.concat(F.lit('"'), frame, F.lit('",'), label),
        "vector": label,
    }
    parts = [
        src.parse_labels(rows.select(v.alias("value"), F.col("frame_number").alias("line_number")), k, "binary_label,frame_number")
        .select(F.lit(k).alias("layout"), "frame_number", F.col("binary_label").cast("long").alias("binary_label"))
        for k, v in lines.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s5_converted_labels", ctes("packets") + """
SELECT frame_number, CAST(binary_label AS BIGINT) AS binary_label FROM packets WHERE protocol = 'tcp'""")
def s5_converted_labels(spark, sf):
    full = F.format_string('"%d", %d.0', "frame_number", "binary_label")
    line = F.when(F.col("protocol") == "tcp", full).otherwise(F.col("frame_number").cast("string"))
    out = src.convert_labels(packets(spark, sf).select(line.alias("value")))
    return out.select("frame_number", F.col("binary_label").cast("long").alias("binary_label"))


@query("s6_capture_sources", ctes("packets", ("m", """
SELECT capture_id, 1 AS start_frame, max(frame_number) AS last FROM packets GROUP BY capture_id""")) + """
SELECT capture_id || '.pcap' AS path, 'normal' AS label, 'train_calibration' AS split, capture_id AS dataset,
  CAST(1 AS BIGINT) AS start_frame, last AS end_frame, 'training' AS role FROM m WHERE capture_id = 'c0'
UNION ALL SELECT capture_id || '.pcap', 'normal', 'test', capture_id, CAST(1 AS BIGINT), last, 'evaluation' FROM m WHERE capture_id <> 'c0'
UNION ALL SELECT capture_id || '.pcap', 'normal', 'calibration', NULL, NULL, NULL, 'manifest' FROM m""")
def s6_capture_sources(spark, sf):
    rows = packets(spark, sf)
    each = rows.groupBy("capture_id").agg(F.max("frame_number").alias("last"))
    entry = F.struct(
        F.concat("capture_id", F.lit(".pcap")).alias("pcap"), F.lit(None).cast("string").alias("labels"),
        F.col("last").alias("total_packets"), F.lit(None).cast("long").alias("test_start_packet"),
        F.lit(None).cast("long").alias("test_end_packet"),
    )
    # One manifest row; it has one entry per capture.
    text = each.agg(
        F.map_from_entries(F.collect_list(F.struct("capture_id", entry))).alias("datasets"),
        F.array_remove(F.collect_list("capture_id"), "c0").alias("names"),
    ).select(F.to_json(F.struct(
        F.struct(F.lit("c0").alias("source_dataset")).alias("training"), F.struct(F.col("names").alias("datasets")).alias("evaluation"), "datasets",
    )).alias("value"))
    parsed = text.select(F.from_json("value", src.JSON_MANIFEST).alias("m")).select("m.*")
    flat = each.select(F.concat(F.lit(" "), "capture_id", F.lit(".pcap")).alias("pcap"), F.lit("normal ").alias("label"), F.lit(" Validation").alias("split"))
    both = src.sources_from_json(parsed).unionByName(src.sources_from_table(flat))
    return src.resolve_sources(both.unionByName(both)).select("path", "label", "split", "dataset", "start_frame", "end_frame", "role")


@query("s7_flow_contract", ctes("flows") + f"""
SELECT {_FLOW_KEY_SQL}, row_id, {grid_sql("packet_count", 3)} AS packet_count FROM flows""")
def s7_flow_contract(spark, sf):
    flows = stores.flow_contract(ops.flow_statistics(packets(spark, sf), WINDOW, number=True))
    return flows.select(*_flow_columns(flows), "row_id", grid("packet_count", 3).alias("packet_count"))


_RULES = ["not_finite", "negative", "no_packet", "unordered_seconds", "duplicate_rows", "duplicate_events", "bin_packets_differ", "bin_bytes_differ", "labels_in_training", "row_id_gaps"]


# Faults put into the flows, each on its own share of the events, one for every rule.
_FAULTS = {"iat_cv": (97, "'NaN'::DOUBLE"), "packet_len_p25": (89, "-1.0::DOUBLE"), "packet_count": (83, "0.0::DOUBLE"),
           "bin_bytes_mean": (73, "bin_bytes_mean + 1"), "timestamp_second": (71, f"timestamp_second - {50 * WINDOW}")}
_TWICE, _GONE = 79, 67


@query("s8_capture_violations", ctes("flows", ("f", f"""
SELECT * REPLACE ({", ".join(f"CASE WHEN event_id % {m} = 0 THEN {v} ELSE {c} END AS {c}" for c, (m, v) in _FAULTS.items())}) FROM flows WHERE event_id % {_GONE} <> 0"""),
    ("bad", f"SELECT * FROM f UNION ALL SELECT * FROM f WHERE event_id % {_TWICE} = 0"),
    ("o", "SELECT *, lag(timestamp_second) OVER (PARTITION BY capture_id ORDER BY row_id) AS earlier FROM bad"),
    ("n", f"""SELECT count(*) FILTER (WHERE event_id % 97 = 0) AS not_finite, count(*) FILTER (WHERE packet_len_p25 < 0) AS negative,
  count(*) FILTER (WHERE packet_count < 1) AS no_packet, count(*) FILTER (WHERE timestamp_second < earlier) AS unordered_seconds,
  count(*) - count(DISTINCT (capture_id, row_id)) AS duplicate_rows, count(*) - count(DISTINCT event_id) AS duplicate_events,
  count(*) FILTER (WHERE event_id % 83 = 0) AS bin_packets_differ, count(*) FILTER (WHERE event_id % 73 = 0) AS bin_bytes_differ,
  count(*) AS labels_in_training, (SELECT sum(abs(g)) FROM (SELECT max(row_id) + 1 - count(*) + min(row_id) AS g FROM bad GROUP BY capture_id)) AS row_id_gaps FROM o""")) +
    " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST({r} AS BIGINT) AS violations FROM n" for r in _RULES))
def s8_capture_violations(spark, sf):
    """Every rule against flows with known faults: changed values, rows twice and rows left out."""
    flows = ops.flow_statistics(packets(spark, sf), WINDOW, number=True).where(F.col("event_id") % _GONE != 0)
    hit = lambda m: F.col("event_id") % m == 0
    faults = {"iat_cv": F.lit(float("nan")), "packet_len_p25": F.lit(-1.0), "packet_count": F.lit(0.0),
              "bin_bytes_mean": F.col("bin_bytes_mean") + 1, "timestamp_second": F.col("timestamp_second") - 50 * WINDOW}
    flows = flows.withColumns({c: F.when(hit(_FAULTS[c][0]), v).otherwise(F.col(c)) for c, v in faults.items()})
    flows = shared_stage(flows)  # read twice by the union and twice by the rules
    return stores.validate_capture(flows.unionByName(flows.where(hit(_TWICE))), training=True)


@query("s9_segment_metadata", ctes("packets", ("seg", f"""
SELECT capture_id, CAST(floor(ts / {SHORT_WINDOW}.0) AS BIGINT) AS window_index, src_ip, src_port, dst_ip, dst_port, protocol,
  count(*) AS p, sum(wire_length) AS b, CASE WHEN max(binary_label) = 1 THEN 'attack' ELSE 'normal' END AS label_name
FROM packets GROUP BY ALL"""), ("w", """
SELECT capture_id, window_index, row_number() OVER (PARTITION BY capture_id ORDER BY window_index DESC) AS back,
  count(*) OVER (PARTITION BY capture_id) AS n FROM (SELECT DISTINCT capture_id, window_index FROM seg)"""), ("cut", """
SELECT capture_id, window_index AS cut FROM w WHERE back = greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT))"""), ("marked", """
SELECT *, CASE WHEN window_index >= cut THEN 'calibration' ELSE 'train' END AS split FROM seg JOIN cut USING (capture_id)""")) + """
SELECT split, label_name, CAST(grouping(split) * 2 + grouping(label_name) AS BIGINT) AS level, count(*) AS segments,
  CAST(sum(p) AS BIGINT) AS packets, CAST(sum(b) AS BIGINT) AS bytes FROM marked GROUP BY CUBE (split, label_name)""")
def s9_segment_metadata(spark, sf):
    seg = ops.segments(packets(spark, sf), SHORT_WINDOW, orientation="directional")
    return stores.segment_metadata(ops.split_calibration(seg, 0.2)).withColumn("level", F.col("level").cast("long"))


@query("s10_stored_reference", ctes("eflows", ("c", """
SELECT capture_id, window_index, least(endpoint_a_ip, endpoint_b_ip) || ',' || greatest(endpoint_a_ip, endpoint_b_ip) AS pair, mode_id, count(*) AS n
FROM eflows GROUP BY ALL"""), ("t", "SELECT count(*) AS total FROM (SELECT DISTINCT capture_id, window_index FROM eflows)"),
    ("s", "SELECT pair, CAST(mode_id AS BIGINT) AS mode_id, sum(ln(1 + n)) AS v FROM c GROUP BY ALL")) + f"""
SELECT g.pair, g.mode_id, {grid_sql("coalesce(v, 0) / total")} AS mean, total AS samples
FROM (SELECT DISTINCT pair, unnest(range(10)) AS mode_id FROM c) g LEFT JOIN s ON g.pair = s.pair AND g.mode_id = s.mode_id, t""")
def s10_stored_reference(spark, sf):
    pairs, entities = context.fit_composition(embedding_flows(spark, sf))
    folder = f"{stage_folder(spark)}/reference-{uuid.uuid4().hex}"
    stores.save_reference(pairs, entities, folder)
    pairs, _ = stores.load_reference(spark, folder)
    rows = pairs.select(F.array_join("pair", ",").alias("pair"), F.posexplode("mean").alias("mode_id", "mean"), "samples")
    return rows.select("pair", F.col("mode_id").cast("long").alias("mode_id"), grid("mean").alias("mean"), "samples")


@query("s11_score_rows", ctes("packets") + """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '__unlabeled__' WHEN l.toxic = 1 THEN 'attack' ELSE 'normal' END AS label_name, d.n_chars AS score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def s11_score_rows(spark, sf):
    scores = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score"))
    named = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "attack").otherwise("normal").alias("label_name"))
    return stores.score_rows(scores, named, ["doc_id"])
