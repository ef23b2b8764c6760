"""Streams over the given tables (T1-T6, S11), the batch history (C4) and the whole detector."""
import uuid

from pyspark.sql import functions as F

from tidewatch.catalog.activity import ACTIVITY, INTENSITY, SPAN, _flows
from tidewatch.catalog.registry import IDENTITY_SQL, ctes, grid, grid_sql, grids, grids_sql, query
from tidewatch.operators.flows import FLOW_STATISTICS
from tidewatch.operators.history import HistoryRule, historical_context
from tidewatch.plans.detector import detect
from tidewatch.plans.views import SHORT_WINDOW, embedding_flows, packets, table
from tidewatch.session import stage_folder
from tidewatch.sources.epochs import read_epochs, write_epochs
from tidewatch.streaming import live
from tidewatch.streaming.run import as_stream, relay, run_available

W = SHORT_WINDOW
# The last row of a bounded stream, in the year 9000: every window before it closes.
_END = 221_845_392_000
RULE = HistoryRule(alpha=0.2, global_mean=(0.0,) * 64)


def _last():
    return {"event_time": F.timestamp_seconds(F.lit(_END))}


def _packet_stream(spark, sf):
    return as_stream(packets(spark, sf), "packets", end={"ts": F.lit(float(_END))})


@query("t1_stream_flows", ctes("sflows") + f"""
SELECT capture_id, timestamp_second, src_ip, dst_ip, protocol, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port,
  {grids_sql(*FLOW_STATISTICS, digits=3)} FROM sflows""")
def t1_stream_flows(spark, sf):
    out = run_available(live.stream_flows(_packet_stream(spark, sf), W), "flows")
    ports = [F.col(c).cast("long").alias(c) for c in ("src_port", "dst_port")]
    return out.select("capture_id", "timestamp_second", "src_ip", "dst_ip", "protocol", *ports, *grids(*FLOW_STATISTICS, digits=3))


@query("t1_late_packets", ctes("packets", ("o", """
SELECT capture_id, frame_number, floor(ts) AS s, max(floor(ts)) OVER (PARTITION BY capture_id ORDER BY mixed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
FROM (SELECT *, frame_number + CASE WHEN frame_number % 5 = 0 THEN 7 ELSE 0 END AS late, (frame_number + CASE WHEN frame_number % 5 = 0 THEN 7 ELSE 0 END) * 2 + CASE WHEN frame_number % 5 = 0 THEN 1 ELSE 0 END AS mixed FROM packets)""")) + """
SELECT capture_id, frame_number FROM o WHERE s < m - 2000""")
def t1_late_packets(spark, sf):
    late = F.when(F.col("frame_number") % 5 == 0, 1).otherwise(0)
    mixed = packets(spark, sf).withColumn("arrival", (F.col("frame_number") + 7 * late) * 2 + late)
    rows = mixed.withColumns({"_f": F.col("frame_number"), "frame_number": F.col("arrival")})
    return live.late_rows(rows, 2000).select("capture_id", F.col("_f").alias("frame_number"))


@query("t2_stream_new_peers", ctes("packets", ("c", f"""
SELECT capture_id, src_ip, CASE WHEN protocol = 'tcp' THEN 0 ELSE 1 END AS role, dst_ip, CAST(floor(ts / {W}.0) AS BIGINT) * {W} AS timestamp_second, count(*) AS flows FROM packets GROUP BY ALL"""),
    ("n", "SELECT *, timestamp_second = min(timestamp_second) OVER (PARTITION BY capture_id, src_ip, role, dst_ip) AS new_peer FROM c")) + f"""
SELECT capture_id, src_ip, CAST(role AS BIGINT) AS role, dst_ip, timestamp_second, flows, new_peer FROM n""")
def t2_stream_new_peers(spark, sf):
    role = F.when(F.col("protocol") == "tcp", 0).otherwise(1)
    cells = relay(live.peer_cells(_packet_stream(spark, sf), W, role), "peer-cells")
    out = run_available(live.stream_new_peers(cells), "peers")
    return out.withColumn("role", F.col("role").cast("long"))


@query("t3_stream_history")
def t3_stream_history(spark, sf):
    rows = embedding_flows(spark, sf).withColumn("event_time", F.timestamp_seconds(F.col("window_index") * 3 + 1))
    cells = relay(live.pair_cells(as_stream(rows, "embedded", end=_last()), 3), "pair-cells")
    folded = relay(live.stream_pair_history(cells, RULE), "pair-history")
    return run_available(live.stream_entity_history(folded, RULE), "entity-history")


@query("t4_stream_intensity", ctes("sflows", *ACTIVITY, *INTENSITY) + f"""
SELECT capture_id, node, CAST(direction AS BIGINT) AS direction, timestamp_second, CAST(behaviour AS BIGINT) AS behaviour, CAST(hl AS BIGINT) AS history_length,
  {grid_sql("mass_raw", 4)} AS mass_raw FROM scored_cells""")
def t4_stream_intensity(spark, sf):
    flows = _flows(spark, sf).select("capture_id", "src_ip", "dst_ip", "behaviour", "packet_count", "byte_count",
                                     F.timestamp_seconds(F.col("timestamp_second") + 1).alias("event_time"))
    cells = relay(live.activity_cells(as_stream(flows, "flows", end=_last()), W), "activity-cells")
    out = run_available(live.stream_intensity(cells, W, SPAN), "intensity")
    return out.select("capture_id", "node", F.col("direction").cast("long").alias("direction"), "timestamp_second",
                      F.col("behaviour").cast("long").alias("behaviour"), "history_length", grid("mass_raw", 4).alias("mass_raw"))


_C = f"PARTITION BY capture_id, {IDENTITY_SQL} ORDER BY first_ts, event_id"


@query("t5_stream_clocks", ctes("sflows", ("o", f"""
SELECT *, dst_port - 80 AS behaviour, lag(event_id) OVER ({_C}) AS pe, lag(first_ts) OVER ({_C}) AS pt FROM sflows"""), ("n", """
SELECT *, lag(event_id) OVER (PARTITION BY capture_id, src_ip, dst_ip, behaviour ORDER BY first_ts, event_id) AS ne,
  lag(first_ts) OVER (PARTITION BY capture_id, src_ip, dst_ip, behaviour ORDER BY first_ts, event_id) AS nt FROM o WHERE pe IS NULL"""), ("b", """
SELECT capture_id, event_id, first_ts, true AS new_connection, ne AS pe, nt AS pt FROM n UNION ALL SELECT capture_id, event_id, first_ts, false, pe, pt FROM o WHERE pe IS NOT NULL""")) + f"""
SELECT capture_id, event_id, new_connection, pe IS NOT NULL AS gap_valid, {grid_sql("coalesce(first_ts - pt, 0)", 4)} AS gap, coalesce(pe, -1) AS gap_predecessor FROM b""")
def t5_stream_clocks(spark, sf):
    last = {"first_packet_time": F.lit(9e9)}  # in the year 2255: the state's frames hold times up to 2262
    first = run_available(live.stream_connection_clocks(as_stream(_flows(spark, sf), "events", end=last)), "clocks")
    fresh = run_available(live.stream_fresh_clocks(as_stream(first, "clocked", end=last | {"new_connection": F.lit(True)})), "fresh")
    shown = ["capture_id", "event_id", "new_connection", "gap_valid", grid("gap", 4).alias("gap"), "gap_predecessor"]
    return first.where("NOT new_connection").select(*shown).unionByName(fresh.select(*shown))


@query("t6_tumbling_windows", ctes("packets", ("c", f"""
SELECT capture_id, CAST(floor(ts / {W}.0) AS BIGINT) * {W} AS timestamp_second, count(*) AS packets, CAST(sum(wire_length) AS BIGINT) AS bytes FROM packets GROUP BY ALL""")) + f"""
SELECT * FROM c""")
def t6_tumbling_windows(spark, sf):
    rows = live.tumble(live.with_event_time(_packet_stream(spark, sf)), W)
    counts = rows.groupBy("capture_id", "window").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("wire_length").cast("long")).alias("bytes"))
    return run_available(counts.select("capture_id", live._seconds(), "packets", "bytes"), "tumbled")


@query("c4_historical_context")
def c4_historical_context(spark, sf):
    out = historical_context(embedding_flows(spark, sf), RULE)
    return out.select("row_id", "reliability", "context_a_count", "context_b_count",
                      F.aggregate("context_a", F.lit(0.0), lambda a, x: a + x).alias("context_a_sum"),
                      F.aggregate("context_b", F.lit(0.0), lambda a, x: a + x).alias("context_b_sum"))


_ZS = ", ".join(f"(ln(1 + {c}) - (SELECT center FROM rs WHERE component = '{c}')) / (SELECT scale FROM rs WHERE component = '{c}')" for c in FLOW_STATISTICS)
_DETECT = (("rl", " UNION ALL ".join(f"SELECT '{c}' AS component, ln(1 + {c}) AS v FROM sflows WHERE binary_label = 0" for c in FLOW_STATISTICS)),
    ("rq", "SELECT component, quantile_cont(v, 0.5) AS center, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM rl GROUP BY 1"),
    ("rs", "SELECT component, center, greatest(0.05, CASE WHEN s < 10 * 2.220446049250313e-16 THEN 1 ELSE s END) AS scale FROM rq"),
    ("zf", f"SELECT *, dst_port - 80 AS seed, [{_ZS}]::DOUBLE[] AS z FROM sflows"),
    ("zx", "SELECT capture_id, row_id, seed, binary_label, unnest(z) AS v, unnest(range(25)) AS dim FROM zf"),
    ("ct", "SELECT seed, dim, avg(v) AS m FROM zx WHERE binary_label = 0 GROUP BY ALL"),
    ("dz", "SELECT capture_id, row_id, ct.seed AS k, sum((v - m) * (v - m)) AS d FROM zx JOIN ct USING (dim) GROUP BY capture_id, row_id, ct.seed"),
    ("nb", "SELECT capture_id, row_id, arg_min(k, d) AS behaviour, min(d) AS prototype_raw FROM dz GROUP BY ALL"),
    ("af", "SELECT f.*, behaviour, prototype_raw FROM sflows f JOIN nb USING (capture_id, row_id)"), *ACTIVITY[1:], *INTENSITY,
    ("sf", """SELECT f.*, c.mass_raw FROM af f JOIN scored_cells c ON c.capture_id = f.capture_id AND c.node = f.src_ip AND c.direction = 0 AND c.timestamp_second = f.timestamp_second AND c.behaviour = f.behaviour"""),
    ("aq", "SELECT quantile_cont(prototype_raw, 0.5) AS p5, quantile_cont(prototype_raw, 0.95) AS p9, quantile_cont(mass_raw, 0.5) AS m5, quantile_cont(mass_raw, 0.95) AS m9 FROM sf WHERE binary_label = 0"),
    ("fs", "SELECT sf.*, (prototype_raw - p5) / greatest(p9 - p5, 1e-6) + (mass_raw - m5) / greatest(m9 - m5, 1e-6) AS final_score FROM sf, aq"),
    ("fq", "SELECT quantile_cont(final_score, 0.99) AS q FROM fs WHERE binary_label = 0"))


@query("detected_flows", ctes("sflows", *_DETECT) + f"""
SELECT capture_id, row_id, CAST(behaviour AS BIGINT) AS behaviour, {grid_sql("prototype_raw", 4)} AS prototype_raw, {grid_sql("mass_raw", 4)} AS mass_raw,
  {grid_sql("final_score", 4)} AS final_score, final_score > q AS flag FROM fs, fq""")
def detected_flows(spark, sf):
    out = detect(packets(spark, sf), W, seed_column=F.col("dst_port") - 80)
    return out.select("capture_id", "row_id", F.col("behaviour").cast("long").alias("behaviour"), *grids("prototype_raw", "mass_raw", "final_score", digits=4), "flag")


@query("s11_stream_scores", "SELECT doc_id, lang, n_chars AS score FROM documents")
def s11_stream_scores(spark, sf):
    stream = as_stream(table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").alias("score")), "scores", 1)
    folder = f"{stage_folder(spark)}/scores-{uuid.uuid4().hex}"
    run = write_epochs(stream, f"{folder}/out", f"{folder}/progress")
    run.awaitTermination()
    return read_epochs(spark, f"{folder}/out", stream.schema).drop("epoch")
