"""Activity mass, history and clocks."""
from pyspark.sql import functions as F

from tidewatch.catalog.context import host_flows
from tidewatch.catalog.registry import IDENTITY_SQL, ctes, grid, grid_sql, grids, grids_sql, query
from tidewatch.operators import activity as ops
from tidewatch.operators.flows import flow_slices
from tidewatch.plans.views import SHORT_WINDOW, packets

SPAN = 16


def _flows(spark, sf):
    return host_flows(spark, sf).withColumn("behaviour", F.col("regime"))


ACTIVITY = (("af", "SELECT *, dst_port - 80 AS behaviour FROM sflows"), ("ends", """
SELECT *, src_ip AS node, 0 AS direction FROM af UNION ALL SELECT *, dst_ip, 1 FROM af"""), ("cells", """
SELECT capture_id, node, direction, timestamp_second, behaviour, count(*)::DOUBLE AS flows, sum(packet_count) AS packets, sum(byte_count) AS bytes FROM ends GROUP BY ALL"""),
    ("born", "SELECT capture_id, node, min(timestamp_second) AS birth FROM cells GROUP BY ALL"),
    ("aged", f"SELECT c.*, birth, least({SPAN}, (timestamp_second - birth) // {SHORT_WINDOW}) AS hl FROM cells c JOIN born USING (capture_id, node)"))
_CELL_SQL = "capture_id, node, CAST(direction AS BIGINT) AS direction, timestamp_second, CAST(behaviour AS BIGINT) AS behaviour"


def _cell():
    return ["capture_id", "node", F.col("direction").cast("long").alias("direction"), "timestamp_second", F.col("behaviour").cast("long").alias("behaviour")]


@query("c21_activity", ctes("sflows", *ACTIVITY) + f"SELECT {_CELL_SQL}, flows, packets, bytes FROM cells")
def c21_activity(spark, sf):
    return ops.activity(_flows(spark, sf)).select(*_cell(), *ops.RESOURCES)


@query("c22_activity_mean", ctes("sflows", *ACTIVITY, ("m", """
SELECT *, greatest(1, sum(flows) OVER (PARTITION BY capture_id, node, direction, timestamp_second)) AS s FROM cells""")) + f"""
SELECT {_CELL_SQL}, {", ".join(f"{grid_sql(f'{r} / s')} AS {r}" for r in ops.RESOURCES)} FROM m""")
def c22_activity_mean(spark, sf):
    return ops.activity_mean(ops.activity(_flows(spark, sf))).select(*_cell(), *grids(*ops.RESOURCES))


@query("c23_history_length", ctes("sflows", *ACTIVITY) + f"SELECT {_CELL_SQL}, birth, CAST(hl AS BIGINT) AS history_length FROM aged")
def c23_history_length(spark, sf):
    return ops.history_length(ops.activity(_flows(spark, sf)), SPAN, SHORT_WINDOW).select(*_cell(), "birth", "history_length")


@query("c24_history", ctes("sflows", *ACTIVITY, ("u", "SELECT DISTINCT capture_id, node, direction, timestamp_second, hl FROM aged"),
    ("past", f"SELECT *, unnest(range(CAST(hl AS BIGINT))) AS i FROM u"), ("att", f"SELECT *, timestamp_second - (hl - i) * {SHORT_WINDOW} AS t FROM past"),
    ("tot", "SELECT capture_id, node, direction, timestamp_second AS t, behaviour, flows, packets FROM cells")) + f"""
SELECT a.capture_id, a.node, CAST(a.direction AS BIGINT) AS direction, a.timestamp_second, CAST(i AS BIGINT) AS i,
  {", ".join(f"coalesce(sum(CASE WHEN behaviour = {b} THEN {r} END), 0)::DOUBLE AS {r}_{b}" for b in range(3) for r in ("flows", "packets"))}
FROM att a LEFT JOIN tot USING (capture_id, node, direction, t) GROUP BY a.capture_id, a.node, a.direction, a.timestamp_second, i""")
def c24_history(spark, sf):
    h = ops.history(ops.activity(_flows(spark, sf)), SPAN, 3, SHORT_WINDOW)
    h = h.select("capture_id", "node", F.col("direction").cast("long").alias("direction"), "timestamp_second", F.posexplode("history").alias("i", "v"))
    return h.select("capture_id", "node", "direction", "timestamp_second", F.col("i").cast("long").alias("i"),
                    *[F.col("v")[3 * b + j].alias(f"{r}_{b}") for b in range(3) for j, r in ((0, "flows"), (1, "packets"))])


INTENSITY = (("hist", f"""SELECT a.capture_id, a.node, a.direction, a.timestamp_second, a.behaviour, a.flows, a.packets, a.bytes, a.hl, a.birth,
  {", ".join(f"coalesce(sum(ln(1 + p.{r})), 0) / greatest(1, a.hl) AS m_{r}, coalesce(sum(ln(1 + p.{r}) ** 2), 0) / greatest(1, a.hl) AS q_{r}" for r in ops.RESOURCES)}
FROM aged a LEFT JOIN cells p ON p.capture_id = a.capture_id AND p.node = a.node AND p.direction = a.direction AND p.behaviour = a.behaviour
  AND p.timestamp_second >= a.timestamp_second - {SPAN * SHORT_WINDOW} AND p.timestamp_second < a.timestamp_second GROUP BY a.capture_id, a.node, a.direction, a.timestamp_second, a.behaviour, a.flows, a.packets, a.bytes, a.hl, a.birth"""),
    ("sig", "SELECT *, " + ", ".join(f"greatest(0.15, sqrt(greatest(0, q_{r} - m_{r} * m_{r}))) AS s_{r}" for r in ops.RESOURCES) + " FROM hist"),
    ("scored_cells", "SELECT *, CASE WHEN hl > 0 THEN (" + " + ".join(
        f"0.5 * ((ln(1 + {r}) - m_{r}) / s_{r}) ** 2 + ln(s_{r}) + 0.9189385332046727" for r in ops.RESOURCES) + ") / 3 ELSE 0 END AS mass_raw FROM sig"))


@query("f21_intensity_score", ctes("sflows", *ACTIVITY, *INTENSITY) + f"SELECT {_CELL_SQL}, {grid_sql('mass_raw', 4)} AS mass_raw FROM scored_cells")
def f21_intensity_score(spark, sf):
    cells = ops.activity(_flows(spark, sf))
    return ops.intensity_score(cells, SPAN, tick=SHORT_WINDOW).select(*_cell(), grid("mass_raw", 4).alias("mass_raw"))


@query("c25_group_to_flow", ctes("sflows", *ACTIVITY, *INTENSITY) + f"""
SELECT f.capture_id, f.row_id, {grid_sql("s.mass_raw", 4)} AS sender_mass_raw, {grid_sql("r.mass_raw", 4)} AS receiver_mass_raw, s.flows AS sender_flows, r.flows AS receiver_flows
FROM af f JOIN scored_cells s ON s.capture_id = f.capture_id AND s.node = f.src_ip AND s.direction = 0 AND s.timestamp_second = f.timestamp_second AND s.behaviour = f.behaviour
JOIN scored_cells r ON r.capture_id = f.capture_id AND r.node = f.dst_ip AND r.direction = 1 AND r.timestamp_second = f.timestamp_second AND r.behaviour = f.behaviour""")
def c25_group_to_flow(spark, sf):
    flows = _flows(spark, sf)
    cells = ops.intensity_score(ops.activity(flows), SPAN, tick=SHORT_WINDOW)
    out = ops.group_to_flow(flows, cells, ["mass_raw", "flows"])
    return out.select("capture_id", "row_id", *grids("sender_mass_raw", "receiver_mass_raw", digits=4), "sender_flows", "receiver_flows")


@query("c26_group_attacks", ctes("sflows", *ACTIVITY, ("g", """
SELECT capture_id, node, direction, timestamp_second, behaviour, count(*) AS cell_flows, CAST(sum(binary_label) AS BIGINT) AS attack_flows FROM ends GROUP BY ALL""")) + f"""
SELECT {_CELL_SQL}, cell_flows, attack_flows, attack_flows > 0 AND attack_flows < cell_flows AS mixed FROM g""")
def c26_group_attacks(spark, sf):
    return ops.group_attacks(_flows(spark, sf)).select(*_cell(), "cell_flows", "attack_flows", "mixed")


_K = 3


def _phi_flows(spark, sf):
    rows = flow_slices(packets(spark, sf), SHORT_WINDOW)
    raw = [1.0 + F.col("dst_port") - 80, 1.0 + F.col("src_port") - 1000, F.lit(1.0)]
    size = F.sqrt(sum((r * r for r in raw[1:]), raw[0] * raw[0]))
    return rows.withColumn("phi", F.array(*[r / size for r in raw]))


_PHI = (("ph", f"""SELECT *, [(1.0 + dst_port - 80) / n, (1.0 + src_port - 1000) / n, 1.0 / n]::DOUBLE[] AS phi,
  greatest(0, least(9, floor((first_ts - timestamp_second) * 10.0 / {SHORT_WINDOW}.0)))::BIGINT AS first_bin
FROM (SELECT *, sqrt((1.0 + dst_port - 80) ** 2 + (1.0 + src_port - 1000) ** 2 + 1) AS n FROM sflows)"""),
    ("bx", "SELECT *, unnest(range(10)) AS bin FROM ph"), ("kx", "SELECT *, unnest([1, 2, 3]) AS k FROM bx"),
    ("bt", """SELECT capture_id, timestamp_second, bin, k, sum(phi[k] * CASE WHEN bin = first_bin THEN 1 ELSE 0 END) AS u, sum(phi[k] * bin_packets[bin + 1]) AS p,
  sum(phi[k] * bin_bytes[bin + 1]) AS b FROM kx GROUP BY ALL"""))


@query("c27_behaviour_bins", ctes("sflows", *_PHI, ("v", """
SELECT x.capture_id, x.event_id, x.bin, sum(x.phi[x.k] * t.u) - max(CASE WHEN x.bin = first_bin THEN 1 ELSE 0 END) AS u, sum(x.phi[x.k] * t.p) - max(bin_packets[x.bin + 1]) AS p,
  sum(x.phi[x.k] * t.b) - max(bin_bytes[x.bin + 1]) AS b FROM kx x JOIN bt t ON t.capture_id = x.capture_id AND t.timestamp_second = x.timestamp_second AND t.bin = x.bin AND t.k = x.k
GROUP BY x.capture_id, x.event_id, x.bin""")) + f"""
SELECT capture_id, event_id, bin, {grid_sql("greatest(0, u)", 5)} AS starts, {grid_sql("greatest(0, p)", 5)} AS packets, {grid_sql("greatest(0, b)", 3)} AS bytes FROM v""")
def c27_behaviour_bins(spark, sf):
    out = ops.behaviour_bins(_phi_flows(spark, sf), _K, ["capture_id", "event_id"])
    return out.select("capture_id", "event_id", F.col("bin").cast("long").alias("bin"), *grids("starts", "packets", digits=5), grid("bytes", 3).alias("bytes"))


_NAMES = [f"u{k}" for k in range(3)] + [f"p{k}" for k in range(3)] + [f"b{k}" for k in range(3)] + ["flows", "packets", "bytes"] + \
    [f"h{b}" for b in range(10)] + [f"q{b}" for b in range(10)] + [f"s{b}" for b in range(10)]
_SUMMARY = (("su", f"SELECT capture_id, timestamp_second // {SHORT_WINDOW} AS t, " + ", ".join(
    [f"sum(phi[{k + 1}]) AS u{k}" for k in range(3)] + [f"sum(phi[{k + 1}] * packet_count) AS p{k}" for k in range(3)] + [f"sum(phi[{k + 1}] * byte_count) AS b{k}" for k in range(3)]
    + ["count(*) AS flows", "sum(packet_count) AS packets", "sum(byte_count) AS bytes"] + [f"count(*) FILTER (WHERE first_bin = {b}) AS h{b}" for b in range(10)]
    + [f"sum(bin_packets[{b + 1}]) AS q{b}" for b in range(10)] + [f"sum(bin_bytes[{b + 1}]) AS s{b}" for b in range(10)]) + " FROM ph GROUP BY ALL"),
    ("ax", "SELECT capture_id, unnest(range(min(t), max(t) + 1)) AS t FROM su GROUP BY 1"),
    ("sd", "SELECT capture_id, t, " + ", ".join(f"coalesce({n}, 0)::DOUBLE AS {n}" for n in _NAMES) + " FROM ax LEFT JOIN su USING (capture_id, t)"))


@query("c28_second_summary", ctes("sflows", *_PHI, *_SUMMARY) + f"SELECT capture_id, CAST(t AS BIGINT) AS t, {grids_sql(*_NAMES, digits=4)} FROM sd")
def c28_second_summary(spark, sf):
    out = ops.second_summary(_phi_flows(spark, sf), _K, SHORT_WINDOW)
    return out.select("capture_id", "t", *[grid(F.col("summary")[i], 4).alias(n) for i, n in enumerate(_NAMES)])


@query("c28_silent_runs", ctes("sflows", *_PHI, *_SUMMARY) + f"""
SELECT capture_id, CAST(t AS BIGINT) AS t, CAST(coalesce(t - lag(t) OVER (PARTITION BY capture_id ORDER BY t) - 1, 0) AS BIGINT) AS silent, {grid_sql("u0", 4)} AS u0, {grid_sql("s9", 4)} AS s9 FROM su""")
def c28_silent_runs(spark, sf):
    out = ops.second_runs(_phi_flows(spark, sf), _K, SHORT_WINDOW)
    return out.select("capture_id", "t", "silent", grid(F.col("summary")[0], 4).alias("u0"), grid(F.col("summary")[len(_NAMES) - 1], 4).alias("s9"))


_TAUS = (4, 16, 64)


@query("c29_decayed_history", ctes("sflows", *_PHI, *_SUMMARY, ("dh", "SELECT a.capture_id, a.t, count(p.t) AS observed, " + ", ".join(
    f"coalesce(sum(p.{n} * exp(-(a.t - 1 - p.t) / {tau}.0)), 0) AS {n}_{i}" for n in ("u0", "p1") for i, tau in enumerate(_TAUS)) + ", " + ", ".join(
    f"coalesce(sum(CASE WHEN p.t IS NOT NULL THEN exp(-(a.t - 1 - p.t) / {tau}.0) END), 0) AS e_{i}" for i, tau in enumerate(_TAUS)) + """
FROM sd a LEFT JOIN sd p ON p.capture_id = a.capture_id AND p.t < a.t GROUP BY a.capture_id, a.t""")) + f"""
SELECT capture_id, CAST(t AS BIGINT) AS t, least(4, observed) AS recent, {", ".join(f"{grid_sql(f'{n}_{i}', 4)} AS {n}_{i}" for n in ("u0", "p1") for i in range(3))},
  {", ".join(f"{grid_sql(f'e_{i}', 4)} AS e_{i}" for i in range(3))} FROM dh""")
def c29_decayed_history(spark, sf):
    summary = ops.second_summary(_phi_flows(spark, sf), _K, SHORT_WINDOW)
    out = ops.decayed_history(summary, 9, _TAUS, 4, block=16)
    return out.select("capture_id", "t", F.size("recent").cast("long").alias("recent"),
                      *[grid(F.col(f"activity_{i}")[j], 4).alias(f"{n}_{i}") for n, j in (("u0", 0), ("p1", 4)) for i in range(3)],
                      *[grid(f"exposure_{i}", 4).alias(f"e_{i}") for i in range(3)])


_C30 = f"PARTITION BY capture_id, {IDENTITY_SQL} ORDER BY first_ts, event_id"


@query("c30_event_clocks", ctes("sflows", ("o", f"""
SELECT *, dst_port - 80 AS behaviour, lag(event_id) OVER ({_C30}) AS pe, lag(first_ts) OVER ({_C30}) AS pt FROM sflows"""), ("n", """
SELECT *, lag(event_id) OVER (PARTITION BY capture_id, src_ip, dst_ip, behaviour ORDER BY first_ts, event_id) AS ne,
  lag(first_ts) OVER (PARTITION BY capture_id, src_ip, dst_ip, behaviour ORDER BY first_ts, event_id) AS nt FROM o WHERE pe IS NULL"""), ("b", """
SELECT capture_id, event_id, first_ts, true AS new_connection, ne AS pe, nt AS pt FROM n UNION ALL SELECT capture_id, event_id, first_ts, false, pe, pt FROM o WHERE pe IS NOT NULL""")) + f"""
SELECT capture_id, event_id, new_connection, pe IS NOT NULL AS gap_valid, {grid_sql("coalesce(first_ts - pt, 0)", 4)} AS gap, coalesce(pe, -1) AS gap_predecessor FROM b""")
def c30_event_clocks(spark, sf):
    out = ops.event_clocks(_flows(spark, sf))
    return out.select("capture_id", "event_id", "new_connection", "gap_valid", grid("gap", 4).alias("gap"), "gap_predecessor")


@query("c33_repetition_audit", ctes("sflows", *ACTIVITY) + f"""
SELECT {_CELL_SQL}, CAST(m AS BIGINT) AS multiplier, {", ".join(f"{r} * m AS mass_{r}, 0.0::DOUBLE AS mean_shift_{r}" for r in ops.RESOURCES)}
FROM cells, (SELECT unnest([1, 2, 10, 100, 1000]) AS m)""")
def c33_repetition_audit(spark, sf):
    out = ops.repetition_audit(ops.activity(_flows(spark, sf)))
    return out.select(*_cell(), F.col("multiplier").cast("long").alias("multiplier"), *[f"mass_{r}" for r in ops.RESOURCES], *[grid(f"mean_shift_{r}").alias(f"mean_shift_{r}") for r in ops.RESOURCES])
