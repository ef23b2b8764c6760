"""Entity, scope and context aggregations."""
from pyspark.sql import functions as F

from tidewatch.catalog.registry import ctes, grid, grid_sql, grids, grids_sql, query
from tidewatch.operators import context as ops
from tidewatch.operators.flows import flow_statistics
from tidewatch.operators.ordered import group_totals
from tidewatch.plans.views import SHORT_WINDOW, embedding_flows, packets, relations
from tidewatch.session import shared_stage

MEMBERS = ("m", """
SELECT e.*, endpoint_a_ip AS entity FROM eflows e UNION ALL
SELECT e.*, endpoint_b_ip FROM eflows e WHERE endpoint_b_ip <> endpoint_a_ip""")
STATE = ("st", """
SELECT capture_id, entity, window_index, count(*) AS flow_count, CAST(sum(packet_count) AS BIGINT) AS packet_count,
  CAST(sum(byte_count) AS BIGINT) AS byte_count FROM m GROUP BY ALL""")


@query("c1_entity_state", ctes("eflows", MEMBERS, STATE,
    ("axis", "SELECT st.*, i FROM st, (SELECT unnest(range(10)) AS i)"),
    ("h", "SELECT capture_id, entity, window_index, mode_id, count(*) AS n FROM m GROUP BY ALL"),
    ("x", "SELECT capture_id, entity, window_index, unnest(range(64)) AS dim, unnest(embedding) AS v FROM m"),
    ("e", "SELECT capture_id, entity, window_index, dim, avg(v) AS v FROM x GROUP BY ALL")) + f"""
SELECT a.*, coalesce(n, 0)::DOUBLE AS mode_flows, {grid_sql("e.v")} AS mean_value FROM axis a
LEFT JOIN h ON h.capture_id = a.capture_id AND h.entity = a.entity AND h.window_index = a.window_index AND h.mode_id = a.i
JOIN e ON e.capture_id = a.capture_id AND e.entity = a.entity AND e.window_index = a.window_index AND e.dim = a.i""")
def c1_entity_state(spark, sf):
    s = ops.entity_state(embedding_flows(spark, sf), 10, 64)
    s = s.select("*", F.posexplode("mode_counts").alias("i", "mode_flows"))
    return s.select("capture_id", "entity", "window_index", "flow_count", "packet_count", "byte_count", F.col("i").cast("long").alias("i"),
                    "mode_flows", grid(F.get("mean_embedding", F.col("i"))).alias("mean_value"))


@query("c2_entity_history", ctes("eflows", MEMBERS, STATE) + """
SELECT s.capture_id, s.entity, s.window_index, CAST(s.window_index - 3 + o AS BIGINT) AS past_window,
  coalesce(p.flow_count, 0)::DOUBLE AS flow_count, coalesce(p.byte_count, 0)::DOUBLE AS byte_count
FROM st s CROSS JOIN (SELECT unnest(range(3)) AS o) LEFT JOIN st p
  ON p.capture_id = s.capture_id AND p.entity = s.entity AND p.window_index = s.window_index - 3 + o""")
def c2_entity_history(spark, sf):
    state = ops.entity_state(embedding_flows(spark, sf), 10)
    h = ops.entity_history(state, 3, 10)
    h = h.select("capture_id", "entity", "window_index", F.posexplode("history").alias("o", "state"))
    return h.select("capture_id", "entity", "window_index", (F.col("window_index") - 3 + F.col("o")).alias("past_window"),
                    F.col("state")[0].alias("flow_count"), F.col("state")[2].alias("byte_count"))


_SIDES = lambda fields, extra="": "SELECT f.*, " + ", ".join(
    f"{s}.{x} AS {s}_{x}" for s in "ab" for x in fields) + f"""{extra} FROM f
JOIN t a ON a.capture_id = f.capture_id AND a.window_index = f.window_index AND a.entity = f.endpoint_a_ip
JOIN t b ON b.capture_id = f.capture_id AND b.window_index = f.window_index AND b.entity = f.endpoint_b_ip"""


@query("c3_spatial_context", ctes("eflows", MEMBERS,
    ("w", "SELECT *, greatest(0.001, exp(-0.2 * least(50, greatest(0, local_score)))) AS w FROM m"),
    ("x", "SELECT capture_id, window_index, entity, w, unnest(range(64)) AS dim, unnest(embedding) AS v FROM w"),
    ("t", "SELECT capture_id, window_index, entity, dim, sum(w) AS sw, sum(w * v) AS swv, count(*) AS n FROM x GROUP BY ALL"),
    ("f", "SELECT row_id, capture_id, window_index, endpoint_a_ip, endpoint_b_ip, greatest(0.001, exp(-0.2 * least(50, greatest(0, local_score)))) AS w, unnest(range(64)) AS dim, unnest(embedding) AS v FROM eflows")) + f"""
SELECT row_id, dim, {grid_sql("CASE WHEN a.sw - w > 1e-12 THEN (a.swv - w * v) / (a.sw - w) ELSE 0 END", 5)} AS a,
  {grid_sql("CASE WHEN b.sw - w > 1e-12 THEN (b.swv - w * v) / (b.sw - w) ELSE 0 END", 5)} AS b,
  a.n - 1 AS a_count, b.n - 1 AS b_count FROM f
JOIN t a ON a.capture_id = f.capture_id AND a.window_index = f.window_index AND a.entity = f.endpoint_a_ip AND a.dim = f.dim
JOIN t b ON b.capture_id = f.capture_id AND b.window_index = f.window_index AND b.entity = f.endpoint_b_ip AND b.dim = f.dim""".replace(
    "row_id, dim,", "row_id, f.dim AS dim,"))
def c3_spatial_context(spark, sf):
    c = ops.spatial_context(embedding_flows(spark, sf), 64, 0.2, 0.001)
    c = c.select("row_id", F.posexplode(F.arrays_zip("context_a", "context_b")).alias("dim", "v"), "context_a_count", "context_b_count")
    return c.select("row_id", F.col("dim").cast("long").alias("dim"), grid("v.context_a", 5).alias("a"), grid("v.context_b", 5).alias("b"),
                    F.col("context_a_count").alias("a_count"), F.col("context_b_count").alias("b_count"))


PAIRS = ("p", "SELECT *, least(endpoint_a_ip, endpoint_b_ip) || ',' || greatest(endpoint_a_ip, endpoint_b_ip) AS pair FROM eflows")


@query("c5_composition", ctes("eflows", MEMBERS, PAIRS) + """
SELECT 'pair' AS kind, pair AS scope, capture_id, window_index, CAST(mode_id AS BIGINT) AS mode_id, count(*) AS mode_count FROM p GROUP BY ALL
UNION ALL SELECT 'entity', entity, capture_id, window_index, CAST(mode_id AS BIGINT), count(*) FROM m GROUP BY ALL""")
def c5_composition(spark, sf):
    pairs, entities = ops.composition(embedding_flows(spark, sf))
    out = lambda df, kind, scope: df.select(F.lit(kind).alias("kind"), scope.alias("scope"), "capture_id", "window_index", F.col("mode_id").cast("long").alias("mode_id"), "mode_count")
    return out(pairs, "pair", F.array_join("pair", ",")).unionByName(out(entities, "entity", F.col("entity")))


_FIT = (
    ("train", "SELECT * FROM eflows WHERE capture_id = 'c0'"),
    ("tm", "SELECT * FROM m WHERE capture_id = 'c0'"), ("tp", "SELECT * FROM p WHERE capture_id = 'c0'"),
    ("total", "SELECT count(*) AS n FROM (SELECT DISTINCT capture_id, window_index FROM train)"),
    ("ec", "SELECT entity AS scope, window_index, mode_id, ln(1 + count(*)) AS v FROM tm GROUP BY ALL"),
    ("pc", "SELECT pair AS scope, window_index, mode_id, ln(1 + count(*)) AS v FROM tp GROUP BY ALL"),
    ("eg", "SELECT DISTINCT scope, unnest(range(10)) AS mode_id FROM ec"), ("pg", "SELECT DISTINCT scope, unnest(range(10)) AS mode_id FROM pc"),
    ("er", """SELECT g.scope, g.mode_id, coalesce(sum(v), 0) / max(n) AS mean,
  sqrt(greatest(0, coalesce(sum(v * v), 0) / max(n) - (coalesce(sum(v), 0) / max(n)) ** 2)) AS std, max(n) AS samples
FROM eg g LEFT JOIN ec c ON c.scope = g.scope AND c.mode_id = g.mode_id, total GROUP BY g.scope, g.mode_id"""),
    ("pr", """SELECT g.scope, g.mode_id, coalesce(sum(v), 0) / max(n) AS mean,
  sqrt(greatest(0, coalesce(sum(v * v), 0) / max(n) - (coalesce(sum(v), 0) / max(n)) ** 2)) AS std, max(n) AS samples
FROM pg g LEFT JOIN pc c ON c.scope = g.scope AND c.mode_id = g.mode_id, total GROUP BY g.scope, g.mode_id"""),
)


def _train(spark, sf):
    return embedding_flows(spark, sf).where("capture_id = 'c0'")


@query("c6_composition_reference", ctes("eflows", MEMBERS, PAIRS, *_FIT) + f"""
SELECT 'pair' AS kind, scope, mode_id, {grid_sql("mean")} AS mean, {grid_sql("std", 5)} AS std, samples FROM pr
UNION ALL SELECT 'entity', scope, mode_id, {grid_sql("mean")}, {grid_sql("std", 5)}, samples FROM er""")
def c6_composition_reference(spark, sf):
    pairs, entities = ops.fit_composition(_train(spark, sf))
    def out(df, kind, scope):
        rows = df.select(F.lit(kind).alias("kind"), scope.alias("scope"), F.posexplode(F.arrays_zip("mean", "std")).alias("mode_id", "v"), "samples")
        return rows.select("kind", "scope", F.col("mode_id").cast("long").alias("mode_id"), grid("v.mean").alias("mean"), grid("v.std", 5).alias("std"), "samples")
    return out(pairs, "pair", F.array_join("pair", ",")).unionByName(out(entities, "entity", F.col("entity")))


def _composition_score_sql(select: str) -> str:
    own = lambda src, key: f"SELECT {key} AS scope, capture_id, window_index, mode_id, count(*) AS n FROM {src} GROUP BY ALL"
    dev = lambda c, r: f"CASE WHEN {r}.mean IS NULL THEN 0 ELSE greatest(0, (ln(1 + {c}.n) - {r}.mean) / ({r}.std + 1e-3)) END"
    join = lambda c, src, key: f"JOIN {src} {c} ON {c}.scope = p.{key} AND {c}.capture_id = p.capture_id AND {c}.window_index = p.window_index AND {c}.mode_id = p.mode_id"
    return ctes("eflows", MEMBERS, PAIRS, *_FIT, ("ep", own("p", "pair")), ("ee", own("m", "entity")), ("s", f"""
SELECT p.row_id, x.n AS pair_mode_count, a.n AS entity_a_mode_count, b.n AS entity_b_mode_count,
  {dev("x", "xr")} AS pair_deviation, {dev("a", "ar")} AS entity_a_deviation, {dev("b", "br")} AS entity_b_deviation
FROM p {join("x", "ep", "pair")} {join("a", "ee", "endpoint_a_ip")} {join("b", "ee", "endpoint_b_ip")}
LEFT JOIN pr xr ON xr.scope = p.pair AND xr.mode_id = p.mode_id LEFT JOIN er ar ON ar.scope = p.endpoint_a_ip AND ar.mode_id = p.mode_id
LEFT JOIN er br ON br.scope = p.endpoint_b_ip AND br.mode_id = p.mode_id""")) + select


@query("c7_composition_deviation", _composition_score_sql(f"""
SELECT row_id, pair_mode_count, entity_a_mode_count, entity_b_mode_count,
  {grids_sql("pair_deviation", "entity_a_deviation", "entity_b_deviation", digits=3)},
  {grid_sql("greatest(pair_deviation, entity_a_deviation, entity_b_deviation)", 3)} AS context_deviation FROM s"""))
def c7_composition_deviation(spark, sf):
    scored = ops.score_composition(embedding_flows(spark, sf), ops.fit_composition(_train(spark, sf)))
    return scored.select("row_id", "pair_mode_count", "entity_a_mode_count", "entity_b_mode_count",
                         *grids("pair_deviation", "entity_a_deviation", "entity_b_deviation", "context_deviation", digits=3))


@query("j13_unseen_scope_is_neutral", _composition_score_sql(f"""
SELECT s.row_id, {grid_sql("pair_deviation", 3)} AS pair_deviation, r.scope IS NULL AS unseen
FROM s JOIN p ON p.row_id = s.row_id LEFT JOIN (SELECT DISTINCT scope FROM pr) r ON r.scope = p.pair"""))
def j13_unseen_scope_is_neutral(spark, sf):
    reference = ops.fit_composition(_train(spark, sf))
    scored = ops.score_composition(embedding_flows(spark, sf), reference)
    seen = reference[0].select("pair", F.lit(False).alias("unseen"))
    return scored.join(seen, "pair", "left").select("row_id", grid("pair_deviation", 3).alias("pair_deviation"), F.coalesce("unseen", F.lit(True)).alias("unseen"))


@query("c8_soft_mass", ctes("eflows", MEMBERS, PAIRS,
    ("f", "SELECT p.*, i, assignment[i] AS x FROM p, (SELECT unnest([1, 2, 3, 4]) AS i)"),
    ("ps", "SELECT capture_id, window_index, pair, i, sum(x) AS s FROM f GROUP BY ALL"),
    ("es", "SELECT capture_id, window_index, entity, i, sum(assignment[i]) AS s FROM m, (SELECT unnest([1, 2, 3, 4]) AS i) GROUP BY ALL"),
    ("j", """SELECT f.row_id, f.x * (ps.s - f.x) AS v, f.x * (a.s - f.x) AS va, f.x * (b.s - f.x) AS vb FROM f
JOIN ps ON ps.capture_id = f.capture_id AND ps.window_index = f.window_index AND ps.pair = f.pair AND ps.i = f.i
JOIN es a ON a.capture_id = f.capture_id AND a.window_index = f.window_index AND a.entity = f.endpoint_a_ip AND a.i = f.i
JOIN es b ON b.capture_id = f.capture_id AND b.window_index = f.window_index AND b.entity = f.endpoint_b_ip AND b.i = f.i""")) + f"""
SELECT row_id, {grid_sql("ln(1 + greatest(0, sum(v)))")} AS pair_log_mass, {grid_sql("ln(1 + greatest(0, sum(va)))")} AS entity_a_log_mass,
  {grid_sql("ln(1 + greatest(0, sum(vb)))")} AS entity_b_log_mass FROM j GROUP BY row_id""")
def c8_soft_mass(spark, sf):
    return ops.soft_mass(embedding_flows(spark, sf), 4).select("row_id", *grids("pair_log_mass", "entity_a_log_mass", "entity_b_log_mass"))


@query("c9_scope_memberships", ctes("eflows", MEMBERS) + """
SELECT row_id, entity, least(endpoint_a_ip, endpoint_b_ip) || ',' || greatest(endpoint_a_ip, endpoint_b_ip) AS pair FROM m""")
def c9_scope_memberships(spark, sf):
    return ops.memberships(embedding_flows(spark, sf)).select("row_id", "entity", F.array_join("pair", ",").alias("pair"))


@query("c11_excess_energy", ctes("eflows", ("v", """
SELECT row_id, local_score AS o, embedding[1] AS mu, embedding[2] AS ls FROM eflows""")) + f"""
SELECT row_id, {grid_sql("0.5 * greatest(0, (o - mu) * exp(-ls)) ** 2", 5)} AS energy,
  {grid_sql("0.5 * ((o - mu) * exp(-ls)) ** 2 + ls", 5)} AS nll FROM v""")
def c11_excess_energy(spark, sf):
    e = [F.get("embedding", i) for i in range(2)]
    o = F.col("local_score")
    return embedding_flows(spark, sf).select("row_id", grid(ops.excess_energy(o, *e), 5).alias("energy"), grid(ops.gaussian_nll(o, *e), 5).alias("nll"))


@query("c12_assignment_stats", ctes("eflows") + f"""
SELECT row_id, {grid_sql("list_max(assignment)")} AS peak,
  {grid_sql("-list_sum(list_transform(assignment, lambda w: least(1, greatest(1e-12, w)) * ln(least(1, greatest(1e-12, w)))))")} AS entropy FROM eflows""")
def c12_assignment_stats(spark, sf):
    return embedding_flows(spark, sf).select(
        "row_id", grid(F.array_max("assignment")).alias("peak"), grid(ops.assignment_entropy(F.col("assignment"))).alias("entropy"))


@query("c13_channel_profile", ctes("eflows", ("c", "SELECT *, endpoint_a_ip || '|' || endpoint_b_ip AS channel FROM eflows"),
    ("x", "SELECT channel, unnest(range(64)) AS dim, unnest(embedding) AS v FROM c"),
    ("g", "SELECT channel, ln(1 + window_index - lag(window_index) OVER (PARTITION BY channel ORDER BY window_index, row_id)) AS lg FROM c"),
    ("gs", "SELECT channel, count(*) AS n, coalesce(median(lg), 0) AS gm, coalesce(stddev_pop(lg), 0) AS gs FROM g GROUP BY 1")) + f"""
SELECT x.channel, dim, {grid_sql("avg(v)")} AS mean, {grid_sql("stddev_pop(v)", 5)} AS std, {grid_sql("quantile_cont(v, 0.5)")} AS p50,
  {grid_sql("quantile_cont(v, 0.25)")} AS p25, {grid_sql("quantile_cont(v, 0.75)")} AS p75, {grid_sql("ln(1 + max(n))")} AS log_count,
  {grid_sql("max(gm)")} AS gap_median, {grid_sql("max(gs)", 5)} AS gap_std FROM x JOIN gs ON gs.channel = x.channel GROUP BY x.channel, dim""")
def c13_channel_profile(spark, sf):
    rows = embedding_flows(spark, sf).withColumn("channel", F.concat_ws("|", "endpoint_a_ip", "endpoint_b_ip"))
    p = ops.channel_profile(rows, "channel", "embedding", 64, "window_index", "row_id")
    return p.select("channel", F.col("dim").cast("long").alias("dim"), *grids("mean", "p50", "p25", "p75", "log_count", "gap_median"), *grids("std", "gap_std", digits=5))


def host_flows(spark, sf):
    # The flow table is the stage boundary every context reads from.
    flows = shared_stage(flow_statistics(packets(spark, sf), SHORT_WINDOW, number=True))
    return flows.withColumns({
        "role": F.when(F.col("protocol") == "tcp", 0).otherwise(1), "regime": F.col("dst_port") - 80,
    })


HOSTS = ("hf", "SELECT *, CASE WHEN protocol = 'tcp' THEN 0 ELSE 1 END AS role, dst_port - 80 AS regime FROM sflows")


def host_sql(role: str, name: str = "hc") -> tuple[tuple[str, str], ...]:
    return (
        (f"{name}_first", f"SELECT capture_id, src_ip, {role} AS role, dst_ip, min(timestamp_second) AS f FROM hf GROUP BY ALL"),
        (name, f"""SELECT h.capture_id, h.timestamp_second, h.src_ip, h.{role} AS role, count(*) AS flow_count, sum(byte_count) AS total_bytes,
  sum(packet_count) AS total_packets, avg(byte_count) AS mean_bytes, stddev_pop(byte_count) AS std_bytes, avg(packet_count) AS mean_packets,
  stddev_pop(packet_count) AS std_packets, count(DISTINCT h.dst_ip) AS unique_peers, count(DISTINCT dst_port) AS unique_ports,
  count(DISTINCT CASE WHEN f = timestamp_second THEN h.dst_ip END) AS new_peers
FROM hf h JOIN {name}_first n ON n.capture_id = h.capture_id AND n.src_ip = h.src_ip AND n.role = h.{role} AND n.dst_ip = h.dst_ip
GROUP BY h.capture_id, h.timestamp_second, h.src_ip, h.{role}"""),
    )


_COUNTS = ["flow_count", "unique_peers", "unique_ports", "new_peers"]
_MEANS = ["total_bytes", "total_packets", "mean_bytes", "std_bytes", "mean_packets", "std_packets"]


@query("c14_host_context", ctes("sflows", HOSTS, *host_sql("role")) + f"""
SELECT capture_id, timestamp_second, src_ip, CAST(role AS BIGINT) AS role, {", ".join(_COUNTS)}, {grids_sql(*_MEANS, digits=4)} FROM hc""")
def c14_host_context(spark, sf):
    c = ops.host_context(host_flows(spark, sf))
    return c.select("capture_id", "timestamp_second", "src_ip", F.col("role").cast("long").alias("role"), *_COUNTS, *grids(*_MEANS, digits=4))


_Q = (HOSTS, *host_sql("role"), ("q", """
SELECT h.capture_id, h.row_id, h.timestamp_second, h.src_ip, h.role, 1.0::DOUBLE AS q_flow, byte_count AS q_bytes, packet_count AS q_packets,
  1.0 / count(*) OVER (PARTITION BY h.capture_id, timestamp_second, h.src_ip, h.role, h.dst_ip) AS q_peer,
  1.0 / count(*) OVER (PARTITION BY h.capture_id, timestamp_second, h.src_ip, h.role, dst_port) AS q_port,
  CASE WHEN f = timestamp_second THEN 1.0 / count(*) OVER (PARTITION BY h.capture_id, timestamp_second, h.src_ip, h.role, h.dst_ip) ELSE 0 END AS q_new_peer
FROM hf h JOIN hc_first n ON n.capture_id = h.capture_id AND n.src_ip = h.src_ip AND n.role = h.role AND n.dst_ip = h.dst_ip"""))


@query("c15_contributions", ctes("sflows", *_Q) + f"SELECT capture_id, row_id, {grids_sql(*ops.CONTRIBUTIONS)} FROM q")
def c15_contributions(spark, sf):
    return ops.contributions(host_flows(spark, sf)).select("capture_id", "row_id", *grids(*ops.CONTRIBUTIONS))


_RES = ", ".join(f"greatest(0, (c.{m} - s.{m}_m) / s.{m}_s)" for m in ops.RESPONSIBLE)


@query("c16_responsibility", ctes("sflows", *_Q, ("s", "SELECT role, " + ", ".join(
    f"avg({m}) AS {m}_m, greatest(1e-6, stddev_pop({m})) AS {m}_s" for m in ops.RESPONSIBLE) + " FROM hc GROUP BY role HAVING count(*) >= 2"),
    ("v", f"""SELECT q.capture_id, q.row_id, [{", ".join("q." + c for c in ops.CONTRIBUTIONS)}]::DOUBLE[] AS q, [{_RES}]::DOUBLE[] AS r
FROM q JOIN hc c ON c.capture_id = q.capture_id AND c.timestamp_second = q.timestamp_second AND c.src_ip = q.src_ip AND c.role = q.role JOIN s ON s.role = q.role"""),
    ("d", "SELECT *, sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(r, r)) AS n FROM v")) + f"""
SELECT capture_id, row_id, {grid_sql("CASE WHEN n > 0 THEN least(1, greatest(0, list_dot_product(q, r) / n)) ELSE 0 END", 5)} AS responsibility FROM d""")
def c16_responsibility(spark, sf):
    flows = host_flows(spark, sf)
    contexts = ops.host_context(flows)
    out = ops.responsibility(ops.contributions(flows), contexts, ops.fit_context_stats(contexts))
    return out.select("capture_id", "row_id", grid("responsibility", 5).alias("responsibility"))


COHORTS = ("hf", "SELECT *, (CASE WHEN protocol = 'tcp' THEN 0 ELSE 1 END) * 16 + dst_port - 80 AS cohort FROM sflows")


@query("c17_cohort_context", ctes("sflows", COHORTS, *host_sql("cohort")) + f"""
SELECT capture_id, timestamp_second, src_ip, CAST(role AS BIGINT) AS cohort, {", ".join(_COUNTS)}, {grids_sql(*_MEANS, digits=4)} FROM hc""")
def c17_cohort_context(spark, sf):
    c = ops.cohort_context(host_flows(spark, sf))
    return c.select("capture_id", "timestamp_second", "src_ip", F.col("cohort").cast("long").alias("cohort"), *_COUNTS, *grids(*_MEANS, digits=4))


@query("c18_backoff", ctes("sflows", COHORTS, *host_sql("cohort"), ("n", """
SELECT role AS cohort, count(*) FILTER (WHERE capture_id = 'c0') AS cell_train, count(*) FILTER (WHERE capture_id <> 'c0') AS cell_calibration FROM hc GROUP BY 1"""),
    ("p", "SELECT *, sum(cell_train) OVER (PARTITION BY cohort // 16) AS rt, sum(cell_calibration) OVER (PARTITION BY cohort // 16) AS rc FROM n")) + """
SELECT CAST(cohort AS BIGINT) AS cohort, cell_train, cell_calibration, CASE WHEN cell_train >= 140 AND cell_calibration >= 138 THEN 'cell'
  WHEN rt >= 200 AND rc >= 400 THEN 'role' ELSE 'global' END AS level FROM p WHERE cell_train > 0""")
def c18_backoff(spark, sf):
    c = ops.cohort_context(host_flows(spark, sf))
    choices = ops.backoff(c.where("capture_id = 'c0'"), c.where("capture_id <> 'c0'"), min_cell_train=140,
                          min_cell_calibration=138, min_role_train=200, min_role_calibration=400)
    return choices.select(F.col("cohort").cast("long").alias("cohort"), "cell_train", "cell_calibration", "level")


_SETS = "GROUPING SETS ((src_ip, dst_ip, protocol), (src_ip, dst_ip, protocol, src_port), (src_ip, dst_ip, protocol, dst_port), (protocol), (protocol, src_port), (protocol, dst_port))"


@query("c19_relation_counts", ctes("rel") + f"""
SELECT src_ip, dst_ip, protocol, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, count(*) AS flows,
  CASE grouping(src_ip) * 4 + grouping(src_port) * 2 + grouping(dst_port) WHEN 3 THEN 'pair' WHEN 1 THEN 'src_port' WHEN 2 THEN 'dst_port'
    WHEN 7 THEN 'protocol' WHEN 5 THEN 'protocol_src_port' ELSE 'protocol_dst_port' END AS granularity
FROM rel WHERE benign GROUP BY {_SETS}""")
def c19_relation_counts(spark, sf):
    c = ops.relation_counts(relations(spark, sf).where("benign"))
    return c.withColumns({p: F.col(p).cast("long") for p in ("src_port", "dst_port")})


_LOOKUP = (("b", "SELECT * FROM rel WHERE benign"), ("c1", "SELECT src_ip, dst_ip, protocol, count(*) AS n FROM b GROUP BY ALL"),
    ("c2", "SELECT src_ip, dst_ip, protocol, src_port, count(*) AS n FROM b GROUP BY ALL"), ("c3", "SELECT src_ip, dst_ip, protocol, dst_port, count(*) AS n FROM b GROUP BY ALL"),
    ("c4", "SELECT protocol, count(*) AS n FROM b GROUP BY ALL"), ("c5", "SELECT protocol, src_port, count(*) AS n FROM b GROUP BY ALL"),
    ("c6", "SELECT protocol, dst_port, count(*) AS n FROM b GROUP BY ALL"), ("l", """
SELECT order_id, line, coalesce(c1.n, 0) AS n_pair, coalesce(c2.n, 0) AS n_src_port, coalesce(c3.n, 0) AS n_dst_port, coalesce(c4.n, 0) AS n_protocol,
  coalesce(c5.n, 0) AS n_protocol_src_port, coalesce(c6.n, 0) AS n_protocol_dst_port FROM rel r
LEFT JOIN c1 USING (src_ip, dst_ip, protocol) LEFT JOIN c2 USING (src_ip, dst_ip, protocol, src_port) LEFT JOIN c3 USING (src_ip, dst_ip, protocol, dst_port)
LEFT JOIN c4 USING (protocol) LEFT JOIN c5 USING (protocol, src_port) LEFT JOIN c6 USING (protocol, dst_port)"""))
_NAMES = [f"n_{n}" for n in ops.RELATION_SETS]


@query("j5_relation_lookup", ctes("rel", *_LOOKUP) + f"SELECT order_id, line, {', '.join(_NAMES)} FROM l")
def j5_relation_lookup(spark, sf):
    rows = relations(spark, sf)
    return ops.relation_lookup(rows, ops.relation_counts(rows.where("benign"))).select("order_id", "line", *_NAMES)


@query("c20_relation_surprise", ctes("rel", *_LOOKUP, ("k", """
SELECT order_id, line, CASE WHEN n_pair > 0 THEN n_pair ELSE n_protocol END AS ref,
  CASE WHEN n_pair > 0 THEN greatest(n_src_port, n_dst_port) ELSE greatest(n_protocol_src_port, n_protocol_dst_port) END AS relation_seen_count FROM l""")) + f"""
SELECT order_id, line, relation_seen_count, {grid_sql("ln(1 + ref) - ln(1 + relation_seen_count)")} AS relation_raw FROM k""")
def c20_relation_surprise(spark, sf):
    rows = relations(spark, sf)
    out = ops.relation_surprise(rows, ops.relation_counts(rows.where("benign")))
    return out.select("order_id", "line", "relation_seen_count", grid("relation_raw").alias("relation_raw"))


@query("c34_service_recency", ctes("sflows", ("c", """
SELECT capture_id, src_ip, dst_ip, protocol, dst_port, timestamp_second, count(*) AS cell_flows FROM sflows GROUP BY ALL"""),
    ("p", "SELECT capture_id, src_ip, dst_ip, protocol, timestamp_second, sum(cell_flows) AS pf, count(*) AS pp FROM c GROUP BY ALL"),
    ("ph", """SELECT *, coalesce(sum(pf) OVER (PARTITION BY capture_id, src_ip, dst_ip, protocol ORDER BY timestamp_second
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS peer_seen FROM p"""),
    ("s", """SELECT *, coalesce(sum(cell_flows) OVER w, 0) AS service_seen, lag(timestamp_second) OVER (PARTITION BY capture_id, src_ip, dst_ip, protocol, dst_port ORDER BY timestamp_second) AS prev FROM c
WINDOW w AS (PARTITION BY capture_id, src_ip, dst_ip, protocol, dst_port ORDER BY timestamp_second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")) + f"""
SELECT capture_id, src_ip, dst_ip, protocol, CAST(dst_port AS BIGINT) AS dst_port, timestamp_second, cell_flows, CAST(service_seen AS BIGINT) AS service_seen,
  timestamp_second - prev AS seconds_since_seen, prev IS NULL AS new_service, {grid_sql("pp / pf")} AS ports_per_flow,
  {grid_sql("CASE WHEN peer_seen > 0 THEN service_seen / peer_seen ELSE 0 END")} AS port_share
FROM s JOIN ph USING (capture_id, src_ip, dst_ip, protocol, timestamp_second)""")
def c34_service_recency(spark, sf):
    out = ops.service_recency(flow_statistics(packets(spark, sf), SHORT_WINDOW))
    return out.withColumn("dst_port", F.col("dst_port").cast("long")).withColumns({c: grid(c) for c in ("ports_per_flow", "port_share")})


@query("j4_scope_totals", ctes("eflows") + """
SELECT row_id, count(*) OVER w AS scope_flows, CAST(sum(byte_count) OVER w AS BIGINT) AS scope_bytes
FROM eflows WINDOW w AS (PARTITION BY capture_id, window_index, endpoint_a_ip)""")
def j4_scope_totals(spark, sf):
    totals = {"scope_flows": F.count(F.lit(1)), "scope_bytes": F.sum("byte_count")}
    return group_totals(embedding_flows(spark, sf), ["capture_id", "window_index", "endpoint_a_ip"], totals).select("row_id", *totals)
