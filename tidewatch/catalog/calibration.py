"""Fitting and calibration tables (F1-F20, F22) and nearest prototypes."""
import math

from pyspark.sql import functions as F

from tidewatch.catalog.context import HOSTS, host_flows, host_sql
from tidewatch.catalog.registry import ctes, grid, grid_sql, grids, query
from tidewatch.operators import calibration as ops, context
from tidewatch.operators.flows import FLOW_STATISTICS, flow_statistics
from tidewatch.plans.views import SHORT_WINDOW, embedding_flows, packets, tied_scores
from tidewatch.session import bounded_rows, shared_stage

SCORES = ["byte_count", "packet_len_std", "active_duration"]


def _flows(spark, sf):
    return shared_stage(flow_statistics(packets(spark, sf), SHORT_WINDOW, number=True))


def _normal(flows):
    return flows.where("capture_id = 'c0' AND binary_label = 0")


def long_sql(source: str, columns, keep: str = "", where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS component, {c}::DOUBLE AS value FROM {source} {where}" for c in columns)


CAL = ("cal", "SELECT * FROM sflows WHERE capture_id = 'c0' AND binary_label = 0")


@query("f1_standard_scaler", ctes("eflows sflows", ("x", "SELECT unnest(range(64)) AS dim, unnest(embedding) AS v FROM eflows"),
    ("v", "SELECT dim, CASE WHEN dim < 8 THEN ln(1 + greatest(0, v)) ELSE v END AS v FROM x"), ("l", long_sql("sflows", FLOW_STATISTICS))) + f"""
SELECT 'dim' || CAST(dim AS VARCHAR) AS component, {grid_sql("avg(v)")} AS mean, {grid_sql("CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END")} AS scale FROM v GROUP BY dim
UNION ALL SELECT component, {grid_sql("avg(ln(1 + value))")}, {grid_sql("CASE WHEN stddev_pop(ln(1 + value)) < 1e-6 THEN 1 ELSE stddev_pop(ln(1 + value)) END")} FROM l GROUP BY 1""")
def f1_standard_scaler(spark, sf):
    vector = ops.fit_standard_vector(embedding_flows(spark, sf), "embedding", 8)
    vector = vector.select(F.concat(F.lit("dim"), F.col("dim").cast("string")).alias("component"), "mean", "scale")
    both = vector.unionByName(ops.fit_standard(_flows(spark, sf), FLOW_STATISTICS, FLOW_STATISTICS))
    return both.select("component", *grids("mean", "scale"))


@query("f2_robust_scaler", ctes("sflows", CAL, ("l", long_sql("cal", FLOW_STATISTICS)), ("q", """
SELECT component, quantile_cont(ln(1 + value), 0.5) AS center, quantile_cont(ln(1 + value), 0.75) - quantile_cont(ln(1 + value), 0.25) AS spread FROM l GROUP BY 1""")) + f"""
SELECT component, {grid_sql("center")} AS center, {grid_sql("greatest(0.05, CASE WHEN spread < 10 * 2.220446049250313e-16 THEN 1 ELSE spread END)")} AS scale FROM q""")
def f2_robust_scaler(spark, sf):
    return ops.fit_robust(_normal(_flows(spark, sf)), FLOW_STATISTICS, 0.05).select("component", *grids("center", "scale"))


@query("f3_quantile_scaler", ctes("sflows", CAL, ("l", long_sql("cal", [*SCORES, "bin_packets_mean"])), ("q", """
SELECT component, quantile_cont(value, 0.5) AS low, quantile_cont(value, 0.95) AS high FROM l GROUP BY 1"""), ("p", """
SELECT component, low, CASE WHEN high - low < 1e-12 THEN low + greatest(abs(low) * 1e-6, 1e-6) ELSE high END AS high FROM q"""),
    ("a", long_sql("sflows", [*SCORES, "bin_packets_mean"], "capture_id, row_id, "))) + f"""
SELECT capture_id, row_id, component, {grid_sql("low")} AS low, {grid_sql("high")} AS high, {grid_sql("greatest(0, (value - low) / (high - low))", 3)} AS scaled FROM a JOIN p USING (component)""")
def f3_quantile_scaler(spark, sf):
    flows = _flows(spark, sf)
    columns = [*SCORES, "bin_packets_mean"]
    fitted = ops.fit_quantile(_normal(flows), columns, 0.5, 0.95)
    long = ops.unpivot(flows, ["capture_id", "row_id"], columns).join(fitted, "component")
    scaled = ops.quantile_scaled(F.col("value"), F.col("low"), F.col("high"))
    return long.select("capture_id", "row_id", "component", *grids("low", "high"), grid(scaled, 3).alias("scaled"))


_RANK = """SELECT r.*, (SELECT count(*) FROM {cal} c WHERE c.v < r.v {on}) AS below, (SELECT count(*) FROM {cal} c WHERE c.v <= r.v {on}) AS upto,
  (SELECT count(*) FROM {cal} c WHERE true {on}) AS n FROM {rows} r"""


@query("f4_tail_evidence", ctes("tied", ("d", "SELECT dataset, score AS v, count(*) AS flows FROM tied GROUP BY ALL"),
    ("k", "SELECT score AS v, count(*) AS w FROM tied WHERE dataset = 'F' AND binary_label = 0 GROUP BY 1"), ("r", """
SELECT d.*, (SELECT sum(w) FROM k) AS n, coalesce((SELECT sum(w) FROM k WHERE k.v < d.v), 0) AS below FROM d""")) + f"""
SELECT dataset, v AS score, flows, {grid_sql("(n - below + 1) / (n + 1)")} AS tail_p, {grid_sql("-ln((n - below + 1) / (n + 1) + 1e-12)")} AS evidence FROM r""")
def f4_tail_evidence(spark, sf):
    rows = tied_scores(spark, sf)
    out = ops.tail_evidence(rows.where("dataset = 'F' AND binary_label = 0"), rows, "score", epsilon=1e-12)
    return out.groupBy("dataset", "score").agg(F.count("*").alias("flows"), grid(F.max("tail_p")).alias("tail_p"), grid(F.max("evidence")).alias("evidence"))


@query("f5_ecdf", ctes("sflows", ("c", "SELECT protocol, packet_len_mean AS v FROM sflows WHERE capture_id = 'c0'"),
    ("r", "SELECT capture_id, row_id, protocol, packet_len_mean AS v FROM sflows"), ("x", _RANK.format(cal="c", rows="r", on="AND c.protocol = r.protocol"))) + f"""
SELECT capture_id, row_id, {grid_sql("upto / (n + 1)")} AS cdf FROM x""")
def f5_ecdf(spark, sf):
    flows = _flows(spark, sf).select("capture_id", "row_id", "protocol", "packet_len_mean")
    return ops.ecdf(flows.where("capture_id = 'c0'"), flows, "packet_len_mean", ["protocol"]).select("capture_id", "row_id", grid("cdf").alias("cdf"))


@query("f6_thresholds", ctes("sflows", CAL, ("l", long_sql("cal", SCORES)), ("k", """
SELECT component, value, row_number() OVER (PARTITION BY component ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY component) AS n FROM l""")) + f"""
SELECT component, {grid_sql("value")} AS threshold FROM k WHERE i = ceil((n - 1) * (1.0::DOUBLE - 0.01::DOUBLE))""")
def f6_thresholds(spark, sf):
    return ops.thresholds(_normal(_flows(spark, sf)), SCORES, 0.01).select("component", grid("threshold").alias("threshold"))


@query("f7_affine_alignment", ctes("sflows", CAL, ("l", long_sql("cal", SCORES)), ("q", """
SELECT component, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99 FROM l GROUP BY 1"""),
    ("a", long_sql("sflows", SCORES, "capture_id, row_id, "))) + f"""
SELECT capture_id, row_id, component, {grid_sql("(value - q50) / greatest(q95 - q50, 1e-6)")} AS aligned, value > q99 AS flag FROM a JOIN q USING (component)""")
def f7_affine_alignment(spark, sf):
    flows = _flows(spark, sf)
    long = ops.unpivot(flows, ["capture_id", "row_id"], SCORES).join(ops.fit_affine(_normal(flows), SCORES), "component")
    aligned = ops.affine_scaled(F.col("value"), F.col("q50"), F.col("q95"))
    return long.select("capture_id", "row_id", "component", grid(aligned).alias("aligned"), (F.col("value") > F.col("q99")).alias("flag"))


_V = ["assignment[1]", "assignment[2]", "local_score"]


@query("f8_fusion", ctes("eflows", ("v", f"SELECT row_id, {_V[0]} AS a, {_V[1]} AS b, {_V[2]} AS c FROM eflows"), ("m", "SELECT *, greatest(a, b, c) AS t FROM v")) + f"""
SELECT row_id, {grid_sql("0.25 * a + 0.25 * b + 0.5 * c")} AS weighted, {grid_sql("t")} AS max, {grid_sql("t")} AS tail_max, {grid_sql("a + b + c")} AS sum,
  {grid_sql("t + 0.5 * ln((exp((a - t) / 0.5) + exp((b - t) / 0.5) + exp((c - t) / 0.5)) / 3)")} AS lse FROM m""")
def f8_fusion(spark, sf):
    v = [F.get("assignment", 0), F.get("assignment", 1), F.col("local_score")]
    kinds = ("weighted", "max", "tail_max", "sum", "lse")
    return embedding_flows(spark, sf).select("row_id", *[grid(ops.fuse(v, k, weights=(1, 1, 2), temperature=0.5)).alias(k) for k in kinds])


@query("f9_local_score", ctes("eflows") + f"""
SELECT row_id, {grid_sql("(0.3 * packet_count + 0.7 * local_score) / 1.0")} AS both, {grid_sql("local_score")} AS error_only FROM eflows""")
def f9_local_score(spark, sf):
    d, e = F.col("packet_count").cast("double"), F.col("local_score")
    return embedding_flows(spark, sf).select(
        "row_id", grid(ops.local_score(d, e, weights=(0.3, 0.7))).alias("both"), grid(ops.local_score(d, e, "reconstruction_only")).alias("error_only"))


@query("f10_prototypes")
def f10_prototypes(spark, sf):
    rows = embedding_flows(spark, sf)
    centers = ops.fit_prototypes(rows, "embedding", 8)
    out = ops.nearest_prototype(rows, "embedding", centers)
    return out.groupBy("prototype").agg(F.count("*").alias("members"), F.avg("distance").alias("mean_distance"))


def _label_centers(spark, sf):
    """Mean embedding per label: ten fixed centers taken from the data."""
    means = context.vector_mean(F.col("embedding"), 64)
    rows = bounded_rows(embedding_flows(spark, sf).groupBy("mode_id").agg(means.alias("c")).orderBy("mode_id"), ops.MOST_PROTOTYPES)
    return [list(r["c"]) for r in rows]


_CENTERS = (("ex", "SELECT mode_id, unnest(range(64)) AS dim, unnest(embedding) AS v FROM eflows"),
    ("cd", "SELECT mode_id, dim, avg(v) AS v FROM ex GROUP BY ALL"), ("ce", "SELECT mode_id AS k, list(v ORDER BY dim) AS c FROM cd GROUP BY 1"),
    ("ds", """SELECT row_id, window_index, k, list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2,
  list_transform(list_zip(embedding, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])) AS parts FROM eflows, ce"""),
    ("dn", "SELECT row_id, window_index, arg_min(k, d2) AS prototype, min(d2) AS d2 FROM ds GROUP BY ALL"))


@query("j10_nearest_prototype", ctes("eflows", *_CENTERS, ("w", """
SELECT row_id, arg_min(k, d2 / ((1 + k) * (1 + k))) AS prototype, min(d2 / ((1 + k) * (1 + k))) AS s FROM ds GROUP BY 1""")) + f"""
SELECT row_id, CAST(prototype AS BIGINT) AS prototype, {grid_sql("s")} AS scaled_distance, {grid_sql("sqrt(s) * (1 + prototype)")} AS distance FROM w""")
def j10_nearest_prototype(spark, sf):
    centers = _label_centers(spark, sf)
    out = ops.nearest_prototype(embedding_flows(spark, sf), "embedding", centers, [1.0 + k for k in range(len(centers))])
    return out.select("row_id", F.col("prototype").cast("long").alias("prototype"), *grids("scaled_distance", "distance"))


@query("f11_prototype_stats", ctes("eflows", *_CENTERS, ("fl", "SELECT greatest(1e-3, 0.1 * median(sqrt(d2))) AS f FROM dn")) + f"""
SELECT CAST(prototype AS BIGINT) AS prototype, {grid_sql("greatest(max(f), median(sqrt(d2)))")} AS width,
  count(DISTINCT (window_index - (SELECT min(window_index) FROM eflows)) // 2) AS support, count(*) AS members FROM dn, fl GROUP BY prototype""")
def f11_prototype_stats(spark, sf):
    assigned = ops.nearest_prototype(embedding_flows(spark, sf), "embedding", _label_centers(spark, sf))
    stats = ops.prototype_stats(assigned, "window_index", block=2)
    return stats.select(F.col("prototype").cast("long").alias("prototype"), grid("width").alias("width"), "support", "members")


@query("f11_radial_response", ctes("eflows", *_CENTERS, ("lr", "SELECT row_id, k, -d2 / (2 * (1.0 + k) * (1.0 + k)) AS l FROM ds"),
    ("rr", "SELECT row_id, k, exp(l - max(l) OVER (PARTITION BY row_id)) AS r FROM lr")) + f"""
SELECT row_id, CAST(k AS BIGINT) AS prototype, {grid_sql("r / sqrt(sum(r * r) OVER (PARTITION BY row_id))")} AS response FROM rr""")
def f11_radial_response(spark, sf):
    centers = _label_centers(spark, sf)
    response = ops.radial_response(F.col("embedding"), centers, [1.0 + k for k in range(len(centers))])
    out = embedding_flows(spark, sf).select("row_id", F.posexplode(response).alias("prototype", "response"))
    return out.select("row_id", F.col("prototype").cast("long").alias("prototype"), grid("response").alias("response"))


@query("f12_mixture_selection")
def f12_mixture_selection(spark, sf):
    return ops.select_mixture(embedding_flows(spark, sf), "embedding", 3)[1]


@query("f12_single_component", ctes("eflows", ("fx", "SELECT unnest(range(64)) AS dim, unnest(embedding) AS x FROM eflows"),
    ("fv", "SELECT dim, greatest(var_pop(x), 1e-4) AS v, var_pop(x) AS raw, count(*) AS n FROM fx GROUP BY 1")) + f"""
SELECT 1 AS k, {grid_sql("sum(n * (ln(2 * pi()) + ln(v) + raw / v)) + 128 * ln(max(n))", 3)} AS bic FROM fv""")
def f12_single_component(spark, sf):
    table = ops.select_mixture(embedding_flows(spark, sf), "embedding", 1)[1]
    return table.select(F.col("k").cast("long").alias("k"), grid("bic", 3).alias("bic"))


_D = 64


def _mixture(spark, sf):
    """Two roles with the labels 0-4 and 5-9 as diagonal components."""
    v = [F.get("embedding", i) for i in range(_D)]
    stats = embedding_flows(spark, sf).groupBy("mode_id").agg(
        F.array(*[F.avg(x) for x in v]).alias("m"), F.array(*[F.greatest(F.lit(1e-4), F.var_pop(x)) for x in v]).alias("v"), F.count("*").alias("n"))
    rows = sorted(bounded_rows(stats, 10), key=lambda r: r["mode_id"])
    out = []
    for role in (0, 1):
        parts = [r for r in rows if r["mode_id"] // 5 == role]
        size = sum(r["n"] for r in parts)
        out.append({"role": role, "parts": [{"w": r["n"] / size, "m": list(r["m"]), "v": list(r["v"])} for r in parts]})
    return out


_MIX = (("mx", f"SELECT row_id, mode_id, unnest(range({_D})) AS dim, unnest(embedding[1:{_D}]) AS x FROM eflows"),
    ("mp", "SELECT mode_id, dim, avg(x) AS m, greatest(1e-4, var_pop(x)) AS v FROM mx GROUP BY ALL"),
    ("mn", "SELECT mode_id, mode_id // 5 AS role, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY mode_id // 5) AS w FROM eflows GROUP BY mode_id"),
    ("ml", f"""SELECT row_id, n.role, n.mode_id - n.role * 5 AS k, ln(max(w)) - 0.5 * (sum((x - m) * (x - m) / v + ln(v)) + {_D} * ln(2 * pi())) AS l
FROM mx JOIN mp USING (dim) JOIN mn n ON n.mode_id = mp.mode_id GROUP BY row_id, n.role, n.mode_id"""),
    ("mt", "SELECT *, max(l) OVER (PARTITION BY row_id, role) AS t FROM ml"),
    ("mr", "SELECT row_id, role, -(max(t) + ln(sum(exp(l - t)))) AS raw, arg_max(k, l) AS regime FROM mt GROUP BY ALL"))


@query("f13_mixture_score", ctes("eflows", *_MIX) + f"""
SELECT row_id, CAST(arg_min(role, raw) AS BIGINT) AS assigned_role, CAST(arg_min(regime, raw) AS BIGINT) AS assigned_regime, {grid_sql("min(raw)", 5)} AS local_raw FROM mr GROUP BY 1""")
def f13_mixture_score(spark, sf):
    rows = embedding_flows(spark, sf).withColumn("v", F.slice("embedding", 1, _D))
    out = ops.mixture_score(rows, "v", _mixture(spark, sf))
    return out.select("row_id", *[F.col(c).cast("long").alias(c) for c in ("assigned_role", "assigned_regime")], grid("local_raw", 5).alias("local_raw"))


@query("f14_mixture_nll", ctes("eflows", *_MIX) + f"""
SELECT r.row_id, {grid_sql(f"raw / {_D}", 5)} AS nll FROM mr r JOIN eflows e ON e.row_id = r.row_id AND r.role = e.mode_id % 2""")
def f14_mixture_nll(spark, sf):
    rows = embedding_flows(spark, sf).withColumns({"v": F.slice("embedding", 1, _D), "role": F.col("mode_id") % 2})
    return ops.mixture_nll(rows, "v", "role", _mixture(spark, sf)).select("row_id", grid("nll", 5).alias("nll"))


_MEASURES = ["packet_count", "byte_count"]


@query("f15_target_bounds", ctes("sflows", ("l", long_sql("sflows", _MEASURES, "protocol, ")), ("q", """
SELECT protocol, component, quantile_cont(ln(1 + value), 0.5) AS center, quantile_cont(ln(1 + value), 0.75) - quantile_cont(ln(1 + value), 0.25) AS s FROM l GROUP BY ALL"""),
    ("y", "SELECT protocol, component, center, greatest(0.05, CASE WHEN s < 1e-15 THEN 1 ELSE s END) AS scale, (ln(1 + value) - center) / greatest(0.05, CASE WHEN s < 1e-15 THEN 1 ELSE s END) AS y FROM l JOIN q USING (protocol, component)")) + f"""
SELECT protocol, component, {grid_sql("max(center)")} AS center, {grid_sql("max(scale)")} AS scale, {grid_sql("min(y)")} AS lower, {grid_sql("max(y)")} AS upper,
  {grid_sql("greatest(0.3, stddev_pop(y)) - 0.05")} AS width, {grid_sql("quantile_cont(y, 0.05)")} AS c0, {grid_sql("quantile_cont(y, 0.35)")} AS c1,
  {grid_sql("quantile_cont(y, 0.95)")} AS c3 FROM y GROUP BY ALL""")
def f15_target_bounds(spark, sf):
    t = ops.fit_targets(_flows(spark, sf), "protocol", _MEASURES, 4, 0.05, 0.05)
    return t.select("protocol", "component", *grids("center", "scale", "lower", "upper", "width"), *[grid(F.col("centers")[i]).alias(f"c{i}") for i in (0, 1, 3)])


@query("f16_context_stats", ctes("sflows", HOSTS, *host_sql("role"), ("l", long_sql("hc", context.RESPONSIBLE, "role, ")), ("k", long_sql("hc", context.HOST_MEASURES, "role, "))) + f"""
SELECT 'residual' AS kind, CAST(role AS BIGINT) AS role, component, {grid_sql("avg(value)", 4)} AS center, {grid_sql("greatest(1e-6, stddev_pop(value))", 4)} AS scale FROM l GROUP BY ALL
UNION ALL SELECT 'scaler', CAST(role AS BIGINT), component, {grid_sql("median(value)", 4)},
  {grid_sql("CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) < 1e-15 THEN 1 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END", 4)} FROM k GROUP BY ALL""")
def f16_context_stats(spark, sf):
    contexts = context.host_context(host_flows(spark, sf))
    stats = context.fit_context_stats(contexts)
    names = F.array(*[F.lit(c) for c in context.RESPONSIBLE])
    stats = stats.select("role", F.inline(F.arrays_zip(names.alias("component"), F.col("residual_mean").alias("center"), F.col("residual_std").alias("scale"))))
    residual = stats.toDF("role", "component", "center", "scale").withColumn("kind", F.lit("residual"))
    scaler = ops.fit_robust(contexts, context.HOST_MEASURES, log=False, by=["role"]).withColumn("kind", F.lit("scaler"))
    return residual.unionByName(scaler).select("kind", F.col("role").cast("long").alias("role"), "component", *grids("center", "scale", digits=4))


@query("f17_joint_evidence", ctes("sflows", ("p", f"SELECT capture_id, row_id, packet_count / 10 AS a, {grid_sql('packet_len_mean', 3)} / 500 AS b FROM sflows"),
    ("r", "SELECT capture_id, row_id, a + b AS v FROM p"), ("c", "SELECT v FROM r WHERE capture_id = 'c0'"), ("x", _RANK.format(cal="c", rows="r", on=""))) + f"""
SELECT capture_id, row_id, {grid_sql("v")} AS joint, {grid_sql("1 - exp(ln((n - below + 1) / (n + 1)))")} AS percentile FROM x""")
def f17_joint_evidence(spark, sf):
    flows = _flows(spark, sf).select("capture_id", "row_id", (F.col("packet_count") / 10).alias("a"), (grid("packet_len_mean", 3) / 500).alias("b"))
    return ops.joint_evidence(flows.where("capture_id = 'c0'"), flows, ["a", "b"]).select("capture_id", "row_id", *grids("joint", "percentile"))


@query("f18_mask_plan", ctes("eflows", ("b", "SELECT row_id, unnest(range(30)) AS bin FROM eflows"), ("o", """
SELECT row_id, bin, row_number() OVER (PARTITION BY row_id ORDER BY sha1('9|all|' || row_id || '|' || bin)) - 1 AS p,
  row_number() OVER (PARTITION BY row_id ORDER BY sha1('9|mask|' || row_id || '|' || bin)) - 1 AS q FROM b""")) + """
SELECT row_id, bin, CAST(CASE WHEN p < 10 THEN p // 5 ELSE 2 + (p - 10) // 4 END AS BIGINT) AS round, q < 3 AS masked FROM o""")
def f18_mask_plan(spark, sf):
    identity = F.col("row_id").cast("string")
    rows = embedding_flows(spark, sf).select(
        "row_id", F.posexplode(ops.mask_rounds(identity, 30, 7, 9)).alias("bin", "round"), ops.masked_bins(identity, 30, 0.1, 9).alias("m"))
    return rows.select("row_id", F.col("bin").cast("long").alias("bin"), F.col("round").cast("long").alias("round"), F.array_contains("m", F.col("bin")).alias("masked"))


@query("f19_event_error", ctes("eflows", ("x", "SELECT row_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM eflows"),
    ("o", "SELECT row_id, e * e AS e, e > 0.05 * (row_id % 5) AS o FROM x"), ("m", "SELECT row_id, avg(CASE WHEN o THEN e END) AS a, avg(CASE WHEN NOT o THEN e END) AS b FROM o GROUP BY 1")) + f"""
SELECT row_id, {grid_sql("CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE 0.8 * a + 0.2 * b END")} AS error FROM m""")
def f19_event_error(spark, sf):
    level = F.lit(0.05) * (F.col("row_id") % 5)
    errors = F.transform("embedding", lambda e: e * e)
    return embedding_flows(spark, sf).select("row_id", grid(ops.event_error(errors, F.transform("embedding", lambda e: e > level), 0.8)).alias("error"))


_PICK = "CAST(('0x' || substr(md5('7|' || draw || '|{t}'), 1, 12)) AS BIGINT) % {n}"


@query("f20_balanced_sample", ctes("sflows", ("base", "SELECT protocol, capture_id, row_id FROM sflows"),
    ("pl", "SELECT *, row_number() OVER (PARTITION BY protocol, capture_id ORDER BY row_id) - 1 AS r FROM base"),
    ("bl", "SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY capture_id) - 1 AS b FROM (SELECT protocol, capture_id, count(*) AS n FROM base GROUP BY ALL)"),
    ("sl", "SELECT protocol, nb, row_number() OVER (ORDER BY protocol) - 1 AS s FROM (SELECT protocol, count(*) AS nb FROM bl GROUP BY 1)"),
    ("d0", "SELECT unnest(range(500)) AS draw"), ("d1", f"SELECT d0.draw, sl.* FROM d0 JOIN sl ON sl.s = {_PICK.format(t='s', n='(SELECT count(*) FROM sl)')}"),
    ("d2", f"SELECT d1.draw, bl.* FROM d1 JOIN bl ON bl.protocol = d1.protocol AND bl.b = {_PICK.format(t='b', n='nb')}")) + f"""
SELECT d2.draw, pl.protocol, pl.capture_id, pl.row_id FROM d2 JOIN pl ON pl.protocol = d2.protocol AND pl.capture_id = d2.capture_id AND pl.r = {_PICK.format(t='r', n='n')}""")
def f20_balanced_sample(spark, sf):
    flows = _flows(spark, sf)
    return ops.balanced_sample(flows, "protocol", "capture_id", "row_id", 500, 7)


@query("f20_epoch_plan", ctes("eflows") + """
SELECT row_id, row_number() OVER (ORDER BY md5('5|' || row_id), row_id) - 1 AS position, (row_number() OVER (ORDER BY md5('5|' || row_id), row_id) - 1) // 64 AS batch FROM eflows""")
def f20_epoch_plan(spark, sf):
    return ops.epoch_plan(embedding_flows(spark, sf), "row_id", 64, 5)


_ERF = """(CASE WHEN {x} < 0 THEN -1 WHEN {x} > 0 THEN 1 ELSE 0 END) * (1 - ((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t + 0.254829592) * t * exp(-{x} * {x}))"""


@query("f22_pit_diagnostics", ctes("eflows", *_MIX, ("z", """
SELECT e.row_id, p.mode_id, (e.embedding[1] - m) / (sqrt(v) * sqrt(2.0)) AS z, w FROM eflows e, mp p JOIN mn USING (mode_id) WHERE p.dim = 0 AND mn.role = 0"""),
    ("t", "SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM z"), ("c", f"SELECT row_id, sum(w * 0.5 * (1 + {_ERF.format(x='z')})) AS pit FROM t GROUP BY 1")) + f"""
SELECT CAST(least(9, floor(pit * 10)) AS BIGINT) AS bin, count(*) AS rows, {grid_sql("(SELECT avg(CASE WHEN pit BETWEEN 0.05 AND 0.95 THEN 1.0 ELSE 0 END) FROM c)")} AS coverage_90,
  {grid_sql("(SELECT avg(CASE WHEN pit BETWEEN 0.025 AND 0.975 THEN 1.0 ELSE 0 END) FROM c)")} AS coverage_95 FROM c GROUP BY 1""")
def f22_pit_diagnostics(spark, sf):
    parts = [{"w": p["w"], "m": p["m"][0], "s": math.sqrt(p["v"][0])} for p in _mixture(spark, sf)[0]["parts"]]
    cdf = ops.mixture_cdf(F.get("embedding", 0), ops.constant(parts, "array<struct<w: double, m: double, s: double>>"))
    out = ops.pit_diagnostics(embedding_flows(spark, sf).select(cdf.alias("pit")), "pit")
    return out.select(F.col("bin").cast("long").alias("bin"), "rows", *grids("coverage_90", "coverage_95"))
