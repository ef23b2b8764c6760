"""Detection metrics and reports."""
from pyspark.sql import functions as F

from tidewatch.catalog.context import host_flows
from tidewatch.catalog.registry import ctes, grid, grid_sql, grids, grids_sql, query
from tidewatch.functions import keys
from tidewatch.operators import activity, metrics as ops
from tidewatch.operators.calibration import thresholds
from tidewatch.operators.ordered import exact_quantiles
from tidewatch.plans.views import SHORT_WINDOW, document_scores, packets, tied_scores

STEPS = lambda src, by: (
    ("g", f"SELECT {by} AS k, score, count(*) FILTER (WHERE binary_label = 1) AS pos, count(*) FILTER (WHERE binary_label = 0) AS neg FROM {src} GROUP BY ALL"),
    ("s", """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY k) AS p, sum(neg) OVER (PARTITION BY k) AS n,
  lead(score) OVER w AS lower FROM g WINDOW w AS (PARTITION BY k ORDER BY score DESC)"""),
    ("r", """SELECT *, tp / nullif(p, 0) AS tpr, fp / nullif(n, 0) AS fpr, (tp - pos) / nullif(p, 0) AS tpr0, (fp - neg) / nullif(n, 0) AS fpr0, tp / (tp + fp) AS pr,
  CASE WHEN tp + fp - pos - neg = 0 THEN 1 ELSE (tp - pos) / (tp + fp - pos - neg) END AS pr0 FROM s"""),
    ("e", """SELECT *, abs(fpr - (1 - tpr)) AS miss, fpr0 - (1 - tpr0) AS l, fpr - (1 - tpr) AS h FROM r"""),
    ("near", "SELECT k, (fpr + 1 - tpr) / 2 AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY miss, score DESC) AS i FROM e) WHERE i = 1"),
    ("cross_at", "SELECT k, CASE WHEN h = 0 THEN fpr ELSE fpr0 + (-l / (h - l)) * (fpr - fpr0) END AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC) AS i FROM e WHERE h >= 0) WHERE i = 1"),
    ("bracket", """SELECT k, CASE WHEN l = 0 THEN fpr0 ELSE fpr0 + (-l / (h - l)) * (fpr - fpr0) END AS v, score AS upper, CASE WHEN l = 0 THEN score ELSE coalesce(lower, '-inf'::DOUBLE) END AS lower
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC) AS i FROM e WHERE l = 0 OR (l < 0 AND h > 0)) WHERE i = 1"""),
    ("m", """SELECT k, CAST(max(p) AS BIGINT) AS attack, CAST(max(n) AS BIGINT) AS normal, sum(neg * (tp - pos + pos / 2)) / nullif(max(p * n), 0) AS auroc, sum(pos / p * pr) AS average_precision,
  sum(pos / p * (pr + pr0) / 2) AS pr_area, coalesce(max(tpr) FILTER (WHERE fpr <= 0.01), 0) AS tpr_at_1pct, coalesce(max(tpr) FILTER (WHERE fpr <= 0.001), 0) AS tpr_at_01pct,
  coalesce(max(tpr) FILTER (WHERE fpr <= 0.0001), 0) AS tpr_at_001pct FROM e GROUP BY k"""),
    ("z", """SELECT m.*, near.v AS eer_nearest, cross_at.v AS eer, bracket.v AS eer_bracket, bracket.lower AS threshold_lower, bracket.upper AS threshold_upper
FROM m JOIN near USING (k) JOIN cross_at USING (k) JOIN bracket USING (k)"""),
)
CURVE = ["auroc", "average_precision", "pr_area", "eer_nearest", "eer", "eer_bracket", "threshold_lower", "threshold_upper", "tpr_at_1pct", "tpr_at_01pct", "tpr_at_001pct"]


@query("m1_confusion", ctes("tied", ("c", """
SELECT dataset, count(*) FILTER (WHERE score > 45 AND binary_label = 1) AS tp, count(*) FILTER (WHERE score > 45 AND binary_label = 0) AS fp,
  count(*) FILTER (WHERE score <= 45 AND binary_label = 0) AS tn, count(*) FILTER (WHERE score <= 45 AND binary_label = 1) AS fn FROM tied GROUP BY 1""")) + f"""
SELECT *, {grid_sql("fp / greatest(1, fp + tn)")} AS fpr, {grid_sql("tp / greatest(1, tp + fn)")} AS tpr FROM c""".replace("SELECT *,", "SELECT dataset, tp, fp, tn, fn,"))
def m1_confusion(spark, sf):
    return ops.confusion(tied_scores(spark, sf), 45.0, ["dataset"]).select("dataset", "tp", "fp", "tn", "fn", *grids("fpr", "tpr"))


@query("m2_roc_points", ctes("tied docs", *STEPS("tied", "dataset")) + f"""
SELECT k AS dataset, score AS threshold, {grids_sql("fpr", "tpr")} FROM r UNION ALL SELECT DISTINCT k, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM r""")
def m2_roc_points(spark, sf):
    return ops.roc(ops.score_steps(tied_scores(spark, sf), ["dataset"]), ["dataset"]).select("dataset", "threshold", *grids("fpr", "tpr"))


@query("m3_pr_points", ctes("docs", *STEPS("docs", "'all'")) + f"SELECT score AS threshold, {grid_sql('pr')} AS precision, {grid_sql('tpr')} AS recall FROM r")
def m3_pr_points(spark, sf):
    return ops.pr_curve(ops.score_steps(document_scores(spark, sf))).select("threshold", *grids("precision", "recall"))


def _curve(metrics, *keep):
    return metrics.select(*keep, "attack", "normal", *grids(*CURVE))


@query("m3_average_precision", ctes("docs", *STEPS("docs", "'all'")) + f"SELECT {grids_sql('average_precision', 'pr_area')} FROM m")
def m3_average_precision(spark, sf):
    return ops.curve_metrics(ops.score_steps(document_scores(spark, sf))).select(*grids("average_precision", "pr_area"))


@query("m4_auroc", ctes("tied", *STEPS("tied", "dataset")) + f"SELECT k AS dataset, attack, normal, {grid_sql('auroc')} AS auroc FROM m WHERE attack > 0 AND normal > 0")
def m4_auroc(spark, sf):
    out = ops.curve_metrics(ops.score_steps(tied_scores(spark, sf), ["dataset"]), ["dataset"])
    return out.where("auroc IS NOT NULL").select("dataset", "attack", "normal", grid("auroc").alias("auroc"))


_EER = ["eer_nearest", "eer", "eer_bracket", "threshold_lower", "threshold_upper"]


@query("m5_eer", ctes("docs", *STEPS("docs", "'all'")) + f"SELECT {grids_sql(*_EER)} FROM z")
def m5_eer(spark, sf):
    return ops.curve_metrics(ops.score_steps(document_scores(spark, sf))).select(*grids(*_EER))


@query("m6_tpr_at_fpr", ctes("docs", *STEPS("docs", "dataset")) + f"""
SELECT k AS dataset, {grids_sql("tpr_at_1pct", "tpr_at_01pct", "tpr_at_001pct")} FROM m WHERE attack > 0 AND normal > 0""")
def m6_tpr_at_fpr(spark, sf):
    out = ops.curve_metrics(ops.score_steps(document_scores(spark, sf), ["dataset"]), ["dataset"])
    return out.where("auroc IS NOT NULL").select("dataset", *grids("tpr_at_1pct", "tpr_at_01pct", "tpr_at_001pct"))


_BOTH = ("both_", "SELECT dataset, score, binary_label FROM docs UNION ALL SELECT 'pooled', score, binary_label FROM docs")


@query("m7_metrics_by_dataset", ctes("docs", _BOTH, *STEPS("both_", "dataset")) + f"SELECT k AS dataset, attack, normal, {grids_sql(*CURVE)} FROM z WHERE attack > 0 AND normal > 0")
def m7_metrics_by_dataset(spark, sf):
    return _curve(ops.metrics_by(document_scores(spark, sf), "dataset").where("auroc IS NOT NULL"), "dataset")


@query("m7_macro_mean", ctes("docs", _BOTH, *STEPS("both_", "dataset")) + f"""
SELECT count(*) AS groups, {", ".join(f"{grid_sql(f'avg({c})')} AS {c}" for c in CURVE[:3])} FROM z WHERE k <> 'pooled' AND attack > 0 AND normal > 0""")
def m7_macro_mean(spark, sf):
    out = ops.metrics_by(document_scores(spark, sf), "dataset").where("auroc IS NOT NULL")
    return ops.macro_mean(out, "dataset", CURVE[:3]).select("groups", *grids(*CURVE[:3]))


# Scored rows for reports: packets with a window, phase, service, mode and score.
def scored(spark, sf):
    rows = keys.window_coords(keys.directional_key(packets(spark, sf)), SHORT_WINDOW)
    attack = rows.where("binary_label = 1 AND capture_id = 'c1'").agg(F.struct(F.min("ts").alias("b"), F.max("ts").alias("e")))
    rows = rows.withColumn("_a", attack.scalar())
    mode = F.col("wire_length") % 12
    return rows.select(
        F.col("frame_number").alias("row_id"), "capture_id", "window_index", "endpoint_a_ip", "endpoint_b_ip", "protocol", "binary_label",
        keys.phase_overlap(F.col("window_start"), F.col("_a.b"), F.col("_a.e"), SHORT_WINDOW).alias("phase"),
        F.concat(F.lit("s"), F.col("dst_port").cast("string")).alias("service"), mode.alias("mode_id"),
        F.col("wire_length").cast("double").alias("score"), (F.col("src_port") - 1001).cast("double").alias("context"),
        (F.col("wire_length") > 1300).alias("flag"), F.col("window_index").alias("timestamp_second"),
        *[(F.col("wire_length") % (5 + i)).cast("long").alias(f"{p}_mode_count") for i, p in enumerate(("pair", "entity_a", "entity_b"))],
        *[((F.col("wire_length") % (9 + i)) / 4).alias(f"{p}_deviation") for i, p in enumerate(("pair", "entity_a", "entity_b"))],
    )


_SCORED = (("sp", "SELECT min(ts) AS b, max(ts) AS e FROM packets WHERE binary_label = 1 AND capture_id = 'c1'"), ("sc", f"""
SELECT frame_number AS row_id, capture_id, CAST(floor(ts / {SHORT_WINDOW}.0) AS BIGINT) AS window_index, src_ip AS endpoint_a_ip, dst_ip AS endpoint_b_ip, protocol, binary_label,
  CASE WHEN floor(ts / {SHORT_WINDOW}.0) * {SHORT_WINDOW}.0 + {SHORT_WINDOW}.0 <= b THEN 'pre_attack' WHEN floor(ts / {SHORT_WINDOW}.0) * {SHORT_WINDOW}.0 <= e THEN 'attack_window' ELSE 'post_attack' END AS phase,
  's' || dst_port AS service, wire_length % 12 AS mode_id, wire_length::DOUBLE AS score, (src_port - 1001)::DOUBLE AS context, wire_length > 1300 AS flag,
  CAST(floor(ts / {SHORT_WINDOW}.0) AS BIGINT) AS timestamp_second,
  {", ".join(f"wire_length % {5 + i} AS {p}_mode_count, (wire_length % {9 + i}) / 4 AS {p}_deviation" for i, p in enumerate(("pair", "entity_a", "entity_b")))}
FROM packets, sp"""))
_PARTS = ["score", "context", "pair_deviation"]
_UNPIVOT = ("both_", " UNION ALL ".join(f"SELECT '{c}' AS component, {c}::DOUBLE AS score, binary_label FROM sc" for c in _PARTS))


@query("m8_ablations", ctes("packets", *_SCORED, _UNPIVOT, *STEPS("both_", "component"), ("ca", "SELECT component, score, row_number() OVER (PARTITION BY component ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY component) AS n FROM both_ WHERE binary_label = 0"),
    ("th", "SELECT component, score AS threshold FROM ca WHERE i = ceil((n - 1) * (1.0::DOUBLE - 0.05::DOUBLE))"),
    ("cf", "SELECT component, threshold, count(*) FILTER (WHERE score > threshold AND binary_label = 1) AS tp, count(*) FILTER (WHERE score > threshold AND binary_label = 0) AS fp FROM both_ JOIN th USING (component) GROUP BY ALL")) + f"""
SELECT component, attack, normal, {grids_sql(*CURVE)}, {grid_sql("threshold")} AS threshold, cf.tp, cf.fp FROM z JOIN cf ON cf.component = z.k""")
def m8_ablations(spark, sf):
    rows = scored(spark, sf)
    limits = thresholds(rows.where("binary_label = 0"), _PARTS, 0.05)
    return _curve(ops.ablations(rows, _PARTS, limits), "component", grid("threshold").alias("threshold"), "tp", "fp")


@query("m9_score_resolution", ctes("packets", *_SCORED, _UNPIVOT) + """
SELECT component, count(*) AS unique_values, max(n) AS largest_tie FROM (SELECT component, score, count(*) AS n FROM both_ GROUP BY ALL) GROUP BY 1""")
def m9_score_resolution(spark, sf):
    return ops.resolution(scored(spark, sf), _PARTS)


_DIST = ["min", "q25", "median", "q75", "q95", "max", "mean"]
_DIST_SQL = lambda v: ", ".join(f"{grid_sql(e)} AS {n}" for n, e in zip(_DIST, (
    f"min({v})", f"quantile_cont({v}, 0.25)", f"quantile_cont({v}, 0.5)", f"quantile_cont({v}, 0.75)", f"quantile_cont({v}, 0.95)", f"max({v})", f"avg({v})")))


@query("m10_distribution", ctes("docs") + f"SELECT dataset, binary_label, count(score) AS n, {_DIST_SQL('score')} FROM docs GROUP BY ALL")
def m10_distribution(spark, sf):
    return ops.distribution(document_scores(spark, sf), ["dataset", "binary_label"], "score").select("dataset", "binary_label", "n", *grids(*_DIST))


_MODES = list(range(12))


def _m11_sql():
    cell = lambda scope, cond, prefix: " UNION ALL ".join(
        f"SELECT capture_id, window_index, mode_id, '{scope}' AS scope, '{m}' AS measure, {prefix}_{m}::DOUBLE AS v FROM sc WHERE {cond}" for m in ("mode_count", "deviation"))
    s, t = "10.0.0.1", "10.0.0.2"
    parts = [cell("pair", f"least(endpoint_a_ip, endpoint_b_ip) = '{s}' AND greatest(endpoint_a_ip, endpoint_b_ip) = '{t}'", "pair")]
    for scope, ip in (("source", s), ("target", t)):
        parts += [cell(scope, f"endpoint_a_ip = '{ip}'", "entity_a"), cell(scope, f"endpoint_b_ip = '{ip}'", "entity_b")]
    return ctes("packets", *_SCORED, ("cl", " UNION ALL ".join(parts)),
        ("bs", "SELECT capture_id, window_index, mode_id, scope, measure, max(v) AS v FROM cl GROUP BY ALL"),
        ("ph", "SELECT capture_id, window_index, arg_min(phase, row_id) AS phase FROM sc GROUP BY ALL"),
        ("gr", "SELECT ph.*, mode_id, scope, measure FROM ph, (SELECT unnest(range(12)) AS mode_id), (SELECT unnest(['pair', 'source', 'target']) AS scope), (SELECT unnest(['mode_count', 'deviation']) AS measure)"),
        ("de", "SELECT phase, mode_id, scope, measure, coalesce(v, 0) AS v FROM gr LEFT JOIN bs USING (capture_id, window_index, mode_id, scope, measure)")) + f"""
SELECT CAST(mode_id AS BIGINT) AS mode_id, phase, scope, measure, count(*) AS windows, {_DIST_SQL("v")}, {grid_sql("sum(v)")} AS sum, count(*) FILTER (WHERE v <> 0) AS nonzero_windows FROM de GROUP BY ALL"""


@query("m11_mode_phase_profiles", _m11_sql())
def m11_mode_phase_profiles(spark, sf):
    out = ops.mode_phase_profiles(scored(spark, sf), "10.0.0.1", "10.0.0.2", _MODES)
    return out.select(F.col("mode_id").cast("long").alias("mode_id"), "phase", "scope", "measure", "windows", *grids(*_DIST, "sum"), "nonzero_windows")


@query("m12_false_positives", ctes("packets", *_SCORED) + f"""
SELECT service, phase, CAST(grouping(service) * 2 + grouping(phase) AS BIGINT) AS level, count(*) AS normal_flows, count(*) FILTER (WHERE flag) AS false_positives,
  {grid_sql("count(*) FILTER (WHERE flag) / count(*)")} AS false_positive_rate FROM sc WHERE binary_label = 0 GROUP BY CUBE (service, phase)""")
def m12_false_positives(spark, sf):
    out = ops.fp_by(scored(spark, sf), "service", "phase")
    return out.select("service", "phase", F.col("level").cast("long").alias("level"), "normal_flows", "false_positives", grid("false_positive_rate").alias("false_positive_rate"))


@query("m13_top_modes", ctes("packets", *_SCORED) + f"""
SELECT CAST(mode_id AS BIGINT) AS mode_id, count(*) AS flows, {grid_sql("count(*) / (SELECT count(*) FROM sc WHERE binary_label = 1)")} AS fraction
FROM sc WHERE binary_label = 1 GROUP BY mode_id ORDER BY count(*) DESC, mode_id LIMIT 8""")
def m13_top_modes(spark, sf):
    return ops.top_modes(scored(spark, sf)).select(F.col("mode_id").cast("long").alias("mode_id"), "flows", grid("fraction").alias("fraction"))


_H = ["attacks", "sparse_like", "sparse_like_with_context", "phase_normals", "phase_normals_without_context", "phase_normals_flagged"]


@query("m14_hypothesis_checks", ctes("packets", *_SCORED, ("q", "SELECT quantile_cont(score, 0.95) AS q FROM sc WHERE binary_label = 0"), ("c", """
SELECT max(q) AS normal_q95, count(*) FILTER (WHERE binary_label = 1) AS attacks, count(*) FILTER (WHERE binary_label = 1 AND score <= q) AS sparse_like,
  count(*) FILTER (WHERE binary_label = 1 AND score <= q AND context > 0) AS sparse_like_with_context, count(*) FILTER (WHERE binary_label = 0 AND phase = 'attack_window') AS phase_normals,
  count(*) FILTER (WHERE binary_label = 0 AND phase = 'attack_window' AND context <= 0) AS phase_normals_without_context,
  count(*) FILTER (WHERE binary_label = 0 AND phase = 'attack_window' AND flag) AS phase_normals_flagged FROM sc, q""")) + f"""
SELECT {", ".join(_H)}, {grid_sql("normal_q95")} AS normal_q95, {grid_sql("sparse_like / attacks")} AS fraction_sparse_like,
  {grid_sql("sparse_like_with_context / sparse_like")} AS fraction_with_context FROM c""")
def m14_hypothesis_checks(spark, sf):
    out = ops.hypothesis_checks(scored(spark, sf), "score", "context", "flag")
    return out.select(*_H, *grids("normal_q95", "fraction_sparse_like", "fraction_with_context"))


@query("m15_attention_summary", ctes("packets", *_SCORED, ("u", " UNION ALL ".join(f"SELECT binary_label, phase, '{c}' AS field, {c}::DOUBLE AS v FROM sc" for c in _PARTS))) + f"""
SELECT CAST(binary_label AS BIGINT) AS binary_label, phase, field, count(*) AS n, {grid_sql("avg(v)")} AS mean, {grid_sql("median(v)")} AS median,
  {grid_sql("quantile_cont(v, 0.95)")} AS q95, {grid_sql("max(v)")} AS max FROM u GROUP BY ALL""")
def m15_attention_summary(spark, sf):
    out = ops.attention_summary(scored(spark, sf), ["binary_label", "phase"], _PARTS)
    return out.select(F.col("binary_label").cast("long").alias("binary_label"), "phase", "field", "n", *grids("mean", "median", "q95", "max"))


@query("m16_error_rows", ctes("packets", *_SCORED) + """
SELECT row_id, CASE WHEN binary_label = 0 THEN 'FP' ELSE 'FN' END AS error FROM sc WHERE (binary_label = 0 AND score >= 1200) OR (binary_label = 1 AND score < 1200)""")
def m16_error_rows(spark, sf):
    return ops.error_rows(scored(spark, sf), 1200.0).select("row_id", "error")


@query("m16_representatives", ctes("packets", *_SCORED, ("k", """
SELECT row_id, CAST(binary_label AS BIGINT) AS binary_label, row_number() OVER (PARTITION BY binary_label ORDER BY CASE WHEN binary_label = 0 THEN -score ELSE score END, row_id) AS place FROM sc""")) + """
SELECT row_id, binary_label, place FROM k WHERE place <= 8""")
def m16_representatives(spark, sf):
    out = ops.representatives(scored(spark, sf))
    return out.select("row_id", F.col("binary_label").cast("long").alias("binary_label"), F.col("place").cast("long").alias("place"))


_FOCUS = ("fo", "SELECT *, CASE phase WHEN 'pre_attack' THEN 'before' WHEN 'attack_window' THEN 'attack' ELSE 'after' END AS ph FROM sc")
_Q99 = ("q", "SELECT quantile_cont(score, 0.75) AS q FROM sc WHERE binary_label = 0")


def _focus(spark, sf):
    rows = scored(spark, sf)
    reference = exact_quantiles(rows.where("binary_label = 0"), [], "score", {"q": 0.75}).scalar()
    phase = F.when(F.col("phase") == "pre_attack", "before").when(F.col("phase") == "attack_window", "attack").otherwise("after")
    return rows.withColumn("phase", phase), reference


@query("m17_focus_summary", ctes("packets", *_SCORED, _FOCUS, _Q99) + f"""
SELECT protocol, ph AS phase, count(*) AS flows, {grid_sql("avg(CASE WHEN score > q THEN 100.0 ELSE 0 END)")} AS above_p99_percent, {grid_sql("median(score)")} AS median,
  {grid_sql("quantile_cont(score, 0.95)")} AS p95 FROM fo, q WHERE binary_label = 0 AND ph IN ('before', 'attack') GROUP BY protocol, ph""")
def m17_focus_summary(spark, sf):
    rows, reference = _focus(spark, sf)
    return ops.focus_summary(rows, "score", reference, ["protocol"]).select("protocol", "phase", "flows", *grids("above_p99_percent", "median", "p95"))


@query("m17_sparse_seconds", ctes("packets", *_SCORED, _FOCUS, _Q99, ("sd", """
SELECT protocol, timestamp_second, count(*) AS n, median(score) AS m FROM fo WHERE binary_label = 1 GROUP BY ALL""")) + f"""
SELECT protocol, count(*) AS attack_seconds, count(*) FILTER (WHERE m > q) AS attack_seconds_above, count(*) FILTER (WHERE n <= 16) AS sparse_seconds,
  count(*) FILTER (WHERE n <= 16 AND m > q) AS sparse_seconds_above, {grid_sql("min(m)")} AS minimum_second_median FROM sd, q GROUP BY protocol""")
def m17_sparse_seconds(spark, sf):
    rows, reference = _focus(spark, sf)
    out = ops.sparse_seconds(rows, "score", reference, by=["protocol"])
    return out.withColumn("minimum_second_median", grid("minimum_second_median"))


@query("m18_changed_by_renaming", ctes("packets") + "SELECT capture_id, 0::BIGINT AS t, 'x' AS side FROM packets WHERE false")
def m18_changed_by_renaming(spark, sf):
    operator = lambda f: activity.activity(f.withColumn("behaviour", F.col("regime")))
    changed = ops.id_permutation_check(host_flows(spark, sf), operator, ["src_ip", "dst_ip"], [
        "capture_id", "direction", "timestamp_second", "behaviour", "flows", "packets", "bytes"])
    return changed.select("capture_id", F.col("timestamp_second").alias("t"), "side")


@query("m18_mass_conservation", ctes("sflows") + f"""
SELECT capture_id, 2 * count(*) AS flow_mass, CAST(2 * sum(packet_count) AS BIGINT) AS packet_mass, CAST(2 * sum(byte_count) AS BIGINT) AS byte_mass FROM sflows GROUP BY 1""")
def m18_mass_conservation(spark, sf):
    cells = activity.activity(host_flows(spark, sf).withColumn("behaviour", F.col("regime")))
    return cells.groupBy("capture_id").agg(
        F.sum("flows").cast("long").alias("flow_mass"), F.sum("packets").cast("long").alias("packet_mass"), F.sum("bytes").cast("long").alias("byte_mass"))


@query("m19_run_summary", ctes("packets", *_SCORED, ("both_", " UNION ALL ".join(f"SELECT protocol || '~{c}' AS component, {c}::DOUBLE AS score, binary_label FROM sc" for c in _PARTS)),
    *STEPS("both_", "component"), ("t", "SELECT split_part(k, '~', 1) AS dataset, " + ", ".join(f"max(CASE WHEN split_part(k, '~', 2) = '{c}' THEN auroc END) AS {c}" for c in _PARTS) + " FROM m GROUP BY 1")) + f"""
SELECT dataset, {grids_sql(*_PARTS)} FROM t UNION ALL SELECT 'macro', {", ".join(grid_sql(f"avg({c})") for c in _PARTS)} FROM t""")
def m19_run_summary(spark, sf):
    long = ops.unpivot(scored(spark, sf), ["protocol", "binary_label"], _PARTS, value="score")
    runs = ops.curve_metrics(ops.score_steps(long, ["protocol", "component"]), ["protocol", "component"])
    out = ops.summarise_runs(runs.withColumnRenamed("protocol", "dataset"), "dataset", "component", "auroc", _PARTS)
    return out.select("dataset", *grids(*_PARTS))


@query("j12_method_comparison", ctes("packets", *_SCORED, ("both_", " UNION ALL ".join(f"SELECT phase || '~{c}' AS component, {c}::DOUBLE AS score, binary_label FROM sc" for c in _PARTS[:2])),
    *STEPS("both_", "component"), ("t", "SELECT split_part(k, '~', 1) AS phase, " + ", ".join(f"max(CASE WHEN split_part(k, '~', 2) = '{c}' THEN {m} END) AS {m}_{s}" for s, c in (("a", "score"), ("b", "context")) for m in ("auroc", "average_precision")) + " FROM m GROUP BY 1"),
    ("d", "SELECT *, auroc_a - auroc_b AS auroc_delta, average_precision_a - average_precision_b AS average_precision_delta FROM t")) + f"""
SELECT phase, {grids_sql("auroc_a", "auroc_b", "auroc_delta", "average_precision_delta")} FROM d
UNION ALL SELECT 'macro', {", ".join(grid_sql(f"avg({c})") for c in ("auroc_a", "auroc_b", "auroc_delta", "average_precision_delta"))} FROM d""")
def j12_method_comparison(spark, sf):
    rows = scored(spark, sf)
    method = lambda c: ops.curve_metrics(ops.score_steps(rows, ["phase"], c), ["phase"])
    deltas, macro = ops.compare_methods(method("score"), method("context"), "phase", ["auroc", "average_precision"])
    return deltas.unionByName(macro.withColumn("phase", F.lit("macro"))).select("phase", *grids("auroc_a", "auroc_b", "auroc_delta", "average_precision_delta"))
