"""Tie-aware detection metrics and report tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewatch.functions.keys import pair_key
from tidewatch.operators.calibration import unpivot
from tidewatch.operators.ordered import exact_quantiles, previous_row, running_sums

POOLED = "pooled"


def confusion(df: DataFrame, threshold: Column | float, by: Sequence[str] = (), score: str = "score", label: str = "binary_label") -> DataFrame:
    """tp, fp, tn, fn with their rates; a flag needs a score strictly above the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flag, attack = F.col(score) > limit, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(flag & attack).alias("tp"), F.count_if(flag & ~attack).alias("fp"),
        F.count_if(~flag & ~attack).alias("tn"), F.count_if(~flag & attack).alias("fn"))
    return counts.withColumns({
        "fpr": F.col("fp") / F.greatest(F.lit(1), F.col("fp") + F.col("tn")),
        "tpr": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")),
    })


def score_steps(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "binary_label", pooled: str | None = None) -> DataFrame:
    """One row per distinct score: attacks and normals at it, above it, and in total.

    All curve metrics are sums or picks over these rows. With `pooled`, the named
    column is also aggregated away in the same pass.
    """
    by = list(by)
    attack = F.count_if(F.col(label) == 1).alias("pos")
    normal = F.count_if(F.col(label) == 0).alias("neg")
    if pooled is None:
        counts = df.groupBy(*by, score).agg(attack, normal)
    else:
        rest = [F.col(c) for c in by if c != pooled] + [F.col(score)]
        counts = df.groupingSets([[F.col(pooled), *rest], rest], F.col(pooled), *rest).agg(F.grouping(pooled).alias("_all"), attack, normal)
        counts = counts.withColumn(pooled, F.when(F.col("_all") == 1, POOLED).otherwise(F.col(pooled))).drop("_all")
    counts = counts.withColumnRenamed(score, "threshold")
    steps = running_sums(counts, by, [F.desc("threshold")], {"pos_above": F.col("pos"), "neg_above": F.col("neg")})
    totals = [F.sum("pos").alias("pos_total"), F.sum("neg").alias("neg_total")]
    if by:
        return steps.join(counts.groupBy(*by).agg(*totals), by)
    return steps.withColumn("_t", counts.agg(F.struct(*totals)).scalar()).select("*", "_t.*").drop("_t")


def _rate(count: Column, size: Column) -> Column:
    return F.try_divide(count, size)


def _points(steps: DataFrame) -> DataFrame:
    pos, neg = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return steps.withColumns({
        "tpr": _rate(pos, F.col("pos_total")), "fpr": _rate(neg, F.col("neg_total")),
        "tpr_above": _rate(F.col("pos_above"), F.col("pos_total")), "fpr_above": _rate(F.col("neg_above"), F.col("neg_total")),
        "precision": pos / (pos + neg),
        "precision_above": F.coalesce(F.try_divide(F.col("pos_above"), F.col("pos_above") + F.col("neg_above")), F.lit(1.0)),
    })


def roc(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC points, ties as one step, starting at (0, 0) with an infinite threshold."""
    points = _points(steps).select(*by, "threshold", "fpr", "tpr")
    start = steps.select(*by).distinct() if by else steps.limit(1).select()
    start = start.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_curve(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _points(steps).select(*by, "threshold", "precision", F.col("tpr").alias("recall"))


def curve_metrics(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUROC, average precision, trapezoid PR area, EER in three readings, TPR at low FPR.

    Null where a group has only one class.
    """
    by = list(by)
    rows = _points(previous_row(steps, by, ["threshold"], ["threshold"], "_lower"))
    gained = _rate(F.col("pos"), F.col("pos_total"))
    area = _rate(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2), F.col("pos_total") * F.col("neg_total"))
    miss = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    left = F.col("fpr_above") - (1 - F.col("tpr_above"))
    right = F.col("fpr") - (1 - F.col("tpr"))
    first = lambda value, cond: F.min_by(value, F.when(cond, -F.col("threshold")))
    crossing = F.when(right == 0, F.col("fpr")).otherwise(
        F.col("fpr_above") + F.try_divide(-left, right - left) * (F.col("fpr") - F.col("fpr_above")))
    bracket_value = F.when(left == 0, F.col("fpr_above")).otherwise(
        F.col("fpr_above") + F.try_divide(-left, right - left) * (F.col("fpr") - F.col("fpr_above")))
    bracket = F.struct(
        bracket_value.alias("value"), F.col("threshold").alias("upper"),
        F.when(left == 0, F.col("threshold")).otherwise(F.coalesce("_lower.threshold", F.lit(float("-inf")))).alias("lower"))
    low = lambda limit: F.coalesce(F.max(F.when(F.col("fpr") <= limit, F.col("tpr"))), F.lit(0.0))
    out = rows.groupBy(*by).agg(
        F.sum("pos").alias("attack"), F.sum("neg").alias("normal"), F.sum(area).alias("auroc"),
        F.sum(gained * F.col("precision")).alias("average_precision"),
        F.sum(gained * (F.col("precision") + F.col("precision_above")) / 2).alias("pr_area"),
        F.min_by(F.struct(((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("v"), miss.alias("d")), F.struct(miss, -F.col("threshold"))).alias("_near"),
        first(crossing, right >= 0).alias("eer"),
        first(bracket, (left == 0) | ((left < 0) & (right > 0))).alias("_bracket"),
        low(0.01).alias("tpr_at_1pct"), low(0.001).alias("tpr_at_01pct"), low(0.0001).alias("tpr_at_001pct"),
    )
    both = (F.col("attack") > 0) & (F.col("normal") > 0)
    # The start point (0, 0) has distance one and value one half.
    nearest = F.when(F.col("_near.d") >= 1.0, 0.5).otherwise(F.col("_near.v"))
    only = lambda c: F.when(both, c)
    return out.select(
        *by, "attack", "normal", only(F.col("auroc")).alias("auroc"), only(F.col("average_precision")).alias("average_precision"),
        only(F.col("pr_area")).alias("pr_area"), only(nearest).alias("eer_nearest"), only(F.col("eer")).alias("eer"),
        only(F.col("_bracket.value")).alias("eer_bracket"), only(F.col("_bracket.lower")).alias("threshold_lower"),
        only(F.col("_bracket.upper")).alias("threshold_upper"),
        *[only(F.col(c)).alias(c) for c in ("tpr_at_1pct", "tpr_at_01pct", "tpr_at_001pct")],
    )


def metrics_by(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Curve metrics per group and pooled over all of them."""
    return curve_metrics(score_steps(df, [group], score, pooled=group), [group])


def macro_mean(metrics: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return metrics.where(F.col(group) != POOLED).agg(F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in columns])


def ablations(df: DataFrame, components: Sequence[str], thresholds: DataFrame, label: str = "binary_label") -> DataFrame:
    """Curve metrics and confusion of every component at its own threshold."""
    long = unpivot(df, [label], components, value="score")
    curves = curve_metrics(score_steps(long, ["component"]), ["component"])
    flagged = confusion(long.join(thresholds, "component"), F.col("threshold"), ["component", "threshold"])
    return curves.join(flagged, "component")


def resolution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values and the largest tie of each score."""
    ties = unpivot(df, [], columns).groupBy("component", "value").agg(F.count(F.lit(1)).alias("n"))
    return ties.groupBy("component").agg(F.count(F.lit(1)).alias("unique_values"), F.max("n").alias("largest_tie"))


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, min, quartiles, q95, max and mean per group."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    q = exact_quantiles(df, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95})
    return base.join(q, list(by), "left")


def mode_phase_profiles(rows: DataFrame, source: str, target: str, modes: Sequence[int]) -> DataFrame:
    """Distribution over all windows of a phase of each scope's per-window maximum, silent windows as zero.

    rows: capture_id, window_index, phase, mode_id, endpoint_a_ip, endpoint_b_ip and
    {pair, entity_a, entity_b}_{mode_count, deviation}.
    """
    window = ["capture_id", "window_index"]
    wanted = rows.where(F.col("mode_id").isin(list(modes)))
    a, b = F.col("endpoint_a_ip"), F.col("endpoint_b_ip")
    between = pair_key(a, b) == F.array(*[F.lit(x) for x in sorted([source, target])])
    def cells(scope, when, prefix):
        return F.when(when, F.array(*[
            F.struct(F.lit(scope).alias("scope"), F.lit(m).alias("measure"), F.col(f"{prefix}_{m}").cast("double").alias("value"))
            for m in ("mode_count", "deviation")]))
    parts = [cells("pair", between, "pair")]
    for name, ip in (("source", source), ("target", target)):
        parts += [cells(name, a == ip, "entity_a"), cells(name, b == ip, "entity_b")]
    empty = F.array().cast("array<struct<scope: string, measure: string, value: double>>")
    long = wanted.select(*window, "mode_id", F.inline(F.concat(*[F.coalesce(p, empty) for p in parts])))
    best = long.groupBy(*window, "mode_id", "scope", "measure").agg(F.max("value").alias("value"))
    phases = rows.groupBy(*window).agg(F.min_by("phase", "row_id").alias("phase"))
    axes = F.array(*[
        F.struct(F.lit(int(m)).alias("mode_id"), F.lit(s).alias("scope"), F.lit(k).alias("measure"))
        for m in modes for s in ("pair", "source", "target") for k in ("mode_count", "deviation")])
    grid = phases.select(*window, "phase", F.inline(axes))
    dense = grid.join(best, [*window, "mode_id", "scope", "measure"], "left").fillna(0.0, ["value"])
    key = ["mode_id", "phase", "scope", "measure"]
    extra = dense.groupBy(*key).agg(F.sum("value").alias("sum"), F.count_if(F.col("value") != 0).alias("nonzero_windows"))
    return distribution(dense, key, "value").withColumnRenamed("n", "windows").join(extra, key)


def fp_by(rows: DataFrame, first: str, second: str, flag: str = "flag", label: str = "binary_label") -> DataFrame:
    """False positives and their rate by each column, by both and overall, in one pass."""
    normal = rows.where(F.col(label) == 0)
    counts = normal.cube(first, second).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("normal_flows"), F.count_if(F.col(flag)).alias("false_positives"))
    return counts.withColumn("false_positive_rate", F.col("false_positives") / F.col("normal_flows"))


def top_modes(rows: DataFrame, k: int = 8, label: str = "binary_label") -> DataFrame:
    """The k most frequent modes among attacks and their share of all attacks."""
    attacks = rows.where(F.col(label) == 1)
    counts = attacks.groupBy("mode_id").agg(F.count(F.lit(1)).alias("flows"))
    whole = attacks.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("fraction", F.col("flows") / whole).orderBy(F.desc("flows"), "mode_id").limit(k)


def hypothesis_checks(rows: DataFrame, score: str, context: str, flag: str, label: str = "binary_label") -> DataFrame:
    """Attacks at or below the normal q95 that context still sees; normals of the attack phase without context."""
    q95 = exact_quantiles(rows.where(F.col(label) == 0), [], score, {"q95": 0.95})
    marked = rows.withColumn("_q95", q95.scalar())
    attack = F.col(label) == 1
    sparse = attack & (F.col(score) <= F.col("_q95"))
    calm = ~attack & (F.col("phase") == "attack_window")
    return marked.agg(
        F.max("_q95").alias("normal_q95"), F.count_if(attack).alias("attacks"), F.count_if(sparse).alias("sparse_like"),
        F.count_if(sparse & (F.col(context) > 0)).alias("sparse_like_with_context"), F.count_if(calm).alias("phase_normals"),
        F.count_if(calm & (F.col(context) <= 0)).alias("phase_normals_without_context"), F.count_if(calm & F.col(flag)).alias("phase_normals_flagged"),
    ).withColumns({
        "fraction_sparse_like": F.try_divide(F.col("sparse_like"), F.col("attacks")),
        "fraction_with_context": F.try_divide(F.col("sparse_like_with_context"), F.col("sparse_like")),
    })


def attention_summary(rows: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """n, mean, median, q95 and max of every field per group."""
    long = unpivot(rows, by, fields, name="field")
    return distribution(long, [*by, "field"], "value").select(*by, "field", "n", "mean", "median", "q95", "max")


def error_rows(rows: DataFrame, threshold: Column | float, score: str = "score", label: str = "binary_label") -> DataFrame:
    """False positives (score >= threshold) and false negatives."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    fp, fn = (F.col(label) == 0) & (F.col(score) >= limit), (F.col(label) == 1) & (F.col(score) < limit)
    return rows.where(fp | fn).withColumn("error", F.when(F.col(label) == 0, "FP").otherwise("FN"))


def representatives(rows: DataFrame, k: int = 8, score: str = "score", label: str = "binary_label", tie: str = "row_id") -> DataFrame:
    """The k highest normals and the k lowest attacks; the limit is applied before the shuffle."""
    key = F.when(F.col(label) == 0, -F.col(score)).otherwise(F.col(score))
    ranked = rows.withColumn("_key", key).withColumn(
        "place", F.row_number().over(Window.partitionBy(label).orderBy("_key", tie)))
    return ranked.where(F.col("place") <= k).drop("_key")


def focus_summary(rows: DataFrame, score: str, reference_q99: Column, by: Sequence[str] = ()) -> DataFrame:
    """Normal rows before and during the focus: median, p95 and share above the normal p99."""
    normal = rows.where((F.col("binary_label") == 0) & F.col("phase").isin("before", "attack"))
    key = [*by, "phase"]
    base = normal.groupBy(*key).agg(F.count(F.lit(1)).alias("flows"), F.avg(F.when(F.col(score) > reference_q99, 100.0).otherwise(0.0)).alias("above_p99_percent"))
    return base.join(exact_quantiles(normal, key, score, {"median": 0.5, "p95": 0.95}), key)


def sparse_seconds(rows: DataFrame, score: str, reference_q99: Column, most: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """Attack seconds, how many are sparse, and how many of each have a median above the normal p99."""
    attacks = rows.where("binary_label = 1")
    key = [*by, "timestamp_second"]
    seconds = attacks.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(
        exact_quantiles(attacks, key, score, {"median": 0.5}), key).withColumn("_q99", reference_q99)
    high, sparse = F.col("median") > F.col("_q99"), F.col("n") <= most
    return seconds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attack_seconds"), F.count_if(high).alias("attack_seconds_above"), F.count_if(sparse).alias("sparse_seconds"),
        F.count_if(sparse & high).alias("sparse_seconds_above"), F.min("median").alias("minimum_second_median"))


def compare_methods(a: DataFrame, b: DataFrame, key: str, measures: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per-dataset deltas a - b and their macro means."""
    right = b.select(key, *[F.col(m).alias(f"{m}_b") for m in measures])
    joined = a.select(key, *[F.col(m).alias(f"{m}_a") for m in measures]).join(right, key)
    deltas = joined.withColumns({f"{m}_delta": F.col(f"{m}_a") - F.col(f"{m}_b") for m in measures})
    return deltas, deltas.agg(*[F.avg(c).alias(c) for c in deltas.columns if c != key])


def summarise_runs(runs: DataFrame, key: str, branch: str, measure: str, branches: Sequence[str]) -> DataFrame:
    """One row per dataset, one column per branch, with the macro mean in the last row."""
    wide = runs.groupBy(key).pivot(branch, list(branches)).agg(F.first(measure))
    macro = wide.agg(F.lit("macro").alias(key), *[F.avg(b).alias(b) for b in branches])
    return wide.unionByName(macro)


def id_permutation_check(flows: DataFrame, operator, ids: Sequence[str], shown: Sequence[str]) -> DataFrame:
    """Rows that change when node names are replaced one-to-one; empty for an id-free operator."""
    renamed = flows.withColumns({c: F.sha1(F.concat(F.lit("node|"), F.col(c)).cast("binary")) for c in ids})
    before, after = operator(flows).select(*shown), operator(renamed).select(*shown)
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(
        after.exceptAll(before).withColumn("side", F.lit("after")))
