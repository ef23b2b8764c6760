"""Scalers, empirical ranks, thresholds, fusion, prototypes and mixtures."""
from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.vectors import bind, log_sum_exp, norm, smooth_max, squared_distance, total
from tidewatch.operators.ordered import exact_quantiles, row_positions, running_sums, same_keys
from tidewatch.session import bounded_rows


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "component", value: str = "value") -> DataFrame:
    """One row per row and column; the set of columns is fixed by the caller."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells))


# Scalers -----------------------------------------------------------------

def fit_standard(df: DataFrame, columns: Sequence[str], log_columns: Sequence[str] = ()) -> DataFrame:
    """component, mean, scale; log1p for the log columns; a scale below 1e-6 becomes 1."""
    ready = df.withColumns({c: F.log1p(F.greatest(F.lit(0.0), F.col(c).cast("double"))) for c in log_columns})
    std = F.stddev_pop("value")
    return unpivot(ready, [], columns).groupBy("component").agg(
        F.avg("value").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("scale"))


def fit_standard_vector(df: DataFrame, vector: str, log_dimensions: int = 0) -> DataFrame:
    """dim, mean, scale of an array column; counts in the first dimensions are log-scaled."""
    long = df.select(F.posexplode(vector).alias("dim", "value"))
    value = F.when(F.col("dim") < log_dimensions, F.log1p(F.greatest(F.lit(0.0), F.col("value")))).otherwise(F.col("value"))
    std = F.stddev_pop(value)
    return long.groupBy("dim").agg(F.avg(value).alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("scale"))


def fit_robust(df: DataFrame, columns: Sequence[str], floor: float = 0.0, log: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """component, center, scale: median and interquartile range; zero range becomes 1, then the floor."""
    long = unpivot(df, by, columns)
    long = long.withColumn("value", F.log1p("value")) if log else long
    q = exact_quantiles(long, [*by, "component"], "value", {"q25": 0.25, "center": 0.5, "q75": 0.75}, few_groups=not by)
    spread = F.col("q75") - F.col("q25")
    usable = F.when(spread < 10 * 2.220446049250313e-16, 1.0).otherwise(spread)
    return q.select(*by, "component", "center", F.greatest(F.lit(float(floor)), usable).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str], center: str = "center", log: bool = True) -> DataFrame:
    """(x - center) / scale per column; the scaler has one row per column."""
    rows = {r["component"]: r for r in bounded_rows(scaler, 10_000)}
    value = lambda c: F.log1p(F.col(c).cast("double")) if log else F.col(c).cast("double")
    return df.withColumns({f"z_{c}": (value(c) - F.lit(rows[c][center])) / F.lit(rows[c]["scale"]) for c in columns})


def fit_quantile(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    """component, low, high; a degenerate width is opened a little."""
    q = exact_quantiles(unpivot(df, [], columns), ["component"], "value", {"low": low, "high": high}, few_groups=True)
    opened = F.col("low") + F.greatest(F.abs("low") * 1e-6, F.lit(1e-6))
    return q.withColumn("high", F.when(F.col("high") - F.col("low") < 1e-12, opened).otherwise(F.col("high")))


def quantile_scaled(value: Column, low: Column, high: Column) -> Column:
    """Clipped below at zero, never above."""
    return F.greatest(F.lit(0.0), (value - low) / (high - low))


def fit_affine(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return exact_quantiles(unpivot(df, [], columns), ["component"], "value", {"q50": 0.5, "q95": 0.95, "q99": 0.99}, few_groups=True)


def affine_scaled(value: Column, q50: Column, q95: Column) -> Column:
    return (value - q50) / F.greatest(q95 - q50, F.lit(1e-6))


# Empirical ranks -----------------------------------------------------------

def rank_against(calibration: DataFrame, rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """For each row: calibration values below it, equal to it, and in total.

    Both sides are first reduced to distinct values, merged and summed along the
    value order, so equal scores never travel together. Null calibration values do not
    count. Every row stays: one with a null value has null ranks, one whose group has no
    calibration has a total of zero.
    """
    by = list(by)
    calibration = calibration.where(F.col(value).isNotNull())
    known = calibration.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cal"))
    asked = rows.where(F.col(value).isNotNull()).select(*by, value).distinct().withColumn("_cal", F.lit(0).cast("long"))
    merged = known.unionByName(asked).groupBy(*by, value).agg(F.sum("_cal").alias("cal_equal"))
    ranked = running_sums(merged, by, [value], {"cal_below": F.col("cal_equal")})
    out = same_keys(rows, ranked, [*by, value])
    if by:
        out = same_keys(out, calibration.groupBy(*by).agg(F.count(F.lit(1)).alias("cal_total")), by)
        return out.withColumn("cal_total", F.coalesce("cal_total", F.lit(0).cast("long")))
    return out.withColumn("cal_total", calibration.agg(F.count(F.lit(1))).scalar())


def tail_probability() -> Column:
    """(# >= x + 1) / (n + 1) after `rank_against`."""
    return (F.col("cal_total") - F.col("cal_below") + 1) / (F.col("cal_total") + 1)


def tail_evidence(calibration: DataFrame, rows: DataFrame, value: str, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    ranked = rank_against(calibration, rows, value, by)
    return ranked.withColumns({"tail_p": tail_probability(), "evidence": -F.log(tail_probability() + F.lit(epsilon))}).drop(
        "cal_below", "cal_equal", "cal_total")


def ecdf(calibration: DataFrame, rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Right-sided #<=x / (n + 1); 0 without calibration, null for a null value."""
    ranked = rank_against(calibration, rows, value, by)
    return ranked.withColumn("cdf", (F.col("cal_below") + F.col("cal_equal")) / (F.col("cal_total") + 1)).drop(
        "cal_below", "cal_equal", "cal_total")


def thresholds(calibration: DataFrame, columns: Sequence[str], fpr: float) -> DataFrame:
    """component, threshold: the order statistic at or above quantile 1 - fpr."""
    return exact_quantiles(unpivot(calibration, [], columns), ["component"], "value", {"threshold": 1.0 - fpr}, method="higher", few_groups=True)


def joint_evidence(calibration: DataFrame, rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Sum of evidences and its benign percentile 1 - exp(-tail evidence)."""
    joined = lambda df: df.withColumn("joint", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    out = tail_evidence(joined(calibration).select("joint"), joined(rows), "joint")
    return out.withColumn("percentile", 1 - F.exp(-F.col("evidence"))).drop("tail_p", "evidence")


# Fusion --------------------------------------------------------------------

def fuse(values: Sequence[Column], kind: str, weights: Sequence[float] | None = None, temperature: float = 1.0) -> Column:
    if kind == "weighted":
        size = sum(weights)
        if size <= 0:
            raise ValueError("weights must have a positive total")
        parts = [v * F.lit(w / size) for v, w in zip(values, weights, strict=True)]
        return sum(parts[1:], parts[0])
    if kind in ("max", "tail_max"):
        return F.greatest(*values)
    if kind == "sum":
        return sum(values[1:], values[0])
    if kind == "lse":
        return smooth_max(values, temperature)
    raise ValueError(f"unknown fusion {kind!r}")


def local_score(distance: Column, error: Column, kind: str = "reconstruction_prototype", weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    """From scaled prototype distance and scaled error, or the error alone."""
    if kind == "reconstruction_only":
        return error
    if kind != "reconstruction_prototype":
        raise ValueError(f"unknown local score {kind!r}")
    return fuse([distance, error], "weighted", weights)


# Prototypes ------------------------------------------------------------------

MOST_PROTOTYPES = 1_024  # a model, not data: bounded by the requested count


def fit_prototypes(
    rows: DataFrame, vector: str, count: int, seed: int = 42, max_iter: int = 20, most: int = MOST_PROTOTYPES
) -> list[list[float]]:
    """Centers of a distributed k-means; with fewer rows than `count`, as many as rows. More than `most` are refused."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 0 < count <= most:
        raise ValueError(f"prototype count must lie in 1..{most}")
    available = rows.limit(count).count()
    features = rows.select(array_to_vector(vector).alias("features"))
    model = KMeans(k=min(count, available), seed=seed, maxIter=max_iter).fit(features) if available > 1 else None
    if model is None:
        return [list(r[0]) for r in rows.select(vector).head(1)]
    return [[float(x) for x in c] for c in model.clusterCenters()]


def constant(value, schema: str) -> Column:
    """A small model as one literal; folded once, not shipped per row."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def nearest_prototype(rows: DataFrame, vector: str, centers: Sequence[Sequence[float]], widths: Sequence[float] | None = None) -> DataFrame:
    """prototype, distance and squared distance over squared width to the nearest center."""
    if len(centers) > MOST_PROTOTYPES:
        raise ValueError("too many prototypes for a model literal")
    model = constant(
        [{"k": i, "c": list(map(float, c)), "w": float(widths[i]) if widths else 1.0} for i, c in enumerate(centers)],
        "array<struct<k: int, c: array<double>, w: double>>",
    )
    gaps = F.transform(model, lambda m: F.struct(
        (squared_distance(F.col(vector), m["c"]) / (m["w"] * m["w"])).alias("scaled"), m["k"].alias("k"), m["w"].alias("w")))
    return rows.withColumn("_near", F.array_min(gaps)).withColumns({
        "prototype": F.col("_near.k"), "scaled_distance": F.col("_near.scaled"),
        "distance": F.sqrt(F.col("_near.scaled")) * F.col("_near.w"),
    }).drop("_near")


def prototype_stats(assigned: DataFrame, second: str, block: int = 10) -> DataFrame:
    """Per prototype: width (median distance with a floor) and support in distinct time blocks."""
    overall = exact_quantiles(assigned, [], "distance", {"m": 0.5})
    floor = F.greatest(F.lit(1e-3), F.lit(0.1) * overall.scalar())
    width = exact_quantiles(assigned, ["prototype"], "distance", {"median": 0.5})
    origin = assigned.agg(F.min(second)).scalar()
    support = assigned.withColumn("_block", F.floor((F.col(second) - origin) / block)).groupBy("prototype").agg(
        F.count_distinct("_block").alias("support"), F.count(F.lit(1)).alias("members"))
    return width.join(support, "prototype").select(
        "prototype", F.greatest(F.col("median"), floor).alias("width"), "support", "members")


def radial_response(vector: Column, centers: Sequence[Sequence[float]], widths: Sequence[float]) -> Column:
    """Unit-norm response exp(-d^2 / 2w^2) over the prototypes."""
    model = constant([{"c": list(map(float, c)), "w": float(w)} for c, w in zip(centers, widths, strict=True)],
                     "array<struct<c: array<double>, w: double>>")
    logs = F.transform(model, lambda m: -squared_distance(vector, m["c"]) / (2.0 * m["w"] * m["w"]))

    def raised(s: Column) -> Column:
        return F.transform(s["logs"], lambda x: F.exp(x - s["top"]))

    def unit(s: Column) -> Column:
        return F.transform(s["v"], lambda x: x / s["n"])

    values = bind(logs, lambda v: bind(F.struct(v.alias("logs"), F.array_max(v).alias("top")), raised))
    return bind(values, lambda v: bind(F.struct(v.alias("v"), norm(v).alias("n")), unit))


# Mixtures ---------------------------------------------------------------------

def fit_mixture(rows: DataFrame, vector: str, k: int, seed: int = 42, max_iter: int = 150, floor: float = 1e-4, tol: float = 1e-3):
    """Diagonal Gaussian mixture by distributed EM: (parts [w, m, v], log likelihood).

    A step is one aggregation over the rows: responsibilities are column expressions, the
    weighted moments of each component are merged map-side. Variances have a floor. It ends
    when the mean log likelihood rises by less than `tol`.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    data = rows.select(F.col(vector).alias("_v"), array_to_vector(vector).alias("_f"))

    def sums(weight: Column, tag: str) -> list[Column]:
        return [F.sum(weight).alias(f"w{tag}"), Summarizer.metrics("mean", "normL2").summary(F.col("_f"), weight).alias(f"s{tag}")]

    def moments(row, tag: str) -> tuple[float, list[float], list[float]]:
        weight, mean, norm = row[f"w{tag}"], row[f"s{tag}"]["mean"].toArray(), row[f"s{tag}"]["normL2"].toArray()
        return weight, mean.tolist(), [max(floor, n * n / weight - m * m) for n, m in zip(norm, mean)]

    n, mean, spread = moments(data.agg(*sums(F.lit(1.0), "")).head(1)[0], "")
    centers = fit_prototypes(rows, vector, k, seed) if k > 1 else [mean]
    parts = [{"w": 1.0 / len(centers), "m": c, "v": spread} for c in centers]
    before = None
    for _ in range(max_iter + 1):
        logs = _component_logs(F.col("_v"), constant(parts, "array<struct<w: double, m: array<double>, v: array<double>>>"))
        shared = data.withColumn("_l", logs).withColumn("_t", log_sum_exp(F.col("_l")))
        weights = [F.exp(F.get("_l", i) - F.col("_t")) for i in range(len(parts))]
        row = shared.agg(F.sum("_t").alias("likelihood"), *[c for i, w in enumerate(weights) for c in sums(w, str(i))]).head(1)[0]
        value = row["likelihood"] / n
        if before is not None and value - before < tol:
            break
        before = value
        # A component that lost all its rows is dropped.
        found = [moments(row, str(i)) for i in range(len(parts)) if row[f"w{i}"] > 1e-9]
        parts = [{"w": w / n, "m": m, "v": v} for w, m, v in found]
    return parts, row["likelihood"]


def select_mixture(rows: DataFrame, vector: str, most: int, seed: int = 42, max_iter: int = 150, floor: float = 1e-4):
    """Diagonal Gaussian mixture with the lowest BIC over k = 1..most.

    Returns (parts for `mixture_score` and `mixture_nll`, table of k and bic)."""
    n = rows.count()
    if n < 2:
        raise ValueError("a mixture needs at least two rows")
    dims = rows.select(F.size(vector)).head(1)[0][0]
    best, tried = None, []
    for k in range(1, min(most, n // 2) + 1):
        parts, likelihood = fit_mixture(rows, vector, k, seed, max_iter, floor)
        bic = -2.0 * likelihood + (2 * k * dims + k - 1) * math.log(n)
        tried.append((k, float(bic)))
        if best is None or bic < best[0]:
            best = (bic, parts)
    return best[1], rows.sparkSession.createDataFrame(tried, "k int, bic double")


MIXTURE_SCHEMA = "array<struct<role: int, parts: array<struct<w: double, m: array<double>, v: array<double>>>>>"


def _component_logs(vector: Column, parts: Column) -> Column:
    """log weight + log density per diagonal component."""
    def one(p: Column) -> Column:
        quad = total(F.zip_with(F.zip_with(vector, p["m"], lambda x, m: (x - m) * (x - m)), p["v"], lambda d, v: d / v + F.log(v)))
        return F.log(p["w"]) - 0.5 * (quad + F.size(p["m"]) * math.log(2 * math.pi))
    return F.transform(parts, one)


def mixture_score(rows: DataFrame, vector: str, params: Sequence[Mapping]) -> DataFrame:
    """Best role by -log density, without a role prior; regime is the likeliest component.

    `params` holds one mapping per role: role, parts[w, m, v]."""
    model = constant(list(params), MIXTURE_SCHEMA)

    def role(r: Column) -> Column:
        return bind(_component_logs(F.col(vector), r["parts"]), lambda logs: F.struct(
            (-log_sum_exp(logs)).alias("raw"), r["role"].alias("role"),
            (F.array_position(logs, F.array_max(logs)) - 1).cast("int").alias("regime")))

    return rows.withColumn("_best", F.array_min(F.transform(model, role))).withColumns({
        "assigned_role": F.col("_best.role"), "assigned_regime": F.col("_best.regime"), "local_raw": F.col("_best.raw"),
    }).drop("_best")


def mixture_nll(rows: DataFrame, target: str, role: str, params: Sequence[Mapping]) -> DataFrame:
    """Negative log density of the row's own role, divided by the dimension."""
    model = F.map_from_entries(F.transform(constant(list(params), MIXTURE_SCHEMA), lambda r: F.struct(r["role"], r["parts"])))
    parts = F.try_element_at(model, F.col(role).cast("int"))
    return rows.withColumn("nll", -log_sum_exp(_component_logs(F.col(target), parts)) / F.size(target))


def fit_targets(cells: DataFrame, role: str, measures: Sequence[str], states: int, floor: float, sigma_floor: float) -> DataFrame:
    """Per role and measure: scale, bounds, quantile-grid centers and width of the scaled log values."""
    scale = fit_robust(cells, measures, floor, by=[role])
    long = unpivot(cells, [role], measures).join(scale, [role, "component"])
    long = long.select(role, "component", "center", "scale", ((F.log1p("value") - F.col("center")) / F.col("scale")).alias("y"))
    bounds = long.groupBy(role, "component").agg(
        F.first("center").alias("center"), F.first("scale").alias("scale"), F.min("y").alias("lower"), F.max("y").alias("upper"),
        (F.greatest(F.lit(0.3), F.stddev_pop("y")) - sigma_floor).alias("width"))
    step = 0.9 / (states - 1) if states > 1 else 0.0
    grid = exact_quantiles(long, [role, "component"], "y", {f"q{i}": 0.05 + step * i for i in range(states)})
    return bounds.join(grid.select(role, "component", F.array(*[f"q{i}" for i in range(states)]).alias("centers")), [role, "component"])


# Masks, errors, sampling --------------------------------------------------------

def _shuffled(seed: int, tag: str, identity: Column, n: int) -> Column:
    """0..n-1 in an order fixed by seed and identity."""
    keyed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.struct(
        F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), identity, b.cast("string")).cast("binary")).alias("h"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda s: s["b"])


def mask_rounds(identity: Column, bins: int, rounds: int, seed: int) -> Column:
    """Round of each bin; every bin belongs to exactly one round and round sizes differ by at most one."""
    rounds = max(1, min(rounds, bins))
    size, extra = divmod(bins, rounds)
    cut = extra * (size + 1)
    place = lambda p: F.when(p < cut, F.floor(p / (size + 1))).otherwise(extra + F.floor((p - cut) / size)).cast("int")
    return bind(_shuffled(seed, "all", identity, bins), lambda order: F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: place(F.array_position(order, b) - 1)))


def masked_bins(identity: Column, bins: int, ratio: float, seed: int, occupied: Column | None = None) -> Column:
    """A fixed share of the bins; with `occupied` (array of boolean) at least one of them is masked."""
    count = max(1, min(bins - 1, round(bins * ratio)))

    def pick(order: Column) -> Column:
        chosen = F.slice(order, 1, count)
        if occupied is None:
            return F.array_sort(chosen)
        busy = F.filter(order, lambda b: F.get(occupied, b))
        missed = ~F.arrays_overlap(busy, chosen) & (F.size(busy) > 0)
        return F.array_sort(F.when(missed, F.concat(chosen, F.slice(busy, 1, 1))).otherwise(chosen))

    return bind(_shuffled(seed, "mask", identity, bins), pick)


def event_error(errors: Column, occupied: Column, weight: float) -> Column:
    """Weighted mean error of occupied and empty bins; one kind alone counts fully."""
    cells = F.zip_with(errors, occupied, lambda e, o: F.struct(e.alias("e"), o.alias("o")))
    mean = lambda keep: F.transform(F.array(F.filter(cells, keep)), lambda c: F.when(
        F.size(c) > 0, total(F.transform(c, lambda s: s["e"])) / F.size(c)))[0]
    busy, empty = mean(lambda c: c["o"]), mean(lambda c: ~c["o"])
    both = F.lit(float(weight)) * busy + F.lit(1.0 - float(weight)) * empty
    return F.when(busy.isNull(), empty).when(empty.isNull(), busy).otherwise(both)


def draw(seed: Column | str, size: Column, *parts) -> Column:
    """Uniform integer in 0..size-1 from an MD5 of seed and parts."""
    text = F.concat_ws("|", F.lit(seed) if isinstance(seed, str) else seed, *[p.cast("string") for p in parts])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return F.pmod(number, size.cast("long"))


def balanced_sample(rows: DataFrame, stratum: str, block: str, identity: str, draws: int, seed: int) -> DataFrame:
    """`draws` rows: a uniform stratum, a uniform block of it, a uniform row of that (with replacement)."""
    placed = row_positions(rows.select(stratum, block, identity), [stratum, block], [identity], "_row")
    blocks = rows.groupBy(stratum, block).agg(F.count(F.lit(1)).alias("_rows"))
    blocks = row_positions(blocks, [stratum], [block], "_block")
    strata = blocks.groupBy(stratum).agg(F.count(F.lit(1)).alias("_blocks"))
    strata = row_positions(strata, [], [stratum], "_stratum")
    asked = rows.sparkSession.range(draws).withColumnRenamed("id", "draw")
    asked = asked.withColumn("_n", strata.agg(F.count(F.lit(1))).scalar())
    key = str(seed)
    asked = asked.withColumn("_stratum", draw(key, F.col("_n"), F.col("draw"), F.lit("s"))).join(strata, "_stratum")
    asked = asked.withColumn("_block", draw(key, F.col("_blocks"), F.col("draw"), F.lit("b"))).join(blocks, [stratum, "_block"])
    asked = asked.withColumn("_row", draw(key, F.col("_rows"), F.col("draw"), F.lit("r")))
    return asked.join(placed, [stratum, block, "_row"]).select("draw", stratum, block, identity)


def epoch_plan(rows: DataFrame, identity: str, batch: int, seed: int) -> DataFrame:
    """Every row once, in seeded order, cut into batches."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string")).cast("binary"))
    ordered = row_positions(rows.select(identity).withColumn("_key", key), [], ["_key", identity], "position")
    return ordered.select(identity, "position", F.floor(F.col("position") / batch).alias("batch"))


def channel_starts(rows: DataFrame, channel: str, order: Sequence[str], draws: int, steps: int, seed: int) -> DataFrame:
    """Uniform channel, then a uniform start inside it, then up to `steps` consecutive rows."""
    placed = row_positions(rows.select(channel, *order), [channel], list(order), "_at")
    sizes = row_positions(rows.groupBy(channel).agg(F.count(F.lit(1)).alias("_size")), [], [channel], "_channel")
    asked = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("_n", sizes.agg(F.count(F.lit(1))).scalar())
    asked = asked.withColumn("_channel", draw(str(seed), F.col("_n"), F.col("draw"), F.lit("c"))).join(sizes, "_channel")
    start = draw(str(seed), F.col("_size"), F.col("draw"), F.lit("o"))
    asked = asked.withColumn("_start", start)
    last = F.least(F.col("_size"), F.col("_start") + steps) - 1
    steps_of = asked.select("draw", channel, "_start", F.explode(F.sequence("_start", last)).alias("_at"))
    return steps_of.join(placed, [channel, "_at"]).select("draw", (F.col("_at") - F.col("_start")).alias("step"), channel, *order)


# Coefficients of a published rational approximation of erf (|error| < 1.5e-7).
ERF_SHIFT = 0.3275911
ERF_TERMS = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_SHIFT * F.abs(x))
    series = F.lit(0.0)
    for c in reversed(ERF_TERMS):
        series = (series + c) * t
    return F.signum(x) * (1.0 - series * F.exp(-x * x))


def mixture_cdf(value: Column, parts: Column) -> Column:
    """CDF of a one-dimensional Gaussian mixture given as array<struct<w, m, s>>."""
    return total(F.transform(parts, lambda p: p["w"] * 0.5 * (1.0 + erf((value - p["m"]) / (p["s"] * math.sqrt(2.0))))))


def pit_diagnostics(rows: DataFrame, pit: str) -> DataFrame:
    """Ten-bin histogram of the PIT with 90 and 95 percent coverage on every row."""
    slot = F.least(F.lit(9), F.floor(F.col(pit) * 10)).cast("int")
    histogram = rows.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    cover = lambda low, high: F.avg(F.when(F.col(pit).between(low, high), 1.0).otherwise(0.0))
    whole = rows.agg(F.struct(cover(0.05, 0.95).alias("a"), cover(0.025, 0.975).alias("b"))).scalar()
    return histogram.withColumn("_w", whole).select("bin", "rows", F.col("_w.a").alias("coverage_90"), F.col("_w.b").alias("coverage_95"))
