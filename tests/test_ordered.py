import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ordered
from tidewatch.operators.activity import decayed_history
from tidewatch.operators.calibration import ecdf, tail_evidence, thresholds
from tidewatch.session import bounded_rows

SKEWED = [("hot" if i % 3 else f"k{i % 7}", int(i), float((i * 37) % 101)) for i in range(400)]


@pytest.fixture
def skewed(spark):
    return spark.createDataFrame(SKEWED, "k string, at long, v double")


def groups():
    out = {}
    for k, at, v in SKEWED:
        out.setdefault(k, []).append((at, v))
    return {k: sorted(rows) for k, rows in out.items()}


def test_hot_group_is_spread(skewed, many_slices):
    rows = ordered.slice_groups(skewed, ["k"], ["at"])
    assert rows.where("k = 'hot'").select("_slice").distinct().count() > 1


def test_null_keys_form_a_group(spark, many_slices):
    rows = spark.createDataFrame([(None, 1, 2.0), ("a", 1, 1.0), (None, 2, 3.0), (None, 3, 4.0)], "k string, at long, v double")
    sums = {(r["k"], r["at"]): r["s"] for r in ordered.running_sums(rows, ["k"], ["at"], {"s": F.col("v")}).collect()}
    assert sums == {(None, 1): 0, (None, 2): 2, (None, 3): 5, ("a", 1): 0}
    totals = {(r["k"], r["at"]): r["t"] for r in ordered.group_totals(rows, ["k"], {"t": F.sum("v")}).collect()}
    assert totals == {(None, 1): 9, (None, 2): 9, (None, 3): 9, ("a", 1): 1}


@pytest.mark.parametrize("sliced", [False, True])
def test_running_previous_and_last(skewed, request, sliced):
    if sliced:
        request.getfixturevalue("many_slices")
    out = ordered.running_sums(skewed, ["k"], ["at"], {"s": F.col("v")})
    out = ordered.running_max(out, ["k"], ["at"], F.col("v"), "m")
    out = ordered.previous_row(out, ["k"], ["at"], ["v"], "p")
    out = ordered.last_known(out, ["k"], ["at"], {"l": F.when(F.col("v") > 50, F.col("at"))})
    got = {(r["k"], r["at"]): r for r in out.collect()}
    assert len(got) == len(SKEWED)
    for k, rows in groups().items():
        for i, (at, v) in enumerate(rows):
            r, before = got[(k, at)], rows[:i]
            assert r["s"] == pytest.approx(sum(x for _, x in before))
            assert r["m"] == (max(x for _, x in before) if before else None)
            assert (r["p"]["v"] if r["p"] else None) == (before[-1][1] if before else None)
            high = [a for a, x in before if x > 50]
            assert r["l"] == (high[-1] if high else None)


@pytest.mark.parametrize("sliced", [False, True])
@pytest.mark.parametrize("method", ["linear", "higher"])
def test_exact_quantiles(skewed, request, sliced, method):
    if sliced:
        request.getfixturevalue("many_slices")
    out = ordered.exact_quantiles(skewed, ["k"], "v", {"a": 0.25, "b": 0.95, "c": 1.0}, method)
    for r in out.collect():
        values = [v for _, v in groups()[r["k"]]]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(np.quantile(values, [0.25, 0.95, 1.0], method=method).tolist())
    whole = ordered.exact_quantiles(skewed, [], "v", {"a": 0.5}, method).first()
    assert whole["a"] == pytest.approx(np.quantile([r[2] for r in SKEWED], 0.5, method=method))


@pytest.mark.parametrize("method", ["linear", "higher"])
def test_exact_quantiles_of_large_groups(spark, method):
    """Groups beyond the size that is its own bracket: smooth, tied, of few values, with infinities and NaN."""
    rng = np.random.default_rng(4)
    data = {
        "smooth": rng.normal(size=30_000), "tied": np.round(rng.exponential(size=20_001), 1), "two": rng.integers(0, 2, 9_000) * 1.0, "one": np.full(5_000, 3.5),
        "far": np.r_[rng.normal(size=4_000) * 1e300, [np.inf] * 40, [-np.inf] * 40], None: rng.integers(-50, 50, 2_001) * 1.0, "pair": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("smooth", None), ("empty", None)], "k string, v double")
    levels = {"a": 0.0, "b": 0.001, "c": 0.25, "d": 0.5, "e": 0.95, "f": 0.999, "g": 1.0}
    got = {r["k"]: [r[n] for n in levels] for r in ordered.exact_quantiles(rows, ["k"], "v", levels, method).collect()}
    assert got.keys() == data.keys()

    def plain(values, q):
        at = (len(values) - 1) * q
        low, high = (int(np.ceil(at)),) * 2 if method == "higher" else (int(np.floor(at)), min(int(np.floor(at)) + 1, len(values) - 1))
        return values[low] if values[low] == values[high] else values[low] + (values[high] - values[low]) * (at - low)

    for k, values in data.items():
        assert got[k] == pytest.approx([plain(np.sort(values), q) for q in levels.values()], rel=1e-12)
    many = spark.createDataFrame([(float(v),) for v in np.r_[rng.normal(size=5_000), [np.nan] * 1_000]], "v double")
    top = ordered.exact_quantiles(many, [], "v", {"a": 0.5, "b": 0.99}, "higher").first()
    assert top["a"] == np.sort(np.array([r[0] for r in many.collect()]))[3000] and np.isnan(top["b"])


def test_trailing_window_across_blocks(spark):
    rows = spark.createDataFrame([("k", int(t), float(t)) for t in range(0, 200, 3)], "k string, t long, v double")
    out = ordered.trailing_window(rows, ["k"], "t", 5, {"s": F.sum("v"), "n": F.count("v")}).collect()
    assert len(out) == 67
    for r in out:
        past = [t for t in range(0, 200, 3) if r["t"] - 5 <= t < r["t"]]
        assert (r["n"], r["s"] or 0) == (len(past), sum(past))


def test_tail_cdf_and_threshold(spark):
    calibration = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    rows = spark.createDataFrame([(-1.0,), (1.0,), (3.0,)], "x double")
    p = {r["x"]: r["tail_p"] for r in tail_evidence(calibration, rows, "x").collect()}
    assert p == {-1.0: 1.0, 1.0: 0.75, 3.0: 0.25}
    assert {r["x"]: r["cdf"] for r in ecdf(calibration, rows, "x").collect()} == {-1.0: 0.0, 1.0: 0.5, 3.0: 0.75}
    assert thresholds(calibration, ["x"], 0.4).first()["threshold"] == np.quantile([0, 1, 2], 0.6, method="higher")


def test_decayed_history_reads_before_update(spark):
    values = [3.0, 0.0, 5.0, 1.0] * 20
    rows = spark.createDataFrame([("c", t, [v, 1.0]) for t, v in enumerate(values)], "capture_id string, t long, summary array<double>")
    got = {r["t"]: r for r in decayed_history(rows, 2, (4, 16), 3, block=8).collect()}
    for i, tau in enumerate((4.0, 16.0)):
        activity = exposure = 0.0
        for t, v in enumerate(values):
            assert got[t][f"activity_{i}"][0] == pytest.approx(activity) and got[t][f"exposure_{i}"] == pytest.approx(exposure)
            activity, exposure = activity * np.exp(-1 / tau) + v, exposure * np.exp(-1 / tau) + 1
    assert [s[0] for s in got[10]["recent"]] == values[7:10]


def test_model_tables_are_refused_when_large(spark):
    with pytest.raises(ValueError):
        bounded_rows(spark.range(10), 5)


def test_no_row_is_lost_by_ranks(spark):
    known = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", None)], "role string, v double")
    rows = spark.createDataFrame([("x", 2.0), ("x", None), ("y", 5.0), (None, 1.0)], "role string, v double")
    got = {(r["role"], r["v"]): r["cdf"] for r in ecdf(known, rows, "v", ["role"]).collect()}
    assert got == {("x", 2.0): pytest.approx(2 / 3), ("x", None): None, ("y", 5.0): 0.0, (None, 1.0): 0.0}
    tails = {(r["role"], r["v"]): r["tail_p"] for r in tail_evidence(known, rows, "v", ["role"]).collect()}
    assert tails == {("x", 2.0): pytest.approx(2 / 3), ("x", None): None, ("y", 5.0): 1.0, (None, 1.0): 1.0}


def test_weighted_quantiles_stand_for_repeated_rows(spark, many_slices):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 3}", float(rng.integers(0, 9)), int(rng.integers(0, 4))) for i in range(90)] + [("g0", None, 5), (None, 2.0, 7)]
    out = ordered.weighted_quantiles(spark.createDataFrame(rows, "g string, v double, w long"), ["g"], "v", "w", {"a": 0.0, "b": 0.33, "c": 0.95, "d": 1.0})
    got = {r["g"]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == 4
    for g, values in got.items():
        full = [v for k, v, w in rows if k == g and v is not None for _ in range(w)]
        assert np.allclose(values, np.quantile(full, [0.0, 0.33, 0.95, 1.0]))
