import math

import numpy as np
import pytest

from tidewatch.functions import keys
from tidewatch.operators import activity
from tidewatch.operators import flows as ops


def packet(ts, src="x1", dst="x2", sport=7001, dport=9, length=64, label=0):
    return (ts, src, dst, sport, dport, "udp", length, label)


# Second 6 holds four packets forth, the third of them late in the file, and one back; second 7 begins exactly at 7.0.
LAYOUT = [packet(6.25, length=90), packet(6.5, "x2", "x1", 9, 7001), packet(6.95, length=30), packet(6.31, length=60), packet(7.0), packet(6.26, length=20)]


def by_key(df):
    return {(r["timestamp_second"], r["src_ip"]): r for r in df.collect()}


def test_direction_and_window_boundaries(packet_table):
    rows = by_key(ops.flow_statistics(packet_table(LAYOUT)))
    assert {k: r["packet_count"] for k, r in rows.items()} == {(6, "x1"): 4, (6, "x2"): 1, (7, "x1"): 1}
    forth = rows[(6, "x1")]
    assert forth["byte_count"] == 200 and forth["active_duration"] == pytest.approx(0.70)
    assert forth["active_bin_count"] == 3 and forth["bin_packets_max"] == 2 and forth["bin_bytes_max"] == 110
    # Times in order: 6.25, 6.26, 6.31, 6.95.
    assert (forth["iat_min"], forth["iat_p50"], forth["iat_max"]) == (pytest.approx(0.01), pytest.approx(0.05), pytest.approx(0.64))
    assert rows[(7, "x1")]["iat_mean"] == 0


def test_single_packet(packet_table):
    row = ops.flow_statistics(packet_table([packet(12.75, length=730)])).first()
    values = [row[c] for c in ops.FLOW_STATISTICS]
    assert values[10:18] == [0.0] * 8 and values[4] == 0 and values[:3] == [1, 730, 0]
    assert values[20] == pytest.approx(219.0)  # one bin of ten holds 730: sqrt(0.1 * 0.9) * 730
    assert values[23] == pytest.approx(0.3)


def random_packets(n=300, seed=5):
    rng = np.random.default_rng(seed)
    return [packet(float(t), "a", "b", 1, int(p), int(s)) for t, p, s in
            zip(np.sort(rng.uniform(0, 3, n)), rng.integers(1, 3, n), rng.integers(40, 1500, n), strict=True)]


def numpy_statistics(times, lengths, second):
    times, lengths = np.sort(np.asarray(times)), np.asarray(lengths, dtype=float)
    gaps = np.diff(times)
    gap = [0.0] * 8 if not len(gaps) else [
        gaps.mean(), gaps.std(), gaps.min(), gaps.max(), *np.percentile(gaps, [25, 50, 75]), gaps.std() / gaps.mean()]
    return [len(lengths), lengths.sum(), times[-1] - times[0], lengths.mean(), lengths.std(), lengths.min(), lengths.max(),
            *np.percentile(lengths, [25, 50, 75]), *gap]


@pytest.mark.parametrize("sliced", [False, True])
def test_statistics_match_numpy_in_both_ways(packet_table, request, sliced):
    if sliced:
        request.getfixturevalue("many_slices")
    rows = random_packets()
    out = ops.flow_statistics(packet_table(rows)).collect()
    for r in out:
        own = [p for p in rows if math.floor(p[0]) == r["timestamp_second"] and p[4] == r["dst_port"]]
        expected = numpy_statistics([p[0] for p in own], [p[6] for p in own], r["timestamp_second"])
        assert [r[c] for c in ops.FLOW_STATISTICS[:18]] == pytest.approx(expected)
    assert sum(r["packet_count"] for r in out) == len(rows)


def test_bidirectional_microbins(packet_table):
    rows = [packet(0.1, "10.0.0.1", "10.0.0.2", 1, 2, 60), packet(0.2, "10.0.0.1", "10.0.0.2", 1, 2, 100), packet(0.3, "10.0.0.2", "10.0.0.1", 2, 1, 70)]
    features = ops.microbins_bidir(packet_table(rows), 2.0, 2).first()["features"]
    assert list(features[0]) == [2, 1, 160, 70, 80, 70] and list(features[1]) == [0] * 6


@pytest.mark.parametrize("sliced", [False, True])
def test_gaps_run_across_bins_and_never_go_negative(packet_table, request, sliced):
    if sliced:
        request.getfixturevalue("many_slices")
    rows = [packet(0.100, length=60), packet(0.110, length=100), packet(0.140, length=80), packet(0.130, length=10), packet(1.5, length=10)]
    out = {r["window_index"]: r["features"] for r in ops.microbins_iat(packet_table(rows), 1.0, 1).collect()}
    assert list(out[0][0][:3]) == [4, 250, 62.5]
    assert out[0][0][4] == pytest.approx((10 + 30 + 0) / 3)
    assert out[1][0][4] == pytest.approx(1370.0)


def test_epoch_windows(spark):
    rows = spark.createDataFrame([("c", 1, 10.0), ("c", 2, 12.0)], "capture_id string, frame_number long, ts double")
    out = keys.window_coords(rows, 3.0).orderBy("ts").collect()
    assert [(r["window_index"], r["window_start"], r["offset"]) for r in out] == [(3, 9.0, 1.0), (4, 12.0, 0.0)]
    capture = keys.window_coords(rows, 1.5, "capture").orderBy("ts").collect()
    assert [(r["window_index"], r["window_start"]) for r in capture] == [(0, 10.0), (1, 11.5)]


def test_canonical_order_is_numeric_not_textual(packet_table):
    rows = packet_table([packet(1.0, "10.0.0.9", "10.0.0.10"), packet(1.0, "2001:db8::1", "10.0.0.1"), packet(1.0, "fe80::2", "fe80::10")])
    out = keys.canonical_key(rows).orderBy("frame_number").collect()
    assert [(r["endpoint_a_ip"], r["direction"]) for r in out] == [("10.0.0.9", 0), ("10.0.0.1", 1), ("fe80::2", 0)]


@pytest.mark.parametrize("sliced", [False, True])
def test_row_numbers_follow_second_then_key(packet_table, request, sliced):
    if sliced:
        request.getfixturevalue("many_slices")
    flows = ops.number_flows(ops.flow_statistics(packet_table(random_packets()))).collect()
    ordered = sorted(flows, key=lambda r: (r["timestamp_second"], r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"]))
    assert [r["row_id"] for r in ordered] == list(range(len(flows)))
    numbered = ops.flow_statistics(packet_table(random_packets()), number=True)
    assert {tuple(r[c] for c in flows[0].__fields__) for r in numbered.collect()} == {tuple(r) for r in flows}


def test_a_flow_over_several_slices_has_exact_quartiles(spark, packet_table, many_slices):
    rng = np.random.default_rng(8)
    times = np.sort(rng.random(6000)) * 0.9
    rows = [(float(t), "a", "b", 1, 2, "tcp", 60 + i % 7, 0) for i, t in enumerate(times)] + [(0.5, "c", "b", 1, 2, "udp", 99, 0), (0.75, "c", "b", 1, 2, "udp", 99, 0)]
    got = {r["src_ip"]: r for r in ops.flow_statistics(packet_table(rows), number=True).collect()}
    gaps = np.diff(times)
    assert [got["a"][f"iat_p{q}"] for q in (25, 50, 75)] == pytest.approx(np.quantile(gaps, [0.25, 0.5, 0.75]).tolist(), rel=1e-9)
    assert got["a"]["packet_count"] == 6000 and got["a"]["iat_mean"] == pytest.approx(gaps.mean())
    assert (got["c"]["iat_p50"], got["a"]["row_id"], got["c"]["row_id"]) == (0.25, 0, 1)


def test_calibration_split_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("c", w) for w in range(5)], "capture_id string, window_index long")
    out = {r["window_index"]: r["split"] for r in ops.split_calibration(rows, 0.5).collect()}
    assert [out[w] for w in range(5)] == ["train"] * 3 + ["calibration"] * 2
    with pytest.raises(ValueError):
        ops.split_calibration(rows, 1.0)


def test_unknown_labels_are_refused(spark):
    rows = spark.createDataFrame([("Normal",), ("odd",)], "label string")
    with pytest.raises(ValueError, match="odd"):
        keys.reject_unknown_labels(rows, "label", ["normal"], ["attack"])
    with pytest.raises(ValueError):
        keys.channel_id(["src_ip", "src_ip"])
    none = spark.createDataFrame([("train", "attack")], "split string, label_class string")
    with pytest.raises(ValueError):
        keys.require_normal(none, "train")


def test_captures_too_short_to_split_are_refused(spark):
    rows = spark.createDataFrame([("whole", 1), ("whole", 2), ("short", 7), ("short", 7)], "capture_id string, at long")
    with pytest.raises(ValueError, match="short"):
        ops.split_calibration(rows.withColumnRenamed("at", "window_index"), 0.5)
    with pytest.raises(ValueError, match="short"):
        ops.split_seconds(rows.withColumnRenamed("at", "timestamp_second"), 0.25)


def test_a_timestamp_far_off_costs_nothing(spark):
    century = 100 * 365 * 86400
    rows = [("c", s, 1.0, 100.0) for s in (5, 5, 6, 9)] + [("c", 5 + century, 4.0, 800.0), ("d", 3, 2.0, 10.0)]
    data = spark.createDataFrame(rows, "capture_id string, timestamp_second long, packet_count double, byte_count double")
    out = {r["capture_id"]: r for r in ops.load_summary(data).collect()}
    assert out["c"]["duration"] == century + 1 and out["c"]["bytes_p99"] == 0 and out["c"]["flows_peak"] == 2
    assert out["c"]["packets_mean"] == pytest.approx(8 / (century + 1))
    assert (out["d"]["duration"], out["d"]["bytes_p95"], out["d"]["bytes_mean"]) == (1, 10, 10)


def test_silent_seconds_are_runs_and_rows(spark):
    rows = [("c", s, [1.0], [1.0] * 10, [2.0] * 10, 0) for s in (5, 5, 9, 10)]
    data = spark.createDataFrame(rows, "capture_id string, timestamp_second long, phi array<double>, bin_packets array<double>, bin_bytes array<double>, first_bin int")
    runs = {r["t"]: r["silent"] for r in activity.second_runs(data, 1).collect()}
    assert runs == {5: 0, 9: 3, 10: 0}
    dense = {r["t"]: list(r["summary"]) for r in activity.second_summary(data, 1, piece=2).collect()}
    assert sorted(dense) == list(range(5, 11)) and dense[7] == [0.0] * 36 and dense[5][0] == 2.0
    far = data.union(spark.createDataFrame([("c", 10**10, [1.0], [1.0] * 10, [2.0] * 10, 0)], data.schema))
    assert max(r["silent"] for r in activity.second_runs(far, 1).collect()) == 10**10 - 11
