import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import calibration, joins, metrics
from tidewatch.sources import packets as src, stores
from tidewatch.sources.frames import decode_frames, wire_length


def scored(spark, labels, scores):
    return spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores, strict=True))], "row_id long, binary_label int, score double")


def test_perfect_ranking(spark):
    m = metrics.curve_metrics(metrics.score_steps(scored(spark, [1, 0, 1, 0, 0], [7.5, -1.0, 3.25, 0.0, 3.0]))).first()
    assert (m["auroc"], m["average_precision"], m["eer"], m["eer_nearest"], m["tpr_at_001pct"]) == (1, 1, 0, 0, 1)


def test_tied_scores(spark):
    # Attacks 9, 5, 5; normal 5, 2, 2, 1: eleven of twelve pairs won with ties as halves.
    m = metrics.curve_metrics(metrics.score_steps(scored(spark, [1, 1, 1, 0, 0, 0, 0], [9, 5, 5, 5, 2, 2, 1]))).first()
    assert m["auroc"] == pytest.approx(11 / 12) and m["average_precision"] == pytest.approx(1 / 3 + 2 / 3 * 3 / 4)
    # From (0, 1/3) to (1/4, 1): misses fall by 2/3 while false positives rise by 1/4, and meet at 2/11.
    assert m["eer"] == pytest.approx(2 / 11)


@pytest.mark.parametrize("sliced", [False, True])
def test_curves_match_plain_counting(spark, request, sliced):
    if sliced:
        request.getfixturevalue("many_slices")
    rng = np.random.default_rng(2)
    scores, labels = rng.integers(0, 25, 300).astype(float), rng.integers(0, 2, 300)
    steps = metrics.score_steps(scored(spark, labels, scores))
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in metrics.roc(steps).collect()}
    assert points.pop(float("inf")) == (0.0, 0.0)
    for t, (fpr, tpr) in points.items():
        assert fpr == pytest.approx((scores[labels == 0] >= t).mean()) and tpr == pytest.approx((scores[labels == 1] >= t).mean())
    wins = np.sign(scores[labels == 1][:, None] - scores[labels == 0][None]).mean()
    assert metrics.curve_metrics(steps).first()["auroc"] == pytest.approx((wins + 1) / 2)


def test_one_class_has_no_curve(spark):
    m = metrics.curve_metrics(metrics.score_steps(scored(spark, [0, 0], [1.0, 2.0]))).first()
    assert m["auroc"] is None and m["normal"] == 2


def test_flags_are_strict(spark):
    c = metrics.confusion(scored(spark, [0, 1], [1.0, 1.0]), 1.0).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (0, 0, 1, 1)


def test_alignment_refuses_duplicates_and_gaps(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "row_id long"), spark.createDataFrame([(1, 0), (2, 1)], "row_id long, y int")
    assert joins.require_aligned(a, b, ["row_id"]).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        joins.require_aligned(a.union(a), b, ["row_id"])
    with pytest.raises(ValueError, match="different"):
        joins.require_aligned(a, b.limit(1), ["row_id"])


def test_robust_scale_floor_and_degenerate_width(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (0.0, 5.0), (1e-6, 5.0)], "a double, b double")
    scale = {r["component"]: r["scale"] for r in calibration.fit_robust(rows, ["a", "b"], 0.05).collect()}
    assert scale == {"a": 0.05, "b": 1.0}
    q = {r["component"]: r for r in calibration.fit_quantile(rows, ["b"], 0.5, 0.95).collect()}
    assert q["b"]["high"] - q["b"]["low"] == pytest.approx(5e-6)


def test_masks_cover_and_force(spark):
    one = spark.range(2).select(F.col("id").cast("string").alias("id"))
    for r in one.select(calibration.mask_rounds(F.col("id"), 30, 4, 9).alias("m")).collect():
        assert sorted(np.bincount(r["m"])) == [7, 7, 8, 8]
    busy = F.array(*[F.lit(i == 29) for i in range(30)])
    for r in one.select(calibration.masked_bins(F.col("id"), 30, 0.1, 4, busy).alias("m")).collect():
        assert 29 in r["m"] and len(r["m"]) in (3, 4)


def test_epoch_plan_and_channel_starts(spark):
    rows = spark.createDataFrame([("one", 0)] + [("many", i) for i in range(50)], "channel string, at long").withColumn("row_id", F.monotonically_increasing_id())
    plan = calibration.epoch_plan(rows, "row_id", 16, 1).collect()
    assert sorted(r["position"] for r in plan) == list(range(51)) and max(r["batch"] for r in plan) == 3
    starts = calibration.channel_starts(rows, "channel", ["at"], 400, 3, 5)
    share = starts.where("step = 0").agg(F.avg((F.col("channel") == "one").cast("double"))).first()[0]
    assert 0.4 < share < 0.6 and starts.groupBy("draw").count().agg(F.max("count")).first()[0] == 3


def test_mixture_has_no_role_prior(spark):
    rows = spark.createDataFrame([([1.0],)], "v array<double>")
    part = lambda m: [{"w": 1.0, "m": [m], "v": [0.01]}]
    r = calibration.mixture_score(rows, "v", [{"role": 5, "parts": part(-1.0)}, {"role": 9, "parts": part(1.0)}]).first()
    assert r["assigned_role"] == 9 and r["local_raw"] == pytest.approx(0.5 * math.log(2 * math.pi * 0.01))


def test_erf_is_close(spark):
    values = np.linspace(-3, 3, 25)
    out = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", calibration.erf(F.col("x")).alias("e")).collect()
    assert all(abs(r["e"] - math.erf(r["x"])) < 2e-7 for r in out)


def ipv4(proto, body, fragment=0, options=b""):
    head = bytes([0x45 + len(options) // 4, 0]) + (20 + len(options) + len(body)).to_bytes(2, "big") + b"\0\0" + fragment.to_bytes(2, "big")
    return head + bytes([64, proto]) + b"\0\0" + bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + options + body


TCP = (1234).to_bytes(2, "big") + (80).to_bytes(2, "big") + b"\0" * 8 + b"\x50\0" + b"\0" * 6
UDP = (53).to_bytes(2, "big") + (9).to_bytes(2, "big") + (8).to_bytes(2, "big") + b"\0\0"


def ipv6(next_header, body, dst=bytes(15) + b"\x01"):
    return b"\x60\0\0\0" + len(body).to_bytes(2, "big") + bytes([next_header, 64]) + bytes([0x20, 1, 0xD, 0xB8]) + bytes(11) + b"\x02" + dst + body


ETHER = b"\xaa" * 12
CASES = [
    (1, ETHER + b"\x08\0" + ipv4(6, TCP), ("10.0.0.1", "10.0.0.2", 1234, 80, "tcp")),
    (1, ETHER + b"\x81\0\0\x01" * 3 + b"\x08\0" + ipv4(17, UDP), ("10.0.0.1", "10.0.0.2", 53, 9, "udp")),
    (113, b"\0" * 14 + b"\x08\0" + ipv4(17, UDP, options=b"\1" * 4), ("10.0.0.1", "10.0.0.2", 53, 9, "udp")),
    (276, b"\x86\xdd" + b"\0" * 18 + ipv6(17, UDP), ("2001:db8::2", "::1", 53, 9, "udp")),
    (101, ipv6(0, b"\x2c\0" + b"\0" * 6 + b"\x11\0" + b"\0" * 6 + UDP), ("2001:db8::2", "::1", 53, 9, "udp")),
    (101, ipv6(51, b"\x06\1" + b"\0" * 10 + TCP), ("2001:db8::2", "::1", 1234, 80, "tcp")),
    (0, b"\x02\0\0\0" + ipv4(6, TCP), ("10.0.0.1", "10.0.0.2", 1234, 80, "tcp")),
    (0, b"\0\0\0\x1e" + ipv6(6, TCP), ("2001:db8::2", "::1", 1234, 80, "tcp")),
    (1, ETHER + b"\x08\0" + ipv4(17, UDP, fragment=5), None), (1, ETHER + b"\x08\0" + ipv4(1, UDP), None),
    (1, ETHER + b"\x08\0" + ipv4(6, TCP)[:30], None), (1, ETHER[:6], None), (1, ETHER + b"\x81\0", None),
    (101, ipv6(44, b"\x11\0\0\x08" + b"\0" * 4 + UDP), None), (101, ipv6(0, b"\x11\x09" + b"\0" * 6 + UDP), None), (99, b"\x45" * 40, None),
]


def test_frame_decoding(spark):
    df = spark.createDataFrame([("c", i, float(i), t, bytearray(b)) for i, (t, b, _) in enumerate(CASES)],
                               "capture_id string, frame_number long, ts double, linktype int, bytes binary")
    got = {r["frame_number"]: (r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"], r["protocol"]) for r in decode_frames(df).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(CASES) if e}
    sizes = {r["frame_number"]: r["wire_length"] for r in wire_length(decode_frames(df)).collect()}
    assert sizes == {0: 40, 1: 28, 2: 32, 6: 40}


@pytest.mark.parametrize("text", ["frame_number,binary_label\n1,0\n2,1\n4,0\n", '"","x"\n"1",0\n"2",1\n"4",0\n', "0\n1\n0\n"])
def test_label_layouts(spark, tmp_path, text):
    path = tmp_path / "labels.csv"
    path.write_text(text)
    got = sorted(tuple(r) for r in src.packet_labels(spark, str(path)).collect())
    assert got == ([(1, 0), (2, 1), (3, 0)] if text.startswith("0") else [(1, 0), (2, 1), (4, 0)])


def test_vector_labels_are_numbered_over_many_blocks(spark, tmp_path):
    path = tmp_path / "vector.csv"
    path.write_text("".join(f"{int(i % 7 == 0)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r["frame_number"]: r["binary_label"] for r in src.packet_labels(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i + 1: int(i % 7 == 0) for i in range(5000)}


def test_label_layout_is_refused(spark):
    with pytest.raises(ValueError):
        src.label_layout("a,b,c")


def test_sources(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"x")
    manifest = spark.createDataFrame([(f"{tmp_path}/a.pcap", "normal ", "Val")] * 2, "pcap string, label string, split string")
    files = src.list_files(spark, f"{tmp_path}/*.pcap")
    rows = src.resolve_sources(src.sources_from_table(manifest), files).collect()
    assert [(r["label"], r["split"]) for r in rows] == [("normal", "calibration")]
    with pytest.raises(FileNotFoundError):
        src.resolve_sources(src.sources_from_table(manifest.withColumn("pcap", F.lit("/no/file"))), files)
    with pytest.raises(ValueError):
        src.resolve_sources(src.sources_from_table(manifest.withColumn("split", F.lit("odd"))))


def test_stores(spark, tmp_path):
    with pytest.raises(ValueError, match="missing flow columns"):
        stores.flow_contract(spark.range(1))
    seg = spark.createDataFrame([("train", "c", 1, [1.0]), ("test", "d", 2, [2.0])], "split string, capture_id string, packet_count int, features array<double>")
    stores.write_segments(seg, str(tmp_path / "segments"))
    assert spark.read.parquet(str(tmp_path / "segments")).where("split = 'test'").first()["features"] == [2.0]
    stores.write_scores(seg.select("packet_count"), str(tmp_path / "scores"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "scores")).count() == 2
