import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import activity
from tidewatch.operators.flows import FLOW_STATISTICS, flow_statistics
from tidewatch.operators.history import HistoryRule, historical_context
from tidewatch.streaming import live
from tidewatch.streaming.run import as_stream, relay, run_available, stream_folder


@pytest.fixture
def feed(spark, packet_table, tmp_path):
    """Packets of 20 seconds in five files, read one file per trigger."""
    rng = np.random.default_rng(4)
    rows = [(float(t), f"n{rng.integers(0, 3)}", f"n{rng.integers(0, 3)}", 1, int(rng.integers(1, 3)), "udp", int(rng.integers(40, 900)), 0)
            for t in np.sort(rng.uniform(0, 20, 400))]
    df = packet_table(rows)
    for i in range(5):
        df.where(F.floor(F.col("ts") / 4) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return df, stream_folder(spark, str(tmp_path / "feed"), df.schema, 1)


def closed(df, last):
    return df.where(F.col("timestamp_second") + 1 <= last - 2)


def test_stream_equals_batch_over_several_triggers(feed):
    batch, stream = feed
    last = batch.agg(F.max("ts")).first()[0]
    key = ["timestamp_second", "src_ip", "dst_ip", "dst_port"]
    rows = lambda df: {tuple(r[k] for k in key): [r[c] for c in FLOW_STATISTICS] for r in df.collect()}
    got, expected = rows(run_available(live.stream_flows(stream), "t")), rows(closed(flow_statistics(batch), last))
    assert got.keys() == expected.keys() and len(got) > 50
    for k in got:
        assert got[k] == pytest.approx(expected[k], abs=1e-6)


def test_bounded_stream_gives_its_last_windows(feed):
    batch, _ = feed
    stream = as_stream(batch, "whole", end={"ts": F.lit(1e9)})
    out = run_available(live.stream_flows(stream), "whole")
    assert out.agg(F.sum("packet_count")).first()[0] == batch.count()
    assert out.count() == flow_statistics(batch).count()


def test_gaps_of_a_long_flow_are_sorted_once(spark, packet_table):
    # Sorting or summing within a lambda is done again for every packet: quadratic in a flow's length.
    rng = np.random.default_rng(7)
    times = np.append(rng.uniform(0, 1, 3000), [0.5, 0.5])
    out = live.stream_flows(packet_table([(float(t), "a", "b", 1, 2, "udp", 60, 0) for t in times]))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("array_sort(") + plan.count("sort_array(") == 2  # the times and their gaps
    gaps = np.diff(np.sort(times))
    expected = [gaps.mean(), gaps.std(), gaps.min(), gaps.max(), *np.percentile(gaps, [25, 50, 75]), gaps.std() / gaps.mean()]
    assert list(out.select("iat_mean", "iat_std", "iat_min", "iat_max", "iat_p25", "iat_p50", "iat_p75", "iat_cv").first()) == pytest.approx(expected, abs=1e-12)


def test_late_rows_of_early_triggers_are_not_forgotten(spark, packet_table, tmp_path):
    # Lateness is judged by the watermark of the trigger before the last one, so two files come before the late row.
    times = [40.0, 50.0, 52.0, 2.0, *[60.0 + i for i in range(100)]]
    df = packet_table([(t, "a", "b", 1, 2, "udp", 60, 0) for t in times])
    rows = df.toPandas()
    for at in range(len(times)):
        rows[rows.frame_number == at + 1].to_parquet(str(tmp_path / f"f{at:03d}.parquet"), index=False)
    stream = stream_folder(spark, str(tmp_path), df.schema, 1)
    with pytest.raises(ValueError, match="1 rows arrived later"):
        run_available(live.stream_flows(stream), "many")


def test_late_packets_are_refused(spark, packet_table, tmp_path):
    rows = [(t, "a", "b", 1, 2, "udp", 60, 0) for t in (1.0, 9.0, 20.0, 2.0, 30.0)]
    df = packet_table(rows)
    assert [r["ts"] for r in live.late_rows(df).collect()] == [2.0]
    for i in range(1, 6):
        df.where(F.col("frame_number") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = stream_folder(spark, str(tmp_path / "late"), df.schema, 1)
    with pytest.raises(ValueError, match="later than the watermark"):
        run_available(live.stream_flows(stream), "late")
    assert live.late_rows(packet_table(rows[:3])).count() == 0


def test_new_peers_over_triggers(feed):
    batch, stream = feed
    cells = relay(live.peer_cells(stream, 1, F.lit(0)), "peers")
    got = run_available(live.stream_new_peers(cells), "new").collect()
    first = {}
    for r in sorted(got, key=lambda r: r["timestamp_second"]):
        key = (r["src_ip"], r["dst_ip"])
        assert r["new_peer"] == (key not in first)
        first.setdefault(key, r["timestamp_second"])
    assert sum(r["flows"] for r in got) == batch.where(F.floor("ts") + 1 <= batch.agg(F.max("ts")).first()[0] - 2).count()


def test_intensity_equals_batch(feed):
    batch, stream = feed
    last = batch.agg(F.max("ts")).first()[0]
    mark = lambda df: df.withColumns({"behaviour": F.col("dst_port"), "packet_count": F.lit(1.0), "byte_count": F.col("wire_length").cast("double"),
                                      "event_time": F.timestamp_micros((F.col("ts") * 1e6).cast("long"))})
    cells = relay(live.activity_cells(mark(stream), 1), "cells")
    key = ["node", "direction", "timestamp_second", "behaviour"]
    rows = lambda df: {tuple(r[k] for k in key): (r["history_length"], r["mass_raw"]) for r in df.collect()}
    got = rows(run_available(live.stream_intensity(cells, 1, 4), "intensity"))
    timed = mark(batch).withColumn("timestamp_second", F.floor("ts"))
    expected = rows(closed(activity.intensity_score(activity.activity(timed), 4), last))
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(expected[k], abs=1e-9)


def test_history_equals_batch(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "c", w, f"n{rng.integers(0, 3)}", f"n{rng.integers(0, 3)}", [float(x) for x in rng.normal(size=2)], float(rng.integers(0, 2)))
            for i, w in enumerate(np.sort(rng.integers(0, 8, 60)).tolist())]
    df = spark.createDataFrame(rows, "row_id long, capture_id string, window_index long, endpoint_a_ip string, endpoint_b_ip string, embedding array<double>, local_score double")
    rule = HistoryRule(alpha=0.5, update_rate=0.3, global_mean=(0.0, 0.1))
    stream = as_stream(df.withColumn("event_time", F.timestamp_seconds(F.col("window_index") * 3 + 1)), "rows")
    folded = run_available(live.stream_pair_history(relay(live.pair_cells(stream, 3), "cells"), rule), "pairs")
    got = {(r["window_index"], r["first_row"]): r["reliability"] for r in folded.where("rate IS NULL").collect()}
    batch = {(r["window_index"], r["row_id"]): r["reliability"] for r in historical_context(df, rule).collect()}
    mark = max(w for w, _ in batch) * 3 + 1 - 2  # the watermark: a window is closed when it ends by then
    done = {k: v for k, v in batch.items() if (k[0] + 1) * 3 <= mark}
    assert got.keys() == done.keys() and all(got[k] == pytest.approx(done[k]) for k in got)
    entities = run_available(live.stream_entity_history(as_stream(folded, "commits"), rule), "entities")
    assert entities.where("observations = 0 AND entity_mean IS NOT NULL").count() == 0 and entities.count() > 0


EVENTS = "capture_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, behaviour int, event_id long, first_packet_time double"


def clocks_of_files(spark, tmp_path, files, tolerance):
    """Both clock stages over the given files, one file a trigger, in the given order; a last row closes the stream."""
    def stream(name, parts):
        for i, rows in enumerate(parts):
            folder = tmp_path / name / f"{i}"
            spark.createDataFrame(rows, parts_schema[name]).coalesce(1).write.parquet(str(folder))
            for f in folder.glob("part-*"):
                (tmp_path / f"{name}-in").mkdir(exist_ok=True)
                target = tmp_path / f"{name}-in" / f"{i:03d}.parquet"
                target.write_bytes(f.read_bytes())
                os.utime(target, (1_000_000 + i, 1_000_000 + i))
        return stream_folder(spark, str(tmp_path / f"{name}-in"), spark.createDataFrame([], parts_schema[name]).schema, 1)

    parts_schema = {"events": EVENTS, "clocked": live.CONNECTION_OUTPUT}
    last = (None,) * 8 + (9e9,)
    first = run_available(live.stream_connection_clocks(stream("events", [*files, [last]]), tolerance), "clocks").collect()
    later = [tuple(r) for r in first]
    cut = [later[i::3] for i in range(3)]
    fresh = run_available(live.stream_fresh_clocks(stream("clocked", [*[c for c in cut if c], [(*last, True, None, None, None)]]), "1 year"), "fresh").collect()
    return first, fresh


def test_clocks_follow_event_time_across_triggers(spark, tmp_path):
    link = ("c", "s", "d", 1, 2, "tcp", 0)
    first, fresh = clocks_of_files(spark, tmp_path, [[(*link, 2, 20.0)], [(*link, 1, 10.0)], [(*link, 3, 21.5)]], "15 seconds")
    assert [(r["event_id"], r["new_connection"], r["gap"], r["gap_predecessor"]) for r in sorted(first, key=lambda r: r["event_id"])] == [
        (1, True, 0.0, -1), (2, False, 10.0, 1), (3, False, 1.5, 2)]
    assert [(r["event_id"], r["gap_valid"], r["gap_predecessor"]) for r in fresh] == [(1, False, -1)]


def test_shuffled_files_give_the_clocks_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [("c", f"s{rng.integers(2)}", "d", int(rng.integers(3)), 2, "tcp", 0, i, float(np.round(rng.random() * 500, 3))) for i in range(150)]
    first, fresh = clocks_of_files(spark, tmp_path, [rows[i::5] for i in range(5)], "600 seconds")
    got = {r["event_id"]: r for r in first if not r["new_connection"]} | {r["event_id"]: r for r in fresh}
    batch = activity.event_clocks(spark.createDataFrame(rows, EVENTS)).collect()
    assert len(got) == len(first) == len(rows) == len(batch)
    for r in batch:
        g = got[r["event_id"]]
        assert (g["new_connection"], g["gap_valid"], g["gap_predecessor"]) == (r["new_connection"], r["gap_valid"], r["gap_predecessor"])
        assert g["gap"] == pytest.approx(r["gap"])


def test_an_event_behind_the_watermark_is_refused(spark, tmp_path):
    link = ("c", "s", "d", 1, 2, "tcp", 0)
    with pytest.raises(ValueError, match="later than the watermark"):
        clocks_of_files(spark, tmp_path, [[(*link, 2, 200.0)], [(*link, 3, 300.0)], [(*link, 1, 10.0)], [(*link, 4, 301.0)]], "5 seconds")
