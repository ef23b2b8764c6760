"""Streaming forms of the flow, peer, history, intensity and clock operators.

A stateful operator has two stages. The first is a watermarked window aggregation
with map-side combine, written in append mode: only closed windows come out, in time
order. The second reads that table as a stream and keeps keyed state of fixed size, or
bounded by the history length.
"""
from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions.keys import FLOW_IDENTITY, pair_key, tenth_bin
from tidewatch.operators.activity import RESOURCES
from tidewatch.operators.flows import bin_columns, mergeable_aggregates, size_columns
from tidewatch.operators.history import EntityMemory, HistoryRule, PairMemory
from tidewatch.operators.ordered import running_max


def tumble(rows: DataFrame, seconds: int, delay: str = "2 seconds", event_time: str = "event_time") -> DataFrame:
    """Epoch-aligned tumbling window start (in seconds) on a watermarked stream."""
    return rows.withWatermark(event_time, delay).withColumn("window", F.window(event_time, f"{seconds} seconds"))


def with_event_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6 + 0.5).cast("long")))


def _seconds(column: str = "window.start"):
    return F.unix_seconds(column).alias("timestamp_second")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` and the lambdas in it name it."""
    return F.transform(F.array(value), then)[0]


GAPS = ("iat_mean", "iat_std", "iat_min", "iat_max", "iat_p25", "iat_p50", "iat_p75", "iat_cv")


def gap_struct(times: Column) -> Column:
    """The eight gap statistics of one flow from its packet times in any order; all zero for one packet.

    Times are sorted, subtracted and summed up once each, so a flow costs what its sort costs.
    """
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def of_gaps(gaps: Column) -> Column:
        n = F.size(gaps)

        def quartile(q: float) -> Column:
            place = (n - 1) * F.lit(q)
            low = F.floor(place).cast("int")
            a, b = F.element_at(gaps, low + 1), F.element_at(gaps, F.least(low + 2, n))
            return a + (b - a) * (place - low)

        def of_mean(mean: Column) -> Column:
            spread = F.sqrt(add(F.transform(gaps, lambda g: (g - mean) * (g - mean))) / n)
            return _let(spread, lambda std: F.struct(*[v.alias(c) for c, v in zip(GAPS, (
                mean, std, F.element_at(gaps, 1), F.element_at(gaps, -1), *[quartile(q) for q in (0.25, 0.5, 0.75)],
                F.when(mean > 0, std / mean).otherwise(0.0)))]))

        return F.when(n > 0, _let(add(gaps) / n, of_mean)).otherwise(F.struct(*[F.lit(0.0).alias(c) for c in GAPS]))

    def of_times(sorted_times: Column) -> Column:
        n = F.size(sorted_times) - 1
        gaps = F.zip_with(F.slice(sorted_times, F.lit(1), n), F.slice(sorted_times, F.lit(2), n), lambda a, b: b - a)
        return _let(F.sort_array(gaps), of_gaps)

    return _let(F.sort_array(times), of_times)


def stream_flows(packets: DataFrame, seconds: int = 1, tolerance: int = 2) -> DataFrame:
    """Directional flows of closed windows with all 25 statistics.

    A window closes once a packet `tolerance` seconds past its end is seen; later rows
    for it are dropped by Spark and reported by `late_rows` and the query progress.
    The gap statistics need the times in order: an open window keeps its flows' times.
    """
    start = F.floor(F.col("ts") / F.lit(float(seconds))) * F.lit(float(seconds))
    timed = with_event_time(packets).withColumn("bin", tenth_bin(F.col("ts") - start, seconds))
    flows = tumble(timed, seconds, f"{tolerance} seconds").groupBy("capture_id", *FLOW_IDENTITY, "window").agg(
        *mergeable_aggregates(), F.collect_list("ts").alias("_times"))
    flows = flows.withColumn("_gaps", gap_struct(F.col("_times")))
    return flows.select(
        "capture_id", _seconds(), *FLOW_IDENTITY, "window", *size_columns(), "_gaps.*", *bin_columns(),
        "first_packet_time", "event_id", "binary_label")


def late_rows(packets: DataFrame, tolerance: int = 2) -> DataFrame:
    """Packets that arrive (frame order) after their second was already closed."""
    second = F.floor("ts")
    seen = running_max(packets, ["capture_id"], ["frame_number"], second, "_latest")
    return seen.where(second < F.col("_latest") - tolerance).drop("_latest")


def refuse_late(dropped: int) -> None:
    """Raise when a finished query dropped rows behind its watermark."""
    if dropped:
        raise ValueError(f"{dropped} rows arrived later than the watermark allows")


def _apply(df: DataFrame, keys: list[str], fn, output: str, state: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(fn, output, state, "append", GroupStateTimeout.NoTimeout)


def _ordered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    # Rows of one key in the windows that closed in this trigger.
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


PEER_OUTPUT = "capture_id string, src_ip string, role int, dst_ip string, timestamp_second long, flows long, new_peer boolean"


PEER = ["capture_id", "src_ip", "role", "dst_ip"]


def peer_cells(packets: DataFrame, seconds: int, role, tolerance: int = 2) -> DataFrame:
    """First stage: packets per host, role, peer and closed window."""
    rows = tumble(with_event_time(packets).withColumn("role", role), seconds, f"{tolerance} seconds")
    return rows.groupBy(*PEER, "window").agg(F.count(F.lit(1)).alias("flows")).select(*PEER, _seconds(), "flows")


def stream_new_peers(cells: DataFrame) -> DataFrame:
    """Peers per host, role and second, with a flag for peers never met before.

    State is one flag per (host, role, peer), so a busy host is spread over its peers.
    """

    def fold(key, batches, state: GroupState):
        known = state.exists
        data = _ordered(batches, ["timestamp_second"])
        first = [not known] + [False] * (len(data) - 1)
        state.update((True,))
        yield data.assign(new_peer=first)[[c.split()[0] for c in PEER_OUTPUT.split(", ")]]

    return _apply(cells, PEER, fold, PEER_OUTPUT, "met boolean")


PAIR_HISTORY_OUTPUT = (
    "capture_id string, pair array<string>, window_index long, first_row long, embedding array<double>, local_score double, "
    "reliability double, pair_mean array<double>, rate double"
)


def pair_cells(rows: DataFrame, seconds: int, tolerance: int = 2) -> DataFrame:
    """First stage: equal rows of a pair merged per closed window.

    rows: event_time, capture_id, endpoint_a_ip, endpoint_b_ip, embedding, local_score, row_id.
    """
    keys = ["capture_id", "pair"]
    named = rows.withColumn("pair", pair_key(F.col("endpoint_a_ip"), F.col("endpoint_b_ip")))
    cells = tumble(named, seconds, f"{tolerance} seconds").groupBy(*keys, "window", "embedding", "local_score").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("first_row"))
    index = (F.unix_seconds("window.start") / seconds).cast("long").alias("window_index")
    return cells.select(*keys, index, "embedding", "local_score", "copies", "first_row")


def stream_pair_history(cells: DataFrame, rule: HistoryRule) -> DataFrame:
    """Reads and commits of every closed window per pair; commits (rate not null) feed `stream_entity_history`."""
    columns = [c.split()[0] for c in PAIR_HISTORY_OUTPUT.split(", ")]

    def fold(key, batches, state: GroupState):
        mean, count, seen = state.get if state.exists else (None, 1.0, 0)
        memory = PairMemory(rule, None if mean is None else np.asarray(mean, dtype=np.float64), count, seen)
        out = []
        for window, group in _ordered(batches, ["window_index", "first_row"]).groupby("window_index", sort=True):
            prior = None if memory.mean is None else memory.mean.tolist()
            vectors = np.array(group["embedding"].tolist(), dtype=np.float64)
            trusts = memory.read_all(vectors, group["local_score"].to_numpy(), group["copies"].to_numpy(np.float64))
            out += [(key[0], list(key[1]), window, first, list(vector), score, float(trust), prior, None) for first, vector, score, trust in zip(
                group["first_row"], vectors.tolist(), group["local_score"], trusts)]
            update = memory.commit()
            if update is not None:
                out.append((key[0], list(key[1]), window, int(group["first_row"].min()), update[1].tolist(), None, None, None, update[0]))
        state.update((None if memory.mean is None else memory.mean.tolist(), memory.count, memory.observations))
        yield pd.DataFrame(out, columns=columns)

    return _apply(cells, ["capture_id", "pair"], fold, PAIR_HISTORY_OUTPUT, "mean array<double>, count double, observations long")


ENTITY_HISTORY_OUTPUT = "capture_id string, entity string, window_index long, entity_mean array<double>, observations long"


def stream_entity_history(commits: DataFrame, rule: HistoryRule) -> DataFrame:
    """Entity state before each window, from the commits of `stream_pair_history` in window order."""
    spread = commits.where("rate IS NOT NULL").select(
        "capture_id", F.explode(F.array_distinct("pair")).alias("entity"), "window_index", "first_row", "rate", F.col("embedding").alias("mean"))

    def fold(key, batches, state: GroupState):
        mean, seen = state.get if state.exists else (None, 0)
        memory = EntityMemory(rule.global_mean, None if mean is None else np.asarray(mean, dtype=np.float64), seen)
        out = []
        for window, group in _ordered(batches, ["window_index", "first_row"]).groupby("window_index", sort=True):
            out.append((key[0], key[1], window, None if memory.mean is None else memory.mean.tolist(), memory.observations))
            for r in group.itertuples(index=False):
                memory.commit(r.rate, np.asarray(r.mean, dtype=np.float64))
        state.update((None if memory.mean is None else memory.mean.tolist(), memory.observations))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTITY_HISTORY_OUTPUT.split(", ")])

    return _apply(spread, ["capture_id", "entity"], fold, ENTITY_HISTORY_OUTPUT, "mean array<double>, observations long")


INTENSITY_OUTPUT = (
    "capture_id string, node string, direction int, timestamp_second long, behaviour int, flows double, packets double, bytes double, "
    "history_length long, mass_raw double"
)


def activity_cells(flows: DataFrame, seconds: int, tolerance: int = 2, event_time: str = "event_time") -> DataFrame:
    """First stage: activity mass of every closed second.

    flows: event_time, capture_id, src_ip, dst_ip, behaviour, packet_count, byte_count.
    """
    ends = F.array(
        F.struct(F.col("src_ip").alias("node"), F.lit(0).alias("direction")),
        F.struct(F.col("dst_ip").alias("node"), F.lit(1).alias("direction")))
    rows = flows.select(event_time, "capture_id", "behaviour", "packet_count", "byte_count", F.inline(ends))
    cells = tumble(rows, seconds, f"{tolerance} seconds", event_time).groupBy("capture_id", "node", "direction", "window", "behaviour").agg(
        F.count(F.lit(1)).cast("double").alias("flows"), F.sum("packet_count").cast("double").alias("packets"),
        F.sum("byte_count").cast("double").alias("bytes"))
    return cells.select("capture_id", "node", "direction", _seconds(), F.col("behaviour").cast("int").alias("behaviour"), *RESOURCES)


def stream_intensity(cells: DataFrame, seconds: int, span: int, floor: float = 0.15) -> DataFrame:
    """Score each closed second of a node against its past, then append it to the past.

    State per node: birth and the cells of the last `span` ticks; silent ticks are zeros.
    """

    def fold(key, batches, state: GroupState):
        birth, past = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        data = _ordered(batches, ["timestamp_second"])
        out = []
        for second, group in data.groupby("timestamp_second", sort=True):
            birth = second if birth is None else birth
            past = [p for p in past if p[0] >= second - span * seconds]
            length = min(span, (second - birth) // seconds)
            fresh = []
            for r in group.itertuples(index=False):
                logs = np.log1p([r.flows, r.packets, r.bytes])
                same = [p for p in past if p[1] == r.direction and p[2] == r.behaviour]
                score = 0.0
                if length > 0:
                    total = np.sum([p[3:] for p in same], axis=0) if same else np.zeros(3)
                    squares = np.sum(np.square([p[3:] for p in same]), axis=0) if same else np.zeros(3)
                    mean = total / length
                    std = np.maximum(floor, np.sqrt(np.maximum(0.0, squares / length - mean * mean)))
                    score = float(np.mean(0.5 * ((logs - mean) / std) ** 2 + np.log(std) + 0.5 * math.log(2 * math.pi)))
                out.append((key[0], key[1], r.direction, second, r.behaviour, r.flows, r.packets, r.bytes, length, score))
                fresh.append((int(second), int(r.direction), int(r.behaviour), *map(float, logs)))
            past += fresh
        state.update((int(birth), past))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in INTENSITY_OUTPUT.split(", ")])

    cell = "struct<second: long, direction: int, behaviour: int, flows: double, packets: double, bytes: double>"
    return _apply(cells, ["capture_id", "node"], fold, INTENSITY_OUTPUT, f"birth long, past array<{cell}>")


_CLOCK = "new_connection boolean, gap_valid boolean, gap double, gap_predecessor long"
CONNECTION_OUTPUT = (
    "capture_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, behaviour int, "
    "event_id long, first_packet_time double, " + _CLOCK
)
FRESH_OUTPUT = "capture_id string, src_ip string, dst_ip string, behaviour int, event_id long, first_packet_time double, " + _CLOCK


_CLOCK_STATE = "time double, event long, pending array<struct<event_id: long, first_packet_time: double, behaviour: int>>"


def _clock_fold(output: str, start_new: bool):
    columns = [c.split()[0] for c in output.split(", ")]
    fields = ["event_id", "first_packet_time", "behaviour"]

    def fold(key, batches, state: GroupState):
        time, event, held = state.get if state.exists else (None, -1, [])
        rows = [tuple(r) for r in held]
        for batch in batches:
            batch = batch if start_new else batch.assign(behaviour=key[-1])
            rows += batch[fields].itertuples(index=False, name=None)
        whole = lambda v: None if pd.isna(v) else int(v)
        rows = [(int(e), float(t), whole(b)) for e, t, b in rows if pd.notna(e) and pd.notna(t)]
        rows.sort(key=lambda r: (r[1], r[0]))
        mark, out = state.getCurrentWatermarkMs(), []
        ready = sum(t * 1000 < mark for _, t, _ in rows)  # nothing earlier can still come
        for number, t, behaviour in rows[:ready]:
            fresh = time is None if start_new else True
            out.append((*key, *((behaviour,) if start_new else ()), number, t, fresh, time is not None, 0.0 if time is None else t - time, event))
            time, event = t, number
        rest = rows[ready:]
        state.update((time, event, rest))
        if rest:
            state.setTimeoutTimestamp(max(int(rest[0][1] * 1000) + 1, mark + 1))
        yield pd.DataFrame(out, columns=columns)

    return fold


def _clocks(events: DataFrame, keys: list[str], tolerance: str, output: str, start_new: bool) -> DataFrame:
    times = events.withColumn("event_time", F.timestamp_micros((F.col("first_packet_time") * 1e6 + 0.5).cast("long"))).withWatermark("event_time", tolerance)
    slim = times.select(*keys, *([F.col("behaviour").cast("int").alias("behaviour")] if start_new else []), "event_id", "first_packet_time", "event_time")
    return slim.groupBy(*keys).applyInPandasWithState(
        _clock_fold(output, start_new), output, _CLOCK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_connection_clocks(events: DataFrame, tolerance: str = "2 seconds") -> DataFrame:
    """Clock of every event against its own connection; new ones go on to `stream_fresh_clocks`.

    An event waits in its connection's state until the watermark has passed it, so events come
    out in order of time whatever trigger brought them; what is held is what `tolerance` spans.
    Later ones are dropped by Spark and reported in the query progress.
    """
    return _clocks(events, ["capture_id", *FLOW_IDENTITY], tolerance, CONNECTION_OUTPUT, True)


def stream_fresh_clocks(clocked: DataFrame, tolerance: str = "2 seconds") -> DataFrame:
    """Clock of new connections against the previous new one of source, destination and behaviour, in order of time as above."""
    return _clocks(clocked.where("new_connection"), ["capture_id", "src_ip", "dst_ip", "behaviour"], tolerance, FRESH_OUTPUT, False)


# Python workers get the folds by value, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
