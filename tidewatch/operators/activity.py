"""Activity mass of nodes, its strictly past history, and the way back to flows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.keys import FLOW_IDENTITY
from tidewatch.functions.vectors import total, vector_sum
from tidewatch.operators.ordered import group_totals, last_known, previous_row, trailing_window
from tidewatch.session import shared_stage

UNIT = ["capture_id", "node", "direction"]
CELL = [*UNIT, "timestamp_second", "behaviour"]
RESOURCES = ["flows", "packets", "bytes"]
SENDER, RECEIVER = 0, 1


def activity(flows: DataFrame) -> DataFrame:
    """Flows, packets and bytes per node, direction, second and behaviour.

    Every flow counts at its sender and at its receiver, so each total is twice
    the input; only active cells exist.
    """
    ends = F.array(
        F.struct(F.col("src_ip").alias("node"), F.lit(SENDER).alias("direction")),
        F.struct(F.col("dst_ip").alias("node"), F.lit(RECEIVER).alias("direction")),
    )
    spread = flows.select("capture_id", "timestamp_second", "behaviour", "packet_count", "byte_count", F.inline(ends))
    return spread.groupBy(*CELL).agg(
        F.count(F.lit(1)).cast("double").alias("flows"), F.sum("packet_count").cast("double").alias("packets"),
        F.sum("byte_count").cast("double").alias("bytes"))


def activity_mean(cells: DataFrame) -> DataFrame:
    """Divide by the flow count of the whole node, direction and second."""
    with_size = group_totals(cells, [*UNIT, "timestamp_second"], {"_size": F.sum("flows")})
    size = F.greatest(F.lit(1.0), F.col("_size"))
    return with_size.withColumns({r: F.col(r) / size for r in RESOURCES}).drop("_size")


def history_length(cells: DataFrame, span: int, tick: int = 1) -> DataFrame:
    """Ticks of history each cell can look back on: min(span, time since the node first appeared)."""
    born = cells.groupBy("capture_id", "node").agg(F.min("timestamp_second").alias("birth"))
    age = ((F.col("timestamp_second") - F.col("birth")) / tick).cast("long")
    return cells.join(born, ["capture_id", "node"]).withColumn("history_length", F.least(F.lit(span), age))


def history_sums(cells: DataFrame, span: int, tick: int = 1) -> DataFrame:
    """Sum and square sum of each log resource of the same cell over the past `span` ticks."""
    timed = cells.withColumn("_t", F.floor(F.col("timestamp_second") / tick).cast("long"))
    sums = {f"past_{r}": F.sum(F.log1p(r)) for r in RESOURCES}
    sums |= {f"past2_{r}": F.sum(F.log1p(r) * F.log1p(r)) for r in RESOURCES}
    out = trailing_window(timed, [*UNIT, "behaviour"], "_t", span, sums)
    return out.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in sums}).drop("_t")


def history(cells: DataFrame, span: int, behaviours: int, tick: int = 1) -> DataFrame:
    """Per node, direction and second: the dense past of all behaviour channels, oldest first.

    Each entry has behaviours x 3 values; silent ticks after birth are true zeros,
    ticks before birth are absent. At most `span` entries are listed.
    """
    channels = [F.sum(F.when(F.col("behaviour") == b, F.col(r)).otherwise(0.0)) for b in range(behaviours) for r in RESOURCES]
    units = cells.groupBy(*UNIT, "timestamp_second").agg(F.array(*channels).alias("now"))
    units = history_length(units, span, tick).withColumn("_t", F.floor(F.col("timestamp_second") / tick).cast("long"))
    listed = trailing_window(units, UNIT, "_t", span, {"_past": F.collect_list(F.struct("_t", "now"))})
    zero = F.array_repeat(F.lit(0.0), 3 * behaviours)
    at = F.sequence(F.col("_t") - F.col("history_length"), F.col("_t") - 1)
    filled = F.transform(at, lambda t: F.coalesce(F.try_element_at(F.map_from_entries("_past"), t), zero))
    none = F.array().cast("array<array<double>>")
    return listed.withColumn("history", F.when(F.col("history_length") > 0, filled).otherwise(none)).drop("_past", "_t")


def intensity_score(cells: DataFrame, span: int, floor: float = 0.15, tick: int = 1) -> DataFrame:
    """Mean NLL of the log resources under the past mean and deviation of the same cell.

    Silent ticks after birth count as zero through the divisor. A cell without any
    history has no reference and scores 0.
    """
    past = history_sums(history_length(cells, span, tick), span, tick)
    n = F.greatest(F.lit(1), F.col("history_length"))
    parts = []
    for r in RESOURCES:
        mean = F.col(f"past_{r}") / n
        std = F.greatest(F.lit(float(floor)), F.sqrt(F.greatest(F.lit(0.0), F.col(f"past2_{r}") / n - mean * mean)))
        z = (F.log1p(r) - mean) / std
        parts.append(0.5 * z * z + F.log(std) + 0.9189385332046727)
    score = F.when(F.col("history_length") > 0, (parts[0] + parts[1] + parts[2]) / 3).otherwise(0.0)
    return past.withColumn("mass_raw", score).drop(*[f"past_{r}" for r in RESOURCES], *[f"past2_{r}" for r in RESOURCES])


def group_to_flow(flows: DataFrame, cells: DataFrame, values: Sequence[str]) -> DataFrame:
    """Values of the sender cell and of the receiver cell on every flow."""
    for direction, column, tag in ((SENDER, "src_ip", "sender"), (RECEIVER, "dst_ip", "receiver")):
        side = cells.where(F.col("direction") == direction).select(
            "capture_id", F.col("node").alias(column), "timestamp_second", "behaviour", *[F.col(v).alias(f"{tag}_{v}") for v in values])
        flows = flows.join(side, ["capture_id", column, "timestamp_second", "behaviour"])
    return flows


def group_attacks(flows: DataFrame) -> DataFrame:
    """Attack flows per cell and whether the cell is mixed."""
    ends = F.array(
        F.struct(F.col("src_ip").alias("node"), F.lit(SENDER).alias("direction")),
        F.struct(F.col("dst_ip").alias("node"), F.lit(RECEIVER).alias("direction")))
    spread = flows.select("capture_id", "timestamp_second", "behaviour", "binary_label", F.inline(ends))
    cells = spread.groupBy(*CELL).agg(F.count(F.lit(1)).alias("cell_flows"), F.sum("binary_label").cast("long").alias("attack_flows"))
    return cells.withColumn("mixed", (F.col("attack_flows") > 0) & (F.col("attack_flows") < F.col("cell_flows")))


def repetition_audit(cells: DataFrame, multipliers: Sequence[int] = (1, 2, 10, 100, 1000)) -> DataFrame:
    """Repeat the current activity: mass grows with the multiplier, the mean variant must not move."""
    means = activity_mean(cells).select(*CELL, *[F.col(r).alias(f"mean_{r}") for r in RESOURCES])
    sized = group_totals(cells, [*UNIT, "timestamp_second"], {"_size": F.sum("flows")}).join(means, CELL)
    spread = sized.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    size = F.greatest(F.lit(1.0), F.col("_size") * F.col("multiplier"))
    return spread.select(
        *CELL, "multiplier", *[(F.col(r) * F.col("multiplier")).alias(f"mass_{r}") for r in RESOURCES],
        *[(F.col(r) * F.col("multiplier") / size - F.col(f"mean_{r}")).alias(f"mean_shift_{r}") for r in RESOURCES])


# Behaviour-weighted bins -----------------------------------------------------

SECOND = ["capture_id", "timestamp_second"]


def second_bins(flows: DataFrame, behaviours: int) -> DataFrame:
    """Per second and bin: behaviour-weighted flow starts, packets and bytes."""
    cells = F.arrays_zip("bin_packets", "bin_bytes")
    long = flows.select(*SECOND, "phi", "first_bin", F.posexplode(cells).alias("bin", "cell"))
    start = F.when(F.col("bin") == F.col("first_bin"), 1.0).otherwise(0.0)
    return long.groupBy(*SECOND, "bin").agg(
        vector_sum(F.col("phi"), behaviours, start).alias("starts"),
        vector_sum(F.col("phi"), behaviours, F.col("cell.bin_packets")).alias("packets"),
        vector_sum(F.col("phi"), behaviours, F.col("cell.bin_bytes")).alias("bytes"))


def behaviour_bins(flows: DataFrame, behaviours: int, key: Sequence[str]) -> DataFrame:
    """What the other flows of the second do in each bin, weighted by behaviour similarity."""
    bins = second_bins(flows, behaviours)
    packed = bins.groupBy(*SECOND).agg(F.array_sort(F.collect_list(F.struct("bin", "starts", "packets", "bytes"))).alias("_bins"))
    joined = flows.join(packed, SECOND).select(
        *key, "phi", "first_bin", "bin_packets", "bin_bytes", F.explode("_bins").alias("c"))
    seen = lambda name: total(F.zip_with("phi", F.col(f"c.{name}"), lambda p, t: p * t))
    own_start = F.when(F.col("c.bin") == F.col("first_bin"), 1.0).otherwise(0.0)
    rest = lambda value, own: F.greatest(F.lit(0.0), value - own)
    return joined.select(
        *key, F.col("c.bin").alias("bin"), rest(seen("starts"), own_start).alias("starts"),
        rest(seen("packets"), F.get("bin_packets", F.col("c.bin"))).alias("packets"),
        rest(seen("bytes"), F.get("bin_bytes", F.col("c.bin"))).alias("bytes"))


def second_runs(flows: DataFrame, behaviours: int, tick: int = 1) -> DataFrame:
    """Fixed-length summary of every busy second and the number of silent seconds just before it."""
    weights = lambda w: [F.sum(F.get("phi", k) * w) for k in range(behaviours)]
    packets, size = total(F.col("bin_packets")), total(F.col("bin_bytes"))
    values = [*weights(F.lit(1.0)), *weights(packets), *weights(size), F.count(F.lit(1)).cast("double"), F.sum(packets), F.sum(size)]
    values += [F.count_if(F.col("first_bin") == b).cast("double") for b in range(10)]
    values += [F.sum(F.get(c, b)) for c in ("bin_packets", "bin_bytes") for b in range(10)]
    busy = flows.groupBy("capture_id", F.floor(F.col("timestamp_second") / tick).alias("t")).agg(F.array(*values).alias("summary"))
    runs = previous_row(busy, ["capture_id"], ["t"], ["t"], "_last")
    return runs.withColumn("silent", F.coalesce(F.col("t") - F.col("_last.t") - 1, F.lit(0))).drop("_last")


def second_summary(flows: DataFrame, behaviours: int, tick: int = 1, piece: int = 4096) -> DataFrame:
    """Summary of every second of a capture; silent seconds are zero rows.

    A silent run is cut into pieces that are spread over the tasks before they become rows. A
    use that can take runs as they are reads `second_runs`.
    """
    runs = shared_stage(second_runs(flows, behaviours, tick))
    first = F.col("t") - F.col("silent")
    starts = runs.where("silent > 0").select("capture_id", F.col("t").alias("_end"), F.explode(F.sequence(first, F.col("t") - 1, F.lit(piece).cast("long"))).alias("_from"))
    spread = starts.repartition("capture_id", "_from")
    silent = spread.select("capture_id", F.explode(F.sequence("_from", F.least(F.col("_end"), F.col("_from") + piece) - 1)).alias("t"))
    zero = F.array_repeat(F.lit(0.0), 3 * behaviours + 33)
    return runs.select("capture_id", "t", "summary").unionByName(silent.withColumn("summary", zero))


def decayed_history(summary: DataFrame, width: int, taus: Sequence[float], span: int, block: int = 1024) -> DataFrame:
    """Read before update: decayed activity and exposure per tau, and the last `span` summaries.

    Sums are rebased per block of seconds. Earlier blocks enter through one decayed
    row each; beyond 745 tau their weight is zero in double precision, so the list of
    earlier blocks is short and nothing is cut off.
    """
    summary = shared_stage(summary)  # one row per second, read by the branches below
    origin = summary.groupBy("capture_id").agg(F.min("t").alias("_start"))
    timed = summary.join(origin, "capture_id").withColumns({
        "_block": F.floor((F.col("t") - F.col("_start")) / block), "_in": (F.col("t") - F.col("_start")) % block})
    inside = Window.partitionBy("capture_id", "_block").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    parts = {}
    for i, tau in enumerate(taus):
        grown = F.exp(F.col("_in") / float(tau))
        shrunk = F.exp(-(F.col("_in") - 1) / float(tau))
        parts[f"_local{i}"] = F.array(*[
            F.coalesce(F.sum(F.get("summary", k) * grown).over(inside), F.lit(0.0)) * shrunk for k in range(width)])
    local = timed.withColumns(parts)
    ends = timed.groupBy("capture_id", "_block").agg(*[
        vector_sum(F.col("summary"), width, F.exp((F.col("_in") - (block - 1)) / float(tau))).alias(f"_end{i}") for i, tau in enumerate(taus)])
    reach = max(1, int(745 * max(taus) // block) + 2)
    listed = F.collect_list(F.struct(F.col("_block").alias("b"), *[F.col(f"_end{i}").alias(f"e{i}") for i in range(len(taus))]))
    carried = trailing_window(ends, ["capture_id"], "_block", reach, {"_earlier": listed}).select("capture_id", "_block", "_earlier")
    out = local.join(carried, ["capture_id", "_block"])
    age = F.col("t") - F.col("_start")
    zero = F.array_repeat(F.lit(0.0), width)

    def carried_in(i: int, tau: float) -> Column:
        # An earlier block ends (own - b - 1) * block + in + 1 seconds before this second.
        def add(acc: Column, e: Column) -> Column:
            gap = (F.col("_block") - e["b"] - 1) * block + F.col("_in")
            return F.zip_with(acc, e[f"e{i}"], lambda a, x: a + x * F.exp(-gap / tau))

        return F.aggregate("_earlier", zero, add)

    for i, tau in enumerate(map(float, taus)):
        out = out.withColumns({
            f"activity_{i}": F.zip_with(F.col(f"_local{i}"), carried_in(i, tau), lambda a, b: a + b),
            f"exposure_{i}": (1 - F.exp(-age / tau)) / (1 - F.exp(F.lit(-1 / tau))),
        })
    out = out.drop("_earlier", "_block", "_in", "_start", *[f"_local{i}" for i in range(len(taus))])
    recent = trailing_window(out, ["capture_id"], "t", span, {"_recent": F.collect_list(F.struct("t", "summary"))})
    return recent.withColumn("recent", F.transform(F.array_sort("_recent"), lambda r: r["summary"])).drop("_recent")


# Event clocks -----------------------------------------------------------------

def event_clocks(events: DataFrame, banned: Column | None = None) -> DataFrame:
    """New-connection flag, gap and predecessor of each event.

    A known connection is measured from its previous event; a new one from the
    previous new connection of the same source, destination and behaviour. A banned
    event reads the clocks but does not move them.
    """
    counted = F.lit(True) if banned is None else ~banned
    order = ["first_packet_time", "event_id"]
    mark = F.when(counted, F.struct(F.col("first_packet_time").alias("time"), F.col("event_id").alias("event")))
    events = events.withColumn("_counted", counted)
    known = last_known(events, ["capture_id", *FLOW_IDENTITY], order, {"_own": mark})
    known = known.withColumn("new_connection", F.col("_own").isNull())
    again = F.when(F.col("_counted"), F.struct(F.col("first_packet_time").alias("time"), F.col("event_id").alias("event")))
    fresh = last_known(known.where("new_connection"), ["capture_id", "src_ip", "dst_ip", "behaviour"], order, {"_prior": again})
    older = known.where("NOT new_connection").withColumn("_prior", F.col("_own"))
    both = fresh.unionByName(older)
    return both.withColumns({
        "gap_valid": F.col("_prior").isNotNull(), "gap": F.coalesce(F.col("first_packet_time") - F.col("_prior.time"), F.lit(0.0)),
        "gap_predecessor": F.coalesce("_prior.event", F.lit(-1).cast("long")),
    }).drop("_own", "_prior", "_counted")
