"""Incidence counts, private chains, relation samples and donors of flow events.

Events that share an endpoint are never paired up. Each role of an endpoint is a
numbered sequence; a target knows its range in that sequence from per-second
counts, draws positions in the range, and fetches exactly the drawn events.

events: capture_id, event_id, timestamp_second, src_ip, src_port, dst_ip, dst_port,
protocol, first_packet_time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.vectors import squared_distance
from tidewatch.operators.ordered import row_positions, running_sums, trailing_window
from tidewatch.session import shared_stage

# Role relations of a candidate to the target's endpoints.
SAME_SOURCE, SAME_DESTINATION, INTO_SOURCE, OUT_OF_DESTINATION = 0, 1, 2, 3
RELATIONS = {SAME_SOURCE: ("src", "src"), SAME_DESTINATION: ("dst", "dst"), INTO_SOURCE: ("dst", "src"), OUT_OF_DESTINATION: ("src", "dst")}
TARGET = ["capture_id", "event_id"]
LANE = ["capture_id", "key", "chain"]  # an excluded chain inside an endpoint sequence


def with_chains(events: DataFrame) -> DataFrame:
    """Endpoint, connection and reverse-connection keys."""
    side = lambda s: F.concat_ws(":", f"{s}_ip", F.col(f"{s}_port").cast("string"))
    return events.withColumns({"src": side("src"), "dst": side("dst")}).withColumns({
        "connection": F.concat_ws(">", "src", "dst", "protocol"), "reverse": F.concat_ws(">", "dst", "src", "protocol")})


def spans(sequence: DataFrame, requests: DataFrame, history: int, slice_seconds: int = 1) -> DataFrame:
    """For each (capture, key, second) asked: entries before the second, in the history, and in the second.

    Both tables have capture_id, key, timestamp_second; the work is on per-second counts.
    """
    cell = ["capture_id", "key", "timestamp_second"]
    counts = sequence.groupBy(*cell).agg(F.count(F.lit(1)).alias("now"))
    asked = requests.select(*cell).distinct().withColumn("now", F.lit(0).cast("long"))
    merged = counts.unionByName(asked).groupBy(*cell).agg(F.sum("now").alias("now"))
    merged = running_sums(merged, ["capture_id", "key"], ["timestamp_second"], {"before": F.col("now")})
    merged = merged.withColumn("_t", F.floor(F.col("timestamp_second") / slice_seconds).cast("long"))
    out = trailing_window(merged, ["capture_id", "key"], "_t", history, {"past": F.sum("now")})
    return out.select(*cell, "before", "now", F.coalesce("past", F.lit(0)).alias("past"))


def _role_sequence(chained: DataFrame) -> DataFrame:
    """Every event twice: in the sequence of its source and of its destination endpoint."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.concat_ws("@", F.lit(r), r).alias("key")) for r in ("src", "dst")])
    return chained.select("capture_id", "event_id", "timestamp_second", "connection", "reverse", "first_packet_time", F.inline(roles))


def _requests(chained: DataFrame) -> DataFrame:
    """One row per target and relation: the sequence it looks into and the chain it must not use."""
    rows = F.array(*[
        F.struct(F.lit(rel).alias("relation"), F.concat_ws("@", F.lit(role), F.col(end)).alias("key"),
                 (F.col("connection") if rel in (SAME_SOURCE, SAME_DESTINATION) else F.col("reverse")).alias("chain"))
        for rel, (role, end) in RELATIONS.items()])
    return chained.select(*TARGET, "timestamp_second", (F.col("src") == F.col("dst")).alias("loop"), F.inline(rows))


def relation_spans(events: DataFrame, history: int, slice_seconds: int = 1) -> DataFrame:
    """Per target and relation: range in the endpoint sequence and in the excluded chain, and both counts.

    A target's own chain lies inside relations 0 and 1, its reverse chain inside 2 and 3;
    when source and destination endpoint coincide both chains are the same.
    """
    chained = with_chains(events)
    asked = _requests(chained)
    sequence = _role_sequence(chained)
    ends = spans(sequence, asked, history, slice_seconds)
    chain_rows = chained.select("capture_id", F.col("connection").alias("key"), "timestamp_second")
    chains = spans(chain_rows, asked.select("capture_id", F.col("chain").alias("key"), "timestamp_second"), history, slice_seconds)
    chains = chains.select("capture_id", F.col("key").alias("chain"), "timestamp_second",
                           F.col("before").alias("chain_before"), F.col("past").alias("chain_past"))
    out = asked.join(ends, ["capture_id", "key", "timestamp_second"]).join(chains, ["capture_id", "chain", "timestamp_second"])
    own_now = F.when((F.col("relation") <= SAME_DESTINATION) | F.col("loop"), 1).otherwise(0)
    return out.withColumns({
        "historical_count": F.col("past") - F.col("chain_past"), "current_count": F.col("now") - own_now})


def incident_counts(events: DataFrame, history: int, slice_seconds: int = 1) -> DataFrame:
    """Candidates per target and relation in the history and in the same slice."""
    return relation_spans(shared_stage(events), history, slice_seconds).select(*TARGET, "relation", "historical_count", "current_count")


def private_chain(events: DataFrame, history: int, own: int = 8, reverse: int = 4, slice_seconds: int = 1) -> DataFrame:
    """Last `own` events of the same connection and last `reverse` of the reverse one, before this second.

    An event is listed once; on a self-addressed connection the own list goes first.
    """
    events = shared_stage(events)  # read by the sequence, the requests and the result
    chained = with_chains(events)
    sequence = chained.select("capture_id", F.col("connection").alias("key"), "timestamp_second", "event_id", "first_packet_time")
    placed = row_positions(sequence, ["capture_id", "key"], ["timestamp_second", "event_id"], "at")
    sides = F.array(F.struct(F.lit("own").alias("side"), F.col("connection").alias("key")),
                    F.struct(F.lit("reverse").alias("side"), F.col("reverse").alias("key")))
    asked = chained.select(*TARGET, "timestamp_second", (F.col("src") == F.col("dst")).alias("loop"), F.inline(sides))
    ranged = asked.join(spans(sequence, asked, history, slice_seconds), ["capture_id", "key", "timestamp_second"])
    high = F.col("before") - F.when((F.col("side") == "reverse") & F.col("loop"), F.least(F.col("past"), F.lit(own))).otherwise(0)
    width = F.when(F.col("side") == "own", own).otherwise(reverse)
    low = F.greatest(F.col("before") - F.col("past"), high - width)
    picked = ranged.where(high > low).withColumn("at", F.explode(F.sequence(low, high - 1)))
    found = placed.select("capture_id", "key", "at", F.col("event_id").alias("neighbor"), F.col("first_packet_time").alias("neighbor_time"),
                          F.col("timestamp_second").alias("neighbor_second"))
    return picked.join(found, ["capture_id", "key", "at"]).select(*TARGET, "side", "neighbor", "neighbor_time", "neighbor_second")


def edge_dt(edges: DataFrame, times: DataFrame, private: bool) -> DataFrame:
    """log1p(dt) / log(65); a private edge is measured from the newest past event, not from the target."""
    if private:
        newest = edges.groupBy(*TARGET).agg(F.max("neighbor_time").alias("_origin"))
        dt = F.greatest(F.lit(0.0), F.col("_origin") - F.col("neighbor_time"))
    else:
        newest = times.select(*TARGET, F.col("first_packet_time").alias("_origin"))
        dt = F.abs(F.col("_origin") - F.col("neighbor_time"))
    return edges.join(newest, TARGET).withColumn("dt", F.log1p(dt) / F.log(F.lit(65.0))).drop("_origin")


def draw(seed: int, *parts: Column) -> Column:
    """A number of 60 bits from the MD5 of seed and parts: any SQL engine draws the same."""
    named = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _distinct_ranks(size: Column, most: Column, seed: int, *parts: Column) -> Column:
    """min(most, size) distinct ranks below `size`, in seeded order, each subset equally likely."""
    def choose(chosen: Column, j: Column) -> Column:
        candidate = F.pmod(draw(seed, *parts, j), j + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, candidate), j).otherwise(candidate)))

    empty = F.array().cast("array<bigint>")
    some = F.aggregate(F.sequence(size - most, size - 1), empty, choose)
    subset = F.when(size <= 0, empty).when(size <= most, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(some)
    mixed = F.transform(subset, lambda r: F.struct(draw(seed + 1, *parts, r).alias("h"), r.alias("r")))
    return F.transform(F.array_sort(mixed), lambda s: s["r"])


def sample_relations(events: DataFrame, k: int, history: int, seed: int, current: bool = False, slice_seconds: int = 1) -> DataFrame:
    """Up to k candidates per target and relation, uniform without replacement, seeded per event.

    A candidate taken by an earlier relation is not taken again. Relation r draws
    (r + 1) k ranks in random order, skips the taken ones (at most r k) and keeps the
    first k: a uniform draw from the remaining pool, and full whenever the pool is.
    """
    events = shared_stage(events)  # read by four branches below
    chained = with_chains(events)
    sequence = _role_sequence(chained)
    placed = row_positions(sequence, ["capture_id", "key"], ["timestamp_second", "event_id"], "at")
    asked = relation_spans(events, history, slice_seconds)
    size = F.col("current_count") if current else F.col("historical_count")
    most = ((F.col("relation") + 1) * k).cast("long")
    ranks = _distinct_ranks(size, most, seed, F.col("event_id"), F.col("relation"), F.lit("c" if current else "h"))
    drawn = asked.where(size > 0).select("*", F.posexplode(ranks).alias("turn", "rank"))
    if current:
        own = placed.select("capture_id", "key", "event_id", F.col("at").alias("own_at"))
        drawn = drawn.join(own, ["capture_id", "key", "event_id"], "left")
        at = F.col("before") + F.col("rank")
        # Skip the target's own place when it lies in this sequence.
        located = drawn.withColumn("at", F.when(F.col("own_at").isNotNull() & (at >= F.col("own_at")), at + 1).otherwise(at))
    else:
        located = _skip_chain(drawn, placed)
    found = placed.select("capture_id", "key", "at", F.col("event_id").alias("neighbor"),
                          F.col("first_packet_time").alias("neighbor_time"), F.col("timestamp_second").alias("neighbor_second"))
    edges = located.join(found, ["capture_id", "key", "at"]).select(
        *TARGET, "relation", "turn", "neighbor", "neighbor_time", "neighbor_second")
    return _first_free(edges, k)


def _skip_chain(drawn: DataFrame, placed: DataFrame) -> DataFrame:
    """Turn a rank among the events outside the excluded chain into a sequence position.

    A chain event at position p with chain index c has p - c foreign events before it.
    The drawn rank g has as many chain events before it as have p - c <= g: a running
    count along the merged order of chain events and draws.
    """
    ranked = drawn.withColumn("g", F.col("before") - F.col("past") - (F.col("chain_before") - F.col("chain_past")) + F.col("rank"))
    # A chain in an endpoint sequence consists of the events of one connection there.
    members = placed.select("capture_id", "key", F.col("connection").alias("chain"), "at", "timestamp_second", "event_id")
    indexed = row_positions(members, LANE, ["timestamp_second", "event_id"], "c")
    marks = indexed.select(*LANE, (F.col("at") - F.col("c")).alias("g"), F.lit(0).alias("kind"), F.col("event_id").alias("tie"),
                           F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("int").alias("relation"), F.lit(None).cast("int").alias("turn"))
    asked = ranked.select(*LANE, "g", F.lit(1).alias("kind"), F.col("event_id").alias("tie"), "event_id", "relation", "turn")
    merged = running_sums(marks.unionByName(asked), LANE, ["g", "kind", "tie", "relation", "turn"], {"skipped": (F.col("kind") == 0).cast("long")})
    return merged.where("kind = 1").withColumn("at", F.col("g") + F.col("skipped"))


def _first_free(edges: DataFrame, k: int) -> DataFrame:
    """Per target, walk the relations in order and keep the first k draws not taken before.

    A target has at most 10k drawn edges; without a repeated neighbour no walk is needed.
    """
    edge = F.struct("relation", "turn", "neighbor", "neighbor_time", "neighbor_second")
    listed = edges.groupBy(*TARGET).agg(F.array_sort(F.collect_list(edge)).alias("_e"))
    kind = "array<struct<relation: int, turn: int, neighbor: bigint, neighbor_time: double, neighbor_second: bigint>>"
    def take(kept: Column, e: Column) -> Column:
        taken = F.exists(kept, lambda x: x["neighbor"] == e["neighbor"])
        full = F.size(F.filter(kept, lambda x: x["relation"] == e["relation"])) >= k
        return F.when(taken | full, kept).otherwise(F.concat(kept, F.array(e)))
    every = F.col("_e").cast(kind)
    repeated = F.size(F.array_distinct(F.transform("_e", lambda e: e["neighbor"]))) < F.size("_e")
    chosen = F.when(repeated, F.aggregate(every, F.array().cast(kind), take)).otherwise(F.filter(every, lambda e: e["turn"] < k))
    return listed.select(*TARGET, F.inline(chosen)).drop("turn")


def donors(events: DataFrame, private: DataFrame, clocks: DataFrame, vector: str, seed: int, choices: int = 32, block: int = 10) -> DataFrame:
    """Two donors per target with private history: one random, one nearest of `choices` others.

    Donors have private history, the same newness and another time block. The pool of
    one newness is numbered by block, so the own block is one range to step over.
    """
    armed = private.select(*TARGET).distinct()
    origin = events.agg(F.min("timestamp_second")).scalar()
    pool = events.join(armed, TARGET).join(clocks.select(*TARGET, "new_connection"), TARGET)
    pool = pool.withColumn("block", F.floor((F.col("timestamp_second") - origin) / block))
    pool = shared_stage(pool.select(*TARGET, "new_connection", "block", vector))  # read by four branches below
    placed = row_positions(pool, ["new_connection"], ["block", *TARGET], "at")
    blocks = placed.groupBy("new_connection", "block").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("width"))
    sizes = placed.groupBy("new_connection").agg(F.count(F.lit(1)).alias("pool"))
    asked = placed.join(blocks, ["new_connection", "block"]).join(sizes, "new_connection")
    free = F.col("pool") - F.col("width")
    ranks = _distinct_ranks(free, F.lit(choices + 1).cast("long"), seed, F.col("capture_id"), F.col("event_id"))
    drawn = asked.where(free > 0).select(
        *TARGET, "new_connection", F.col(vector).alias("_own"), "low", "width", F.posexplode(ranks).alias("turn", "rank"))
    at = F.when(F.col("rank") < F.col("low"), F.col("rank")).otherwise(F.col("rank") + F.col("width"))
    found = placed.select("new_connection", "at", F.struct("capture_id", "event_id").alias("donor"), F.col(vector).alias("_other"), F.col("block").alias("donor_block"))
    pairs = drawn.withColumn("at", at).join(found, ["new_connection", "at"])
    distance = squared_distance(F.col("_own"), F.col("_other"))
    return pairs.groupBy(*TARGET).agg(
        F.max(F.when(F.col("turn") == 0, F.col("donor"))).alias("random_donor"),
        F.min_by("donor", F.when(F.col("turn") > 0, F.struct(distance, F.col("turn")))).alias("nearest_donor"),
        F.count(F.lit(1)).alias("drawn"))
