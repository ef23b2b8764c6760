"""Context of a flow: entity states, scopes, behaviour composition, hosts and relations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import FLOW_IDENTITY, channel_id, pair_key
from tidewatch.functions.vectors import dot, norm, total, vector_mean, vector_sum
from tidewatch.operators.ordered import exact_quantiles, group_totals, previous_row, running_sums, trailing_window

WINDOW_KEY = ["capture_id", "window_index"]


def with_scopes(flows: DataFrame) -> DataFrame:
    """Scopes of a flow: its IP pair and its one or two entities (a self-loop has one)."""
    return flows.withColumns({
        "pair": pair_key(F.col("endpoint_a_ip"), F.col("endpoint_b_ip")),
        "entities": F.array_distinct(F.array("endpoint_a_ip", "endpoint_b_ip")),
    })


def memberships(flows: DataFrame) -> DataFrame:
    """One row per flow and entity."""
    return with_scopes(flows).withColumn("entity", F.explode("entities")).drop("entities")


def _sides(flows: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Join a per-entity table to both endpoints as entity_a_* and entity_b_*."""
    for side, column in (("a", "endpoint_a_ip"), ("b", "endpoint_b_ip")):
        renamed = table.select(
            *[F.col(k) for k in keys], F.col("entity").alias(column),
            *[F.col(v).alias(f"entity_{side}_{v}") for v in values],
        )
        flows = flows.join(renamed, [*keys, column], "left")
    return flows


def entity_state(flows: DataFrame, modes: int, dims: int | None = None) -> DataFrame:
    """Per capture, entity and window: flows, packets, bytes, mode histogram, mean embedding."""
    histogram = F.array(*[F.count_if(F.col("mode_id") == m).cast("double") for m in range(modes)])
    extra = [] if dims is None else [vector_mean(F.col("embedding"), dims).alias("mean_embedding")]
    return memberships(flows).groupBy("capture_id", F.col("entity"), "window_index").agg(
        F.count(F.lit(1)).alias("flow_count"), F.sum("packet_count").alias("packet_count"),
        F.sum("byte_count").alias("byte_count"), histogram.alias("mode_counts"), *extra,
    )


def entity_history(state: DataFrame, windows: int, modes: int, dims: int | None = None) -> DataFrame:
    """The `windows` states before each state, oldest first, zero where there was none."""
    parts = [F.array(*[F.col(c).cast("double") for c in ("flow_count", "packet_count", "byte_count")]), F.col("mode_counts")]
    if dims is not None:
        parts.append(F.col("mean_embedding"))
    width = 3 + modes + (dims or 0)
    rows = state.withColumn("state", F.concat(*parts))
    # At most `windows` rows fall into the frame, so the list is short.
    past = trailing_window(
        rows, ["capture_id", "entity"], "window_index", windows,
        {"_past": F.collect_list(F.struct("window_index", "state"))},
    )
    zero = F.array_repeat(F.lit(0.0), width)
    at = F.sequence(F.col("window_index") - windows, F.col("window_index") - 1)
    return past.withColumn(
        "history", F.transform(at, lambda w: F.coalesce(F.try_element_at(F.map_from_entries("_past"), w), zero))
    ).drop("_past")


def edge_states(flows: DataFrame, state: DataFrame) -> DataFrame:
    """Links from each flow to the state rows of its endpoints."""
    return _sides(flows, state, WINDOW_KEY, ["flow_count"])


def local_reliability(score: Column, alpha: float, floor: float) -> Column:
    clipped = F.least(F.lit(50.0), F.greatest(F.lit(0.0), score))
    return F.greatest(F.lit(float(floor)), F.exp(-F.lit(float(alpha)) * clipped))


def spatial_context(flows: DataFrame, dims: int, alpha: float, floor: float) -> DataFrame:
    """Reliability-weighted mean embedding of the other flows at each endpoint."""
    rows = flows.withColumn("reliability", local_reliability(F.col("local_score"), alpha, floor))
    sums = memberships(rows).groupBy(*WINDOW_KEY, "entity").agg(
        F.sum("reliability").alias("weight"), F.count(F.lit(1)).alias("members"),
        vector_sum(F.col("embedding"), dims, F.col("reliability")).alias("mass"),
    )
    out = _sides(rows, sums, WINDOW_KEY, ["weight", "members", "mass"])
    zero = F.array_repeat(F.lit(0.0), dims)
    for side in "ab":
        rest = F.col(f"entity_{side}_weight") - F.col("reliability")
        others = F.zip_with(
            F.col(f"entity_{side}_mass"), F.col("embedding"), lambda s, x: (s - F.col("reliability") * x) / rest)
        out = out.withColumns({
            f"context_{side}": F.when(rest > 1e-12, others).otherwise(zero),
            f"context_{side}_count": F.greatest(F.lit(0), F.col(f"entity_{side}_members") - 1),
        }).drop(f"entity_{side}_weight", f"entity_{side}_members", f"entity_{side}_mass")
    return out


def composition(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows per (window, pair, mode) and per (window, entity, mode)."""
    pairs = with_scopes(flows).groupBy(*WINDOW_KEY, "pair", "mode_id").agg(F.count(F.lit(1)).alias("mode_count"))
    entities = memberships(flows).groupBy(*WINDOW_KEY, "entity", "mode_id").agg(F.count(F.lit(1)).alias("mode_count"))
    return pairs, entities


def _fit_scope(counts: DataFrame, windows: DataFrame, scope: str, modes: int, use_log: bool) -> DataFrame:
    value = F.log1p(F.col("mode_count").cast("double")) if use_log else F.col("mode_count").cast("double")
    first = [F.sum(F.when(F.col("mode_id") == m, value).otherwise(0.0)) for m in range(modes)]
    second = [F.sum(F.when(F.col("mode_id") == m, value * value).otherwise(0.0)) for m in range(modes)]
    sums = counts.groupBy(scope).agg(F.array(*first).alias("_s"), F.array(*second).alias("_q"))
    sums = sums.withColumn("samples", windows.agg(F.count(F.lit(1))).scalar())
    mean = F.transform("_s", lambda s: s / F.col("samples"))
    variance = lambda s, q: F.greatest(F.lit(0.0), q / F.col("samples") - (s / F.col("samples")) * (s / F.col("samples")))
    return sums.select(scope, mean.alias("mean"), F.zip_with("_s", "_q", lambda s, q: F.sqrt(variance(s, q))).alias("std"), "samples")


def fit_composition(flows: DataFrame, modes: int = 10, use_log: bool = True) -> tuple[DataFrame, DataFrame]:
    """Mean and deviation of (log) counts per scope and mode over all windows.

    Silent windows count as zero through the divisor; no zero row is made.
    """
    pairs, entities = composition(flows)
    windows = flows.select(*WINDOW_KEY).distinct()
    return _fit_scope(pairs, windows, "pair", modes, use_log), _fit_scope(entities, windows, "entity", modes, use_log)


def _deviation(count: Column, mean: Column, std: Column, use_log: bool, epsilon: float, positive: bool) -> Column:
    value = F.log1p(count.cast("double")) if use_log else count.cast("double")
    at = lambda a: F.get(a, F.col("mode_id").cast("int"))
    deviation = (value - at(mean)) / (at(std) + F.lit(float(epsilon)))
    return F.coalesce(F.greatest(F.lit(0.0), deviation) if positive else F.abs(deviation), F.lit(0.0))


def score_composition(
    flows: DataFrame, reference: tuple[DataFrame, DataFrame],
    use_log: bool = True, epsilon: float = 1e-3, positive: bool = True,
) -> DataFrame:
    """Deviation of the flow's own mode in its pair and entities; unseen scopes score 0."""
    pairs, entities = composition(flows)
    pair_ref, entity_ref = reference
    score = lambda c, m, s: _deviation(F.col(c), F.col(m), F.col(s), use_log, epsilon, positive)
    pair_scored = pairs.join(pair_ref, "pair", "left").select(
        *WINDOW_KEY, "pair", "mode_id", F.col("mode_count").alias("pair_mode_count"),
        score("mode_count", "mean", "std").alias("pair_deviation"),
    )
    entity_scored = entities.join(entity_ref, "entity", "left").select(
        *WINDOW_KEY, "entity", "mode_id", "mode_count", score("mode_count", "mean", "std").alias("deviation"),
    )
    out = with_scopes(flows).join(pair_scored, [*WINDOW_KEY, "pair", "mode_id"])
    out = _sides(out, entity_scored, [*WINDOW_KEY, "mode_id"], ["mode_count", "deviation"])
    entity = F.greatest("entity_a_deviation", "entity_b_deviation")
    return out.withColumns({
        "entity_deviation": entity, "context_deviation": F.greatest(F.col("pair_deviation"), entity),
    })


def soft_mass(flows: DataFrame, channels: int) -> DataFrame:
    """log1p of the soft mass the other flows share with this one, per pair and entity."""
    scoped = with_scopes(flows)
    own = F.col("assignment")
    pair_sums = scoped.groupBy(*WINDOW_KEY, "pair").agg(vector_sum(own, channels).alias("_pair_sum"))
    entity_sums = memberships(flows).groupBy(*WINDOW_KEY, "entity").agg(vector_sum(own, channels).alias("sum"))
    out = _sides(scoped.join(pair_sums, [*WINDOW_KEY, "pair"]), entity_sums, WINDOW_KEY, ["sum"])
    shared = lambda s: F.log1p(F.greatest(F.lit(0.0), dot(own, F.zip_with(s, own, lambda t, w: t - w))))
    return out.withColumns({
        "pair_log_mass": shared(F.col("_pair_sum")),
        "entity_a_log_mass": shared(F.col("entity_a_sum")), "entity_b_log_mass": shared(F.col("entity_b_sum")),
    }).drop("_pair_sum", "entity_a_sum", "entity_b_sum")


def excess_energy(observed: Column, mean: Column, log_scale: Column) -> Column:
    """One-sided energy: traffic below expectation is not anomalous."""
    excess = F.greatest(F.lit(0.0), (observed - mean) * F.exp(-log_scale))
    return F.lit(0.5) * excess * excess


def gaussian_nll(observed: Column, mean: Column, log_scale: Column) -> Column:
    z = (observed - mean) * F.exp(-log_scale)
    return F.lit(0.5) * z * z + log_scale


def assignment_entropy(weights: Column) -> Column:
    clipped = F.transform(weights, lambda w: F.least(F.lit(1.0), F.greatest(F.lit(1e-12), w)))
    return -total(F.transform(clipped, lambda w: w * F.log(w)))


def channel_profile(rows: DataFrame, channel: str, vector: str, dims: int, time: str, tie: str) -> DataFrame:
    """Per channel: mean, std, median and quartiles of every dimension, log count, log-gap median and std."""
    long = rows.select(channel, F.posexplode(vector).alias("dim", "value"))
    moments = long.groupBy(channel, "dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    quartiles = exact_quantiles(long, [channel, "dim"], "value", {"p50": 0.5, "p25": 0.25, "p75": 0.75})
    gaps = previous_row(rows.select(channel, time, tie), [channel], [time, tie], [time], "_prev")
    gaps = gaps.withColumn("log_gap", F.log1p((F.col(time) - F.col(f"_prev.{time}")).cast("double")))
    spread = gaps.groupBy(channel).agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("log_count"), F.coalesce(F.stddev_pop("log_gap"), F.lit(0.0)).alias("gap_std"))
    middle = exact_quantiles(gaps, [channel], "log_gap", {"gap_median": 0.5})
    per_channel = spread.join(middle, channel, "left").withColumn("gap_median", F.coalesce("gap_median", F.lit(0.0)))
    return moments.join(quartiles, [channel, "dim"]).join(per_channel, channel)


HOST_GROUP = ["capture_id", "timestamp_second", "src_ip", "role"]

# The ten host-role measures in their published order.
HOST_MEASURES = [
    "flow_count", "total_bytes", "total_packets", "mean_bytes", "std_bytes",
    "mean_packets", "std_packets", "unique_peers", "unique_ports", "new_peers",
]


def _host_parts(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows per (group, peer) with the newness of the peer, and per (group, port)."""
    peers = flows.groupBy(*HOST_GROUP, "dst_ip").agg(F.count(F.lit(1)).alias("peer_flows"))
    first = peers.groupBy("capture_id", "src_ip", "role", "dst_ip").agg(F.min("timestamp_second").alias("_first"))
    peers = peers.join(first, ["capture_id", "src_ip", "role", "dst_ip"]).withColumn(
        "new_peer", F.col("_first") == F.col("timestamp_second")).drop("_first")
    ports = flows.groupBy(*HOST_GROUP, "dst_port").agg(F.count(F.lit(1)).alias("port_flows"))
    return peers, ports


def host_context(flows: DataFrame) -> DataFrame:
    """Ten measures per capture, second, source host and role; a new peer was never met before that second."""
    peers, ports = _host_parts(flows)
    base = flows.groupBy(*HOST_GROUP).agg(
        F.count(F.lit(1)).alias("flow_count"), F.sum("byte_count").alias("total_bytes"), F.sum("packet_count").alias("total_packets"),
        F.avg("byte_count").alias("mean_bytes"), F.stddev_pop("byte_count").alias("std_bytes"),
        F.avg("packet_count").alias("mean_packets"), F.stddev_pop("packet_count").alias("std_packets"),
    )
    met = peers.groupBy(*HOST_GROUP).agg(F.count(F.lit(1)).alias("unique_peers"), F.count_if("new_peer").alias("new_peers"))
    used = ports.groupBy(*HOST_GROUP).agg(F.count(F.lit(1)).alias("unique_ports"))
    return base.join(met, HOST_GROUP).join(used, HOST_GROUP)


CONTRIBUTIONS = ["q_flow", "q_bytes", "q_packets", "q_peer", "q_port", "q_new_peer"]
RESPONSIBLE = ["flow_count", "total_bytes", "total_packets", "unique_peers", "unique_ports", "new_peers"]


def contributions(flows: DataFrame) -> DataFrame:
    """Share of each flow in six of the group measures."""
    peers, ports = _host_parts(flows)
    out = flows.join(peers, [*HOST_GROUP, "dst_ip"]).join(ports, [*HOST_GROUP, "dst_port"])
    return out.withColumns({
        "q_flow": F.lit(1.0), "q_bytes": F.col("byte_count").cast("double"), "q_packets": F.col("packet_count").cast("double"),
        "q_peer": 1.0 / F.col("peer_flows"), "q_port": 1.0 / F.col("port_flows"),
        "q_new_peer": F.when(F.col("new_peer"), 1.0 / F.col("peer_flows")).otherwise(0.0),
    }).drop("peer_flows", "port_flows", "new_peer")


def fit_context_stats(contexts: DataFrame) -> DataFrame:
    """Per role: mean and deviation (at least 1e-6) of the six responsible measures."""
    return contexts.groupBy("role").agg(
        F.count(F.lit(1)).alias("groups"),
        F.array(*[F.avg(c) for c in RESPONSIBLE]).alias("residual_mean"),
        F.array(*[F.greatest(F.lit(1e-6), F.stddev_pop(c)) for c in RESPONSIBLE]).alias("residual_std"),
    ).where("groups >= 2")


def responsibility(contributed: DataFrame, contexts: DataFrame, stats: DataFrame) -> DataFrame:
    """Cosine of the flow's contribution and the group's positive residual, in [0, 1]."""
    values = F.array(*[F.col(c).cast("double") for c in RESPONSIBLE])
    z = F.zip_with(F.zip_with(values, "residual_mean", lambda x, m: x - m), "residual_std", lambda d, s: d / s)
    residual = contexts.join(stats, "role", "left").select(
        *HOST_GROUP, F.transform(z, lambda v: F.greatest(F.lit(0.0), v)).alias("_residual"))
    out = contributed.join(residual, HOST_GROUP)
    q = F.array(*CONTRIBUTIONS)
    scale = norm(q) * norm(F.col("_residual"))
    cosine = F.when(scale > 0, dot(q, F.col("_residual")) / scale).otherwise(0.0)
    return out.withColumn("responsibility", F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))).drop("_residual")


def cohort_context(flows: DataFrame) -> DataFrame:
    """Host context per joint role and regime."""
    joint = F.col("role") * 16 + F.col("regime")
    return host_context(flows.withColumn("role", joint)).withColumnRenamed("role", "cohort")


def backoff(
    train: DataFrame, calibration: DataFrame, *, min_cell_train: int, min_cell_calibration: int,
    min_role_train: int, min_role_calibration: int,
) -> DataFrame:
    """Model level per trained cohort: its own cell, its role, or the global model."""
    support = lambda df, name: df.groupBy("cohort").agg(F.count(F.lit(1)).alias(name))
    cells = support(train, "cell_train").join(support(calibration, "cell_calibration"), "cohort", "full").fillna(0)
    cells = cells.withColumn("role", F.floor(F.col("cohort") / 16))
    cells = group_totals(cells, ["role"], {"role_train": F.sum("cell_train"), "role_calibration": F.sum("cell_calibration")})
    own = (F.col("cell_train") >= min_cell_train) & (F.col("cell_calibration") >= min_cell_calibration)
    parent = (F.col("role_train") >= min_role_train) & (F.col("role_calibration") >= min_role_calibration)
    return cells.where("cell_train > 0").withColumn("level", F.when(own, "cell").when(parent, "role").otherwise("global"))


def backoff_level(contexts: DataFrame, choices: DataFrame) -> DataFrame:
    """Level to score each cohort with; cohorts never trained use the global model."""
    return contexts.join(choices.select("cohort", "level"), "cohort", "left").withColumn("level", F.coalesce("level", F.lit("global")))


RELATION = ["src_ip", "dst_ip", "protocol"]
RELATION_SETS = {
    "pair": RELATION, "src_port": [*RELATION, "src_port"], "dst_port": [*RELATION, "dst_port"],
    "protocol": ["protocol"], "protocol_src_port": ["protocol", "src_port"], "protocol_dst_port": ["protocol", "dst_port"],
}


def relation_counts(benign: DataFrame) -> DataFrame:
    """Flow counts at six granularities in one pass."""
    columns = [*RELATION, "src_port", "dst_port"]
    level = F.grouping_id()
    codes = {}
    for name, keys in RELATION_SETS.items():
        codes[name] = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
    counted = benign.groupingSets([[F.col(k) for k in keys] for keys in RELATION_SETS.values()], *[F.col(c) for c in columns]).agg(
        level.alias("_code"), F.count(F.lit(1)).alias("flows"))
    name = F.lit(None).cast("string")
    for n, code in codes.items():
        name = F.when(F.col("_code") == code, n).otherwise(name)
    return counted.withColumn("granularity", name).drop("_code")


def relation_lookup(flows: DataFrame, counts: DataFrame) -> DataFrame:
    """The six benign counts of each flow's relation, zero where never seen or where a key is null.

    Distinct relations are listed once a granularity, meet the counts in one join and come
    back as one row each, so the flows themselves move once, whatever the granularities.
    """
    columns = [*RELATION, "src_port", "dst_port"]
    names = list(RELATION_SETS)
    masked = lambda n, keys: F.struct(
        F.lit(n).alias("granularity"), *[F.when(F.lit(c in keys), F.col(c)).alias(f"_{c}") for c in columns])
    level = lambda n, keys: F.when(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda known: known), masked(n, keys))
    relations = flows.select(*columns).distinct()
    asked = relations.select("*", F.explode(F.array_compact(F.array(*[level(n, k) for n, k in RELATION_SETS.items()]))).alias("_level")).select(
        *columns, "_level.*")
    same = F.col("a.granularity") == F.col("c.granularity")
    for c in columns:
        same = same & F.col(f"a._{c}").eqNullSafe(F.col(f"c.{c}"))
    found = asked.alias("a").join(counts.alias("c"), same).select(*[f"a.{c}" for c in columns], "a.granularity", "c.flows")
    wide = found.groupBy(*columns).agg(
        *[F.sum(F.when(F.col("granularity") == n, F.col("flows"))).alias(f"n_{n}") for n in names])
    near = [F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in columns]
    out = flows.alias("f").join(wide.alias("w"), near, "left")
    return out.select("f.*", *[F.coalesce(f"w.n_{n}", F.lit(0)).alias(f"n_{n}") for n in names])


def relation_surprise(flows: DataFrame, counts: DataFrame) -> DataFrame:
    """log1p(reference) - log1p(familiar); an unseen pair backs off to its protocol."""
    out = relation_lookup(flows, counts)
    known = F.col("n_pair") > 0
    reference = F.when(known, F.col("n_pair")).otherwise(F.col("n_protocol"))
    familiar = F.when(known, F.greatest("n_src_port", "n_dst_port")).otherwise(F.greatest("n_protocol_src_port", "n_protocol_dst_port"))
    return out.withColumns({
        "relation_seen_count": familiar,
        "relation_raw": F.log1p(reference.cast("double")) - F.log1p(familiar.cast("double")),
    }).drop(*[f"n_{n}" for n in RELATION_SETS])


def service_recency(flows: DataFrame) -> DataFrame:
    """How familiar a host-peer service is inside its capture, strictly before this second."""
    peer = ["capture_id", "src_ip", "dst_ip", "protocol"]
    service = [*peer, "dst_port"]
    cells = flows.groupBy(*service, "timestamp_second").agg(F.count(F.lit(1)).alias("cell_flows"))
    seen = running_sums(cells, service, ["timestamp_second"], {"service_seen": F.col("cell_flows")})
    seen = previous_row(seen, service, ["timestamp_second"], ["timestamp_second"], "_prev")
    seconds = cells.groupBy(*peer, "timestamp_second").agg(
        F.sum("cell_flows").alias("peer_flows"), F.count(F.lit(1)).alias("peer_ports"))
    history = running_sums(seconds, peer, ["timestamp_second"], {"peer_seen": F.col("peer_flows")})
    out = seen.join(history, [*peer, "timestamp_second"])
    return out.select(
        *service, "timestamp_second", "cell_flows", "service_seen",
        (F.col("timestamp_second") - F.col("_prev.timestamp_second")).alias("seconds_since_seen"),
        F.col("_prev").isNull().alias("new_service"),
        (F.col("peer_ports") / F.col("peer_flows")).alias("ports_per_flow"),
        F.when(F.col("peer_seen") > 0, F.col("service_seen") / F.col("peer_seen")).otherwise(0.0).alias("port_share"),
    )


def with_channels(flows: DataFrame, fields: Sequence[str] = FLOW_IDENTITY[:2]) -> DataFrame:
    return flows.withColumn("channel_id", channel_id(fields))
