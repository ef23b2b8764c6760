"""Named queries with the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CTES = {
    "packets": views.PACKETS_SQL,
    "eflows": views.EMBEDDING_FLOWS_SQL,
    "tied": views.TIED_SCORES_SQL,
    "docs": views.DOCUMENT_SCORES_SQL,
    "rel": views.RELATIONS_SQL,
}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# Rounding on a grid whose cell edges are off the decimal ties, so that sums
# taken in another order land in the same cell in both engines.
def grid(value, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value.cast("double") * F.lit(10.0**digits) + F.lit(0.5003)).cast("double") / F.lit(10.0**digits)


def grid_sql(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5003) / {scale})"


def grids(*names: str, digits: int = 6) -> list[Column]:
    return [grid(n, digits).alias(n) for n in names]


def grids_sql(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{grid_sql(n, digits)} AS {n}" for n in names)


IDENTITY_SQL = "src_ip, dst_ip, src_port, dst_port, protocol"


def _flow_ctes(prefix: str, window: int) -> dict[str, str]:
    key = f"capture_id, timestamp_second, {IDENTITY_SQL}"
    bytes_in = ", ".join(f"coalesce(sum(CASE WHEN bin = {b} THEN wire_length END), 0)::DOUBLE" for b in range(10))
    packets_in = ", ".join(f"count(*) FILTER (WHERE bin = {b})::DOUBLE" for b in range(10))
    return {
        f"{prefix}_gaps": f"""
SELECT *, ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, frame_number) AS gap
FROM (SELECT *, CAST(floor(ts / {window}.0) AS BIGINT) * {window} AS timestamp_second,
        CAST(greatest(0, least(9, floor((ts - floor(ts / {window}.0) * {window}.0) * 10.0 / {window}.0))) AS INT) AS bin
      FROM packets WHERE protocol IN ('tcp', 'udp'))""",
        f"{prefix}_raw": f"""
SELECT {key}, count(*)::DOUBLE AS packet_count, sum(wire_length)::DOUBLE AS byte_count,
  max(ts) - min(ts) AS active_duration, avg(wire_length) AS packet_len_mean,
  stddev_pop(wire_length) AS packet_len_std, min(wire_length)::DOUBLE AS packet_len_min,
  max(wire_length)::DOUBLE AS packet_len_max,
  quantile_cont(wire_length, 0.25) AS packet_len_p25, quantile_cont(wire_length, 0.5) AS packet_len_p50,
  quantile_cont(wire_length, 0.75) AS packet_len_p75,
  coalesce(avg(gap), 0) AS iat_mean, coalesce(stddev_pop(gap), 0) AS iat_std,
  coalesce(min(gap), 0) AS iat_min, coalesce(max(gap), 0) AS iat_max,
  coalesce(quantile_cont(gap, 0.25), 0) AS iat_p25, coalesce(quantile_cont(gap, 0.5), 0) AS iat_p50,
  coalesce(quantile_cont(gap, 0.75), 0) AS iat_p75,
  CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) ELSE 0 END AS iat_cv,
  count(DISTINCT bin)::DOUBLE AS active_bin_count,
  [{bytes_in}] AS bin_bytes, [{packets_in}] AS bin_packets,
  max(binary_label) AS binary_label, min(frame_number) AS event_id, min(ts) AS first_ts
FROM {prefix}_gaps GROUP BY ALL""",
        prefix: f"""
SELECT *, list_avg(bin_bytes) AS bin_bytes_mean, list_stddev_pop(bin_bytes) AS bin_bytes_std,
  list_max(bin_bytes) AS bin_bytes_max, list_avg(bin_packets) AS bin_packets_mean,
  list_stddev_pop(bin_packets) AS bin_packets_std, list_max(bin_packets) AS bin_packets_max,
  row_number() OVER (PARTITION BY capture_id ORDER BY timestamp_second, {IDENTITY_SQL}) - 1 AS row_id
FROM {prefix}_raw""",
    }


_FLOW = _flow_ctes("flows", views.WINDOW)
_SHORT = _flow_ctes("sflows", views.SHORT_WINDOW)
_NEEDS = {
    "flows": ["packets", "flows_gaps", "flows_raw"], "sflows": ["packets", "sflows_gaps", "sflows_raw"],
}
CTES.update(_FLOW)
CTES.update(_SHORT)


def ctes(names: str, *more: tuple[str, str]) -> str:
    """WITH clause over named views (and what they need) followed by extra tables."""
    order: list[str] = []
    for n in names.split():
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    parts = [f"{n} AS ({CTES[n].strip()})" for n in order]
    parts += [f"{n} AS ({body.strip()})" for n, body in more]
    return "WITH " + ",\n".join(parts) + "\n"


def recursive_ctes(names: str, *more: tuple[str, str]) -> str:
    return ctes(names, *more).replace("WITH ", "WITH RECURSIVE ", 1)
