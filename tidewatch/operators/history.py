"""Read-then-commit history of pairs and entities.

Pairs come first: what a row weighs depends on the state its pair's earlier windows left, so
the windows of one pair are folded in order, each as one matrix, with a state of fixed size.
Rows with equal embedding and score inside a (pair, window) are merged with their
multiplicity before the shuffle. Entities are fed by one commit per pair and window, whose
rate is known by then; their states are a scan of affine maps over slices of time, so that an
entity in most rows is spread over all tasks.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import pair_key
from tidewatch.operators.ordered import SLICE, same_keys, slice_groups
from tidewatch.session import shared_stage


@dataclass(frozen=True)
class HistoryRule:
    alpha: float = 2.0
    min_reliability: float = 0.001
    history_beta: float = 1.0
    update_rate: float = 0.1
    multiplicity_gamma: float = 0.05
    global_mean: tuple[float, ...] = ()


class PairMemory:
    """State of one pair and the sums of its open window."""

    def __init__(self, rule: HistoryRule, mean=None, count: float = 1.0, observations: int = 0):
        self.rule, self.mean, self.count, self.observations = rule, mean, count, observations
        self.fallback = np.asarray(rule.global_mean, dtype=np.float64)
        self._open()

    def _open(self) -> None:
        self.weight, self.rows = 0.0, 0
        self.mass = np.zeros_like(self.fallback)

    def read_all(self, embeddings: np.ndarray, local_scores: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Reliability of rows of the open window, from the state before it."""
        rule = self.rule
        trust = np.exp(-rule.alpha * np.clip(local_scores, 0.0, 50.0))
        if self.mean is not None:
            trust = trust * np.exp(-rule.history_beta * np.minimum(np.mean((embeddings - self.mean) ** 2, axis=1), 50.0))
        reliability = np.maximum(rule.min_reliability, trust)
        self.weight += float(copies @ reliability)
        self.rows += int(copies.sum())
        self.mass = self.mass + (copies * reliability) @ embeddings
        return reliability

    def commit(self):
        """Close the window: (rate, mean) to hand to the entities, or None when it weighs nothing."""
        rule, update = self.rule, None
        if self.weight > 1e-12:
            mean = self.mass / self.weight
            gate = 1.0
            if self.mean is not None:
                excess = max(0.0, self.rows / max(self.count, 1.0) - 1.0)
                gate = float(np.exp(-rule.multiplicity_gamma * excess))
            rate = rule.update_rate * self.weight / self.rows * gate
            kept = float(np.clip(rate, 0.0, 1.0))
            base = self.fallback if self.mean is None else self.mean
            self.mean = (1.0 - kept) * base + kept * mean
            self.count = (1.0 - rate) * self.count + rate * self.rows
            self.observations += 1
            update = (rate, mean)
        self._open()
        return update


class EntityMemory:
    def __init__(self, fallback, mean=None, observations: int = 0):
        self.fallback, self.mean, self.observations = np.asarray(fallback, dtype=np.float64), mean, observations

    def commit(self, rate: float, value: np.ndarray) -> None:
        kept = float(np.clip(rate, 0.0, 1.0))
        base = self.fallback if self.mean is None else self.mean
        self.mean = (1.0 - kept) * base + kept * value
        self.observations += 1


WINDOW = ["capture_id", "window_index"]
PAIR_OUTPUT = (
    "scope string, pair array<string>, capture_id string, window_index long, first_row long, "
    "prior array<double>, rate double, mean array<double>"
)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fold_pairs(rule: HistoryRule):
    """State of a pair before each of its windows, and what the window commits; a window's rows are read as one matrix."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, memory, first = None, None, 0

        def close() -> tuple:
            prior = None if memory.mean is None else memory.mean.tolist()
            rate, mean = memory.commit() or (None, None)
            return (key[0], list(key[1]), key[2], key[3], first, prior, rate, None if mean is None else mean.tolist())

        for batch in batches:
            keys = list(zip(batch.column("scope").to_pylist(), map(tuple, batch.column("pair").to_pylist()),
                            batch.column("capture_id").to_pylist(), batch.column("window_index").to_pylist()))
            scores, copies, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("local_score", "copies", "first_row"))
            vectors, out, at = _matrix(batch.column("embedding")), [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != key:
                    if key is not None:
                        out.append(close())
                    if key is None or keys[at][:2] != key[:2]:
                        memory = PairMemory(rule)
                    key, first = keys[at], int(rows[at])
                first = min(first, int(rows[at:end].min()))
                memory.read_all(vectors[at:end], scores[at:end], copies[at:end].astype(np.float64))
                at = end
            yield _table(out, _PAIRS)
        if key is not None:
            yield _table([close()], _PAIRS)

    return fold


_VECTOR = pa.list_(pa.float64())
_PAIRS = pa.schema([("scope", pa.string()), ("pair", pa.list_(pa.string())), ("capture_id", pa.string()), ("window_index", pa.int64()),
                    ("first_row", pa.int64()), ("prior", _VECTOR), ("rate", pa.float64()), ("mean", _VECTOR)])
_SCAN = pa.schema([("scope", pa.string()), ("entity", pa.string()), ("capture_id", pa.string()), ("window_index", pa.int64()), (SLICE, pa.int32()),
                   ("kind", pa.int32()), ("scale", pa.float64()), ("shift", _VECTOR), ("seen", pa.int64())])
SCAN_OUTPUT = f"scope string, entity string, capture_id string, window_index long, {SLICE} int, kind int, scale double, shift array<double>, seen long"
START_OUTPUT = f"scope string, entity string, {SLICE} int, start array<double>, before long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _scan_slice(dims: int):
    """Within a slice: the map mean -> scale * mean + shift of an entity's commits so far, at each read and at the slice's end."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scale, shift, seen = None, 1.0, np.zeros(dims), 0
        end = lambda: (key[1], key[2], None, None, key[0], 1, scale, shift.tolist(), seen)
        for batch in batches:
            out = []
            slices, scopes, entities, captures, windows, kinds, rates, means = (
                batch.column(c).to_pylist() for c in (SLICE, "scope", "entity", "capture_id", "window_index", "kind", "rate", "mean"))
            for row, capture, window, kind, rate, mean in zip(zip(slices, scopes, entities), captures, windows, kinds, rates, means):
                if row != key:
                    if key is not None:
                        out.append(end())
                    key, scale, shift, seen = row, 1.0, np.zeros(dims), 0
                if kind == 0:
                    out.append((row[1], row[2], capture, window, row[0], 0, scale, shift.tolist(), seen))
                else:
                    kept = min(max(rate, 0.0), 1.0)
                    scale, shift, seen = (1.0 - kept) * scale, (1.0 - kept) * shift + kept * np.asarray(mean), seen + 1
            yield _table(out, _SCAN)
        if key is not None:
            yield _table([end()], _SCAN)

    return scan


def _starts(rule: HistoryRule):
    """Mean of an entity at the start of each of its slices; one row a slice, so a group is no longer than the list of slices."""
    def carry(ends: pd.DataFrame) -> pd.DataFrame:
        mean, seen, out = np.asarray(rule.global_mean, dtype=np.float64), 0, []
        for scope, entity, number, scale, shift, n in ends.sort_values(SLICE)[["scope", "entity", SLICE, "scale", "shift", "seen"]].itertuples(index=False):
            out.append((scope, entity, number, mean.tolist(), seen))
            mean, seen = scale * mean + np.asarray(shift), seen + n
        return pd.DataFrame(out, columns=["scope", "entity", SLICE, "start", "before"])

    return carry


def _keyed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def pair_states(rows: DataFrame, rule: HistoryRule) -> DataFrame:
    """One row per scope, pair and window: state before it (`prior`) and what it commits (`rate`, `mean`)."""
    merged = rows.groupBy("scope", "pair", *WINDOW, "embedding", "local_score").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("first_row"))
    return _keyed(merged, ["scope", "pair"], [*WINDOW, "first_row"]).mapInArrow(_fold_pairs(rule), PAIR_OUTPUT)


def entity_states(asked: DataFrame, commits: DataFrame, rule: HistoryRule) -> DataFrame:
    """Mean and number of commits of each asked entity before the window.

    The rate of a commit is known when it arrives, so it is an affine map of the mean, and
    maps compose: slices of (entity, time) are scanned on their own, one row per entity
    and slice carries the mean from slice to slice, and a hub is spread over all tasks.

    asked: scope, entity, capture_id, window_index. commits: also first_row, rate, mean.
    """
    keys = ["scope", "entity", *WINDOW]
    ask = asked.select(*keys, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("first_row"),
                       F.lit(None).cast("double").alias("rate"), F.lit(None).cast("array<double>").alias("mean"))
    told = commits.select(*keys, F.lit(1).alias("kind"), "first_row", "rate", "mean")
    order = [*WINDOW, "kind", "first_row"]
    sliced = slice_groups(ask.unionByName(told), ["scope", "entity"], order)
    scanned = shared_stage(_keyed(sliced, [SLICE], ["scope", "entity", *order]).mapInArrow(_scan_slice(len(rule.global_mean)), SCAN_OUTPUT))
    starts = scanned.where("kind = 1").groupBy("scope", "entity").applyInPandas(_starts(rule), START_OUTPUT)
    met = same_keys(scanned.where("kind = 0").drop("kind"), starts, ["scope", "entity", SLICE])
    mean = F.zip_with(F.transform("start", lambda m: m * F.col("scale")), "shift", lambda a, b: a + b)
    return met.select(*keys, mean.alias("entity_mean"), (F.col("before") + F.col("seen")).alias("observations"))


def historical_context(flows: DataFrame, rule: HistoryRule, reset_each_capture: bool = True) -> DataFrame:
    """Context of both endpoints from the state before the window, the flow's reliability, and observation counts.

    flows: capture_id, window_index, row_id, endpoint_a_ip, endpoint_b_ip, embedding, local_score.
    """
    scope = F.col("capture_id") if reset_each_capture else F.lit("all")
    rows = flows.withColumns({"scope": scope, "pair": pair_key(F.col("endpoint_a_ip"), F.col("endpoint_b_ip"))})
    states = shared_stage(pair_states(rows, rule))  # read by the flows and by the entities
    commits = states.where("rate IS NOT NULL").withColumn("entity", F.explode(F.array_distinct("pair")))
    asked = states.select("scope", F.explode(F.array_distinct("pair")).alias("entity"), *WINDOW).distinct()
    entities = entity_states(asked, commits, rule)
    # A row's reliability follows from its own values and the pair's state before the window.
    out = rows.join(states.select("scope", "pair", *WINDOW, F.col("prior").alias("pair_mean")), ["scope", "pair", *WINDOW])
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(50.0), F.col("local_score")))
    far = F.aggregate(F.zip_with("embedding", "pair_mean", lambda e, p: (e - p) * (e - p)), F.lit(0.0), lambda a, x: a + x) / F.size("embedding")
    trust = F.exp(-F.lit(rule.alpha) * clipped)
    trust = F.when(F.col("pair_mean").isNull(), trust).otherwise(trust * F.exp(-F.lit(rule.history_beta) * F.least(far, F.lit(50.0))))
    out = out.withColumn("reliability", F.greatest(F.lit(rule.min_reliability), trust))
    for side, column in (("a", "endpoint_a_ip"), ("b", "endpoint_b_ip")):
        state = entities.select("scope", F.col("entity").alias(column), *WINDOW, F.col("entity_mean").alias("_mean"), F.col("observations").alias(f"context_{side}_count"))
        out = out.join(state, ["scope", column, *WINDOW])
        mixed = F.zip_with("_mean", "pair_mean", lambda e, p: 0.5 * e + 0.5 * p)
        out = out.withColumn(f"context_{side}", F.when(F.col("pair_mean").isNotNull(), mixed).otherwise(F.col("_mean"))).drop("_mean")
    return out.drop("scope", "pair", "pair_mean")


# Python workers get the folds by value, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
