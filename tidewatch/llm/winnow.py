"""Document fingerprints by winnowing.

Every run of `k` code points is hashed; of each `window` consecutive hashes the smallest is
kept, the rightmost one of equal ones, together with its position. Two texts that share a
passage of window + k - 1 code points (23 with the defaults, at every text length) therefore
share a fingerprint. A text of fewer code points has the smallest hash of what it has; one shorter than k is hashed whole; an empty
text has none. A fingerprint is written as 16 hex digits a selection, hash and position,
separated by commas; likeness is the Jaccard coefficient of the distinct hashes, and 1 for
two texts without any.

For texts against their neighbours in descending doc_id, rows are dealt into ranges of
doc_id of about equal size (bounded in number, so the list of limits is small), each range
gets the first text of the next one as a guest, and a task runs through its ranges in order
with one text in hand. Null doc_ids come last; equal ones are ordered by a hash of the text.
A single document is its own next.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import text_of
from tidewatch.llm.words import mixed

GRAM, WINDOW = 8, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64(2**32 - 1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0][:n], _powers[1][:n]


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes, in the upper half of 64 bits, of every run of k code points."""
    n = len(points)
    k = min(k, n)
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * up, out=total[1:])
    return mixed((total[k:] - total[:n - k + 1]) * down[:n - k + 1] + np.uint64(k)) & ~_LOW


def winnow(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the selections, by position."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    h = rolling(points, k)
    h |= _LOW - np.arange(len(h), dtype=np.uint64)  # of equal hashes the later one is smaller
    w, size = min(window, len(h)), 1
    last = len(h) - w + 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    h = np.minimum(h[:last], h[w - size:w - size + last])
    h = h[np.r_[True, h[1:] != h[:-1]]]
    return (h >> np.uint64(32)).astype(np.uint32), (_LOW - (h & _LOW)).astype(np.uint32)


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    return np.stack([hashes, places], 1).astype(">u4").tobytes().hex(",", 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id and an array of (hash, place) of every text."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int64())]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"hash": int(h), "place": int(p)} for h, p in zip(*winnow(t.as_py() or "", k, window))] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(make, "doc_id long, fingerprint array<struct<hash:long,place:long>>")


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _ranges(rows: DataFrame, range_chars: int, most_ranges: int) -> DataFrame:
    """Add _r, the range of doc_id, descending; null ids are in the last one."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = min(most_ranges, max(1, -(-chars // range_chars)))
    cuts = np.zeros(0, np.int64)
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0] or [], np.int64))
    sent, last = rows.sparkSession.sparkContext.broadcast(cuts), len(cuts) + 1

    @F.pandas_udf("int")
    def number(ids):
        out = np.full(len(ids), last, np.int64)
        some = ids.notna().to_numpy()
        out[some] = len(sent.value) - np.searchsorted(sent.value, ids[some].astype("int64").to_numpy(), "right")
        import pandas as pd
        return pd.Series(out)

    return rows.withColumn("_r", number("doc_id"))


def with_next(docs: DataFrame, range_chars: int = 8 << 20, most_ranges: int = 50_000, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = _ranges(rows, range_chars, most_ranges)
    # First of each range: the largest doc_id, of equal ones the smallest tie.
    heads = rows.groupBy("_r").agg(F.min_by(F.struct("doc_id", "_tie"), F.struct((-F.col("doc_id")).alias("i"), "_tie")).alias("h"), F.max("doc_id").alias("_top"))
    heads = sorted((r["_r"], r["h"]["doc_id"], r["h"]["_tie"]) for r in heads.select("_r", "h").collect())
    to = {r: heads[i - 1][0] for i, (r, _, _) in enumerate(heads)}  # a range's first text goes to the range before it
    spark = docs.sparkSession
    guests = spark.createDataFrame([(i, t, to[r]) for r, i, t in heads], "_i long, _t long, _to int")
    meet = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t"))
    guests = rows.join(F.broadcast(guests), meet).dropDuplicates(["_i", "_t"]).select("doc_id", "text", "_tie", F.col("_to").alias("_r"), F.lit(1).alias("_g"))
    dealt = rows.select("doc_id", "text", "_tie", "_r", F.lit(0).alias("_g")).union(guests)
    # As many partitions as ranges: a task gets a few ranges of bounded size, whatever the table's size.
    dealt = dealt.repartition(max(1, len(heads)), "_r").sortWithinPartitions("_r", "_g", F.col("doc_id").desc_nulls_last(), "_tie")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for r, guest, key, text in zip(batch.column("_r").to_pylist(), batch.column("_g").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                print_ = winnow(text, k, window)
                if held is not None:
                    old_key, old, old_print = held
                    changed = edited(old, text)
                    new_print = winnow(changed, k, window)
                    out.append((old_key, len(old), hashlib.sha256(changed.encode()).hexdigest(), written(*old_print), written(*new_print),
                                likeness(old_print[0], new_print[0]), likeness(old_print[0], print_[0])))
                held = None if guest else (key, text, print_)
                if len(out) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return dealt.select("_r", "_g", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
