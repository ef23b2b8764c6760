"""Repeated passages by seed and extend.

A window is `length` consecutive words of one text; a window whose words also start
anywhere else, in the same text or another, is repeated, and all its words go.

* Seeds: of the word `gram`-grams in each window the one with the smallest hash is the
  window's anchor, the rightmost of equal ones. Equal windows have equal anchors at the same
  place, so documents that share a window meet in a join on anchors.
* Extension: an anchor is extended both ways over all windows that it is the anchor of. Where
  the whole extent of one anchor equals that of another, all its windows are repeated and
  nothing else has to be looked at. Only where extents differ, at the ends of a shared
  passage, one anchor of each extent compares its windows one by one.
* Repeated windows that overlap or touch are merged to maximal repeats.

Groups are counted before they are joined and no pairs are listed, so a passage in a third of
all documents costs a row for each place it stands at. Anchors that occur once are kept back
early by one bit a slot (`slot_bits`); the joins behind are exact. Words are told apart
by 64 bits, windows by 128, rows by a hash of id and text: equal rows agree.

A null text has no words, a text shorter than a window loses none. An empty table gives no
rows. Extra columns are not looked at.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import in_bits, slot_bits, text_of
from tidewatch.llm.words import _BASE, NOT_SPACE, _power, mixed, slices, word_hashes
from tidewatch.session import shared_stage

LENGTH, GRAM = 35, 8
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCK = 1 << 17


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key and first word's place of each word, and its hash, in blocks that overlap by a window less a word."""
    for batch in batches:
        for part, data, places in slices(batch, "text"):
            hashes, bounds = word_hashes(data, places, NOT_SPACE, lower=False)
            keys = part.column("key").to_numpy()
            for at in range(0, len(hashes), _BLOCK):
                yield keys, bounds, hashes, at


def _extents(keys, bounds, hashes, at, length: int, gram: int):
    """Of the windows that begin in a block: anchor hash, extent hash, key, first window's place, number of windows and anchor's offset."""
    h = hashes[at:at + _BLOCK + length - 1]
    n = len(h) - length + 1
    if n <= 0:
        return None
    text = np.searchsorted(bounds, np.arange(at, at + n), "right") - 1
    inside = np.arange(at, at + n) + length <= bounds[text + 1]
    g = np.zeros(len(h) - gram + 1, np.uint64)
    factor = 1
    for j in range(gram):
        g += h[j:len(h) - gram + 1 + j] * np.uint64(factor)
        factor = factor * int(_STEP) % 2**64
    g = mixed(g)
    # Place of the smallest of `wide` grams, rightmost of equal ones: the later half wins ties.
    wide, size = length - gram + 1, 1
    low, where = g, np.arange(len(g))
    while 2 * size <= wide:
        later = low[size:] <= low[:-size]
        low, where = np.where(later, low[size:], low[:-size]), np.where(later, where[size:], where[:-size])
        size *= 2
    rest = wide - size
    later = low[rest:rest + n] <= low[:n]
    where = np.where(later, where[rest:rest + n], where[:n])
    starts = np.flatnonzero(inside)
    if not len(starts):
        return None
    anchor = where[starts]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[starts[1:]] != text[starts[:-1]])])
    s, count = starts[first], np.diff(np.append(first, len(starts)))
    anchor = anchor[first]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("up", _BASE, len(h)), out=total[1:])
    down = _power("down", pow(_BASE, -1, 2**64), len(h))
    return g[anchor], s, count, anchor - s, total, down, keys[text[s]], s + at - bounds[text[s]]


def _span(total: np.ndarray, down: np.ndarray, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    return (total[start + words] - total[start]) * down[start]


def _anchor_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = _extents(*block, length, gram)
            if found is not None:
                h, n = np.unique(found[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _anchors(docs: DataFrame, bits: np.ndarray, length: int, gram: int) -> DataFrame:
    """h (anchor), extent, key and at (place of the first window, number of windows and offset) of anchors that may occur again."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = _extents(*block, length, gram)
            if found is None:
                continue
            stay = np.flatnonzero(in_bits(sent.value, found[0]))
            h, s, count, off = (x[stay] for x in found[:4])
            shape = count.astype(np.uint64) * np.uint64(length) + off.astype(np.uint64)
            extent = mixed(_span(found[4], found[5], s, count + length - 1) + shape * _STEP)
            at = (found[7][stay] * length + count - 1) * length + off
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(extent.view(np.int64)), pa.array(found[6][stay]), pa.array(at)], ["h", "extent", "key", "at"])

    return docs.mapInArrow(run, "h long, extent long, key long, at long")


def _windows(chosen: DataFrame, length: int) -> DataFrame:
    """Each window of the chosen anchors: a and b (its 128 bits), n, and key and place where the extent occurs once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, places in slices(batch, "text"):
                hashes, bounds = word_hashes(data, places, NOT_SPACE, lower=False)
                for i, (key, ends) in enumerate(zip(part.column("key").to_pylist(), part.column("ends"))):
                    ends = ends.values
                    at, h, n = (ends.field(c).to_numpy() for c in ("at", "h", "n"))
                    off, count, place = at % length, at // length % length + 1, at // length**2
                    own = np.repeat(np.arange(len(at)), count)
                    step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                    begin = place[own] + step
                    words = hashes[bounds[i]:bounds[i + 1]]
                    b = np.zeros(len(begin), np.uint64)
                    factor = 1
                    for j in range(length):
                        b += words[begin + j] * np.uint64(factor)
                        factor = factor * _BASE % 2**64
                    a = mixed(h[own].view(np.uint64) + (off[own] - step).astype(np.uint64) * _STEP)
                    once = n[own] == 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(mixed(b).view(np.int64)), pa.array(np.minimum(n[own], 2)),
                         pa.array(np.full(len(own), key), mask=~once), pa.array(begin, mask=~once)], ["a", "b", "n", "key", "place"])

    return chosen.mapInArrow(run, "a long, b long, n long, key long, place long")


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _repeats(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Texts that may hold a repeat, and of each key with one the list of its repeated stretches (first window, number less one)."""
    counts = _anchor_counts(texts.select("key", "text"), length, gram).where(F.col("n") > 1)
    anchors = shared_stage(_anchors(texts.select("key", "text"), slot_bits(counts, "h"), length, gram))
    extents = anchors.groupBy("h", "extent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one"))
    extents = shared_stage(extents)  # the joins below then shuffle both sides, so that run-time statistics can split a hot key
    seeds = extents.groupBy("h").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("kinds")).where(F.col("places") > 1)
    # An extent that occurs twice is repeated as a whole; where an anchor has several, each is looked at.
    whole = anchors.join(extents.where(F.col("n") > 1).select("h", "extent"), ["h", "extent"]).select("key", F.floor(F.col("at") / length).alias("stretch"))
    chosen = extents.join(seeds.where(F.col("kinds") > 1).select("h"), "h").select("one.key", F.struct("one.at", "h", "n").alias("end"))
    chosen = chosen.groupBy("key").agg(F.collect_list("end").alias("ends"))

    touched = slot_bits(anchors, "key")
    sent = texts.sparkSession.sparkContext.broadcast(touched)

    @F.pandas_udf("boolean")
    def may_repeat(keys):
        import pandas as pd
        return pd.Series(in_bits(sent.value, keys.to_numpy().view(np.uint64)))

    held = texts.withColumn("held", may_repeat("key"))
    windows = _windows(held.where("held").join(chosen, "key").select("key", "doc_id", "text", "ends"), length)
    again = windows.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    both = lambda df: df.withColumn("ab", F.xxhash64("a", "b"))  # one more column asks for a shuffle of its own on either side
    single = both(windows.where(F.col("key").isNotNull()).drop("n")).join(both(again), ["a", "b", "ab"])
    single = single.select("key", (F.col("place") * length).alias("stretch"))
    spans = whole.union(single).groupBy("key").agg(F.collect_set("stretch").alias("spans"))
    return held, spans


def merged(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last word of maximal repeats."""
    first = np.sort(spans)
    first, end = first // length, first // length + first % length + length
    end = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
    return first[new], end[np.append(new[1:], len(first)) - 1]


def _kept_words(text: str, spans: np.ndarray, length: int) -> Iterator[tuple[int, list[bytes]]]:
    """Words of a text in pieces of a megabyte: how many there are and those that stay."""
    data = text.encode()
    first, end = merged(spans, length) if len(spans) else (np.zeros(0, np.int64),) * 2
    at = seen = 0
    while at < len(data):
        to = min(at + (1 << 20), len(data))
        while to < len(data) and NOT_SPACE[data[to]]:
            to += 1
        piece = data[at:to].split()
        a, b = np.clip(first - seen, 0, len(piece)), np.clip(end - seen, 0, len(piece))
        kept, last = [], 0
        for x, y in zip(a[b > a], b[b > a]):
            kept += piece[last:x]
            last = y
        yield len(piece), kept + piece[last:] if last else piece
        seen += len(piece)
        at = to


def _outputs(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept text and the repeats on demand."""
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        ddl += ", kept_text string, repeats array<struct<first:long,last:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans")):
                spans = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
                digest, total, stay, parts = hashlib.sha256(), 0, 0, []
                for n, kept in _kept_words(text.as_py(), spans, length):
                    if kept:
                        joined = (b" " if stay else b"") + b" ".join(kept)
                        digest.update(joined)
                        if with_text:
                            parts.append(joined)
                    total, stay = total + n, stay + len(kept)
                row = (key, total, total - stay, digest.hexdigest())
                if with_text:
                    pairs = zip(*merged(spans, length)) if len(spans) else ()
                    row += (b"".join(parts).decode(), [{"first": int(a), "last": int(b) - 1} for a, b in pairs])
                out.append(row)
                if len(out) == 2000 or with_text:
                    yield _batch(out, with_text)
                    out = []
            if out:
                yield _batch(out, with_text)

    return rows.select("doc_id", "text", "spans").mapInArrow(run, ddl)


def _batch(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    if with_text:
        kinds += [("kept_text", pa.string()), ("repeats", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Every document's word counts and digest of what stays, and with `with_text` the kept words and the maximal repeats (first and last word)."""
    if not 0 < gram <= length:
        raise ValueError("an anchor must fit into a window")
    held, spans = _repeats(_keyed(docs), length, gram)
    touched = held.where("held").select("key", "doc_id", "text").join(spans, "key", "left")
    alone = held.where("not held").withColumn("spans", F.lit(None).cast("array<long>"))
    return _outputs(touched, length, with_text).union(_outputs(alone, length, with_text))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT d, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
g AS (SELECT d, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT d, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM g),
r AS (SELECT d, i, count(*) OVER (PARTITION BY h) > 1 AS again FROM h),
c AS (SELECT w.d, w.i, w.word, coalesce(bool_or(r.again) OVER (PARTITION BY w.d ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
      FROM w LEFT JOIN r ON r.d = w.d AND r.i = w.i),
k AS (SELECT d, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY d)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (d)
"""
