"""Mix sources to target weights from fixed-length blocks.

The words of a source, document after document, form one stream that is cut into equal blocks
of about `block_words`, or a 64th of a small source. Sources in code-point order (null last) take the weights in turn and share
`budget` times all words; a target stops at `most` times its source's words, and what is
over is shared out again. Each output shard draws multinomial source counts without going
beyond what a source has left; a source's last slot takes only the words that its target
still lacks, so totals miss their targets by what equal blocks differ in, a word each at most.
Slot j of a source with n blocks takes block perm(j mod n), where perm is a pseudorandom permutation of the
source's own (a Feistel network walked into range), so no block is taken more than
ceil(slots / n) times. Blocks are joined to documents by (source, block).

Null text has no words; null doc_id and repeated rows are rows of their own; a source
without words gets nothing. An empty table gives an empty mix. Same input, same mix.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.llm.shared import quoted, whole_row
from tidewatch.llm.words import NOT_SPACE, slices, word_counts
from tidewatch.operators.ordered import running_sums
from tidewatch.session import bounded_rows, shared_stage

MOST_SOURCES = 100_000


@dataclass
class Mix:
    """rows: _row, _k (hash of id and text), doc_id, source, size, _s, _start. sources: _s, source_size, target.
    slots: shard, _s, turn, block, limit (words of the block, null for all of them).
    pieces: _s, block, _row, doc_id, inside (place in the block), first, length (words of the document)."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Words wanted of each source."""
    left, out = budget * sum(sizes), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def shard_counts(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Multinomial slots per (shard, source); what a source has left bounds each draw."""
    rng, left = np.random.default_rng(seed), quota.astype(np.int64).copy()
    out = np.zeros((shards, len(quota)), np.int64)
    for i in range(shards):
        want = int(left.sum()) // (shards - i)
        while want:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[i] += drawn
            left -= drawn
            want -= int(drawn.sum())
    return out


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of j under a pseudorandom permutation of 0..n-1 chosen by `key`, for whole arrays."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    half = (np.uint64(1) << bits) - np.uint64(1)
    x, todo = j.astype(np.uint64), np.arange(len(j))
    while len(todo):
        b, h, k = bits[todo], half[todo], key[todo].astype(np.uint64)
        left, right = x[todo] >> b, x[todo] & h
        for turn in range(4):
            f = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)) * np.uint64(0xD6E8FEB86659FD93)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
            left, right = right, left ^ ((f ^ (f >> np.uint64(33))) & h)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _range(first: Column, count: Column, step: int = 4096) -> tuple[Column, Column]:
    """Two generators that list count numbers from `first` on without one huge array."""
    starts = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1, F.lit(step).cast("long")))
    return starts, lambda s: F.sequence(first + s, first + F.least(s + step - 1, count - 1))


def _listed(df: DataFrame, first: Column, count: Column, name: str, *spread: str) -> DataFrame:
    starts, run = _range(first, count)
    runs = df.withColumn("_at", F.explode(starts))
    runs = runs.repartition(*spread, "_at") if spread else runs  # runs of numbers go to tasks, not whole rows
    return runs.withColumn(name, F.explode(run(F.col("_at")))).drop("_at")


def _scaled(a: Column, b: Column, c: Column) -> Column:
    """floor(a b / c) in 38 decimal digits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(b), wide(c))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, places in slices(batch, "text"):
            size = pa.array(word_counts(data, places, NOT_SPACE))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("_row", "_k", "doc_id", "source")), size], ["_row", "_k", "doc_id", "source", "size"])


def _content() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0,
    block_words: int = 128, shards: int = 64, seed: int = 17,
) -> Mix:
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), _content().alias("_k"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(_sized, "_row long, _k long, doc_id long, source string, size long")
    rows = shared_stage(rows)
    sizes = bounded_rows(rows.groupBy("source").agg(F.sum("size").alias("size")), MOST_SOURCES)
    sizes = sorted(sizes, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    words = [int(r["size"]) for r in sizes]
    wanted = targets(words, [weights[i % len(weights)] for i in range(len(words))], budget, most)
    blocks = [max(1, w // min(block_words, max(1, w // 64))) for w in words]
    # Whole blocks, then the words of one more.
    whole = [min(round(t), int(most * w)) * b // w if w else 0 for t, w, b in zip(wanted, words, blocks)]
    rest = [min(round(t), int(most * w)) - q * w // b if w else 0 for t, w, b, q in zip(wanted, words, blocks, whole)]
    quota = [q + (r > 0) for q, r in zip(whole, rest)]
    drawn = shard_counts(np.array(quota, np.int64), shards, seed)
    first = np.cumsum(drawn, axis=0) - drawn
    sources = spark.createDataFrame(
        [(i, r["source"], words[i], float(wanted[i]), blocks[i]) for i, r in enumerate(sizes)],
        "_s int, source string, source_size long, target double, _blocks long")
    plan = spark.createDataFrame(
        [(s, i, blocks[i], int(first[s, i]), int(drawn[s, i]), whole[i], rest[i]) for s in range(shards) for i in range(len(words)) if drawn[s, i]],
        "shard int, _s int, _blocks long, _first long, _n long, _whole long, _rest long")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n, j, whole, rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "_blocks", "_slot", "_whole", "_rest"))
            block = permuted(j % n, n, s + 1 + seed * 1_000_003)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("_s"), pa.array((j // n).astype(np.int32)), pa.array(block), pa.array(rest, mask=j < whole)],
                ["shard", "_s", "turn", "block", "limit"])

    slots = _listed(plan, F.col("_first"), F.col("_n"), "_slot", "shard", "_s")
    slots = slots.mapInArrow(chosen, "shard int, _s int, turn int, block long, limit long")
    same = F.col("_r.source").eqNullSafe(F.col("_t.source"))
    rows = rows.alias("_r").join(F.broadcast(sources.alias("_t")), same).select("_r.*", "_s", F.col("source_size").alias("_words"), "_blocks")
    rows = running_sums(rows, ["_s"], ["doc_id", "size", "_row"], {"_start": F.col("size")})
    begin, end = F.col("_start"), F.col("_start") + F.col("size")
    # Block b holds the words from floor(b words / blocks) on.
    block_of = lambda word: F.call_function(
        "div", (word + 1).cast("decimal(19,0)") * F.col("_blocks").cast("decimal(19,0)") - 1, F.col("_words").cast("decimal(19,0)"))
    low, high = block_of(begin), block_of(end - 1)
    cut = lambda b: _scaled(b, F.col("_words"), F.col("_blocks"))
    pieces = _listed(rows.where("size > 0"), low, high - low + 1, "block").withColumns({"_from": cut(F.col("block")), "_to": cut(F.col("block") + 1)})
    pieces = pieces.select(
        "_s", "block", "_row", "doc_id", (F.greatest(begin, F.col("_from")) - F.col("_from")).alias("inside"),
        (F.greatest(begin, F.col("_from")) - begin).alias("first"),
        (F.least(end, F.col("_to")) - F.greatest(begin, F.col("_from"))).alias("length"),
    )
    rows = rows.drop("_words", "_blocks")
    return Mix(rows, sources, slots, pieces)


def chosen_pieces(m: Mix) -> DataFrame:
    """Pieces the mix takes: turn (from 0) and the length taken in it."""
    slots = m.slots.select("_s", "block", "turn", "limit")
    # A few rows explode into as many as there are blocks, which size estimates do not see: never broadcast them.
    found = m.pieces.join(slots.hint("merge"), ["_s", "block"])
    length = F.when(F.col("limit").isNull(), F.col("length")).otherwise(F.least("length", F.col("limit") - F.col("inside")))
    return found.withColumn("length", length).where("length > 0").drop("limit", "inside")


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    m = mix(docs, **how)
    words = chosen_pieces(m).groupBy("_row").agg(F.sum("length").alias("taken"))
    return (
        m.rows.join(F.broadcast(m.sources.drop("source")), "_s").join(words, "_row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_at(text: str, size: int, runs: Sequence[dict]) -> str:
    """The words of `text` in the given runs (first, length); the text as it is when they cover it."""
    if sum(r["length"] for r in runs) == size:
        return text
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    parts: list[list[int]] = []
    for r in sorted(runs, key=lambda r: r["first"]):
        if parts and parts[-1][1] == r["first"]:
            parts[-1][1] += r["length"]
        else:
            parts.append([r["first"], r["first"] + r["length"]])
    return b" ".join(data[places[a][0]:places[b - 1][1]] for a, b in parts).decode()


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the columns of `docs`: a row for each document and turn, its text the words taken."""
    m = mix(docs, **how)
    takes = chosen_pieces(m).groupBy("_row", "turn").agg(F.collect_list(F.struct("first", "length")).alias("runs"))
    takes = takes.join(m.rows.select("_row", "_k", "size"), "_row").select(F.col("_k").alias("_key"), "size", "runs")
    names = docs.columns
    rows = docs.select(whole_row(docs, ("text", "n_chars")).alias("_doc"), F.col("text").cast("string").alias("text"), _content().alias("_k"))
    rows = rows.dropDuplicates(["_k"]).join(takes, F.col("_k") == F.col("_key")).select("_doc", "size", "runs", "text")
    schema = StructType([rows.schema["_doc"], StructField("_text", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [words_at(t, n, r) for t, n, r in zip(*(part.column(c).to_pylist() for c in ("text", "size", "runs")))]
                yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(texts, pa.string())], ["_doc", "_text"])

    out = rows.mapInArrow(cut, schema)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(n, F.col(f"_doc.{quoted(n)}")).alias(n) for n in names])
