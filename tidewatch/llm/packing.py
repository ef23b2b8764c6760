"""Pack token sequences by best-fit decreasing.

A document's ids are cut into full windows of `window` ids and a rest. Pieces are dealt by
hash into shards of about `shard_pieces`; each shard takes its pieces from long to short
and puts each into the open window with the least room that still holds it. A segment tree
over the remaining capacities, each leaf a stack of windows, finds it in log(window) steps.
A shard leaves at most a few windows unfilled, so padding does not grow with the shards.

Null text is empty (one end id); repeated rows and null doc_ids are documents of their own.
Ids equal those of the named tokenizer; see `_Ids`.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import shared_stage

END = 1
#: A single space between two other characters starts a new token whatever stands around it.
ODD_SPACE = re.compile(r"\s |\ \s|^ | $|[\x1c-\x1f]|<\|endoftext\|>")


class _Ids:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    A text is split at its single spaces, which are token boundaries of the byte-level
    pattern, and each chunk's ids are kept for the next time it is met. Texts with other
    white space next to a space, or with a special token, go to the tokenizer whole. The
    chunks are merged by the rank file of the same vocabulary.
    """

    MOST = 120_000  # chunks kept by a worker, some 30 MB

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids = np.array(self.coding.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, chunk = self.known, self._chunk
        first, *rest = text.split(" ")
        parts = [known.get(first) or chunk(first)] if first else []
        for c in rest:
            c = " " + c
            parts.append(known.get(c) or chunk(c))
        return b"".join(parts)


_ids: dict[tuple[str, str], _Ids] = {}


def _coder(path: str, ranks: str) -> _Ids:
    if (path, ranks) not in _ids:
        _ids[path, ranks] = _Ids(path, ranks)
    return _ids[path, ranks]


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, window: int = 2048, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """_row, doc_id, start, length, doc_tokens and ids (packed 32-bit) of every piece.

    `tokenizer` names the tokenizer file and the rank file of the same vocabulary.
    """
    names = tokenizer or _tokenizer()
    schema = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = _coder(*names), np.array([END], "<u4").tobytes()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row, key, text in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = coder.of(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    rows.append((row, key, at, min(window, n - at), n, ids[4 * at:4 * (at + window)]))
                size += len(ids)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "_row long, doc_id long, start long, length long, doc_tokens long, ids binary")


class OpenWindows:
    """Open windows by remaining capacity; a max-free segment tree of counts over capacities 0..window."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.stacks[room].append(number)
        at = room + self.leaves
        while at:
            self.tree[at] += 1
            at //= 2

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least `need`: (room, number)."""
        tree, at = self.tree, need + self.leaves
        if not tree[at]:
            while at > 1 and (at % 2 or not tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        number = self.stacks[room].pop()
        while at:
            tree[at] -= 1
            at //= 2
        return room, number


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window number and offset of each piece; `lengths` run from long to short."""
    spaces, places, offsets, n = OpenWindows(window), [], [], 0
    for length in lengths:
        found = spaces.tightest(length)
        room, number = found if found else (window, n)
        n += found is None
        places.append(number)
        offsets.append(window - room)
        if room > length:
            spaces.add(room - length, number)
    return places, offsets, n


def place(pieces: DataFrame, window: int = 2048, shard_pieces: int = 8192) -> DataFrame:
    """Add sequence_id and offset to pieces that have _row, start and length.

    sequence_id is shard * 2**32 + the window's number in its shard.
    """
    count = pieces.count()
    shards = max(1, -(-count // shard_pieces))

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("_row", "ascending")])
        places, offsets, _ = best_fit(table.column("length").to_pylist(), window)
        base = key[0].as_py() << 32
        return (table.drop_columns(["_shard"]).append_column("sequence_id", pa.array([base + p for p in places], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("_row", "start"), F.lit(shards)).cast("long"))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("_shard").applyInArrow(packed, schema)


def pack(docs: DataFrame, window: int = 2048, **how) -> DataFrame:
    """Every piece with its ids and place: the packed sequences as rows."""
    pieces = shared_stage(token_pieces(docs, window))
    places = place(pieces.drop("ids"), window, **how).select("_row", "start", "sequence_id", "offset")
    return pieces.join(places, ["_row", "start"])


def packed_digests(docs: DataFrame, window: int = 2048, **how) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    digests = token_pieces(docs, window).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(shared_stage(digests), window, **how).drop("_row")
