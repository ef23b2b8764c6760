"""Exact dedup: a cuckoo-filter index over content digests.

Two texts are equal when they are identical after each run of ASCII white space became
one space; null counts as empty. Every task of the scan keeps a cuckoo index of the
digests it has met and hands on one row per digest, so a text that fills a third of the
table costs one row per task. Digests are then dealt out by their own bits and a second
index per task merges what the scan tasks found. Of equal texts the row with the smallest
doc_id stays; a null doc_id comes after all others, and if no row has one, the group's
keep_id is null and none of its rows counts as kept. Rows repeated with the same doc_id
and text are all kept or all dropped.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import text_of, whole_row

WHITE = r"[\x20\x09-\x0D]+"


class CuckooIndex:
    """Live digests with a value each: find, insert, delete.

    Four fingerprints of 16 bits a bucket answer most misses; a fingerprint that matches is
    verified against the full digest stored in the same slot. An entry's second bucket is
    its first xor a hash of the fingerprint, so entries can be moved without their digest.
    When kicks run out, the table doubles and is rebuilt from the stored digests.
    """

    SLOTS, KICKS = 4, 64

    def __init__(self, buckets: int = 1 << 10):
        self.count = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.stored: list[list[list]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return print_, one, self._other(one, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> list | None:
        """The entry [digest, value] or None."""
        print_, one, two = self._places(digest)
        for bucket in (one, two):
            if print_ in self.prints[bucket]:
                for entry in self.stored[bucket]:
                    if entry[0] == digest:
                        return entry
        return None

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not in the index yet."""
        self._put([digest, value])
        self.count += 1

    def _put(self, entry: list) -> None:
        print_, one, two = self._places(entry[0])
        for bucket in (one, two):
            if len(self.prints[bucket]) < self.SLOTS:
                self.prints[bucket].append(print_)
                self.stored[bucket].append(entry)
                return
        bucket = two
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            print_, self.prints[bucket][slot] = self.prints[bucket][slot], print_
            entry, self.stored[bucket][slot] = self.stored[bucket][slot], entry
            bucket = self._other(bucket, print_)
            if len(self.prints[bucket]) < self.SLOTS:
                self.prints[bucket].append(print_)
                self.stored[bucket].append(entry)
                return
        entries = [e for b in self.stored for e in b] + [entry]
        self._clear(2 * (self.mask + 1))
        for e in entries:
            self._put(e)

    def delete(self, digest: bytes) -> bool:
        print_, one, two = self._places(digest)
        for bucket in (one, two):
            for slot, entry in enumerate(self.stored[bucket]):
                if entry[0] == digest:
                    del self.prints[bucket][slot], self.stored[bucket][slot]
                    self.count -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        return (e for b in self.stored for e in b)


_PARTS = pa.schema([("_digest", pa.binary()), ("_keep", pa.int64()), ("_size", pa.int64())])


def _merge(batches: Iterable[pa.RecordBatch], release: int | None) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(d, *v) for d, v in index.entries()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows[at:at + 50_000]), _PARTS.types)], schema=_PARTS)

    for batch in batches:
        for digest, keep, size in zip(*(batch.column(n).to_pylist() for n in _PARTS.names)):
            entry = index.find(digest)
            if entry is None:
                index.insert(digest, (keep, size))
                continue
            old, n = entry[1]
            entry[1] = (keep if old is None else old if keep is None else min(old, keep), n + size)
        if release and index.count > release:  # partial groups may leave early; the second index joins them
            yield from out()
            index = CuckooIndex()
    yield from out()


def digests(docs: DataFrame, content: str = "text") -> DataFrame:
    """Every row's digest: SHA-256 of the normalised text in UTF-8."""
    plain = F.regexp_replace(text_of(content), WHITE, " ")
    return docs.withColumn("_digest", F.unhex(F.sha2(plain.cast("binary"), 256)))


def groups(keyed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per digest of `keyed`: _digest, _keep (smallest id), _size."""
    rows = keyed.select("_digest", F.col(id_column).cast("long").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    ddl = "_digest binary, _keep long, _size long"
    parts = rows.mapInArrow(lambda it: _merge(it, 1 << 18), ddl)
    # The release bound keeps a scan task's index small; the second index holds one task's share of the digests.
    return parts.repartition("_digest").mapInArrow(lambda it: _merge(it, None), ddl)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs` (doc_id, text)."""
    keyed = digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")))
    found = groups(keyed)
    return (
        keyed.select("doc_id", "_digest").join(found, "_digest")
        .select(
            "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
            F.coalesce(F.col("doc_id") == F.col("_keep"), F.lit(False)).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )


def unique_documents(docs: DataFrame) -> DataFrame:
    """One whole row of `docs` for each text, that with the smallest doc_id."""
    rows = docs.select(whole_row(docs).alias("_doc"), "text", F.col("doc_id").cast("long").alias("_id"))
    keyed = digests(rows)
    kept = keyed.drop("text").join(groups(keyed, "_id"), "_digest").where(F.col("_id").eqNullSafe(F.col("_keep")))
    return kept.dropDuplicates(["_digest"]).select("_doc.*")


def apply_changes(index: CuckooIndex, changes: Iterable[tuple[str, str, int]]) -> list[tuple[int, int | None]]:
    """Feed live changes ("insert" or "delete", text, id) to an index.

    Returns for each insert (id, id of the equal live text or None). A deleted text is
    free again at once, so the next equal insert counts as new.
    """
    out = []
    for what, text, key in changes:
        digest = hashlib.sha256(text.encode()).digest()
        entry = index.find(digest)
        if what == "delete":
            if entry is not None and entry[1] == key:
                index.delete(digest)
        else:
            out.append((key, None if entry is None else entry[1]))
            if entry is None:
                index.insert(digest, key)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, false) AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
