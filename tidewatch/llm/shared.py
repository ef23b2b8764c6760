"""Small helpers that several operators use."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 20


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns, or all but some, as one struct, whatever their names."""
    return F.struct(*[F.col(quoted(n)) for n in df.columns if n not in but])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_of(name: str, parts: int) -> Column:
    """crc32 of the value as text, modulo `parts`; null stays null."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % parts


def in_slots(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among `wanted`: a filter in front of a join, not the join itself.

    Keys are hashed to SLOTS slots, so what is broadcast has at most SLOTS numbers however
    many keys there are; keys that share a slot pass as well and fall out in the join.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    slots = wanted.select(slot.alias("_slot")).distinct()
    return rows.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


#: Bits of the sets that `slot_bits` makes: 16 MB, whatever the table's size.
BITS = 1 << 27


def slot_bits(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each slot in which a key of `keys` lies, as 2**21 numbers of 64 bits.

    It goes in front of a shuffle to keep back rows that cannot matter; rows that share a
    slot pass as well and fall out in the exact step behind. Its size is fixed: with many
    more keys than slots it holds nothing back, and the shuffle carries all rows.
    """
    slot = F.pmod(F.col(key), F.lit(BITS))
    cells = keys.select(F.floor(slot / 64).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys lie in a slot of `slot_bits`."""
    slot = keys & np.uint64(BITS - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
