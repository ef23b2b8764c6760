"""Brown class-based bigram scoring.

Tokens are a text's words (runs of bytes other than ASCII white space, A-Z lowered) and one
end. Units of the class model are all words that training shows `least` times, the end, and
`shapes` groups that take all other words, known or not, by their last three bytes. Exchange
clustering assigns every unit to one of `classes` classes. It starts with the `core` most
frequent words, the end and the groups, which hold all other words at first: a Spark job
counts each unit's neighbours by class, the model-sized table is searched for moves that
raise the likelihood of the class bigrams, and the next round counts anew; the best
assignment seen stays. Then every other word of `least` or more leaves its group: its own
neighbours by class are a Spark table with a row for each word and task, and each word is
put where the likelihood gains most, in partitions; a neighbour outside the core counts by
its group's class in that sweep. The bigrams are counted anew with the words' own classes,
and the sweep stays if it raised the likelihood; else each word keeps its group's class. The
end keeps a class of its own, which is also the history of a first word.

    P(word | previous) = P(class | class of previous) * P(unit | class) * P(word | unit)

Transitions are smoothed with the class shares. A word that is a unit is its unit. Within a
group, absolute discounting sets mass aside for words that training did not show. Counts and
classes of all words stay a table; only the `frequent` most frequent ones are sent to the
tasks (of equally frequent ones those with the smallest hashes), and what is not among them
is joined by word hash. `head` bounds the number of units, if given.

Null and empty texts consist of their end. A null doc_id counts as training. Repeated rows
are texts of their own. Without training texts every base score is 0 per token and the
class model is uniform.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import crc_of
from tidewatch.llm.words import NOT_SPACE, Tally, Words, slices, words
from tidewatch.session import shared_stage


_LOW = np.uint64(0x3FF)
_NEAR = np.dtype([("s", "u1"), ("n", "<u4")])  # class of a neighbour, 64 more if it follows, and how often


@dataclass
class ClassModel:
    head: np.ndarray  # sorted hashes of the words that the exchange on the driver has as units
    head_class: np.ndarray
    shapes: int
    unit_class: np.ndarray  # head words, groups, end
    transition: np.ndarray  # log10, [previous class, class]
    emission: np.ndarray  # log10 P(unit | class)
    group_total: np.ndarray  # training tokens of each group
    group_types: np.ndarray
    discount: float
    class_total: np.ndarray  # training tokens of each class, half a token more for each unit


def _shape(found: Words, shapes: int) -> np.ndarray:
    return (found.ending * 2654435761 % (1 << 32) >> 7) % shapes


def _keys(found: Words, shapes: int) -> np.ndarray:
    """Hash of each word whose low ten bits name its group, so that the group need not be carried along."""
    return (found.hash & ~_LOW) | _shape(found, shapes).astype(np.uint64)


def _units(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Unit of each word: its place in `head`, or len(head) + its group."""
    out = len(head) + (keys & _LOW).astype(np.int64)
    if len(head):
        at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
        hit = head[at] == keys
        out[hit] = at[hit]
    return out


def word_table(docs: DataFrame, shapes: int) -> DataFrame:
    """h, n: how often each word stands in `docs` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, data, places in slices(batch, "text"):
                tally.add(_keys(words(data, places, NOT_SPACE), shapes))
        h, n = tally.merge()
        for at in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[at:at + 200_000].view(np.int64)), pa.array(n[at:at + 200_000])], ["h", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


def pair_table(docs: DataFrame, head: np.ndarray, shapes: int) -> DataFrame:
    """a, b, n: how often unit b follows unit a; a text begins and ends with the end unit."""
    size = len(head) + shapes + 1
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, data, places in slices(batch, "text"):
                found = words(data, places, NOT_SPACE)
                unit = np.full(len(found.hash) + len(places) - 1, size - 1, np.int64)
                unit[np.arange(len(found.hash)) + found.text] = _units(_keys(found, shapes), sent.value)
                before = np.r_[size - 1, unit[:-1]]
                tally.add(before * size + unit)
        codes, n = tally.merge()
        for at in range(0, len(codes), 200_000):
            c = codes[at:at + 200_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((c // size).astype(np.int32)), pa.array((c % size).astype(np.int32)), pa.array(n[at:at + 200_000])], ["a", "b", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "a int, b int, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def exchange(left: np.ndarray, right: np.ndarray, where: np.ndarray, classes: int, fixed: int, share: float, rng) -> np.ndarray:
    """One sweep of moves. left[u, c], right[u, c]: tokens of class c before and after unit u."""
    where = where.copy()
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, where, right)
    rows, cols = table.sum(1), table.sum(0)
    order = np.argsort(-right.sum(1), kind="stable")
    for u in order:
        r, l, a = right[u], left[u], where[u]
        if u == fixed or not r.any() or rng.random() > share:
            continue
        nr, nl = r.sum(), l.sum()
        table[a] -= r
        table[:, a] -= l
        rows[a] -= nr
        cols[a] -= nl
        table = np.maximum(table, 0)
        to, of = np.flatnonzero(r), np.flatnonzero(l)
        gain = (_xlogx(table[:classes, to] + r[to]) - _xlogx(table[:classes, to])).sum(1)
        gain += (_xlogx(table[of, :classes] + l[of, None]) - _xlogx(table[of, :classes])).sum(0)
        gain -= _xlogx(rows[:classes] + nr) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + nl) - _xlogx(cols[:classes])
        b = int(np.argmax(gain))
        where[u] = b
        table[b] += r
        table[:, b] += l
        rows[b] += nr
        cols[b] += nl
    return where


def _neighbours(pairs: DataFrame, where: np.ndarray, size: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    spark = pairs.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(where)], "u int, c int"))
    out = []
    for unit, other in (("b", "a"), ("a", "b")):
        rows = pairs.join(known, F.col(other) == F.col("u")).groupBy(unit, "c").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((size, classes + 1))
        table[rows.column(unit).to_numpy(), rows.column("c").to_numpy()] = rows.column("n").to_numpy()
        out.append(table)
    return out[0], out[1]


def cluster(pairs: DataFrame, size: int, classes: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each unit, class table [previous, next] and tokens of each unit."""
    rng = np.random.default_rng(seed)
    where = np.arange(size) % classes
    where[size - 1] = classes
    best, share = None, 1.0
    for turn in range(rounds + 1):
        left, right = _neighbours(pairs, where, size, classes)
        table = np.zeros((classes + 1, classes + 1))
        np.add.at(table, where, right)
        value = likelihood(table)
        if best is None or value > best[0]:
            best = (value, where, left, right, table)
        else:  # moves that were judged apart from each other did not add up: fewer of them
            share /= 2
            value, where, left, right, table = best
        if turn < rounds:
            moved = exchange(left, right, where, classes, size - 1, share, rng)
            if (moved == where).all():
                break
            where = moved
    _, where, left, _, table = best
    return where, table, left.sum(1)


def _top(counts: DataFrame, most: int) -> Column:
    """Whether a word is among the `most` most frequent ones.

    Whole buckets (an eighth of a doubling of n) are taken while they fit; of the next one the
    words with the smallest hashes, by the upper twelve bits.
    """
    have = {r["k"]: r["m"] for r in counts.groupBy(_bucket().alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}
    total, cut = 0, max(have, default=0) + 1
    for k in sorted(have, reverse=True):
        if total + have[k] > most:
            break
        total += have[k]
        cut = k
    edge = max((k for k in have if k < cut), default=None)
    if edge is None:
        return _bucket() >= cut
    slot, limit = F.shiftrightunsigned("h", 52), 0
    for r in counts.where(_bucket() == edge).groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("m")).orderBy("s").collect():
        total += r["m"]
        if total > most:
            break
        limit = r["s"] + 1
    return (_bucket() >= cut) | ((_bucket() == edge) & (slot < limit))


def _bucket():
    return F.floor(F.log2(F.col("n").cast("double")) * 8)


class _Pairs:
    """Counts of (64-bit hash, number) pairs, merged now and then like a Tally."""

    def __init__(self, limit: int = 1 << 20):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b, np.ones(len(a), np.int64)))
        self.size += len(a)
        if self.size > self.limit:
            self.merge()
            self.limit = max(self.limit, 2 * self.size)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.parts:
            a, b, n = (np.concatenate(x) for x in zip(*self.parts))
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
            self.parts = [(a[at], b[at], np.add.reduceat(n, at) if len(at) else n)]
            self.size = len(at)
            return self.parts[0]
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _packed(a: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Sorted (a, s, n) as one row for each a with its (s, n) as bytes."""
    data = np.empty(len(a), _NEAR)
    data["s"], data["n"] = s, n
    at = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)] if len(a) else np.zeros(1, np.int64)
    for i in range(0, len(at) - 1, 50_000):
        cut = at[i:i + 50_001]
        places = ((cut - cut[0]) * _NEAR.itemsize).astype(np.int32)
        body = pa.py_buffer(data[cut[0]:cut[-1]].tobytes())
        yield a[cut[:-1]].view(np.int64), pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(places.tobytes()), body])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many entries each row has, and all entries."""
    size = np.array([0 if x is None else len(x) for x in column.to_pylist()], np.int64) // _NEAR.itemsize
    return size, np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), _NEAR)


def _sequence(found: Words, texts: int, of_words: np.ndarray, end) -> np.ndarray:
    """Values of the words with `end` after each text."""
    out = np.full(len(of_words) + texts, end, of_words.dtype)
    out[np.arange(len(of_words)) + found.text] = of_words
    return out


def neighbour_table(docs: DataFrame, heads: np.ndarray, where: np.ndarray, shapes: int) -> DataFrame:
    """h, x: neighbours by class of each word outside `heads`, a row for each word and task."""
    sent = docs.sparkSession.sparkContext.broadcast((heads, where))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, where = sent.value
        tally, end = _Pairs(), len(where) - 1
        for batch in batches:
            for _, data, places in slices(batch, "text"):
                found, texts = words(data, places, NOT_SPACE), len(places) - 1
                keys = _keys(found, shapes)
                unit = _sequence(found, texts, _units(keys, heads), end)
                keys = _sequence(found, texts, keys, 0)
                cls, tail = where[unit], (unit >= len(heads)) & (unit < end)
                at = np.flatnonzero(tail)  # a text's end follows its last word
                tally.add(keys[at], np.r_[where[end], cls[:-1]][at])
                tally.add(keys[at], 64 + cls[at + 1])
        for h, x in _packed(*tally.merge()):
            yield pa.RecordBatch.from_arrays([pa.array(h), x], ["h", "x"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, x binary")


def gains(u: np.ndarray, s: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """Likelihood gained by each class for each unit, once it has left its own class.

    Entries are sorted by u, 0 up; s is the neighbour's class, 64 more if it follows.
    """
    near = np.zeros((128, classes))
    near[:classes + 1], near[64:65 + classes] = table[:, :classes], table[:classes].T
    a, value, rows = own[u], near[s], np.arange(len(u))
    out = _xlogx(value + n[:, None]) - _xlogx(value)
    out[rows, a] = _xlogx(value[rows, a]) - _xlogx(np.maximum(value[rows, a] - n, 0))
    out = np.add.reduceat(out, np.flatnonzero(np.r_[True, u[1:] != u[:-1]]), axis=0)
    each = np.arange(len(own))
    for total, side in ((table.sum(1), s >= 64), (table.sum(0), s < 64)):
        total, m = total[:classes], np.bincount(u[side], n[side], len(own))
        loss = _xlogx(total + m[:, None]) - _xlogx(total)
        loss[each, own] = _xlogx(total[own]) - _xlogx(np.maximum(total[own] - m, 0))
        out -= loss
    return out


def best_classes(u: np.ndarray, s: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray, classes: int, block: int = 1 << 14) -> np.ndarray:
    """The class of the greatest of `gains` for each unit, worked out for about `block` entries at a time."""
    begins = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    out, at = np.zeros(len(own), np.int64), 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + block, "right")) - 1) if begins[at] + block < len(u) else len(own)
        a, b = begins[at], begins[to] if to < len(own) else len(u)
        out[at:to] = gains(u[a:b] - at, s[a:b], n[a:b], own[at:to], table, classes).argmax(1)
        at = to
    return out


def place(near: DataFrame, table: np.ndarray, group_class: np.ndarray, classes: int, least: int) -> DataFrame:
    """h, n, c: the class with the greatest gain for each word that stands `least` times or more."""
    sent = near.sparkSession.sparkContext.broadcast((table, group_class))

    def moved(h: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        table, group_class = sent.value
        found, u = np.unique(h, return_inverse=True)
        code, back = np.unique(u * 128 + x["s"], return_inverse=True)
        n = np.bincount(back, x["n"].astype(np.float64), len(code))
        u, s = code // 128, code % 128
        total = np.bincount(u[s >= 64], n[s >= 64], len(found))
        often = total >= least
        keep = often[u]
        u, s, n = (np.cumsum(often) - 1)[u[keep]], s[keep], n[keep]
        found, total = found[often], total[often]
        best = np.zeros(0, np.int64)
        if len(found):
            best = best_classes(u, s, n, group_class[found & 0x3FF], table, classes)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total.astype(np.int64)), pa.array(best.astype(np.int32))], ["h", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_x = np.zeros(0, np.int64), np.zeros(0, _NEAR)
        for batch in batches:
            size, x = _unpacked(batch.column("x"))
            h = np.r_[held, np.repeat(batch.column("h").to_numpy(), size)]
            x = np.concatenate([held_x, x])
            if len(h):
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield moved(h[:cut], x[:cut])
                held, held_x = h[cut:], x[cut:]
        if len(held):
            yield moved(held, held_x)

    return near.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, n long, c int")


def _constants(values: np.ndarray, kind: str = "double") -> Column:
    return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(f"array<{kind}>")


def _class_of(h: str, c: str, group_class: np.ndarray) -> Column:
    """A word's class, which is its group's if it has none of its own."""
    return F.coalesce(F.col(c), F.get(_constants(group_class, "int"), F.col(h).bitwiseAND(0x3FF).cast("int")))


def _look_up(sorted_: np.ndarray, values: np.ndarray, keys: np.ndarray, other) -> np.ndarray:
    out = np.full(len(keys), other, values.dtype)
    if len(sorted_):
        at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
        hit = sorted_[at] == keys
        out[hit] = values[at[hit]]
    return out


def class_table(docs: DataFrame, frequent: np.ndarray, frequent_class: np.ndarray, placed: DataFrame, group_class: np.ndarray, shapes: int, classes: int) -> np.ndarray:
    """Bigrams by class [previous, next]. Words outside `frequent` get theirs from `placed` (h, c) or their group."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, frequent_class))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, near, pairs = np.zeros(4096, np.int64), _Pairs(), _Pairs()
        for batch in batches:
            for _, data, places in slices(batch, "text"):
                found, texts = words(data, places, NOT_SPACE), len(places) - 1
                keys = _keys(found, shapes)
                cls = _sequence(found, texts, _look_up(*sent.value, keys, -1).astype(np.int64), classes)
                keys = _sequence(found, texts, keys, 0)
                before, key_before = np.r_[classes, cls[:-1]], np.r_[np.uint64(0), keys[:-1]]
                a, b = before >= 0, cls >= 0
                local += np.bincount(before[a & b] * 64 + cls[a & b], minlength=4096)
                near.add(keys[a & ~b], before[a & ~b])
                near.add(key_before[~a & b], 64 + cls[~a & b])
                both = ~a & ~b
                pairs.add(key_before[both], keys[both].view(np.int64))
        some = np.flatnonzero(local)
        names = ["kind", "a", "b", "n", "x"]

        def batch_of(kind, a, b, n, x):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n), x], names)

        none = lambda m: pa.nulls(m, pa.binary())
        yield batch_of(0, some // 64, some % 64, local[some], none(len(some)))
        for h, x in _packed(*near.merge()):
            yield batch_of(1, h, np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), x)
        a, b, n = pairs.merge()
        for i in range(0, len(a), 200_000):
            yield batch_of(2, a[i:i + 200_000].view(np.int64), b[i:i + 200_000], n[i:i + 200_000], none(len(a[i:i + 200_000])))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((64, 128), np.int64)
        for batch in batches:
            size, x = _unpacked(batch.column("x"))
            np.add.at(out, (np.repeat(batch.column("c").to_numpy(), size), x["s"].astype(np.int64)), x["n"].astype(np.int64))
        c, s = np.nonzero(out)
        ahead = s >= 64
        yield pa.RecordBatch.from_arrays([pa.array(np.where(ahead, c, s)), pa.array(np.where(ahead, s - 64, c)), pa.array(out[c, s])], ["a", "b", "n"])

    rows = shared_stage(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "kind int, a long, b long, n long, x binary"))
    placed = placed.select("h", "c")
    own = rows.where("kind = 1").select(F.col("a").alias("h"), "x").join(placed, "h", "left")
    own = own.select(_class_of("h", "c", group_class).alias("c"), "x").mapInArrow(add_up, "a long, b long, n long")
    two = rows.where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for end in ("a", "b"):
        two = two.join(placed.select(F.col("h").alias(end), F.col("c").alias(f"c_{end}")), end, "left")
    two = two.select(*(_class_of(e, f"c_{e}", group_class).cast("long").alias(e) for e in ("a", "b")), "n")
    every = rows.where("kind = 0").select("a", "b", "n").unionByName(own).unionByName(two).groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((classes + 1, classes + 1))
    table[every.column("a").to_numpy(), every.column("b").to_numpy()] = every.column("n").to_numpy()
    return table


@dataclass
class Trained:
    model: ClassModel
    counts: DataFrame
    tokens: int
    types: int
    texts: int
    frequent: np.ndarray
    frequent_n: np.ndarray
    frequent_class: np.ndarray  # -1: the word is no unit
    lexicon: DataFrame  # h, n, c: every word, its class if it is a unit outside the core


def train(
    docs: DataFrame, head: int | None = None, shapes: int = 512, classes: int = 48, rounds: int = 5, frequent: int = 1 << 17,
    beta: float = 4.0, seed: int = 5, core: int = 4096, least: int = 2,
) -> Trained:
    """Fit on all of `docs` (text). What the driver holds depends on the parameters only; words and their classes are a table."""
    if shapes > 1024 or classes > 62:
        raise ValueError("at most 1024 shapes and 62 classes")
    counts = shared_stage(word_table(docs, shapes))
    totals = counts.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    all_words, types, once, twice = (int(v or 0) for v in totals)
    in_core, often = _top(counts, core if head is None else head), _top(counts, frequent)
    rows = counts.where(in_core | often).select("h", "n", in_core.alias("top")).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, n, top = h[order], rows.column("n").to_numpy()[order], rows.column("top").to_numpy()[order]
    heads = h[top]
    size = len(heads) + shapes + 1
    pairs = shared_stage(pair_table(docs, heads, shapes))
    where, table, unit_n = cluster(pairs, size, classes, rounds, seed)
    texts = int(unit_n[size - 1])
    group_class = where[len(heads):size - 1]
    cls = np.full(len(h), -1, np.int64)
    cls[top] = where[:len(heads)]
    class_total = np.zeros(classes + 1)
    grouped, lexicon = ~in_core, counts.select("h", "n", F.lit(None).cast("int").alias("c"))
    if head is None:
        placed = shared_stage(place(neighbour_table(docs, heads, where, shapes), table, group_class, classes, least))
        mine = placed.where(often).select("h", "c").toArrow()
        at = mine.column("h").to_numpy().view(np.uint64)
        order = np.argsort(at)
        moved = np.where(top, cls, _look_up(at[order], mine.column("c").to_numpy()[order].astype(np.int64), h, -1))
        groups = group_class[(h & _LOW).astype(np.int64)]
        anew = class_table(docs, h, np.where(moved < 0, groups, moved), placed, group_class, shapes, classes)
        if likelihood(anew) > likelihood(table):
            cls, table = moved, anew
        else:
            cls = np.where(top | (moved < 0), cls, groups)
            placed = placed.withColumn("c", F.lit(None).cast("int")).select("h", "n", _class_of("h", "c", group_class).alias("c"))
        for r in placed.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).collect():
            class_total[r["c"]] += r["n"] + 0.5 * r["m"]
        lexicon = shared_stage(counts.join(placed.select("h", "c"), "h", "left"))
        grouped &= F.col("n") < least
    shape = F.col("h").bitwiseAND(0x3FF).cast("int").alias("shape")
    per = counts.where(grouped).groupBy(shape).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).toArrow()
    group_types, group_n = np.zeros(shapes), np.zeros(shapes)
    group_types[per.column("shape").to_numpy()] = per.column("m").to_numpy()
    group_n[per.column("shape").to_numpy()] = per.column("n").to_numpy()
    unit_n = np.r_[unit_n[:len(heads)], group_n, unit_n[size - 1]]
    share = table.sum(0) + 0.5
    share /= share.sum()
    transition = np.log10((table + beta * share) / (table.sum(1, keepdims=True) + beta))
    class_total += np.bincount(where, unit_n + 0.5, classes + 1)
    emission = np.log10((unit_n + 0.5) / class_total[where])
    discount = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))
    model = ClassModel(heads, where[:len(heads)], shapes, where, transition, emission, group_n, group_types, discount, class_total)
    return Trained(model, counts, all_words + texts, types + (texts > 0), texts, h, n, cls, lexicon)


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of `docs` (doc_id, held_out, text)."""
    m, spark = trained.model, docs.sparkSession
    with np.errstate(divide="ignore"):
        group_log = np.where(m.group_total > 0, np.log10(np.maximum(m.group_total, 1)), 0.0)
        unseen = np.where(m.group_types > 0, np.log10(m.discount * np.maximum(m.group_types, 1)), 0.0)
    group_class = m.unit_class[len(m.head):-1]
    share = m.emission[len(m.head):-1] - group_log  # of a group's words, to which each adds its own part
    sent = spark.sparkContext.broadcast((m, trained.frequent, trained.frequent_n, trained.frequent_class, group_class, share))
    total, end_n = trained.tokens + 0.5 * (trained.types + 1), trained.texts

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, freq, freq_n, freq_class, group_class, share = sent.value
        end = m.transition.shape[0] - 1
        for batch in batches:
            for part, data, places in slices(batch, "text"):
                found = words(data, places, NOT_SPACE)
                text, texts = found.text, len(places) - 1
                keys = _keys(found, m.shapes)
                spot = _look_up(freq, np.arange(len(freq)), keys, -1)
                seen = spot >= 0
                group = (keys & _LOW).astype(np.int64)
                cls, value = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
                c, known_class = freq_n[spot[seen]], freq_class[spot[seen]]
                unit = known_class >= 0
                cls[seen] = np.where(unit, known_class, group_class[group[seen]])
                value[seen] = np.where(
                    unit, np.log10((c + 0.5) / m.class_total[known_class]), share[group[seen]] + np.log10(np.maximum(c - m.discount, 0.1)))
                full = _sequence(found, texts, cls, end)
                before = np.r_[end, full[:-1]]
                at = np.arange(len(keys)) + text
                owner = _sequence(found, texts, text, -1)
                owner[found.bounds[1:] + np.arange(texts)] = np.arange(texts)
                whole = (full >= 0) & (before >= 0)
                points = np.bincount(owner[whole], m.transition[before[whole], full[whole]], texts) + m.emission[-1]
                points += np.bincount(text, value, texts)
                n = np.diff(found.bounds)
                base = np.full(texts, np.log10((end_n + 0.5) / total)) + np.bincount(text[seen], np.log10((c + 0.5) / total), texts)
                known = np.full(texts, int(end_n > 0)) + np.bincount(text[seen], minlength=texts)
                rest = ~seen
                at = at[rest]
                where = np.r_[0, np.cumsum(np.bincount(text[rest], minlength=texts))].astype(np.int32)
                two = (full < 0) & (before < 0)
                key_full = _sequence(found, texts, keys.view(np.int64), 0)
                first, second = key_full[np.flatnonzero(two) - 1], key_full[two]
                where_two = np.r_[0, np.cumsum(np.bincount(owner[two], minlength=texts))].astype(np.int32)
                lists = lambda w, x: pa.ListArray.from_arrays(pa.array(w), pa.array(x))
                yield pa.RecordBatch.from_arrays([
                    part.column("_row"), part.column("doc_id"), part.column("held_out"), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(points),
                    lists(where, keys[rest].view(np.int64)), lists(where, before[at].astype(np.int32)), lists(where, full[at + 1].astype(np.int32)),
                    lists(where_two, first), lists(where_two, second),
                ], ["_row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "before", "after", "first", "second"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "held_out", F.col("text").cast("string").alias("text"))
    rows = shared_stage(rows.mapInArrow(
        local, "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rest array<long>, before array<int>, after array<int>, first array<long>, second array<long>"))
    step = lambda a, b: F.get(_constants(m.transition.ravel()), a * m.transition.shape[0] + b)
    of_group = lambda values: F.get(_constants(values), F.col("h").bitwiseAND(0x3FF).cast("int"))
    loose = rows.select("_row", F.explode(F.arrays_zip("rest", "before", "after")).alias("w"))
    loose = loose.select("_row", F.col("w.rest").alias("h"), "w.before", "w.after").join(trained.lexicon, "h", "left").select(
        "_row", "h", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "c", _class_of("h", "c", group_class).alias("at"), "before", "after")
    n, none = F.col("n"), F.lit(0.0)
    value = F.when(F.col("c").isNotNull(), F.log10((n + 0.5) / F.get(_constants(m.class_total), F.col("c"))))
    value = value.when(n > 0, of_group(share) + F.log10(n - m.discount)).otherwise(of_group(share) + of_group(unseen))
    value += F.when(F.col("before") >= 0, step(F.col("before"), F.col("at"))).otherwise(none)
    value += F.when(F.col("after") >= 0, step(F.col("at"), F.col("after"))).otherwise(none)
    extra = loose.select("_row", (n > 0).cast("long").alias("k"), F.log10((n + 0.5) / total).alias("b"), value.alias("s"))
    two = rows.select("_row", F.explode(F.arrays_zip("first", "second")).alias("w")).select("_row", "w.first", "w.second")
    for end in ("first", "second"):
        two = two.join(trained.lexicon.select(F.col("h").alias(end), F.col("c").alias(f"c_{end}")), end, "left")
    two = two.select("_row", F.lit(0).cast("long").alias("k"), none.alias("b"), step(*(_class_of(e, f"c_{e}", group_class) for e in ("first", "second"))).alias("s"))
    extra = extra.unionByName(two).groupBy("_row").agg(F.sum("k").alias("_known"), F.sum("b").alias("_base"), F.sum("s").alias("_score"))
    return rows.drop("rest", "before", "after", "first", "second").join(extra, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))


def perplexity_table(docs: DataFrame, parts: int = 5, held: int = 1, **how) -> DataFrame:
    """Train on the documents whose crc32(doc_id) modulo `parts` is not `held`, score all."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of("doc_id", parts) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"))
    return score(rows, train(rows.where(~F.col("held_out")), **how))
