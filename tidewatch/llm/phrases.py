"""Phrase collocations from depth-truncated suffix subtrees.

Suffixes are runs of up to three words that start anywhere in a piece of text, of one
language each. They are counted level by level, as a suffix tree is built by vertical
partitioning:

* Level 1 counts words. Only words seen `least` times can stand in a phrase.
* Word prefixes are dealt into groups of at most about `budget` suffixes each. A prefix with
  more than a quarter of a group's suffixes is extended: its two-word prefixes are dealt on
  their own, and those as large once more as three-word prefixes, so a very common word
  never fills one group.
* Each group sorts its suffixes and reads its subtree off them in one pass; the totals of
  the leaves are the counts. A branch that stays below `least` is closed: the next level
  reads only suffixes whose branches are open.

Every task merges equal suffixes before they are shuffled. A word is told apart by 64 bits of
its bytes and its language. What is broadcast is bounded: the extended prefixes, at most four
a group, and one bit a slot for open branches (`slot_bits`), which only keeps suffixes
back early; counts are exact.

A null text is empty, a null language is "und". Empty texts and empty tables give no rows;
repeated rows count as often as they occur.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import in_bits, slot_bits, text_of
from tidewatch.llm.words import cut, mixed, slices, words
from tidewatch.session import bounded_rows, shared_stage

#: Bytes that end a piece; space and tab part the words within one.
ENDS = np.zeros(256, bool)
ENDS[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
#: Groups at most; beyond that they grow, sorted with spill and read as a stream.
MOST_GROUPS = 1 << 18
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Word hashes with the language in them, whether the next word follows in the same piece, and where the words stand."""
    for batch in batches:
        for part, whole, places in slices(batch, "text"):
            tongues = part.column("tongue").to_numpy(zero_copy_only=False).view(np.uint64)
            for data, at in cut(whole, places, ENDS):
                found = words(data, at, WORD)
                if not len(found.hash):
                    continue
                piece = np.searchsorted(np.flatnonzero(ENDS[data]), found.start)
                text = found.text
                follows = np.zeros(len(text), bool)
                follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
                yield mixed(found.hash ^ tongues[text]), follows, part, data, found


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and where in it each run begins."""
    code = columns[0]
    for c in columns[1:]:
        code = mixed(code * _STEP + c)
    order = np.argsort(code, kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def word_table(docs: DataFrame) -> DataFrame:
    """lang, word, w (hash of both) and n, the word's occurrences."""
    schema = pa.schema([("lang", pa.string()), ("w", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, _, part, data, found in _read(batches):
            seen, first, n = np.unique(codes, return_index=True, return_counts=True)
            langs = part.column("lang").take(pa.array(found.text[first]))
            text = data.tobytes().lower()
            spelt = [text[a:a + m] for a, m in zip(found.start[first].tolist(), found.length[first].tolist())]
            yield pa.RecordBatch.from_arrays([langs, pa.array(seen.view(np.int64)), pa.array(spelt, pa.binary()), pa.array(n)], schema=schema)

    parts = docs.mapInArrow(count, "lang string, w long, word binary, n long")
    return parts.groupBy("lang", "w", "word").agg(F.sum("n").alias("n"))


def _merged(held: list[list[np.ndarray]], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Distinct rows of the held columns and how often each occurs, in batches of `rows`; empties `held`."""
    parts = [list(c) for c in zip(*held)]
    held.clear()
    columns = []
    while parts:  # a column's parts go before the next column is put together
        columns.append(np.concatenate(parts.pop(0)))
    order, begins = _runs(columns)
    n = np.diff(np.append(begins, len(order)))
    order = order[begins]
    for at in range(0, len(order), rows):
        some = order[at:at + rows]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[some].view(np.int64)) for c in columns], pa.array(n[at:at + rows])], [*names, "n"])


def _suffixes(docs: DataFrame, depth: int, open_bits: np.ndarray, block: int = 1 << 19) -> DataFrame:
    """w1..w`depth` and n of suffixes whose branches of one level less may be open, merged within blocks of a task."""
    sent = docs.sparkSession.sparkContext.broadcast(open_bits)
    names = [f"w{i + 1}" for i in range(depth)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for w, follows, *_ in _read(batches):
            if len(w) < depth:
                continue
            if depth == 2:
                good = in_bits(sent.value, w)
                at = np.flatnonzero(good[:-1] & good[1:] & follows[:-1])
            else:
                good = follows[:-1] & in_bits(sent.value, pair_code(w[:-1], w[1:]))
                at = np.flatnonzero(good[:-1] & good[1:])
            held.append([w[at + i] for i in range(depth)])
            size += len(at)
            if size >= block:
                yield from _merged(held, names)
                size = 0
        if size:
            yield from _merged(held, names)

    return docs.mapInArrow(make, ", ".join(f"{c} long" for c in [*names, "n"]))


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _STEP + b)


def _leaves(rows: DataFrame, depth: int, least: int, groups: int, deep: list[list[int]]) -> DataFrame:
    """Totals of the subtrees' leaves at `depth`, those below `least` closed.

    `deep` lists the prefixes to extend: words at the first place, pairs (by their code) at the second.
    """
    names = [f"w{i + 1}" for i in range(depth)]
    sc = rows.sparkSession.sparkContext
    sent = [sc.broadcast(np.sort(np.array(d, np.int64))) for d in deep]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [batch.column(n).to_numpy() for n in names]
            level = np.isin(w[0], sent[0].value).astype(np.int32)
            if depth == 3:
                level += (level > 0) & np.isin(pair_code(w[0].view(np.uint64), w[1].view(np.uint64)).view(np.int64), sent[1].value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level)], [*batch.schema.names, "level"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            w, n = [batch.column(c).to_numpy() for c in names], batch.column("n").to_numpy()
            if held is not None:
                w, n = [np.append(h, c) for h, c in zip(held[0], w)], np.append(held[1], n)
            new = np.zeros(len(n), bool)
            new[:1] = True
            for c in w:
                new[1:] |= c[1:] != c[:-1]
            begins = np.flatnonzero(new)
            if not len(begins):
                continue
            sums = np.add.reduceat(n, begins)
            held = [c[begins[-1:]] for c in w], sums[-1:]
            yield out([c[begins[:-1]] for c in w], sums[:-1])
        if held is not None:
            yield out(*held)

    def out(w: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch:
        stay = sums >= least
        return pa.RecordBatch.from_arrays([*[pa.array(c[stay]) for c in w], pa.array(sums[stay])], [*names, "n"])

    ddl = ", ".join(f"{c} long" for c in [*names, "n"])
    if any(deep):
        rows = rows.mapInArrow(placed, ddl + ", level int")
    else:
        rows = rows.withColumn("level", F.lit(0))
    prefix = F.when(F.col("level") == 0, F.col("w1")).when(F.col("level") == 1, F.xxhash64("w1", "w2")).otherwise(F.xxhash64(*names))
    grouped = rows.repartition(groups, prefix).select(*names, "n").sortWithinPartitions(*names)
    return grouped.mapInArrow(total, ddl)


def _cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in 38 decimal digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, inside_percent: int = 50, budget: int = 1 << 22) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best `most` phrases of two or three words.

    a counts the phrase, l and r the parts of its lowest-scoring cut, n all words of the
    language. Two-word phrases inside a three-word one that has `inside_percent` of their
    count are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    rows = rows.withColumn("tongue", F.xxhash64("lang"))
    table = shared_stage(word_table(rows))
    sizes = table.groupBy("lang").agg(F.sum("n").alias("total"))
    whole = int(sizes.agg(F.sum("total")).first()[0] or 0)
    groups = max(1, min(MOST_GROUPS, -(-whole // budget)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    large = -(-whole // (4 * groups))  # fewer than four prefixes a group are larger
    common = table.where(F.col("n") >= least)
    deep_words = [r["w"] for r in bounded_rows(common.where(F.col("n") > large).select("w"), 4 * groups)]
    pairs = shared_stage(_leaves(_suffixes(rows, 2, slot_bits(common, "w")), 2, least, groups, [deep_words]))

    coded = pairs.mapInArrow(_with_code, "w1 long, w2 long, n long, code long")
    deep_pairs = [r["code"] for r in bounded_rows(coded.where(F.col("n") > large).select("code"), 4 * groups)]
    triples = _leaves(_suffixes(rows, 3, slot_bits(coded, "code")), 3, least, groups, [deep_words, deep_pairs])
    triples = shared_stage(triples.select("w1", "w2", "w3", F.col("n").alias("a")))

    spelt = common.select("w", "lang", F.col("word").cast("string").alias("word"), "n")
    first = spelt.select(F.col("w").alias("w1"), "lang", F.col("word").alias("t1"), F.col("n").alias("f1"))
    second = spelt.select(F.col("w").alias("w2"), F.col("word").alias("t2"), F.col("n").alias("f2"))
    known = shared_stage(pairs.join(first, "w1").join(second, "w2").select("w1", "w2", "lang", "t1", "t2", "f1", "f2", F.col("n").alias("f12")))

    a = F.col("a")
    outer = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = known.join(outer, ["w1", "w2"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("f12") * inside_percent, F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f12").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))
    two = two.withColumn("score", _cut_score(a, F.col("l"), F.col("r")))

    tail = known.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("t2").alias("t3"), F.col("f2").alias("f3"), F.col("f12").alias("f23"))
    three = triples.join(known, ["w1", "w2"]).join(tail, ["w2", "w3"])
    three = three.withColumns({"s1": _cut_score(a, F.col("f1"), F.col("f23")), "s2": _cut_score(a, F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    return _best(two.union(three), sizes, most)


def _with_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code = pair_code(*(batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], [*batch.schema.names, "code"])


def _best(found: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language: first within shares of it, so that no language is sorted in one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = max(64, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= most)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, d, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM i),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
o AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN o ON o.lang = f2.lang AND o.w1 = f2.w1 AND o.w2 = f2.w2
  WHERE f2.f >= 10 AND coalesce(100 * o.f < 50 * f2.f, true)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 1
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
