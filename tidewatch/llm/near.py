"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

A document's set holds its distinct k-word shingles as 64-bit hashes; with fewer than k
words the whole sequence is its one shingle. Documents with equal sets form one class and
are worked on once. Every class gets SAMPLES MinHash values: the first ones form bands of ROWS, each
a bucket key, and all together are folded into an odd sketch, a bitmap of parities. From the
bits in which two sketches differ follows a close estimate of a high similarity; candidates
clearly below the wanted similarity go, the others are confirmed on the full sets.

Buckets are never expanded into all pairs. In each of a few rounds every class compares
itself with one bucket leader outside its component, and confirmed links merge components.
What still stands in one bucket but in different components is compared at the end: classes
whose shingles are too much their own to reach the similarity with anyone fall out, the rest
meets by sketches in blocks of bounded size, and only similar pairs leave a block. A pair at the wanted similarity shares no band
with probability (1 - s**ROWS)**BANDS, about 1e-7 at 0.8.

Null, empty and white texts have no set and link with nothing. Repeated rows share a class.
A group's id is its smallest doc_id; a null doc_id never is one while another exists, and
`kept` is null-safe: rows of a group without any doc_id are all kept. An empty table gives
an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import in_slots, text_of, whole_row
from tidewatch.llm.words import NOT_SPACE, grams, mixed, slices, words
from tidewatch.session import shared_stage

ROWS, BANDS = 5, 40
SAMPLES, BITS = 1600, 4096
#: The estimate's spread at 0.8 is below 0.014: five times that below the wanted similarity nothing is refused.
MARGIN = 0.07
_rng = np.random.default_rng(977)
_A = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_PLACE = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, places: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = words(data, places, NOT_SPACE)
    g, whole = grams(found, k)
    for a, b in zip(found.bounds[:-1], found.bounds[1:]):
        if b - a >= k:
            yield np.unique(g[a:b][whole[a:b]])
        elif b > a:
            h = np.uint64(b - a)
            for w in found.hash[a:b]:
                h = mixed(np.array([h], np.uint64) * np.uint64(0xA0761D6478BD642F) + w)[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(best, (np.multiply.outer(_A, x[at:at + 512]) + _B[:, None]).min(1), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    for column in values[:BANDS * ROWS].reshape(BANDS, ROWS).T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return mixed(key).view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash samples as BITS / 64 numbers."""
    bit = mixed(_PLACE ^ values.astype(np.uint64)) % np.uint64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(bool)).view(np.int64)


def odd_similarity(differing):
    """Estimated similarity from the number of differing bits (a Column)."""
    share = F.least(differing / F.lit(BITS / 2), F.lit(1 - 1e-9))
    return 1 + F.lit(BITS / (4.0 * SAMPLES)) * F.log(1 - share)


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, bands, odd; null set_key for texts without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, places in slices(batch, "text"):
                n, keys, bands, odd = [], [], [], []
                for s in shingle_sets(data, places, k):
                    n.append(len(s))
                    keys.append(_set_key(s) if len(s) else None)
                    values = minhashes(s) if len(s) else None
                    bands.append(band_keys(values) if len(s) else None)
                    odd.append(odd_sketch(values) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, odd array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """set_key and the set's packed hashes; a task gives each set once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            for _, data, places in slices(batch, "text"):
                rows = []
                for s in shingle_sets(data, places, k):
                    key = _set_key(s)
                    if len(s) and key not in given:
                        given.add(key)
                        rows.append((key, s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["set_key", "shingles"])

    return docs.select("text").mapInArrow(make, "set_key binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets (node, shingles)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column("_one"), batch.column("_two")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(keep) for n in ("a", "b")], ["a", "b"])

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_one")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_two")), "b")
    return rows.select("a", "b", "_one", "_two").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node in `links` (a, b).

    Every root hooks onto its smallest neighbour, chains of hooks are halved until flat, and
    the links are drawn again between the new roots; each step is a table.
    """
    links = shared_stage(links)
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    while True:
        links = shared_stage(
            links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if links.isEmpty():
            return labels
        hooks = shared_stage(links.groupBy("a").agg(F.min("b").alias("p")))
        while True:
            up = hooks.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
            longer = hooks.join(up, F.col("p") == F.col("_a"), "left")
            if longer.where("_p is not null").isEmpty():
                break
            hooks = shared_stage(longer.select("a", F.coalesce("_p", "p").alias("p")))

        def through(df: DataFrame, name: str) -> DataFrame:
            hook = hooks.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
            return df.join(hook, F.col(name) == F.col("_a"), "left").withColumn(name, F.coalesce("_p", name)).drop("_a", "_p")

        labels = shared_stage(through(labels, "root"))
        links = through(through(links, "a"), "b")


BLOCK = 1024  # members of a bucket that are compared with as many others at a time


def _similar(one: np.ndarray, two: np.ndarray, n: tuple[np.ndarray, np.ndarray], common: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which of all pairs may reach `percent`, by odd sketches, set sizes and shingles that others have too."""
    bits = np.bitwise_count(one[:, None, :] ^ two[None, :, :]).sum(2)
    share = np.minimum(bits / (BITS / 2), 1 - 1e-9)
    estimate = 1 + BITS / (4.0 * SAMPLES) * np.log(1 - share)
    most = np.minimum.outer(*common)  # no pair has more in common
    return (estimate >= percent / 100 - MARGIN) & (100 * most >= percent * (np.add.outer(*n) - most))


def _compared(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, within each (h, lb, rb).

    blocks: h, lb, rb, left, node, comp, n_shingles, common, odd, bands. Rows come sorted by block,
    so a task holds one block at a time; a pair leaves it if it passes the sketches, and only in
    the first band that the two share.
    """

    def pairs_of(t: pa.Table) -> np.ndarray:
        left = t.column("left").to_numpy()
        node, comp, n, common = (t.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "common"))
        odd = t.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().astype(np.uint32).reshape(-1, BANDS)
        own = int((bands[0] == np.uint32(t.column("h")[0].as_py() & 0xFFFFFFFF)).argmax())
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        good = []
        for at in range(0, len(x), 64):
            i = x[at:at + 64]
            hit = _similar(odd[i], odd[y], (n[i], n[y]), (common[i], common[y]), percent) & (comp[i][:, None] != comp[y][None, :])
            p, q = np.nonzero(hit)
            first = (bands[i[p]] == bands[y[q]]).argmax(1) == own
            p, q = p[first], q[first]
            good.append(np.stack([node[i[p]], node[y[q]]], 1))
        return np.concatenate(good) if good else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("h", "lb", "rb")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for at, to in zip(cuts[:-1], cuts[1:]):
                if to == at:
                    continue
                own = tuple(key[at])
                if own != now and held:
                    yield from given(pairs_of(pa.concat_tables(held)))
                    held = []
                now = own
                held.append(pa.Table.from_batches([batch.slice(at, to - at)]))
        if held:
            yield from given(pairs_of(pa.concat_tables(held)))

    def given(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found.max(1)), pa.array(found.min(1))], ["a", "b"])

    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = blocks.repartition(parts, "h", "lb", "rb").sortWithinPartitions("h", "lb", "rb")
    return rows.mapInArrow(run, "a long, b long")


def _estimated(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that set sizes and odd sketches do not rule out."""
    one = light.select(F.col("node").alias("a"), F.col("n_shingles").alias("_na"), F.col("odd").alias("_oa"))
    two = light.select(F.col("node").alias("b"), F.col("n_shingles").alias("_nb"), F.col("odd").alias("_ob"))
    differing = F.aggregate(F.zip_with("_oa", "_ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")) & (odd_similarity(differing) >= percent / 100 - MARGIN)
    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")


def _ordered(a: str, b: str) -> tuple:
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def _leader_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """One comparison a class: the best leader, of all its buckets, outside its component.

    A bucket is led by the member with most company in its own buckets, which in a group of
    near copies is one that was edited little; later turns vary the order at random.
    """
    rank = -F.col("company") * (1 if turn == 0 else 1 + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(8)))
    lead = rows.groupBy("h").agg(
        F.min(F.struct(rank.alias("r"), "node", "comp")).alias("_l"), F.min("comp").alias("_x"), F.max("comp").alias("_y"))
    lead = lead.where("_x < _y").select("h", "_l")
    chosen = rows.join(lead, "h").where(F.col("comp") != F.col("_l.comp")).groupBy("node").agg(F.min("_l").alias("_l"))
    return chosen.select("node", F.col("_l.node").alias("_n")).select(*_ordered("node", "_n")).distinct()


def _open_rows(rows: DataFrame) -> DataFrame:
    """Buckets that hold several components: h, main (the largest), most, m, x, y."""
    sizes = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("x"))
    return sizes.groupBy("h").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("m"),
        F.min("x").alias("x"), F.max("x").alias("y"), F.count(F.lit(1)).alias("comps")).where("comps > 1")


def _shingle_rows(sets: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, own in zip(batch.column("node").to_pylist(), batch.column("shingles")):
                s = np.frombuffer(own.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s)], ["node", "s"])

    return sets.select("node", "shingles").mapInArrow(spread, "node long, s long")


def _linkable(nodes: DataFrame, light: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of `nodes`, those that share enough shingles with any other of them: light's columns and `common`.

    `common` counts a class's shingles that stand in another class as well. No pair has more
    than that in common, which rules out exactly what was edited too much or stands for itself.
    """
    alone = _shingle_rows(sets.join(nodes, "node")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    single = alone.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    counted = light.join(nodes, "node").join(single, "node", "left")
    counted = counted.withColumn("common", F.col("n_shingles") - F.coalesce("u", F.lit(0).cast("long"))).drop("u")
    return shared_stage(counted.where(100 * F.col("common") >= percent * F.col("n_shingles")))


def _open_pairs(rows: DataFrame, light: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair that shares a bucket but no component and may be similar.

    In each bucket the members outside its largest component meet all members, block by
    block; a bucket of two is a pair already.
    """
    nodes = rows.join(_open_rows(rows).select("h"), "h").select("node").distinct()
    light = _linkable(nodes, light, sets, percent)
    rows = rows.join(light.select("node"), "node")
    sizes = shared_stage(_open_rows(rows))
    twos = _estimated(sizes.where("m = 2").select(*_ordered("x", "y")).distinct(), light, percent)
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    more = sizes.where("m > 2").select("h", "main", parts(F.col("m") - F.col("most")).alias("_nl"), parts(F.col("m")).alias("_nr"))
    met = rows.join(more, "h").join(light, "node")
    shown = ("h", "node", "comp", "n_shingles", "common", "odd", "bands")
    lb, rb = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_nl")), F.pmod(F.xxhash64("node", F.lit(2)), F.col("_nr"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = met.where("comp <> main").select(*shown, F.lit(True).alias("left"), lb.alias("lb"), every("_nr").alias("rb"))
    right = met.select(*shown, F.lit(False).alias("left"), rb.alias("rb"), every("_nl").alias("lb"))
    return twos.union(_compared(left.unionByName(right), percent)).distinct()


def _linked(members: DataFrame, light: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame | None:
    """node, root over all confirmed links between classes that share a bucket, or None."""
    links: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(rounds + 1):
        rows = members.withColumn("comp", F.col("node"))
        if labels is not None:
            rows = members.join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        pairs = _estimated(_leader_pairs(rows, turn), light, percent) if turn < rounds else _open_pairs(rows, light, sets, percent)
        found = shared_stage(confirmed(pairs, sets, percent))
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = components(links)
    return labels


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2, with_root: bool = False) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component_id and kept of every document.

    With `with_root` also root, which tells components apart whatever their ids; null without words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = shared_stage(signatures(rows, k))
    classes = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = shared_stage(classes.select("*", F.monotonically_increasing_id().alias("node")))
    banded = classes.select("node", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    members = shared_stage(banded.join(shared, "h"))
    company = members.groupBy("node").agg(F.sum("_m").alias("company"))
    members = shared_stage(members.select("h", "node").join(company, "node"))
    named = shared_stage(members.select("node").distinct().join(
        classes.select("node", "set_key", "text_key", "n_shingles", "odd", "bands"), "node"))
    wanted = in_slots(rows.select("text", "text_key"), named, "text_key")
    sets = full_sets(wanted, k).join(named.select("set_key", "node"), "set_key").dropDuplicates(["node"]).select("node", "shingles")
    labels = _linked(members, named.select("node", "n_shingles", "odd", "bands"), shared_stage(sets), percent, rounds)
    ids = classes.select("set_key", "node", "rep")
    if labels is None:
        ids = ids.withColumns({"component_id": F.col("rep"), "root": F.col("node")})
    else:
        ids = ids.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
        ids = ids.join(smallest, "root")
    out = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(ids.select("set_key", "component_id", "root"), "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    root = ["root"] if with_root else []
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), *root)


def unique_documents(docs: DataFrame, **how) -> DataFrame:
    """One whole row of `docs` for each group of near-duplicates, and of the rows without words one for each id and text.

    In a group that with the smallest doc_id stays (null last), of equal ids that with the smallest text hash.
    """
    groups = near_groups(docs, with_root=True, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_key"))
    chosen = groups.where(F.col("root").isNotNull()).groupBy("root").agg(first.alias("_first")).select("_first.doc_id", "_first.text_key")
    groups = chosen.union(groups.where(F.col("root").isNull()).select("doc_id", "text_key").distinct())
    rows = docs.select(
        whole_row(docs).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_key"))
    same = (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    return rows.join(groups, same, "left_semi").dropDuplicates(["_key", "_id"]).select("_doc.*")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
r AS (
  WITH RECURSIVE reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.seen)
  SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id
"""
