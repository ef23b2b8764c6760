"""License scans by diagonal voting.

All rolling two-word hashes of a text are joined to the positions of the same hashes in a
small set of templates. Matches with the same offset (word position minus template position)
lie on one diagonal; each diagonal's matches are counted, diagonals that lie next to each
other are merged (a word more or less moves the rest of a notice by one), and the spans that
have enough votes are verified word by word against the text.

Base phrases count where all their words stand consecutively. Notices carry finer labels;
among overlapping notices the best one stays. Words are runs of small letters, digits and
everything beyond ASCII after A-Z were lowered. Null and empty texts have no words. Rows
repeated with the same doc_id and text give equal rows.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import in_slots, text_of
from tidewatch.llm.words import ALNUM, grams, slices, text_bytes, word_counts, words

#: Phrases with the labels they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices as they commonly stand in files, with finer labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this library is licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under the mozilla public license version 2 0", "mpl-2.0"),
)
GRAM = 2
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool


def templates(phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> list[Template]:
    return [Template(tuple(t.split()), label, base) for base, group in ((True, phrases), (False, notices)) for t, label in group]


def _lower(text: str) -> bytes:
    return bytes(text, "utf-8").translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def word_list(text: str) -> list[str]:
    return [w.decode() for w in _WORD.findall(_lower(text))]


def gram_rows(docs: DataFrame) -> DataFrame:
    """doc_id, _k, pos and h of every two-word run of every text."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, places in slices(batch, "text", 1 << 20):
                found = words(data, places, ALNUM)
                g, whole = grams(found, GRAM)
                text = found.text
                at = np.flatnonzero(whole)
                row = pa.array(text[at])
                pos = (at - found.bounds[:-1][text[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("_k").take(row), pa.array(pos), pa.array(g[at].view(np.int64))], ["doc_id", "_k", "pos", "h"])

    return docs.select("doc_id", "_k", "text").mapInArrow(roll, "doc_id long, _k long, pos int, h long")


def template_rows(spark, known: Sequence[Template]) -> DataFrame:
    rows = []
    for i, t in enumerate(known):
        data, places = text_bytes(pa.array([" ".join(t.words)]))
        g, whole = grams(words(data, places, ALNUM), GRAM)
        rows += [(i, t.base, len(t.words), j, int(v)) for j, v in enumerate(g[whole].view(np.int64))]
    return spark.createDataFrame(rows, "t int, base boolean, n int, tpos int, h long")


def spans(docs: DataFrame, known: Sequence[Template], slack: int = 3, least: float = 0.5) -> DataFrame:
    """doc_id, _k, t, first, last: where a template may stand, from votes alone."""
    # The templates are a parameter: a few hundred positions, whatever the corpus.
    hits = gram_rows(docs).join(F.broadcast(template_rows(docs.sparkSession, known)), "h")
    hits = hits.select("doc_id", "_k", "t", "base", "n", (F.col("pos") - F.col("tpos")).alias("d"), "pos").distinct()
    lines = hits.groupBy("doc_id", "_k", "t", "base", "n", "d").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    own = lines.where(F.col("base") & (F.col("votes") == F.col("n") - GRAM + 1))
    rest = lines.where(~F.col("base"))
    by = Window.partitionBy("doc_id", "_k", "t").orderBy("d")
    new = F.coalesce(F.col("d") - F.lag("d").over(by) > slack, F.lit(True))
    rest = rest.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(by))
    merged = rest.groupBy("doc_id", "_k", "t", "n", "_run").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    merged = merged.where(F.col("votes") >= least * (F.col("n") - GRAM + 1))
    out = ("doc_id", "_k", "t", "first", (F.col("last") + GRAM - 1).alias("last"))
    return own.select(*out).union(merged.select(*out))


def _share(template: Sequence[str], text: Sequence[str]) -> float:
    """Words in common and in order, as a share of the longer of the template and the matched stretch."""
    blocks = [b for b in SequenceMatcher(None, template, text, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0
    stretch = blocks[-1].b + blocks[-1].size - blocks[0].b
    return sum(b.size for b in blocks) / max(len(template), stretch)


def verified(docs: DataFrame, found: DataFrame, known: Sequence[Template], least: float = 0.8) -> DataFrame:
    """doc_id, _k, n_base, first_word, last_word, base_labels, labels, score of texts with spans."""
    listed = found.groupBy("doc_id", "_k").agg(F.collect_list(F.struct("t", "first", "last")).alias("spans"))
    texts = in_slots(docs.select("doc_id", "_k", "text"), listed, "_k").dropDuplicates(["doc_id", "_k"])
    same = F.col("x._k").eqNullSafe(F.col("y._k")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))
    rows = listed.alias("x").join(texts.alias("y"), same).select("x.doc_id", "x._k", "x.spans", "y.text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, k, places, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "_k", "spans", "text"))):
                ws, base, notices = word_list(text), [], []
                for p in places:
                    t, a, b = known[p["t"]], p["first"], p["last"]
                    if t.base:
                        if tuple(ws[a:b + 1]) == t.words:
                            base.append((a, t.label))
                    else:
                        # room for words that stand before the first and after the last match
                        share = _share(t.words, ws[max(0, a - 2):b + 3])
                        if share >= least:
                            notices.append((-share, a, b, t.label))
                best: list[tuple] = []
                for n in sorted(notices):
                    if all(n[2] < m[1] or m[2] < n[1] for m in best):
                        best.append(n)
                own = {label for _, label in base}
                labels = own | {n[3] for n in best}
                score = max([1.0 if base else 0.0, *(-n[0] for n in best)])
                starts = [a for a, _ in base]
                out.append((key, k, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("_k", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    return rows.mapInArrow(check, "doc_id long, _k long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, places in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_k"), pa.array(word_counts(data, places, ALNUM))], ["doc_id", "_k", "n_words"])


def licenses(docs: DataFrame, known: Sequence[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    known = known or templates()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("_k", F.xxhash64("doc_id", "text"))
    sizes = rows.mapInArrow(_counted, "doc_id long, _k long, n_words long")
    marks = verified(rows, spans(rows, known), known)
    same = F.col("x._k").eqNullSafe(F.col("y._k")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))
    none = F.lit("")
    return sizes.alias("x").join(marks.alias("y"), same, "left").select(
        "x.doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
