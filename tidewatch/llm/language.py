"""Language ID by hierarchical discrimination.

A linear classifier first tells the language family, then one-versus-one linear support
vector machines separate the languages within it. Features of a text are the square roots
of its hashed letter n-gram counts (1 to 3 bytes of UTF-8, A-Z lowered, everything in ASCII
that is no letter taken as a gap), scaled to length 1. Every text is read whole. The fit
uses about `per_language` labelled rows of each language, chosen by a hash of their ids;
that bound is its only limit. Languages outside the family table form families of their own.

Null texts and texts without a letter are `und` with score 0; so is everything when no
labelled row exists. With one language, that is the answer with score 1. A null doc_id
counts as training; repeated rows are predicted alike.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewatch.llm.shared import crc_of, quoted, whole_row
from tidewatch.llm.words import LOWER, slices
from tidewatch.session import bounded_rows

DIMS = 4096
PIECE = 1 << 18  # bytes worked on at a time, so that a worker stays small
UNKNOWN = "und"
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr"),
}
LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One row of DIMS numbers for each text."""
    n = len(places) - 1
    out = np.zeros(n * DIMS, np.float32)
    x = LOWER[data]
    x = np.where(LETTER[x], x, 32)
    for at in range(0, len(x), PIECE):  # a piece and the two bytes after it
        part = x[at:at + PIECE + 2].astype(np.int64)
        own = min(len(part), PIECE)
        text = np.searchsorted(places, np.arange(at, at + own), "right") - 1
        left = places[text + 1] - np.arange(at, at + own)
        code = np.zeros(own, np.int64)
        for size in (1, 2, 3):
            more = part[size - 1:size - 1 + own]
            code[:len(more)] = code[:len(more)] * 257 + more + 1
            good = left >= size
            slot = ((code + size * 7919) * 2654435761 >> 9) % DIMS
            low, high = int(text[0]), int(text[-1]) + 1
            counted = np.bincount((text[good] - low) * DIMS + slot[good], minlength=(high - low) * DIMS)
            out[low * DIMS:high * DIMS] += counted
    out = np.sqrt(out.reshape(n, DIMS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, turns: int = 20, seed: int = 3) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine, by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.full((len(x), 1), 0.5, x.dtype)])
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(turns):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0, c) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    w[-1] *= 0.5
    return w


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)  # languages of each family
    family_weights: np.ndarray | None = None  # one column a family
    pairs: list[tuple[int, int, int]] = field(default_factory=list)  # family, language for +, language for -
    pair_weights: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each row, and a score."""
        n, sure = len(x), np.ones(len(x))
        family = np.zeros(n, np.int64)
        if len(self.families) > 1:
            margin = x @ self.family_weights[:-1] + self.family_weights[-1]
            family = margin.argmax(1)
            top = np.sort(margin, 1)
            sure = 1 / (1 + np.exp(-(top[:, -1] - top[:, -2])))
        votes = np.zeros((n, len(self.languages)))
        margins = x @ self.pair_weights[:-1] + self.pair_weights[-1] if self.pairs else None
        for k, (_, a, b) in enumerate(self.pairs):
            m = margins[:, k]
            soft = np.tanh(m) * 1e-3  # ties in votes go to the larger margins
            votes[:, a] += (m >= 0) + soft
            votes[:, b] += (m < 0) - soft
        mask = np.full((len(self.families), len(self.languages)), -np.inf)
        for f, own in enumerate(self.families):
            mask[f, own] = 0
        best = (votes + mask[family]).argmax(1)
        for k, (_, a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-2 * np.abs(margins[:, k])))
            sure = np.where((best == a) | (best == b), np.minimum(sure, p), sure)
        return best, sure


def fit(labelled: DataFrame, per_language: int = 500, families: Mapping[str, tuple[str, ...]] = FAMILIES, most_languages: int = 500) -> Model:
    """Fit on `labelled` (doc_id, text, lang); text and lang are not null."""
    sizes = bounded_rows(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), most_languages)
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model()
    of = {lang: name for name, members in families.items() for lang in members}
    names = sorted({of.get(lang, lang) for lang in languages})
    groups = [[i for i, lang in enumerate(languages) if of.get(lang, lang) == name] for name in names]
    model = Model(languages, groups)
    if len(languages) == 1:
        return model
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, places in slices(batch, "text", 1 << 20):
                x = features(data, places)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    rows = sample.mapInArrow(vectors, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, DIMS)
    y = np.array([languages.index(v) for v in rows.column("lang").to_pylist()])
    order = np.lexsort((x[:, :8].sum(1), y))  # the same fit whatever order the rows came in
    x, y = x[order], y[order]
    if len(groups) > 1:
        model.family_weights = np.stack([svm(x, np.where(np.isin(y, own), 1.0, -1.0)) for own in groups], 1)
    columns = []
    for f, own in enumerate(groups):
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                rows_ab = (y == a) | (y == b)
                model.pairs.append((f, a, b))
                columns.append(svm(x[rows_ab], np.where(y[rows_ab] == a, 1.0, -1.0)))
    if columns:
        model.pair_weights = np.stack(columns, 1)
    return model


def _has_letter(part: pa.RecordBatch, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum((LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A))]
    out = np.diff(total[places]) > 0
    for i in np.flatnonzero(~out & (np.diff(places) > 0)):
        out[i] = any(c.isalpha() for c in data[places[i]:places[i + 1]].tobytes().decode())
    return out


def predict(docs: DataFrame, model: Model, mark: bool = True, keep_text: bool = False) -> DataFrame:
    """All columns of `docs` but text (unless `keep_text`), with lang_pred and score.

    Without any language learned, texts with letters are marked as unknown like the others, or
    with `mark` off get an empty prediction.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [n for n in docs.columns if keep_text or n != "text"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part, data, places in slices(batch, "text", 1 << 20):
                some = _has_letter(part, data, places)
                names, scores = [], []
                for at in range(0, len(places) - 1, 128):
                    own = places[at:at + 129]
                    best, sure = model.predict(features(data[own[0]:own[-1]], own - own[0])) if model.languages else (None, None)
                    for i, ok in enumerate(some[at:at + 128]):
                        known = ok and bool(model.languages)
                        names.append(model.languages[best[i]] if known else UNKNOWN if mark or not ok else "")
                        scores.append(float(sure[i]) if known else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(tell, StructType([*(f for f in docs.schema if f.name in kept), *added]))


def training_rows(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    learn = ~F.coalesce(crc_of("doc_id", parts) == held, F.lit(False))
    return docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def identify(docs: DataFrame, parts: int = 4, held: int = 2, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(training_rows(docs, parts, held), **how)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of("doc_id", parts) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"))
    return predict(rows, model)


def known_language(docs: DataFrame, parts: int = 4, held: int = 2, **how) -> DataFrame:
    """The rows of `docs` whose language can be told, with all their columns; null and letterless texts go.

    Where no row has a label, nothing can be told apart and every text with letters stays.
    """
    model = fit(training_rows(docs, parts, held), **how)
    rows = docs.select(whole_row(docs, ("text",)).alias("_doc"), F.col("text").cast("string").alias("text"))
    out = predict(rows, model, mark=False, keep_text=True).where(F.col("lang_pred") != UNKNOWN)
    return out.select(*["text" if n == "text" else F.col(f"_doc.{quoted(n)}").alias(n) for n in docs.columns])
