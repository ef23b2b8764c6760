"""Secret scans with inferred grammars.

Fixed patterns find three kinds of credentials. Their values, labelled by kind, are the
training strings of one probabilistic automaton a kind: a prefix tree over character
classes whose states are merged as long as their outgoing frequencies agree (Hoeffding
bound). Every other run of credential characters that is long enough and holds both a digit
and a letter is a candidate; it becomes an `inferred` span when some kind's automaton gives
it a likelihood per character as high as that kind's own held-back strings have, and higher
than the automaton of ordinary words (runs without a digit, one a text) gives it. Base spans
always stay.

A fit uses at most `per_kind` distinct strings a kind, those with the smallest hashes; scans
read every text whole. Null and empty texts have no spans (the digest is that of an empty
string). Repeated rows give equal rows; places are code points.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import shared_stage

KINDS = ("assign", "access", "hex")
INFERRED = "inferred"
SLACK = 0.05  # below the least score of a held-back string, in natural log a character
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer is no match of the kind, and runs do not overlap
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]{8,}(?![A-Za-z0-9+/_.=-])")


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of the fixed patterns, by start, then kind."""
    out = [(m.start(), m.end(), 0, m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m.start(), m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k], a, b) for s, e, k, a, b in sorted(out, key=lambda x: (x[0], x[2]))]


def candidates(text: str, spans: Sequence[tuple]) -> list[tuple[int, int]]:
    """Runs of credential characters with a digit and a letter that touch no base span."""
    out = []
    for m in RUN.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not any(s < m.end() and m.start() < e for s, e, *_ in spans):
            out.append((m.start(), m.end()))
    return out


def ordinary_word(text: str) -> str | None:
    """The digit-free run of a text whose checksum is smallest."""
    return min(set(ORDINARY.findall(text)), key=lambda w: (zlib.crc32(w.encode()), w), default=None)


CLASSES = {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"},
           **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: c for c in "+/_.=-"}}
_SIZE = {"0": 10, "a": 6, "g": 20, "A": 26}
_SYMBOLS = sorted(set(CLASSES.values()))


class Automaton:
    """Deterministic probabilistic automaton inferred by merging prefix-tree states."""

    def __init__(self, strings: Sequence[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for text in strings:
            q = 0
            for c in text:
                self.visits[q] += 1
                s = CLASSES.get(c, "-")
                if s not in self.next[q]:
                    self.next[q][s] = len(self.next)
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.seen[q][s] = self.seen[q].get(s, 0) + 1
                q = self.next[q][s]
            self.visits[q] += 1
            self.ends[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _agree(self, x: int, m: int, y: int, n: int) -> bool:
        return not m or not n or abs(x / m - y / n) < self.bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))

    def _alike(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            m, n = self.visits[p], self.visits[q]
            if not self._agree(self.ends[p], m, self.ends[q], n):
                return False
            for s in {*self.seen[p], *self.seen[q]}:
                if not self._agree(self.seen[p].get(s, 0), m, self.seen[q].get(s, 0), n):
                    return False
                if s in self.next[p] and s in self.next[q]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for s, n in self.seen[q].items():
                self.seen[p][s] = self.seen[p].get(s, 0) + n
                if s in self.next[p]:
                    todo.append((self.next[p][s], self.next[q][s]))
                else:
                    self.next[p][s] = self.next[q][s]

    def _merge(self) -> None:
        red = [0]
        while True:
            fringe = {(q, s): t for q in red for s, t in self.next[q].items() if t not in red}
            if not fringe:
                self.states = red
                return
            (q, s), blue = max(fringe.items(), key=lambda x: (self.visits[x[1]], x[0]))
            for r in red:
                if self._alike(r, blue):
                    self.next[q][s] = r
                    self._fold(r, blue)
                    break
            else:
                red.append(blue)

    def score(self, text: str) -> float:
        """Mean log likelihood of a character, the end counted as one."""
        q, total, whole = 0, 0.0, len(_SYMBOLS) + 1
        for c in text:
            s = CLASSES.get(c, "-")
            seen, n = (self.seen[q].get(s, 0), self.visits[q]) if q >= 0 else (0, 0)
            total += math.log((seen + 0.1) / (n + 0.1 * whole)) - math.log(_SIZE.get(s, 1))
            q = self.next[q].get(s, -1) if q >= 0 else -1
        seen, n = (self.ends[q], self.visits[q]) if q >= 0 else (0, 0)
        return (total + math.log((seen + 0.1) / (n + 0.1 * whole))) / (len(text) + 1)


@dataclass
class Grammars:
    kinds: list[tuple[Automaton, float]]  # with the score a string must reach
    ordinary: Automaton | None

    def accepts(self, text: str) -> bool:
        scores = [(a.score(text), least) for a, least in self.kinds]
        plain = self.ordinary.score(text) if self.ordinary else -math.inf
        return any(value >= least and value > plain for value, least in scores)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, end, kind, value), runs (start, end, value) and an ordinary word of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            base, runs, plain = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([(s, e, k, text[a:b]) for s, e, k, a, b in spans])
                runs.append([(s, e, text[s:e]) for s, e in candidates(text, spans)])
                plain.append(ordinary_word(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[dict(zip(("start", "end", "kind", "value"), x)) for x in v] for v in base], base_type),
                                              pa.array([[dict(zip(("start", "end", "value"), x)) for x in v] for v in runs], run_type),
                                              pa.array(plain, pa.string())], ["doc_id", "base", "runs", "plain"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, base array<struct<start:long,end:long,kind:string,value:string>>, runs array<struct<start:long,end:long,value:string>>, plain string")


def infer(found: DataFrame, per_kind: int = 300) -> Grammars:
    """Automata from the scan's own labelled values; the last fifth of a kind's strings sets its least score."""
    def strings(rows: DataFrame) -> list[str]:
        rows = rows.distinct().withColumn("_h", F.xxhash64("value")).orderBy("_h", "value").limit(per_kind)
        return [r["value"] for r in rows.collect()]

    values = found.select(F.explode("base").alias("v")).select("v.kind", "v.value")
    kinds = []
    for kind in KINDS:
        own = strings(values.where(F.col("kind") == kind).select(F.substring("value", 1, 512).alias("value")))
        if len(own) >= 5:
            cut = len(own) - len(own) // 5
            automaton = Automaton(own[:cut])
            kinds.append((automaton, min(automaton.score(v) for v in own[cut:]) - SLACK))
    plain = strings(found.where("plain is not null").select(F.substring("plain", 1, 512).alias("value")))
    return Grammars(kinds, Automaton(plain) if len(plain) >= 5 else None)


def add_inferred(found: DataFrame, grammars: Grammars) -> DataFrame:
    """doc_id, base and spans (start, end, kind) with what the grammars accept."""
    sent = found.sparkSession.sparkContext.broadcast(grammars)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate((*KINDS, INFERRED))}
        for batch in batches:
            base, spans = [], []
            for old, runs in zip(batch.column("base").to_pylist(), batch.column("runs").to_pylist()):
                old = [{k: v[k] for k in ("start", "end", "kind")} for v in old]
                new = [{"start": r["start"], "end": r["end"], "kind": INFERRED} for r in runs if sent.value.accepts(r["value"])]
                base.append(old)
                spans.append(sorted(old + new, key=lambda v: (v["start"], order[v["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(spans, span)], ["doc_id", "base", "spans"])

    kind = "array<struct<start:long,end:long,kind:string>>"
    return found.mapInArrow(judge, f"doc_id long, base {kind}, spans {kind}")


def secrets(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    found = shared_stage(scan(docs))
    rows = add_inferred(found, infer(found, **how))

    def listed(name: str):
        return F.array_join(F.transform(name, lambda v: F.concat_ws(":", v["kind"], v["start"].cast("string"), v["end"].cast("string"))), ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda v: v["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(counted, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
