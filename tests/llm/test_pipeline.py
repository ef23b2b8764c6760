"""The pipeline's stages against plain versions on the smallest tables."""
import collections
import re

import pytest

import corpus_pipeline
from tidewatch.llm import mixing
from tidewatch.session import shared_stage

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(shared_stage(stage(spark, out[-1], SMALL)))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5


def test_language_stage_keeps_every_text_with_letters(steps):
    assert sorted(rows(steps[1])) == sorted(r for r in rows(steps[0]) if any(c.isalpha() for c in r[1] or ""))


def test_exact_stage(steps):
    first = {}
    for key, text in sorted(rows(steps[1])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), key)
    assert sorted(k for k, _ in rows(steps[2])) == sorted(first.values())


def test_near_stage(steps):
    from test_operators import brute_groups

    before = rows(steps[2])
    want = {g for _, _, g in brute_groups(before, 5, 80)}
    assert sorted(k for k, _ in rows(steps[3])) == sorted(want)


def test_mixing_stage_meets_the_targets(steps):
    source = {r["doc_id"]: r["source"] for r in steps[3].select("doc_id", "source").collect()}
    sizes, got = collections.Counter(), collections.Counter()
    for key, text in rows(steps[3]):
        sizes[source[key]] += len(text.encode().split())
    for key, text in rows(steps[4]):
        got[source[key]] += len(text.encode().split())
    order = sorted(sizes)
    want = mixing.targets([sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5, 2.0)
    for s, w in zip(order, want):
        assert got[s] == pytest.approx(w, rel=0.01, abs=2)


def test_packing_stage_takes_every_token(steps):
    pieces = steps[5].collect()
    per = collections.Counter()
    for r in pieces:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 2048 and sum(per.values()) > 0.98 * 2048 * len(per) - 2048
    assert {r["doc_id"] for r in pieces} == {k for k, _ in rows(steps[4])}


def test_run_is_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, steps[5].select(*key).collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, `page-id` int, `my col` string, `a.b` string, `order` int, `_doc` string, `x``y` int"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 7, "c", "d", 3, "e", 9) for i, t, lang, s in rows], ODD)


def test_stages_take_columns_of_any_name(spark):
    rows = [(i, f"word{i} and more words of text number {i}" * 3, "en" if i % 2 else "de", "ab"[i % 2]) for i in range(40)]
    docs = odd_docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.schema == docs.schema
        assert {tuple(r)[5:] for r in out.collect()} == {(7, "c", "d", 3, "e", 9)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    docs = odd_docs(spark, [(i, f"some text {i}", None, "a") for i in range(60)] + [(60, "12 34", None, "a"), (61, None, None, "a")])
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, SMALL).collect()} == set(range(60))


def test_near_stage_keeps_one_of_equal_or_missing_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    copies = [f"{words} {x}" for x in ("a", "b", "c")]
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(5, t, "en", "a") for t in copies] + [(None, f"{other} {x}", "en", "a") for x in "abc"] + [(None, "", "en", "a"), (7, None, "en", "a"), (8, "lone words", "en", "a")]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, odd_docs(spark, rows), SMALL).collect()]
    assert sum(k == 5 for k, _ in kept) == 1 and sum(k is None and bool(t) for k, t in kept) == 1
    assert {(None, ""), (7, None), (8, "lone words")} <= set(kept) and len(kept) == 5
