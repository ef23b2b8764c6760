"""The operators of this subpackage as queries over their whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import exact, language, licenses, lm, mixing, near, packing, phrases, secrets, substring, warc, whitening, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_class_lm")
def op1(spark, folder):
    return lm.perplexity_table(documents(spark, folder))


@query("op2_pack")
def op2(spark, folder):
    return packing.packed_digests(documents(spark, folder))


@query("op3_licenses")
def op3(spark, folder):
    return licenses.licenses(documents(spark, folder))


@query("op4_mix")
def op4(spark, folder):
    return mixing.taken(documents(spark, folder))


@query("op5_warc", warc.ORACLE)
def op5(spark, folder):
    return warc.round_trip(spark.read.parquet(f"{folder}/pages.parquet"))


@query("op6_near_dedup", near.ORACLE)
def op6(spark, folder):
    return near.near_groups(documents(spark, folder), k=4).drop("text_key")


@query("op7_exact_dedup", exact.ORACLE)
def op7(spark, folder):
    return exact.dedup(documents(spark, folder))


@query("op8_winnow")
def op8(spark, folder):
    return winnow.with_next(documents(spark, folder))


@query("op9_secrets")
def op9(spark, folder):
    return secrets.secrets(documents(spark, folder))


@query("op10_language")
def op10(spark, folder):
    return language.identify(documents(spark, folder))


@query("op11_phrases", phrases.ORACLE)
def op11(spark, folder):
    return phrases.collocations(documents(spark, folder))


@query("op12_whitening")
def op12(spark, folder):
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op13_substring", substring.ORACLE)
def op13(spark, folder):
    return substring.without_repeats(documents(spark, folder), with_text=False)
