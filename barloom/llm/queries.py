"""The registered queries of this folder and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import byte_bpe, compression_toxicity, html_text, licence_rules, line_templates, order_minhash
from barloom.llm import phrase_stripes, prefix_trie, projection_trees, repeated_passages, setsketch, source_mix, token_counts
from barloom.llm.workers import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{folder}/{name}.parquet")


@query("op8_byte_bpe")
def op8(spark, folder):
    return byte_bpe.digests(table(spark, folder, "documents"))


@query("op6_order_minhash")
def op6(spark, folder):
    return order_minhash.with_next(table(spark, folder, "documents"))


@query("op10_html_text")
def op10(spark, folder):
    return html_text.extract_pages(table(spark, folder, "pages"))


@query("op1_repeated_passages")
def op1(spark, folder):
    return repeated_passages.digests(table(spark, folder, "documents"))


@query("op5_setsketch")
def op5(spark, folder):
    return setsketch.near_duplicates(table(spark, folder, "documents"), size=2)


@query("op3_projection_trees")
def op3(spark, folder):
    return projection_trees.near_duplicates(table(spark, folder, "embeddings"))


@query("op4_compression_toxicity")
def op4(spark, folder):
    return compression_toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_source_mix", source_mix.ORACLE)
def op7(spark, folder):
    return source_mix.mixed(table(spark, folder, "documents"))


@query("op2_line_templates", line_templates.ORACLE)
def op2(spark, folder):
    return line_templates.digests(table(spark, folder, "documents"))


@query("op9_licence_rules", licence_rules.oracle())
def op9(spark, folder):
    return licence_rules.scan(table(spark, folder, "documents"))


@query("op13_token_counts")
def op13(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"))


@query("op12_phrase_stripes", phrase_stripes.ORACLE)
def op12(spark, folder):
    return phrase_stripes.collocations(table(spark, folder, "documents"))


@query("op11_prefix_trie")
def op11(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations"))
