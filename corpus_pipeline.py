"""A corpus pipeline of the operators in barloom.llm: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.shared import materialise
from barloom.llm import byte_bpe, compression_toxicity, line_templates, setsketch, source_mix
from barloom.llm.workers import reachable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of those in docs that are not held out."""
    labels = reachable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_toxicity.learn(docs, labels)
    return compression_toxicity.scored(docs, model, name="_toxicity").where(F.col("_toxicity") < 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first that holds them; every document stays."""
    return line_templates.deduplicated(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    reachable(spark)
    return setsketch.one_of_each(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: per round, each document that gives words, with those words as its text; a doc_id may come up to three times."""
    return source_mix.mix_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text."""
    reachable(spark)
    return byte_bpe.tokenised(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_weights),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL cannot express the classifier and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
