"""A corpus from raw documents to token digests in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the
last return the columns of documents. Rows with a null id pass the duplicate stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, substrings, toxicity
from tessera.llm.common import read, released, settled, vocab


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _afresh(stage: Stage) -> Stage:
    """The stage, after executors have given back the memory that what ran before made them take."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        released(spark)
        return stage(spark, docs, sf_dir)

    return run


@_afresh
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model rejects go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@_afresh
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least id stays, and the least row of an id."""
    found = settled(jaccard.join(docs))
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    named, row = kept.filter("doc_id is not null"), F.struct("text", *[c for c in kept.columns if c != "text"])
    return named.groupBy("doc_id").agg(F.min(row).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in kept.columns]).union(kept.filter("doc_id is null"))


@_afresh
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat in a document of a smaller id are cut; documents stay, with what is left of them."""
    cut = substrings.without(docs, substrings.passages(docs))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_afresh
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; repeated documents are repeated rows, partly taken ones hold the words taken."""
    return mixing.mixed_texts(docs)


@_afresh
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what was mixed."""
    return bpe.encode_decode(docs, vocab("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Training, exact set joins and merges are beyond SQL; tests check each stage on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settled(docs)
    return docs
