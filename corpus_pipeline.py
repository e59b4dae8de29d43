"""From raw documents to token ids: STAGES, each of which works on what the one before kept.

Defined results: null and empty texts go where the classifier rejects them, else they pass every stage and have no tokens; documents
of which line dedup leaves nothing go; rows that repeat an id and text are handled alike and stay together, since no stage
compares a document with itself; documents with a null id link with nothing; null sources are a source of their own; an empty
table gives no rows; further columns, whatever their names, pass up to the last stage, which keeps doc_id, lang and source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import bpe, line_dedup, mixing, ngram_join, quality
from pulseframe.llm.common import Scratch, drop_path, shared_dir
from pulseframe.llm.queries import public_ranks


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, and documents of which nothing is left."""
    return line_dedup.dedup_lines(docs).drop("n_removed")


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return ngram_join.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or don't appear, as their source's weight and a hash say."""
    return mixing.mix(docs).drop("copy_no", "n_copies", "mix_key")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digests of what they decode to."""
    ranks = public_ranks()
    return bpe.digests(bpe.encode(docs, ranks, keep=["doc_id", "lang", "source"], decoded=True))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE", token_stage),
]

#: SQL can't express a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again, and the one before it is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = len(Scratch.made)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
        Scratch.sweep(made)  # the stage's own tables
        if k:
            drop_path(spark, f"{root}/{k - 1}")
    return docs
