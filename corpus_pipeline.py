"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Rejected documents, near copies and documents with benchmark passages leave; what is left is packed into
training sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkevidence.llm import classifier, decontam, packing, quality_rules, simhash
from sparkevidence.llm.common import drop_staged, stage


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_rules(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by all labelled documents of the corpus, finds good.

    It learns from the whole documents table: the rules have removed nearly all bad examples from docs.
    """
    corpus, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    model = classifier.train(classifier.featurize(corpus, ["doc_id"]), labels)
    return classifier.keep_good(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules), ("quality classifier", quality), ("near duplicates", near_copies),
    ("benchmark decontamination", leaks), ("best-fit packing", packed),
]
#: Tokens, fingerprints and the classifier's densities are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        docs, path = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            drop_staged(spark, before)
        before = path
    return docs
