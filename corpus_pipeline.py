"""A training corpus from raw documents, in stages that each call one operator."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import exact_dedup, mixing, ngram_join, ordinal_quality, packing
from concordat.session import materialise, scratch, ship_package


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on the labelled ones among them."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ordinal_quality.select_good(docs, ordinal_quality.train(docs, labels))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.drop_duplicates(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one that names it stays, with those that have no words."""
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", _quality),
    ("exact dedup", _exact_dedup),
    ("n-gram Jaccard join", _near_dedup),
    ("mixing sources to target weights", _mixing),
    ("best-fit packing", _packing),
]

#: The classifier and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written and read again.

    Once a stage's result is stored, what the stage and the one before it stored on the way is deleted.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark) as own:
            docs = stage(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs = materialise(docs, re.sub(r"\W+", "-", name))
        if i + 1 < len(STAGES):
            own.release(keep=docs)
            if before is not None:
                before.release()
            before = own
    return docs
