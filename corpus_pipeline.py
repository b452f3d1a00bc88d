"""The corpus pipeline: quality rules, exact and near deduplication, repeated strings, packing.

Each stage works on the rows that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import exact_dedup, minhash, packing, quality_rules, suffix_dedup
from strataloom.llm.common import Scratch, table, tidy
from strataloom.llm.queries import tokenizer_path

NEAR_PERCENT = 80

_left: list[Scratch] = []
"""Folders with what stages that are done have left, their results among it."""


def clearing(stage):
    """A stage that first deletes what earlier ones have left, unless its rows come from there: by then the result before
    it has been written elsewhere. Rows whose files cannot be told (cached ones) keep everything."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = spark._jvm.org.apache.hadoop.util.StringUtils.arrayToString(docs._jdf.inputFiles())
        for scratch in [s for s in _left if read and s.folder.rpartition("/")[2] not in read]:
            scratch.drop()
            _left.remove(scratch)
        with tidy() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@clearing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the weights are fitted to the documents given."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


@clearing
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id."""
    return exact_dedup.keep_first(docs)


@clearing
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at a similarity of 0.8 or more, the document with the smallest id."""
    return minhash.keep_smallest(docs, link_percent=NEAR_PERCENT)


@clearing
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with strings that occur more than once cut out of their texts."""
    return suffix_dedup.remove_repeats(docs)


@clearing
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("repeated strings", repeats), ("packing", pack)]

ORACLE_SQL = None  # weights, shingle links, byte strings and token ids are out of SQL's reach


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; its table alone stays, also of what the stages' operators wrote."""
    docs = table(spark, sf_dir, "documents")
    with tidy():
        scratch = Scratch(spark)
        for _, stage in STAGES:
            with tidy() as made:
                docs = scratch.adopt(stage(spark, docs, sf_dir), made)
            for other in made:
                other.drop()
            scratch.drop(keep=1)
    return docs
