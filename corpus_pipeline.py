"""Documents from raw table to training mix: five stages of the operators in ``tracelake.llm``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; ``run`` writes every stage's rows as Parquet in the
session's shared folder and reads them back as the next one's input.  The rows cannot be stated in SQL (language
identification is a trained model), so tests compare the stages with brute force.

All stages keep the columns of ``docs`` whatever their names (``text``, ``lang``, ``doc_id`` and ``source`` have a meaning),
give no rows for an empty table, and judge rows that repeat alike, with the exceptions named below.  Null, empty and
word-less texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import decontaminate, language_id, mixing, near_dup, quality
from tracelake.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and very short texts are rejected."""
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are clearly in one of the languages of the labelled documents.

    A null ``lang`` is not learned from; where there is no label at all, texts with a letter stay.
    """
    return language_id.keep_known(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose sets of five words have similarity 0.8 or more.

    That of the smallest id stays, one row of it; rows with a null id all stay, texts without words are nobody's duplicates.
    """
    return near_dup.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts and items contain nothing and are in nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words it takes of each (``size``, ``source_size``, ``target``, ``taken``).

    A null source is a source of its own; texts without words are not taken; rows of one id carry its sums.
    """
    return mixing.keep_mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", known_language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
