"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the result is written as Parquet
and read again as the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from episodica.llm import decontaminate, mixing, neardup, sharding, toxicity
from episodica.llm.common import shared_dir, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts score the sample's share of toxic
    ones and so stay unless that is 0.3 or more; repeated rows are judged alike; an empty table gives none."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Documents without words are linked
    with nothing and stay, as do rows of a null id; an empty table gives none."""
    return neardup.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts hold none; with an empty benchmark all stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times. Null sources are a source of their own; texts
    without words count nothing and are repeated at most as often as others; an empty table gives none."""
    return mixing.mix(docs).select(*docs.columns)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 40 shards of nearly equal bytes, repeated rows each in a slot of its own; a null text counts as
    empty; columns named ``shard``, ``slot`` or ``size`` are replaced; an empty table gives none."""
    return sharding.assign_shards(docs, 40)


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
    ("sharding", _sharding),
]

#: The classifier and the random draws have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
