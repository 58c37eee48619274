"""Event and reference tables on disk: changes rewrite only the hash partitions they touch.

A table of events is partitioned by a hash of the id. An upsert, update or delete reads the partitions of
its ids alone and replaces them (dynamic partition overwrite); the files of all others stay as they
are. Each replaced partition is swapped as a whole; one writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

PART = "id_part"
#: Partitions of a new table; a table keeps the number it was made with.
PARTS = 64
#: Fixed value: the relation of references from before relations were kept.
PLAIN = "references"


def part_of(n: int) -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(n)).cast("int")


def create(events: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write ``events`` as a new table; an existing one is an error. Null ids are kept, in one partition."""
    rows = events.withColumn(PART, part_of(parts))
    rows.repartition(PART).write.partitionBy(PART).parquet(f"{path}/data")
    events.sparkSession.createDataFrame([(parts,)], "parts int").coalesce(1).write.parquet(f"{path}/layout")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{path}/data").drop(PART)


def _rewrite(spark: SparkSession, path: str, ids: DataFrame, change) -> list[int]:
    """Replace the partitions of ``ids`` by ``change(their rows)``; returns the partitions."""
    parts = spark.read.parquet(f"{path}/layout").first().parts
    touched = sorted(r[0] for r in ids.select(part_of(parts)).distinct().collect())  # at most ``parts`` numbers
    if not touched:
        return []
    old = spark.read.option("mergeSchema", True).parquet(f"{path}/data").where(F.col(PART).isin(touched)).drop(PART)
    new = change(old).withColumn(PART, part_of(parts)).repartition(PART)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{path}/data")
    # A partition without rows is not written, so it still holds what it had.
    here = spark.read.parquet(f"{path}/data").where(F.col(PART).isin(touched))
    gone = here.join(ids.select("event_id").distinct(), "event_id", "left_semi").select(PART).distinct()
    for part in [r[0] for r in gone.collect()]:
        if change(here.where(F.col(PART) == part).drop(PART)).isEmpty():
            old.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/data/{PART}={part}")
    return touched


def upsert(spark: SparkSession, path: str, changes: DataFrame) -> list[int]:
    """:func:`store.upsert` on the table; returns the partitions that were replaced."""
    return _rewrite(spark, path, changes, lambda rows: store.upsert(rows, changes)[0])


def update(spark: SparkSession, path: str, changes: DataFrame) -> list[int]:
    """:func:`store.update` on the table: ids that it does not have are left out."""
    return _rewrite(spark, path, changes, lambda rows: store.update(rows, changes))


def delete(spark: SparkSession, path: str, ids: DataFrame) -> list[int]:
    """Remove the events of ``ids(event_id)``."""
    return _rewrite(spark, path, ids, lambda rows: rows.join(ids.select("event_id").distinct(), "event_id", "left_anti"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``event_id, ref_id, relation`` of a table whose older files have no ``relation``: those read as plain ones."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    relation = F.coalesce("relation", F.lit(PLAIN)) if "relation" in rows.columns else F.lit(PLAIN)
    return rows.select("event_id", "ref_id", relation.alias("relation"))


def upgrade_references(spark: SparkSession, path: str, batch: str = "batch") -> list:
    """Write the relation into the partitions of ``batch`` that lack it; a second call finds nothing to do."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    old = rows.where("relation IS NULL") if "relation" in rows.columns else rows
    behind = sorted(r[0] for r in old.select(batch).distinct().collect())  # one row a partition
    if behind:
        relation = F.coalesce("relation", F.lit(PLAIN)) if "relation" in rows.columns else F.lit(PLAIN)
        new = rows.where(F.col(batch).isin(behind)).withColumn("relation", relation)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)
    return behind
