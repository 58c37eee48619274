"""Stored models: versions that are never changed, and a pointer to the one in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(model: DataFrame, path: str) -> int:
    """Store ``model`` as the next version and put it into use; returns the version.

    The pointer is an append-only table of versions: its new row appears only when the version is
    whole, so a reader sees the old model or the new one. One writer at a time is assumed.
    """
    spark = model.sparkSession
    number = (_newest(spark, path) or 0) + 1
    model.write.mode("overwrite").parquet(f"{path}/version={number}")
    use(spark, path, number)
    return number


def use(spark: SparkSession, path: str, number: int) -> None:
    """Put an existing version into use (again)."""
    row = spark.range(1).select(F.lit(number).alias("version"), F.current_timestamp().alias("since"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/in_use")


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/in_use")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(f"{path}/in_use") if there else None


def _newest(spark: SparkSession, path: str) -> int | None:
    rows = _pointers(spark, path)
    return rows.agg(F.max("version")).first()[0] if rows else None


def current(spark: SparkSession, path: str) -> int | None:
    """The version in use; null before the first one."""
    rows = _pointers(spark, path)
    return rows.agg(F.max_by("version", F.struct("since", "version"))).first()[0] if rows else None


def load(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The model in use, or version ``number``."""
    number = current(spark, path) if number is None else number
    if number is None:
        raise ValueError(f"no model at {path}")
    return spark.read.parquet(f"{path}/version={number}")


def predict_stream(events: DataFrame, model_path: str, *, out_path: str, checkpoint: str, once: bool = True):
    """Write ``event_id, patient_id, event_type, next_type, model`` for a stream of events.

    Every batch takes the model in use when it begins (``event_type, next_type``; unknown types get
    null), so a model that is put into use while the stream runs takes effect with the next batch. A
    repeated batch replaces its own output.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        version = current(spark, model_path)
        model = load(spark, model_path, version).select("event_type", "next_type")
        rows = batch.join(model, "event_type", "left").select("event_id", "patient_id", "event_type", "next_type", F.lit(version).alias("model"))
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
