"""Live HL7 ingest and streaming scores as Structured Streaming jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import audit
from ..sources import hl7


#: Bytes of files that a batch of messages takes for each core, if no number of files is given.
CORE_BYTES = 128 << 20


def message_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of messages from files dropped into ``path`` (an MLLP gateway or Kafka sink writes them).

    All files are taken, in batches of ``max_files``, or else of ``CORE_BYTES`` for each core, so that what
    an executor holds of a batch does not grow with the number of files that wait. A file is read whole,
    also one above that size.
    """
    limit = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", CORE_BYTES * spark.sparkContext.defaultParallelism)
    reader = spark.readStream.option(*limit)
    return hl7.parse(hl7.split_messages(reader.text(path, wholetext=True).select(F.col("value").alias("raw"))))


def deduplicated_events(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events with a control id seen once within the watermark, so resent messages store nothing."""
    events = hl7.to_events(messages).withColumn("t", F.col("t_start").cast("timestamp"))
    return events.withWatermark("t", delay).dropDuplicatesWithinWatermark(["control_id"])


def ingest(messages: DataFrame, *, events_path: str, dead_path: str, checkpoint: str, ack_path: str | None = None, audit_path: str | None = None, salt: str | None = None, once: bool = True):
    """Write events and, apart, the messages that give none (dead letters), each batch exactly once.

    With ``ack_path`` every readable message is acknowledged (``control_id, code, ack``; code AA also for one
    without patient or time, which is sound but holds nothing to store; what is unreadable has no
    control id to answer). With ``audit_path`` every message leaves an audit entry, patients as
    pseudonyms under ``salt``. Batches are numbered folders written in overwrite mode, in all sinks: a
    batch that is repeated after a failure replaces its own output.
    """
    if audit_path and not salt:
        raise ValueError("audit entries need a salt")

    def write(batch: DataFrame, number: int) -> None:
        # What the sinks ask for is kept, not the segments; a text only if it is set aside.
        msh = F.col("MSH")
        more = {"sender": hl7.field(msh, 3)} | ({"ack": hl7.acknowledgement(F.lit("AA"), msh)} if ack_path else {})
        found = hl7.fields(batch.withColumn("readable", F.col("segments").isNotNull()), ("message", "readable"), **more)
        reason = F.when(~F.col("readable"), "unreadable").when(F.col("patient_id").isNull(), "no patient").when(F.col("t_start").isNull(), "no time")
        rows = found.withColumns({"reason": reason, "message": F.when(reason.isNotNull(), F.col("message"))}).persist()
        try:
            sinks(rows, number)
        finally:
            rows.unpersist()

    def sinks(rows: DataFrame, number: int) -> None:
        out = lambda rows, path: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        out(hl7.events(rows), events_path)
        out(rows.where("reason IS NOT NULL").select("message", "reason"), dead_path)
        control = F.coalesce("control_id", F.lit("unknown"))
        if ack_path:
            out(rows.where("readable").select(control.alias("control_id"), F.lit("AA").alias("code"), "ack"), ack_path)
        if audit_path:
            stored = F.col("reason").isNull()
            said = F.concat(F.lit("hl7v2 msg_id="), control, F.when(stored, F.concat(F.lit(" type="), "kind", F.lit("^"), F.coalesce("trigger", F.lit("")))).otherwise(F.concat(F.lit(" reason="), "reason")))
            told = rows.select(
                F.lit("import").alias("action"),
                F.concat(F.lit("mllp:"), F.coalesce("sender", F.lit("unknown"))).alias("user"),
                F.when(stored, "event").alias("resource_type"),
                F.when(stored, control).alias("resource_id"),
                F.when(stored, F.col("patient_id")).alias("patient_id"),
                stored.alias("success"),
                said.alias("details"),
            )
            out(audit.entries(told, salt), audit_path)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dead_letters(spark: SparkSession, dead_path: str) -> DataFrame:
    """``batch, message, reason`` of what :func:`ingest` has set aside."""
    return spark.read.parquet(dead_path).select("batch", "message", "reason")


def clear_dead_letters(spark: SparkSession, dead_path: str, before: int) -> None:
    """Empty the dead letters of the batches below ``before``; a running stream only writes later ones."""
    rows = dead_letters(spark, dead_path)
    old = [r.batch for r in rows.where(F.col("batch") < before).select("batch").distinct().collect()]  # one row a batch
    for number in old:
        rows.drop("batch").limit(0).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")


def windowed_counts(events: DataFrame, *, window: str = "1 hour", delay: str = "1 day", time: str = "t_start") -> DataFrame:
    """Events per window and type; late data counts until the watermark passes."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay)
    return rows.groupBy(F.window("__t", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_episodes(events: DataFrame, *, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """Episodes of point events on a stream: session windows per patient."""
    rows = events.withColumn("__t", F.col("t_start").cast("timestamp")).withWatermark("__t", delay)
    out = rows.groupBy("patient_id", F.session_window("__t", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return out.select("patient_id", F.col("w.start").alias("t_begin"), F.col("w.end").alias("t_close"), "n_events")


class _RollingZ(StatefulProcessor):
    """Scores a patient's new values against the last ones, which are a list in the state store."""

    def __init__(self, history: int, least: int):
        self.history, self.least = history, least

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "x double")

    def handleInputRows(self, key, rows, timers):
        # The frames of one batch are of any order: its rows are sorted together before they are scored.
        frame = pd.concat(list(rows)).sort_values(["t_start", "event_id"], kind="stable")
        held = [x for (x,) in self.held.get()] if self.held.exists() else []
        values = np.array([np.nan if x is None else x for x in held] + list(frame["x"]), dtype=float)
        z = np.zeros(len(frame))
        # Each row beside the ``history`` values before it; those that are missing count for nothing.
        padded = np.concatenate([np.full(self.history, np.nan), values])[len(held) :]
        for lo in range(0, len(frame), 10_000):
            hi = min(lo + 10_000, len(frame))
            before = np.lib.stride_tricks.sliding_window_view(padded[lo : hi + self.history - 1], self.history)
            known = ~np.isnan(before)
            n = known.sum(1)
            mean = np.where(known, before, 0).sum(1) / np.maximum(n, 1)
            spread = np.sqrt(np.where(known, (before - mean[:, None]) ** 2, 0).sum(1) / np.maximum(n, 1))
            x = padded[self.history + lo : self.history + hi]
            good = (n >= self.least) & (spread > 1e-6) & ~np.isnan(x)
            z[lo:hi] = np.where(good, np.abs(x - mean) / np.where(good, spread, 1), 0.0)
        self.held.put([(None if x != x else float(x),) for x in values[-self.history :]])
        yield pd.DataFrame({"patient_id": key[0], "event_id": frame["event_id"].to_numpy(), "z": z})

    def close(self) -> None:
        pass


def streaming_z(events: DataFrame, attr: str, *, history: int = 100, least: int = 3) -> DataFrame:
    """``patient_id, event_id, z`` on a stream: |z| against the patient's last values.

    A batch's rows of a patient are scored in order of time and id, however many they are, after those
    of earlier batches. The state of a patient is one list of ``history`` values; the first events, and
    those without the value, score 0. Needs the state store with list state, see :func:`list_state`.
    """
    rows = events.select("patient_id", "event_id", "t_start", F.col("num").getItem(attr).alias("x"))
    return rows.groupBy("patient_id").transformWithStateInPandas(_RollingZ(history, least), "patient_id string, event_id string, z double", "Append", "None")


def list_state(spark: SparkSession) -> None:
    """Let streams that start in this session from now on keep lists in their state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def queue_status(spark: SparkSession, events_path: str, dead_path: str) -> DataFrame:
    """``kind, batches, n`` of what :func:`ingest` has stored and set aside."""
    read = lambda kind, path: spark.read.parquet(path).select(F.lit(kind).alias("kind"), "batch")
    rows = read("stored", events_path).unionByName(read("dead", dead_path))
    return rows.groupBy("kind").agg(F.countDistinct("batch").alias("batches"), F.count("*").alias("n"))


def predicted(events: DataFrame, model: DataFrame) -> DataFrame:
    """Stream of events plus ``next_type`` from a stored model (``event_type, next_type``); null if unknown.

    A stream-static join reads the model anew with every batch, so a model that another job replaced takes effect.
    """
    return events.join(model.select("event_type", "next_type"), "event_type", "left")
