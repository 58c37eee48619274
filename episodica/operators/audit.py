"""An append-only audit log as a Parquet table; patients appear in it as pseudonyms only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .privacy import pseudonym

#: Text columns that an entry may have besides its action, patient and success.
TEXTS = ("user", "ip", "resource_type", "resource_id", "details")


def entries(rows: DataFrame, salt: str) -> DataFrame:
    """Audit entries of ``rows``: ``action``, and any of ``TEXTS``, ``patient_id`` and ``success`` (else true).

    Ids begin with the time, so they sort by it; the random rest keeps concurrent writers apart. A missing
    patient stays null.
    """
    have = set(rows.columns)
    at = F.current_timestamp()
    hashed = F.when(F.col("patient_id").isNotNull(), pseudonym(F.col("patient_id"), salt)) if "patient_id" in have else F.lit(None).cast("string")
    return rows.select(
        F.concat(F.date_format(at, "yyyyMMddHHmmssSSSSSS"), F.lit("-"), F.expr("uuid()")).alias("audit_id"),
        at.alias("timestamp"),
        "action",
        *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in TEXTS],
        hashed.alias("patient_hash"),
        (F.coalesce("success", F.lit(True)) if "success" in have else F.lit(True)).alias("success"),
    )


def record(rows: DataFrame, path: str, salt: str) -> None:
    """Append the entries of ``rows``; nothing here changes or removes what was written."""
    entries(rows, salt).write.mode("append").parquet(path)


def count(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("n"))


def export_csv(audit: DataFrame, path: str) -> int:
    """Write all entries in order as CSV files with a header; the number of rows, counted on the way."""
    seen = Observation()
    audit.orderBy("audit_id").observe(seen, F.count("*").alias("n")).write.option("header", True).csv(path)
    return seen.get["n"]
