"""The canonical event table and adapters that build it.

events: event_id, patient_id, event_type (strings), t_start, t_end, stay_start, stay_end (timestamps),
        num map<string,double> (numeric and boolean attributes), cat map<string,string> (all attributes
        as text), confidence double
refs:   event_id, ref_id, relation

``num`` and ``cat`` are built with ``create_map`` over literal names, so ``num['value']`` folds into the
column behind it and only that column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(t: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp (of either kind; wall-clock times count as UTC)."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def days(a: Column, b: Column) -> Column:
    """Days from ``a`` to ``b``."""
    return (micros(b) - micros(a)) / F.lit(float(DAY))


def attrs(**columns: Column) -> Column:
    """``map<string,double>`` of the given numeric columns."""
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("double"))])


def texts(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])


def num(name: str) -> Column:
    """A numeric attribute, null if the event has none of that name."""
    return F.col("num").getItem(name)


def number_like(name: str) -> Column:
    """A numeric attribute, or a text that reads as a number."""
    return F.coalesce(num(name), F.col("cat").getItem(name).try_cast("double"))


def point_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point events of the table ``events``: attributes value and k."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("patient_id"),
        "event_type",
        F.col("ts").alias("t_start"),
        F.col("ts").alias("t_end"),
        (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("stay_start"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("stay_end"),
        attrs(value=F.col("value"), k=k).alias("num"),
        texts(value=F.col("value"), k=k).alias("cat"),
        F.lit(1.0).alias("confidence"),
    )


def _line() -> Column:
    """Identity of a line item; order and line number alone repeat in the data."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval events: one per line item of an order, between order and shipping date.

    patient_id is the customer, event_type the order's priority; the stay is the order, from its date to
    its latest line. The stay is a window on the order key, which the join has already partitioned by.
    """
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.least("o_orderdate", "l_shipdate"), F.greatest("o_orderdate", "l_shipdate")
    stay = Window.partitionBy("l_orderkey")
    return joined.select(
        _line().alias("event_id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("o_orderpriority").alias("event_type"),
        start.alias("t_start"),
        end.alias("t_end"),
        F.col("o_orderdate").alias("stay_start"),
        F.max(end).over(stay).alias("stay_end"),
        attrs(quantity=F.col("l_quantity"), price=F.col("l_extendedprice"), discount=F.col("l_discount")).alias("num"),
        texts(flag=F.col("l_returnflag"), status=F.col("l_linestatus")).alias("cat"),
        F.lit(1.0).alias("confidence"),
    )


def part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference edges line -> order."""
    return table(spark, sf_dir, "lineitem").select(
        _line().alias("event_id"), F.col("l_orderkey").cast("string").alias("ref_id"), F.lit("part_of").alias("relation")
    )


def preceded_by(events: DataFrame) -> DataFrame:
    """Reference edges event -> previous event of the patient."""
    w = Window.partitionBy("patient_id").orderBy("t_start", "event_id")
    edges = events.select("event_id", F.lag("event_id").over(w).alias("ref_id"), F.lit("preceded_by").alias("relation"))
    return edges.where(F.col("ref_id").isNotNull())
