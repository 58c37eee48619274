"""SQL views of the canonical tables, and small helpers of the query modules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session gets one temporary folder until it ends; a cluster has none that would do.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="episodica-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{name}-{uuid.uuid4().hex}"


#: Point events.
E = """(SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS patient_id, event_type, ts AS t_start, ts AS t_end,
  ts - INTERVAL 1 HOUR AS stay_start, ts + INTERVAL 1 HOUR AS stay_end, value, CAST(regexp_extract(props, ':\\s*(\\d+)', 1) AS DOUBLE) AS k FROM events)"""
#: Interval events.
I = """(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id, CAST(o_custkey AS VARCHAR) AS patient_id, o_orderpriority AS event_type,
  least(o_orderdate, l_shipdate) AS t_start, greatest(o_orderdate, l_shipdate) AS t_end, o_orderdate AS stay_start,
  max(greatest(o_orderdate, l_shipdate)) OVER (PARTITION BY l_orderkey) AS stay_end,
  l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: Edges from each point event to the one before.
P = f"""(SELECT event_id, ref_id, 'preceded_by' AS relation FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY patient_id ORDER BY t_start, event_id) AS ref_id FROM {E}) WHERE ref_id IS NOT NULL)"""


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def flat(rows, *columns: str):
    """``rows`` with numeric map entries value and k as columns."""
    return rows.select(*columns, r6(F.col("num").getItem("value")).alias("value"))
