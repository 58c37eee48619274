"""Joins of interval events by their relation in time, without all pairs of a patient.

Intervals have levels: an interval of level L is at most ``BASE * 2**L`` microseconds long, so it touches at
most two buckets of that width. Two intervals that share a point share a bucket of the higher of their
two levels, and are compared there only: the equi-join is on patient, level and bucket, so a patient of
any number of events is spread over the buckets, and long intervals are not dealt to many short ones.
Pairs that are apart in time are counted, not made: one cumulative sum over coarse buckets and one inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal
from ..schema import micros

DAY = 86_400_000_000
#: Width of a bucket of level 0, in microseconds.
BASE = DAY
#: Width of the buckets of :func:`count_before`.
COARSE = 30 * DAY


def _ends(prefix: str) -> tuple[Column, Column]:
    start = micros(f"{prefix}t_start")
    return start, micros(F.coalesce(F.col(f"{prefix}t_end"), F.col(f"{prefix}t_start")))


def _placed(rows: DataFrame, prefix: str, reach: int) -> DataFrame:
    """``rows`` plus ``__lo``, ``__hi`` (microseconds, widened by ``reach``) and ``__level``."""
    start, end = _ends(prefix)
    rows = rows.withColumns({"__lo": start - reach, "__hi": end + reach}).where("__lo <= __hi")
    level = F.greatest(F.ceil(F.log2((F.col("__hi") - F.col("__lo") + 1) / F.lit(float(BASE)))), F.lit(0)).cast("int")
    return rows.withColumn("__level", level)


def _dealt(rows: DataFrame, level: Column, side: str) -> DataFrame:
    """One row for each bucket of ``level`` (an array of levels) that an interval touches, with its first one."""
    rows = rows.withColumn("__at", F.explode(level))
    width = F.expr(f"shiftleft({BASE}L, __at)")
    # Whole numbers, rounded down also before 1970.
    first, last = F.expr("__lo div __w - if(__lo % __w < 0, 1, 0)"), F.expr("__hi div __w - if(__hi % __w < 0, 1, 0)")
    rows = rows.withColumn("__w", width).withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, last)))
    return rows.drop("__lo", "__hi", "__w", "__level").withColumnRenamed("__first", f"__first_{side}")


def interval_join(left: DataFrame, right: DataFrame, *, by: str = "patient_id", relations: tuple[str, ...] | None = None, within_days: float = 0.0) -> DataFrame:
    """Pairs of the events of ``left`` and ``right`` of one patient that share a point of time, or lie at most
    ``within_days`` apart: ``by``, all other columns as ``a_...`` and ``b_...``, and ``relation``.

    ``relations`` keeps some relations only. A missing end is the start; an event whose end lies before
    its start, or without a start or patient, has no pair. Repeated rows are pairs of their own; empty
    tables give no rows.
    """
    reach = round(within_days * DAY)
    named = lambda rows, p: rows.select(by, *[F.col(c).alias(p + c) for c in rows.columns if c != by])
    a, b = named(left, "a_"), named(right, "b_")
    start, end = _ends("a_")
    a = _placed(a.where(start <= end), "a_", reach)
    b = _placed(b.where(_ends("b_")[0] <= _ends("b_")[1]), "b_", 0)
    top = F.lit(a.select("__level").unionByName(b.select("__level")).agg(F.max("__level")).first()[0] or 0)
    own, up = F.array("__level"), F.sequence("__level", top)
    above = F.when(F.col("__level") < top, F.sequence(F.col("__level") + 1, top)).otherwise(F.array().cast("array<int>"))
    keys = [by, "__at", "__bucket"]
    # A pair meets at the higher of its levels: the left one's, if the right one's is no higher, or else the right one's.
    pairs = _dealt(a, own, "a").join(_dealt(b, up, "b"), keys)
    pairs = pairs.unionByName(_dealt(a, above, "a").join(_dealt(b, own, "b"), keys))
    pairs = pairs.where(F.col("__bucket") == F.greatest("__first_a", "__first_b"))
    pairs = pairs.withColumn("relation", temporal.event_relation("a_", "b_"))
    a_end, b_end = F.coalesce("a_t_end", "a_t_start"), F.coalesce("b_t_end", "b_t_start")
    gap = F.greatest(micros("b_t_start") - micros(a_end), micros("a_t_start") - micros(b_end))
    pairs = pairs.where(gap <= reach)
    if relations is not None:
        pairs = pairs.where(F.col("relation").isin(*relations))
    return pairs.drop("__at", "__bucket", "__first_a", "__first_b")


def count_before(left: DataFrame, right: DataFrame, *, by: str = "patient_id") -> DataFrame:
    """``by, n``: how many pairs of a patient's events have the left one end before the right one starts.

    No pair is made. Right starts are summed in coarse buckets and, beside the left ends, inside their
    bucket, so the events of one patient are spread over its buckets. Events as in :func:`interval_join`.
    """
    marks = left.select(by, _ends("")[1].alias("t"), F.lit(0).alias("right"), (_ends("")[0] <= _ends("")[1]).alias("ok"))
    marks = marks.unionByName(right.select(by, _ends("")[0].alias("t"), F.lit(1).alias("right"), (_ends("")[0] <= _ends("")[1]).alias("ok")))
    marks = marks.where(F.col("ok") & F.col(by).isNotNull()).withColumn("bucket", F.expr(f"t div {COARSE} - if(t % {COARSE} < 0, 1, 0)"))
    inside = Window.partitionBy(by, "bucket").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)
    near = marks.withColumn("later", F.coalesce(F.sum("right").over(inside), F.lit(0))).where("right = 0")
    near = near.groupBy(by, "bucket").agg(F.count("*").alias("n_left"), F.sum("later").alias("later"))
    sums = marks.groupBy(by, "bucket").agg(F.sum("right").alias("n_right"))
    behind = Window.partitionBy(by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("far", F.coalesce(F.sum("n_right").over(behind), F.lit(0)))
    return near.join(sums, [by, "bucket"]).groupBy(by).agg(F.sum(F.col("later") + F.col("n_left") * F.col("far")).alias("n"))


def relation_matrix(left: DataFrame, right: DataFrame, *, by: str = "patient_id") -> DataFrame:
    """``relation, n``: how many pairs of a patient's events stand in each relation; null counts pairs with an
    event whose end lies before its start. Relations without a pair have no row."""
    met = interval_join(left, right, by=by).groupBy("relation").agg(F.count("*").alias("n"))
    apart = [count_before(x, y, by=by).agg(F.sum("n").alias("n")).select(F.lit(name).alias("relation"), "n") for name, x, y in (("before", left, right), ("after", right, left))]
    sized = lambda rows, name: rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias(name), F.count_if(_ends("")[0] <= _ends("")[1]).alias(f"{name}_ok"))
    odd = sized(left, "x").join(sized(right, "y"), by).agg(F.sum(F.col("x") * F.col("y") - F.col("x_ok") * F.col("y_ok")).alias("n"))
    rows = met.unionByName(apart[0]).unionByName(apart[1]).unionByName(odd.select(F.lit(None).cast("string").alias("relation"), "n"))
    return rows.where("n > 0").groupBy("relation").agg(F.sum("n").alias("n"))
