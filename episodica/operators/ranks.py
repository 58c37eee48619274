"""Exact order statistics of very many distinct values: counted ranges instead of one sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a group that may be sorted in one task; more are narrowed down first.
SORTED = 10_000


def middle_distinct(rows: DataFrame, group: str, x: str) -> DataFrame:
    """``group`` and ``x``: element floor(k / 2) of the k >= 2 sorted distinct values of each group, exactly.

    Each round takes approximate quantiles on both sides of the wanted rank, counts the values up to
    them, and goes on with the range that holds it; rounds end when every range has at most ``SORTED``
    values, and only those are numbered. The driver holds one row per group. Nulls are no values, NaN is
    the greatest one, groups with fewer than two values have no row.
    """
    distinct = rows.where(F.col(group).isNotNull() & F.col(x).isNotNull()).select(group, x).distinct().persist()
    try:
        kind = distinct.schema[x].dataType.simpleString()
        name = distinct.schema[group].dataType.simpleString()
        ranges = {r[0]: [None, None, r[1] // 2, r[1]] for r in distinct.groupBy(group).agg(F.count("*")).where("count(1) > 1").collect()}
        spark = rows.sparkSession
        schema = f"`{group}` {name}, __lo {kind}, __hi {kind}, __rank long, __n long"

        def within() -> DataFrame:
            """Values of the ranges ``(lo, hi]``; one row for each group, so this side is as small as the driver's."""
            told = F.broadcast(spark.createDataFrame([(g, *v) for g, v in ranges.items()], schema))
            inside = (F.col("__lo").isNull() | (F.col(x) > F.col("__lo"))) & (F.col("__hi").isNull() | (F.col(x) <= F.col("__hi")))
            return distinct.join(told, group).where(inside)

        open_ = set(ranges)
        while wide := [g for g in open_ if ranges[g][3] > SORTED]:
            shares = {g: [max(0.0, v[2] / v[3] - 0.01), min(1.0, (v[2] + 1) / v[3] + 0.01)] for g, v in ranges.items() if g in wide}
            found = within().where(F.col(group).isin(wide))
            cuts = {r[0]: r[1] for r in found.groupBy(group).agg(_each(group, x, shares).alias("cuts")).collect()}
            below = [F.sum(F.coalesce(*(F.when((F.col(group) == g) & (F.col(x) <= c[k]), 1) for g, c in cuts.items()), F.lit(0))) for k in (0, 1)]
            for g, low, high in found.groupBy(group).agg(*below).collect():
                lo, hi, rank, n = ranges[g]
                if rank < low:
                    now = [lo, cuts[g][0], rank, low]
                elif rank < high:
                    now = [cuts[g][0], cuts[g][1], rank - low, high - low]
                else:
                    now = [cuts[g][1], hi, rank - high, n - high]
                if now[3] == n:  # no cut divides it: numbered as it is
                    open_.discard(g)
                ranges[g] = now
        nth = F.row_number().over(Window.partitionBy(group).orderBy(x)) - 1
        out = within().withColumn("__nth", nth).where("__nth = __rank").select(group, x)
        # One row per group, so that the values can be let go.
        return spark.createDataFrame(out.collect(), out.schema)
    finally:
        distinct.unpersist()


def _each(group: str, x: str, shares: dict):
    """Per group, approximate quantiles at the group's own two shares."""
    whens = [F.when(F.first(group) == g, F.percentile_approx(F.col(x), list(s), 10_000)) for g, s in shares.items()]
    return F.coalesce(*whens)
