"""Cohort queries: predicates as boolean columns, a count quantifier, an aggregate condition, set algebra."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import distance_days, event_relation
from ..schema import days, num, number_like

_OPS = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}


def two_valued(c: Column) -> Column:
    """Unknown counts as false, so that ``~`` is a true complement."""
    return F.coalesce(c, F.lit(False))


def has_type(event_type: str, subtypes: list[str] | None = None) -> Column:
    """The type itself or one of its subtypes; a literal list, so Parquet can filter by it."""
    return two_valued(F.col("event_type").isin([event_type, *(subtypes or [])]))


def attr(name: str, value) -> Column:
    """Equality of an attribute's text; a missing attribute equals None."""
    return F.col("cat").getItem(name).eqNullSafe(F.lit(None if value is None else str(value)))


def val(name: str, op: str, threshold: float) -> Column:
    """Comparison of a number; missing, not numeric or an unknown operator: false (also for ``!=``)."""
    return two_valued(_OPS[op](number_like(name), F.lit(float(threshold)))) if op in _OPS else F.lit(False)


def trel(relation: str, *, prefix: str = "other_") -> Column:
    """Relation of the event to another one joined in with ``prefix``."""
    return two_valued(event_relation("", prefix) == relation)


def dist(kind: str, low: float, high: float, *, prefix: str = "other_") -> Column:
    ends = [F.coalesce(F.col(f"{p}t_end"), F.col(f"{p}t_start")) for p in ("", prefix)]
    return two_valued(distance_days(kind, F.col("t_start"), ends[0], F.col(f"{prefix}t_start"), ends[1]).between(low, high))


@dataclass
class Cohort:
    """Patients with at least ``min_count`` matching events and, if given, a matching aggregate.

    ``aggregate`` is (function, attribute, comparison, threshold) over the numeric values of matching
    events; functions mean, max, min, count (others count as mean); without values it does not hold.
    """

    event_type: str | None = None
    attrs: dict = field(default_factory=dict)
    vals: list[tuple[str, str, float]] = field(default_factory=list)
    predicate: Column | None = None
    min_count: int = 1
    aggregate: tuple[str, str, str, float] | None = None

    def matches(self) -> Column:
        parts = [F.col("event_type") == self.event_type] if self.event_type else []
        parts += [attr(k, v) for k, v in self.attrs.items()] + [val(*v) for v in self.vals]
        parts += [self.predicate] if self.predicate is not None else []
        out = F.lit(True)
        for part in parts:
            out = out & two_valued(part)
        return out

    def run(self, events: DataFrame) -> DataFrame:
        """``patient_id, n_events`` of the cohort: one aggregation over the whole table."""
        rows = events.where(self.matches())
        if self.min_count <= 0:  # patients without a match belong to it too
            rows = events.withColumn("__hit", self.matches())
            counted = [F.count_if("__hit").alias("n_events")]
            of = lambda name: F.when(F.col("__hit"), num(name))
        else:
            counted, of = [F.count("*").alias("n_events")], num
        if self.aggregate:
            fn, name, _, _ = self.aggregate
            make = {"max": F.max, "min": F.min, "count": F.count}.get(fn, F.avg)
            counted += [make(of(name)).cast("double").alias("__agg"), F.count(of(name)).alias("__n")]
        found = rows.groupBy("patient_id").agg(*counted).where(F.col("n_events") >= self.min_count)
        if self.aggregate:
            _, _, op, threshold = self.aggregate
            holds = two_valued(_OPS[op](F.col("__agg"), F.lit(float(threshold)))) if op in _OPS and op != "!=" else F.lit(False)
            found = found.where(holds & (F.col("__n") > 0))
        return found.select("patient_id", "n_events")

    def report(self, events: DataFrame, *, patients: DataFrame | None = None, max_patients: int | None = None) -> DataFrame:
        """``patient_id, n_events, in_cohort`` for every patient of the universe.

        The universe is ``patients`` or else those with an event of the type (all, if no type is named);
        ``max_patients`` keeps the first by id. Patients without a match count 0.
        """
        hit, every = self.matches(), F.lit(True)
        of_type = F.col("event_type") == self.event_type if self.event_type else every
        rows = events.where(two_valued(of_type))
        if patients is not None:
            rows = rows.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
        counted, holds = [F.count_if(hit).alias("n_events")], every
        if self.aggregate:
            fn, name, op, threshold = self.aggregate
            make = {"max": F.max, "min": F.min, "count": F.count}.get(fn, F.avg)
            counted += [make(F.when(hit, num(name))).cast("double").alias("__agg"), F.count(F.when(hit, num(name))).alias("__n")]
            holds = two_valued(_OPS[op](F.col("__agg"), F.lit(float(threshold)))) if op in _OPS and op != "!=" else F.lit(False)
            holds = holds & two_valued(F.col("__n") > 0)
        found = rows.groupBy("patient_id").agg(*counted)
        if patients is not None:
            found = patients.select("patient_id").distinct().join(found, "patient_id", "left")
        if max_patients is not None:
            found = found.orderBy("patient_id").limit(max_patients)
        n = F.coalesce("n_events", F.lit(0))
        return found.select("patient_id", n.alias("n_events"), ((n >= self.min_count) & holds).alias("in_cohort"))


def report_size(report: DataFrame) -> DataFrame:
    """One row: cohort_size, total_patients and n_events of the universe."""
    return report.agg(F.count_if("in_cohort").alias("cohort_size"), F.count("*").alias("total_patients"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("patient_id").intersect(b.select("patient_id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("patient_id").union(b.select("patient_id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("patient_id").subtract(b.select("patient_id"))


def complement(events: DataFrame, a: DataFrame) -> DataFrame:
    return events.select("patient_id").subtract(a.select("patient_id"))


def followed_by(events: DataFrame, first: Column, then: Column, *, within_days: float) -> DataFrame:
    """Patients (with counts) whose event ``first`` is followed by ``then`` within some days.

    The next ``then`` event is found by a window over the patient's events, not by a self-join.
    """
    later = Window.partitionBy("patient_id").orderBy("t_start", "event_id").rowsBetween(1, Window.unboundedFollowing)
    rows = events.where(first | then)
    rows = rows.withColumn("next", F.first(F.when(then, F.col("t_start")), ignorenulls=True).over(later))
    gap = days(F.coalesce(F.col("t_end"), F.col("t_start")), F.col("next"))
    return rows.where(two_valued(first) & gap.between(0, within_days)).groupBy("patient_id").agg(F.count("*").alias("n_pairs"))
