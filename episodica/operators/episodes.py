"""Episodes (gap sessions), trajectories and Markov prediction of the next episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import days, micros

#: Defaults for a context that the model has not seen, and the least learned gap.
UNSEEN_CONFIDENCE, UNSEEN_GAP, LEAST_DELTA = 0.3, 30.0, 1.0


def _end() -> Column:
    return F.coalesce(F.col("t_end"), F.col("t_start"))


def number_episodes(events: DataFrame, delta_days: float, types: list[str] | None = None) -> DataFrame:
    """Events plus ``ep_index`` (from 0): a new episode starts more than ``delta_days`` after the end of
    the event before it (not after the latest end so far); equality stays inside."""
    rows = events.where(F.col("event_type").isin(types)) if types else events
    w = Window.partitionBy("patient_id").orderBy("t_start", "event_id")
    starts = F.when(days(F.lag(_end()).over(w), F.col("t_start")) > delta_days, 1).otherwise(0)
    return rows.withColumn("__new", starts).withColumn("ep_index", F.sum("__new").over(w).cast("int")).drop("__new")


def build_episodes(events: DataFrame, delta_days: float, types: list[str] | None = None) -> DataFrame:
    """One row per episode: bounds, events, sorted distinct types, dominant type (count, then name), days.

    Two aggregations by (patient, episode): first counts per type, then the episode from them.
    """
    rows = number_episodes(events, delta_days, types)
    per = rows.groupBy("patient_id", "ep_index", "event_type").agg(F.count("*").alias("n"), F.min("t_start").alias("b"), F.max(_end()).alias("e"))
    out = per.groupBy("patient_id", "ep_index").agg(
        F.min("b").alias("t_begin"),
        F.max("e").alias("t_end"),
        F.sum("n").alias("n_events"),
        F.array_sort(F.collect_list("event_type")).alias("event_types"),
        F.min(F.struct((-F.col("n")).alias("n"), "event_type")).getField("event_type").alias("dominant_type"),
    )
    return out.withColumn("duration_days", days(F.col("t_begin"), F.col("t_end")))


def with_gaps(episodes: DataFrame) -> DataFrame:
    """Episodes plus ``gap_days`` to the episode before (at least 0, null for the first)."""
    w = Window.partitionBy("patient_id").orderBy("ep_index")
    gap = days(F.lag("t_end").over(w), F.col("t_begin"))
    return episodes.withColumn("gap_days", F.when(gap < 0, 0.0).otherwise(gap))


def trajectories(episodes: DataFrame) -> DataFrame:
    """Per patient: number of episodes, their dominant types in order, total days (0 below two), mean gap."""
    rows = with_gaps(episodes).groupBy("patient_id").agg(
        F.count("*").alias("n_episodes"),
        F.transform(F.array_sort(F.collect_list(F.struct("ep_index", "dominant_type"))), lambda x: x["dominant_type"]).alias("sequence"),
        F.min("t_begin").alias("b"),
        F.max("t_end").alias("e"),
        F.avg("gap_days").alias("mean_gap_days"),
    )
    total = F.when(F.col("n_episodes") < 2, 0.0).otherwise(days(F.col("b"), F.col("e")))
    return rows.select("patient_id", "n_episodes", "sequence", total.alias("total_days"), "mean_gap_days")


def validate_trajectories(episodes: DataFrame, *, min_episodes: int = 2, confidence: Column | None = None, min_confidence: float = 0.5) -> DataFrame:
    """Per patient: violations (too few episodes, low confidence, episodes that start before the one before)."""
    w = Window.partitionBy("patient_id").orderBy("ep_index")
    rows = episodes.withColumn("bad", (F.col("t_begin") < F.lag("t_begin").over(w)).cast("int"))
    per = rows.groupBy("patient_id").agg(F.count("*").alias("n_episodes"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_unordered"), F.min(F.lit(1.0) if confidence is None else confidence).alias("low"))
    tests = F.array(
        F.when(F.col("n_episodes") < min_episodes, F.lit("too_few_episodes")),
        F.when(F.col("low") < min_confidence, F.lit("low_confidence")),
        F.when(F.col("n_unordered") > 0, F.lit("order")),
    )
    return per.withColumn("violations", F.array_compact(tests)).withColumn("valid", F.size("violations") == 0).drop("low")


def learn_deltas(events: DataFrame, *, floor: float = LEAST_DELTA) -> DataFrame:
    """``event_type, n_gaps, delta_days``: exact median gap between events of a type within a patient."""
    w = Window.partitionBy("patient_id", "event_type").orderBy("t_start", "event_id")
    gaps = events.withColumn("gap", days(F.lag("t_start").over(w), F.col("t_start"))).where("gap IS NOT NULL")
    return gaps.groupBy("event_type").agg(F.count("*").alias("n_gaps"), F.greatest(F.lit(float(floor)), F.median("gap")).alias("delta_days"))


def transitions(episodes: DataFrame, order: int = 1) -> DataFrame:
    """Markov model: ``context`` (last types, ``|``-joined), ``next_type``, n, mean gap, probability."""
    w = Window.partitionBy("patient_id").orderBy("ep_index")
    rows = with_gaps(episodes)
    past = [F.lag("dominant_type", k).over(w) for k in range(order, 0, -1)]
    rows = rows.select(F.concat(*[x for k, c in enumerate(past) for x in ([F.lit("|")] if k else []) + [c]]).alias("context"), F.col("dominant_type").alias("next_type"), "gap_days")
    counts = rows.where("context IS NOT NULL").groupBy("context", "next_type").agg(F.count("*").alias("n"), F.avg("gap_days").alias("mean_gap_days"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("context")))


def top_next(model: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` likeliest next types of each context; ties by name."""
    w = Window.partitionBy("context").orderBy(F.desc("p"), "next_type")
    return model.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def predict_next(episodes: DataFrame, model: DataFrame, order: int = 1) -> DataFrame:
    """Per patient the likeliest next type, its probability, mean gap and expected begin.

    An unseen context repeats the last type with the fixed confidence and gap.
    """
    last = episodes.groupBy("patient_id").agg(
        F.array_sort(F.collect_list(F.struct("ep_index", "dominant_type"))).alias("all"), F.max_by("t_end", "ep_index").alias("last_end")
    )
    tail = F.transform(F.slice("all", F.greatest(F.size("all") - order + 1, F.lit(1)), order), lambda x: x["dominant_type"])
    last = last.select("patient_id", "last_end", F.array_join(tail, "|").alias("context"), F.element_at(tail, -1).alias("last_type"))
    best = top_next(model, 1).select("context", "next_type", "p", F.coalesce("mean_gap_days", F.lit(UNSEEN_GAP)).alias("gap"))
    return last.join(best, "context", "left").select(
        "patient_id",
        "context",
        F.coalesce("next_type", "last_type").alias("next_type"),
        F.coalesce("p", F.lit(UNSEEN_CONFIDENCE)).alias("confidence"),
        F.coalesce("gap", F.lit(UNSEEN_GAP)).alias("gap_days"),
        F.timestamp_micros((micros("last_end") + F.coalesce("gap", F.lit(UNSEEN_GAP)) * 86400e6).cast("long")).cast("timestamp_ntz").alias("expected_begin"),
    )
