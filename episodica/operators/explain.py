"""Event-level explanations of a patient score.

The score of a set of events is clamp(mean of all its numeric attribute values / scale, 0, 1), or any
``model``: a function of two columns, sum and count of the values, that gives a column. The coalition
work is done in array expressions on one row per patient, so it adds no shuffle to the grouping.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest number of events for exact values: 2**8 coalitions a patient.
MOST_EVENTS = 8


def mean_model(scale: float = 10.0) -> Callable[[Column, Column], Column]:
    return lambda s, n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s / F.greatest(n, F.lit(1.0)) / F.lit(scale)))


def _summed(events: DataFrame, names: list[str]) -> DataFrame:
    """``events`` plus x (values in the order of ``names``), s (their sum), n (how many are not null)."""
    x = F.array(*[F.col("num").getItem(a) for a in names])
    held = F.array_compact(x)
    return events.withColumns({"x": x, "s": F.aggregate(held, F.lit(0.0), lambda a, v: a + v), "n": F.size(held).cast("double")})


def _events_of(events: DataFrame, names: list[str], k: int | None = None) -> DataFrame:
    """``patient_id, all``: the events by time, the first ``k`` if given, as structs r, event_id, s (sum), n (count), x (values)."""
    w = Window.partitionBy("patient_id").orderBy("t_start", "event_id")
    rows = _summed(events, names).withColumn("r", F.row_number().over(w) - 1)
    rows = rows if k is None else rows.where(F.col("r") < k)
    return rows.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("r", "event_id", "s", "n", "x"))).alias("all"))


def shapley(events: DataFrame, names: list[str], *, model=None, k: int = MOST_EVENTS, digits: int | None = 6) -> DataFrame:
    """``patient_id, event_id, phi``: exact Shapley values of the first ``k`` events, rounded to ``digits``."""
    model = model or mean_model()
    if k > MOST_EVENTS:
        raise ValueError(f"at most {MOST_EVENTS} events")
    rows = _events_of(events, names, k).withColumn("d", F.size("all"))
    in_set = lambda m, r: F.bit_get(m, r) == 1

    def total(m: Column, field: str) -> Column:
        return F.aggregate("all", F.lit(0.0), lambda a, e: a + F.when(in_set(m, e["r"]), e[field]).otherwise(0.0))

    masks = F.sequence(F.lit(0), F.pow(F.lit(2.0), F.col("d")).cast("int") - 1)
    rows = rows.withColumn("v", F.transform(masks, lambda m: model(total(m, "s"), total(m, "n"))))
    # weight[d][size] = size! (d - size - 1)! / d!
    table = [[math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) if s < d else 0.0 for s in range(k)] for d in range(1, k + 1)]
    weights = F.array(*[F.array(*map(F.lit, line)) for line in table])

    def phi(r: Column) -> Column:
        bit = F.pow(F.lit(2.0), r).cast("int")
        each = F.transform("v", lambda v, m: F.when(in_set(m, r), 0.0).otherwise(F.get(F.get(weights, F.col("d") - 1), F.bit_count(m)) * (F.get(F.col("v"), m + bit) - v)))
        value = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return value if digits is None else F.bround(value, digits)

    found = F.transform("all", lambda e: F.struct(e["event_id"].alias("event_id"), phi(e["r"]).alias("phi")))
    return rows.select("patient_id", F.explode(found).alias("x")).select("patient_id", "x.*")


def explaining(values: DataFrame, phi_min: float = 0.05, top: int = 5) -> DataFrame:
    """Events with phi >= ``phi_min``, at most ``top`` a patient by size."""
    w = Window.partitionBy("patient_id").orderBy(F.desc(F.abs("phi")), "event_id")
    return values.where(F.col("phi") >= phi_min).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def counterfactuals(events: DataFrame, names: list[str], *, model=None, target_reduction: float = 0.1) -> DataFrame:
    """Per patient the first change that lowers the score by ``target_reduction``: events by time,
    attributes in the given order, factors .5, .25, .1, 0."""
    model = model or mean_model()
    rows = _summed(events, names).select("patient_id", "t_start", "event_id", "x", "s", "n")
    whole = rows.groupBy(F.col("patient_id").alias("__p")).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rows = rows.drop("s", "n").join(whole, F.col("patient_id").eqNullSafe(F.col("__p"))).withColumn("score", model(F.col("all_s"), F.col("all_n")))
    rows = rows.select("*", F.posexplode("x").alias("i", "was")).where("was IS NOT NULL")
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, (0.5, 0.25, 0.1, 0.0)))).alias("j", "f"))
    rows = rows.withColumn("new_score", model(F.col("all_s") - F.col("was") * (1 - F.col("f")), F.col("all_n")))
    rows = rows.where(F.col("new_score") <= F.col("score") - target_reduction)
    change = F.struct("score", "event_id", F.get(F.array(*map(F.lit, names)), F.col("i")).alias("attr"), "was", F.bround(F.col("was") * F.col("f"), 4).alias("now"), "new_score")
    return rows.groupBy("patient_id").agg(F.min_by(change, F.struct("t_start", "event_id", "i", "j")).alias("x")).select("patient_id", "x.*")


def sufficient(events: DataFrame, names: list[str], *, model=None, epsilon: float = 0.05, k_max: int | None = None) -> DataFrame:
    """Greedy explanation: events added one by one, each time the one that brings the score nearest to
    the whole's, until within ``epsilon`` (or ``k_max`` events are chosen).

    ``patient_id, event_ids, score, full_score, is_sufficient``; with ``k_max``, patients with at most so
    many events keep them all. The first event in time wins ties.
    """
    model = model or mean_model()
    rows = _events_of(events, names)
    s = F.aggregate("all", F.lit(0.0), lambda a, e: a + e["s"])
    n = F.aggregate("all", F.lit(0.0), lambda a, e: a + e["n"])
    rows = rows.withColumn("full", model(s, n))

    def step(acc: Column, _: Column) -> Column:
        free = F.filter("all", lambda e: ~F.array_contains(acc["ids"], e["event_id"]))
        options = F.transform(free, lambda e: F.struct(F.abs(model(acc["s"] + e["s"], acc["n"] + e["n"]) - F.col("full")).alias("far"), e["r"].alias("r"), e["event_id"].alias("id"), e["s"].alias("s"), e["n"].alias("n")))

        def more(best: Column) -> Column:
            return F.struct(F.concat(acc["ids"], F.array(best["id"])).alias("ids"), (acc["s"] + best["s"]).alias("s"), (acc["n"] + best["n"]).alias("n"), (best["far"] <= epsilon).alias("done"))

        return F.when(acc["done"] | (F.size(free) == 0), acc).otherwise(F.get(F.transform(F.array(F.array_min(options)), more), F.lit(0)))

    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.size("all") if k_max is None else F.least(F.size("all"), F.lit(k_max))), start, step)
    rows = rows.withColumn("x", found).select("patient_id", F.col("x.ids").alias("event_ids"), model(F.col("x.s"), F.col("x.n")).alias("score"), F.col("full").alias("full_score"), F.col("x.done").alias("is_sufficient"), "all")
    if k_max is not None:
        few = F.size("all") <= k_max
        rows = rows.withColumns({
            "event_ids": F.when(few, F.transform("all", lambda e: e["event_id"])).otherwise(F.col("event_ids")),
            "score": F.when(few, F.col("full_score")).otherwise(F.col("score")),
            "is_sufficient": few | F.col("is_sufficient"),
        })
    return rows.drop("all")
