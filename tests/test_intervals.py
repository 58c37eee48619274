"""The interval join against all pairs, on random intervals and on one patient with very many events."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from episodica.functions import temporal
from episodica.operators import intervals

SCHEMA = "patient_id string, event_id string, t_start timestamp_ntz, t_end timestamp_ntz, relation string"


def made(spark, n, seed, reversed_too=False):
    rng, t0, rows = random.Random(seed), datetime(1969, 12, 1), []
    for k in range(n):
        start = t0 + timedelta(hours=12 * rng.randint(0, 150))
        length = rng.choice([0, 0, 12, 24, 240, 2400]) * rng.randint(0, 2) - (12 if reversed_too and k % 9 == 0 else 0)
        rows.append((rng.choice(["p", "q", None]), f"e{k}", start, rng.choice([start + timedelta(hours=length), None]), "theirs"))
    return spark.createDataFrame(rows, SCHEMA)


def all_pairs(a, b):
    named = lambda rows, p: rows.select("patient_id", *[rows[c].alias(p + c) for c in rows.columns if c != "patient_id"])
    return named(a, "a_").join(named(b, "b_"), "patient_id").withColumn("found", temporal.event_relation("a_", "b_"))


@pytest.mark.parametrize("within", [0, 3])
def test_join_equals_all_pairs(spark, within):
    a, b = made(spark, 60, 1, True), made(spark, 50, 2, True)
    gap = "greatest(timestampdiff(MICROSECOND, coalesce(a_t_end, a_t_start), b_t_start), timestampdiff(MICROSECOND, coalesce(b_t_end, b_t_start), a_t_start))"
    want = all_pairs(a, b).where(f"found is not null and {gap} <= {within} * 86400000000L")
    got = intervals.interval_join(a, b, within_days=within)
    assert Counter((r.a_event_id, r.b_event_id, r.found) for r in want.collect()) == Counter((r.a_event_id, r.b_event_id, r.relation) for r in got.collect())
    assert got.where("a_relation <> 'theirs'").isEmpty()
    some = intervals.interval_join(a, b, relations=("during",))
    assert some.count() == want.where("found = 'during'").count()


def test_matrix_equals_all_pairs(spark):
    a, b = made(spark, 80, 3, True), made(spark, 70, 4, True)
    want = Counter(r.found for r in all_pairs(a, b).collect())
    got = intervals.relation_matrix(a, b)
    assert {r.relation: r.n for r in got.collect()} == want
    empty = a.limit(0)
    assert intervals.relation_matrix(empty, b).count() == intervals.interval_join(empty, empty).count() == 0


def test_a_patient_with_many_events(spark):
    """10^5 events of one patient: the all-pairs join would make 10^10 rows."""
    hour = "timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))"
    rows = spark.range(100_000).selectExpr("'p' as patient_id", "cast(id as string) as event_id", f"{hour} as t_start", f"{hour} + interval 90 minutes as t_end")
    counts = {r.relation: r.n for r in intervals.relation_matrix(rows, rows).collect()}
    n = 100_000
    assert counts == {"equals": n, "overlaps": n - 1, "overlapped_by": n - 1, "before": (n - 1) * (n - 2) // 2, "after": (n - 1) * (n - 2) // 2}
    near = intervals.interval_join(rows, rows, within_days=1 / 24)
    assert near.count() == n + 2 * (n - 1) + 2 * (n - 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
