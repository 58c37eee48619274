"""Exact thresholds and exact calibration against plain computation."""

import math
import random

import pytest

from episodica.operators import ranks, scoring


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_middle_of_distinct_values(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "SORTED", most)
    rng = random.Random(most)
    groups = {
        "even": [float(k) for k in range(500)],
        "skewed": [math.exp(rng.gauss(0, 20)) for _ in range(701)],
        "ties": [float(rng.randint(0, 9)) for _ in range(400)],
        "ends": [-math.inf, math.inf, math.nan, 0.0, 1.0, -1.0],
        "two": [3.0, 1.0, 3.0],
        "one": [7.0] * 30,
        None: [1.0, 2.0],
    }
    rows = [(g, x) for g, own in groups.items() for x in own] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    got = {r.g: r.x for r in ranks.middle_distinct(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    key = lambda x: (math.isnan(x), x)
    want = {g: sorted({str(x): x for x in own}.values(), key=key) for g, own in groups.items() if g}
    assert got == {g: own[len(own) // 2] for g, own in want.items() if len(own) > 1}
    assert ranks.middle_distinct(spark.createDataFrame([], "g string, x double"), "g", "x").count() == 0


def descend(points, steps):
    a, b = 1.0, 0.0
    for _ in range(steps):
        d = [(1 / (1 + math.exp(-(a * s + b))) - y, s) for s, y in points]
        a, b = a - 0.1 * sum(e * s for e, s in d) / len(points), b - 0.1 * sum(e for e, _ in d) / len(points)
    return a, b


def test_calibration_equals_descent_over_all_points(spark, monkeypatch):
    rng = random.Random(4)
    points = [(rng.choice([rng.random(), 0.5]), float(rng.random() < 0.4)) for _ in range(1000)]
    rows = spark.createDataFrame([*points, (None, 1.0), (0.3, None)], "s double, y double").repartition(3)
    assert scoring.fit_platt(rows, "s", "y") == pytest.approx(descend(points, 500), abs=1e-6)
    monkeypatch.setattr(scoring, "POINTS", 10)
    assert scoring.fit_platt(rows, "s", "y", steps=12) == pytest.approx(descend(points, 12), abs=1e-9)
    assert scoring.fit_platt(rows.limit(0), "s", "y") is None
