import random

import pytest
from pyspark.sql import functions as F

from episodica.functions import temporal

#: Which of the points p0 < p1 < p2 < p3 are start and end of the first and of the second interval.
PLACES = {
    "before": "0123", "meets": "0112", "overlaps": "0213", "starts": "0102", "during": "1203", "finishes": "1202", "equals": "0101",
    "after": "2301", "met_by": "1201", "overlapped_by": "1302", "started_by": "0201", "contains": "0312", "finished_by": "0212",
}
_rng = random.Random(7)
DRAWN = [sorted(_rng.sample(range(1000), 4)) for _ in range(8)]
CASES = [(*(p[int(k)] for k in places), name) for name, places in PLACES.items() for p in DRAWN]
#: Points and an interval that ends before it starts.
CASES += [(2, 2, 2, 2, "meets"), (2, 2, 2, 8, "meets"), (0, 7, 7, 7, "meets"), (7, 7, 0, 7, "finishes"), (2, 6, 2, 2, "started_by"), (9, 4, 0, 1, None)]


def rows(spark):
    return spark.createDataFrame([(float(a), float(b), float(c), float(d), r) for a, b, c, d, r in CASES], "a double, b double, c double, d double, want string")


def test_relations(spark):
    found = rows(spark).select("want", temporal.allen_relation(*[F.col(x) for x in "abcd"]).alias("got")).collect()
    assert [r.got for r in found] == [r.want for r in found]


def test_exactly_one_relation_on_proper_intervals(spark):
    n = rows(spark).where("a < b AND c < d")
    n = n.select(sum((temporal.holds(r, *[F.col(x) for x in "abcd"]).cast("int") for r in temporal.RELATIONS), F.lit(0)).alias("n"))
    assert {r.n for r in n.collect()} == {1}


@pytest.mark.parametrize("sigma", [0.0, 0.5])
def test_fuzzy_sums_to_one(spark, sigma):
    pairs = rows(spark).where("want IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    found = temporal.fuzzy_distribution(pairs, key=["id", "want"], sigma=F.lit(sigma), n_samples=200)
    assert all(abs(r.p - 1) < 1e-9 for r in found.groupBy("id").agg(F.sum("p").alias("p")).collect())
    if sigma == 0:
        assert all(r.relation == r.want for r in found.collect())


def test_fuzzy_draws_only_where_they_matter(spark):
    """The same shares as from all draws of all pairs, but no row is made for a draw."""
    pairs = spark.range(60).selectExpr("concat('k', id) k", "floor(rand(1) * 40) * 3.0D a", "if(id % 9 = 1, null, floor(rand(2) * 40) * 3.0D) b", "if(id % 7 = 1, null, floor(rand(3) * 40) * 3.0D) c", "floor(rand(4) * 40) * 3.0D d", "element_at(array(0D, 0.5D, 5D), cast(id % 3 + 1 as int)) s")
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
    found = temporal.fuzzy_distribution(pairs, key=["k"], sigma=F.col("s"), n_samples=100, seed=7)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    unit = lambda j: (F.shiftrightunsigned(F.xxhash64("k", "draw", F.lit(j), F.lit(7)), 11) + 0.5) / F.lit(float(1 << 53))
    normal = lambda j: F.sqrt(-2 * F.log(unit(2 * j))) * F.cos(2 * F.lit(3.141592653589793) * unit(2 * j + 1))
    drawn = pairs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(100))))
    drawn = drawn.select("k", *[(F.col(x) + F.col("s") * normal(j)).alias(x) for j, x in enumerate("abcd")])
    ends = [f(p, q) for p, q in (("a", "b"), ("c", "d")) for f in (F.least, F.greatest)]
    want = drawn.groupBy("k", temporal.allen_relation(*ends).alias("relation")).agg((F.count("*") / 100).alias("p"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_fuzzy_without_spread_holds_no_pair(spark):
    """At sigma 0 the relation is a column of the pair: nothing is grouped by pair, so no task holds its pairs."""
    pairs = rows(spark).where("want IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    found = temporal.fuzzy_distribution(pairs, key=["id"], sigma=F.lit(0.0), n_samples=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert found.where("p = 1").count() == pairs.count()
