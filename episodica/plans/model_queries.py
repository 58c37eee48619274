"""Type system, causal, explanation, privacy, federation and schema-evolution queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import causal, evolution, explain, privacy, typesys
from ..schema import attrs, point_events, table
from ..sources import fhir
from .base import E, r6


def _types(spark, d):
    """A DAG: part types and brands; a brand lies below every type it occurs with, types below their last word."""
    parts = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("parent")).distinct()
    tops = parts.select(F.col("parent").alias("name"), F.lit("ANY").alias("parent")).distinct()
    return parts.unionByName(tops)


def _part_events(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_brand").alias("event_type"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("other"), F.col("p_name")).alias("cat"))


def _specs(spark, d):
    """Sizes are whole numbers between bounds that each type narrows; prices are declared at the top."""
    kinds = table(spark, d, "part").groupBy(F.col("p_type").alias("type_name")).agg(F.min("p_size").cast("double").alias("lo"), (F.max("p_size") - 10).cast("double").alias("hi"))
    none = F.lit(None).cast("array<string>")
    sizes = kinds.select("type_name", F.lit("size").alias("attr"), F.lit("int").alias("spec_type"), "lo", "hi", none.alias("values"), (F.col("lo") > 0).alias("required"))
    top = spark.createDataFrame([("ANY", "price", "float", 0.0, None, None, True), ("ANY", "size", "float", 45.0, None, None, False)], sizes.schema)
    return sizes.unionByName(top)


def type_closure(spark, d):
    return typesys.closure(_types(spark, d))


def type_depths(spark, d):
    return typesys.depths(typesys.closure(_types(spark, d)))


def subtype_events(spark, d):
    name = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    return typesys.events_of(_part_events(spark, d), typesys.closure(_types(spark, d)), name).select("event_id", "event_type")


def type_conflicts(spark, d):
    return typesys.conflicts(typesys.closure(_types(spark, d)), _specs(spark, d))


def required_attributes(spark, d):
    return typesys.required(typesys.closure(_types(spark, d)), _specs(spark, d))


def attribute_validation(spark, d):
    rows = typesys.validate_attributes(_part_events(spark, d), typesys.closure(_types(spark, d)), _specs(spark, d))
    return rows.groupBy("attr", "ok").agg(F.count("*").alias("n"))


def _orders(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select((F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).cast("int").alias("x"), (F.col("o_totalprice") > 150000).alias("y"), F.col("c_mktsegment").alias("z"), "o_totalprice", "c_acctbal")


def backdoor_effect(spark, d):
    return causal.do_backdoor(_orders(spark, d), "x", F.col("y"), ["z"]).select("x", r6("p").alias("p"))


def risk_difference(spark, d):
    p = causal.do_backdoor(_orders(spark, d), "x", F.col("y"), ["z"])
    return p.agg(r6(F.sum(F.when(F.col("x") == 1, F.col("p")).otherwise(-F.col("p")))).alias("difference"))


NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def corr_matrix(spark, d):
    n, _, cov = causal.moments(table(spark, d, "lineitem"), NAMES)
    rows = [(a, b, round(causal.partial_correlation(cov, i, j, n=n), 6)) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if i < j]
    return spark.createDataFrame(rows, "a string, b string, r double")


def partial_corr(spark, d):
    n, _, cov = causal.moments(table(spark, d, "lineitem"), NAMES)
    r = causal.partial_correlation(cov, 0, 1, (2,), n)
    return spark.createDataFrame([(round(r, 6), causal.independent(cov, n, 0, 1, (2,)))], "r double, independent boolean")


def pc_structure(spark, d):
    return causal.learn_structure(table(spark, d, "lineitem"), NAMES)


def pc_skeleton_orders(spark, d):
    """What depends on what among an order's number of lines, its quantity and its price: pairs without a direction."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    found = causal.learn_structure(rows, ["n_lines", "price", "quantity"])
    return found.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def bootstrap_structure(spark, d):
    return causal.bootstrap_edges(table(spark, d, "lineitem"), NAMES, key=F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def ate_regression(spark, d):
    rows = _orders(spark, d).select(F.col("x").cast("double"), F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("w"))
    return spark.createDataFrame([(round(causal.ate(rows, "x", "y", ["w"]), 4),)], "ate double")


def ate_refutation(spark, d):
    rows = _orders(spark, d).select(F.col("x").cast("double"), F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("w"))
    return spark.createDataFrame(list(causal.refute(rows, "x", "y", ["w"]).items()), "name string, effect double")


def _scaled(spark, d):
    return point_events(spark, d).withColumn("num", attrs(value=F.col("num").getItem("value") / 50, k=F.col("num").getItem("k") / 10))


def shapley_top8(spark, d):
    # A tiny shift keeps exact ties off the rounding boundary, here and in the SQL.
    rows = explain.shapley(_scaled(spark, d), ["value", "k"], digits=None)
    return rows.select("patient_id", "event_id", F.round(F.col("phi") + 1e-9, 5).alias("phi"))


def shapley_explaining(spark, d):
    rows = explain.explaining(explain.shapley(_scaled(spark, d), ["value", "k"], digits=None), phi_min=0.05)
    return rows.select("patient_id", "event_id", F.round(F.col("phi") + 1e-9, 5).alias("phi"))


def counterfactuals(spark, d):
    rows = explain.counterfactuals(_scaled(spark, d), ["value", "k"], target_reduction=0.05)
    return rows.select("patient_id", "event_id", "attr", r6("score").alias("score"), r6("new_score").alias("new_score"))


def sufficient_explanations(spark, d):
    rows = explain.sufficient(_scaled(spark, d), ["value", "k"], epsilon=0.001)
    return rows.select("patient_id", F.array_join("event_ids", ",").alias("events"), r6("score").alias("score"), "is_sufficient")


def bounded_explanations(spark, d):
    rows = explain.sufficient(_scaled(spark, d), ["value", "k"], epsilon=0.0001, k_max=3)
    return rows.select("patient_id", F.array_join("event_ids", ",").alias("events"), r6("score").alias("score"), "is_sufficient")


def _institutions(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("institution_id"), F.col("c_custkey").alias("patient_id"))


def _epsilons(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("institution_id"), (0.5 + F.col("n_nationkey") / 4.0).alias("epsilon"))


def federated_counts(spark, d):
    rows = privacy.federated_counts(_institutions(spark, d), _epsilons(spark, d), noise=False)
    return rows.select("institution_id", "n", "epsilon", "released", "level", r6("variance").alias("variance"))


def federated_total(spark, d):
    rows = privacy.federated_total(privacy.federated_counts(_institutions(spark, d), _epsilons(spark, d), noise=False))
    return rows.select("institutions", "total", r6("std_error").alias("std_error"))


def federated_noisy(spark, d):
    return privacy.federated_total(privacy.federated_counts(_institutions(spark, d), _epsilons(spark, d), seed=3))


def dp_release(spark, d):
    budget, events = privacy.Budget(2.0), point_events(spark, d)
    count = privacy.dp_count(events, budget, 1.0, seed=1)
    mean = privacy.dp_mean(events, "value", 0.0, 500.0, budget, 1.0, seed=2)
    return spark.createDataFrame([("patients", count), ("mean_value", mean), ("budget_left", budget.left)], "name string, released double")


OPERATIONS = [("ren_type", "click", "tap"), ("rem_type", "error"), ("add_attr", "unit", "eur"), ("chg_attr", "value", "int"), ("rem_attr", "k")]


def migrate_events(spark, d):
    rows = evolution.migrate(point_events(spark, d), OPERATIONS)
    cat = F.col("cat")
    return rows.where("NOT rejected").select("event_id", "event_type", cat.getItem("unit").alias("unit"), cat.getItem("value").alias("value"), cat.getItem("k").alias("k"))


def migration_result(spark, d):
    return evolution.migration_result(evolution.migrate(point_events(spark, d), OPERATIONS))


VERSIONS = [("v1", datetime(2024, 1, 5), datetime(2024, 1, 12)), ("v2", datetime(2024, 1, 12), datetime(2024, 1, 20)), ("v3", datetime(2024, 1, 22), None)]


def version_asof(spark, d):
    return evolution.with_version(point_events(spark, d), VERSIONS).groupBy("version_id").agg(F.count("*").alias("n"))


def migration_log(spark, d):
    events = evolution.with_version(point_events(spark, d), VERSIONS)
    return evolution.run_migration(events, OPERATIONS, "v2", "v3", dry_run=True)[1]


def migration_run(spark, d):
    events = evolution.run_migration(evolution.with_version(point_events(spark, d), VERSIONS), OPERATIONS, "v2", "v3")[0]
    return events.groupBy("version_id", "event_type", F.col("cat").getItem("unit").alias("unit")).agg(F.count("*").alias("n"))


def _first_type(spark, d):
    return table(spark, d, "part").agg(F.min("p_type")).first()[0]


def type_removal(spark, d):
    return typesys.remove_type(_types(spark, d), _first_type(spark, d), top="ANY")


def type_neighbours(spark, d):
    name, types = _first_type(spark, d), _types(spark, d)
    above = typesys.parents_of(types, name).select(F.lit("parent").alias("side"), F.col("parent").alias("name"))
    return above.unionByName(typesys.children_of(types, name).select(F.lit("child").alias("side"), "name"))


def nearest_resources(spark, d):
    types = _types(spark, d)
    name = F.col("name")
    resource = F.when(name.startswith("PROMO"), "Procedure").when(name.startswith("STANDARD"), "Condition").when(name == "ANY", "Observation")
    declared = types.select("name").union(types.select("parent")).distinct().withColumn("resource", resource)
    return fhir.nearest_resource(typesys.closure(types), declared)


def strata_grid(spark, d):
    return causal.strata(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


def do_monte_carlo(spark, d):
    rows = _orders(spark, d)
    return causal.do_monte_carlo(rows, "x", F.col("y"), ["z"], key=[F.col("o_totalprice"), F.col("c_acctbal")]).select("x", r6("p").alias("p"))


def federated_simulation(spark, d):
    rows = privacy.simulate_federation(spark, institutions=4, patients=150, fraction=0.35, epsilon=2.0, noise=False)
    return rows.select("institution_id", "n", "epsilon", "released", "level", r6("variance").alias("variance"))


_T = "(SELECT DISTINCT p_brand AS name, p_type AS parent FROM part UNION SELECT DISTINCT p_type, 'ANY' FROM part)"
_C = f"""(WITH RECURSIVE u(name, ancestor, depth) AS (SELECT name, name, 0 FROM (SELECT name FROM {_T} UNION SELECT parent FROM {_T})
  UNION ALL SELECT u.name, t.parent, u.depth + 1 FROM u JOIN {_T} t ON u.ancestor = t.name) SELECT name, ancestor, CAST(max(depth) AS INTEGER) AS depth FROM u GROUP BY ALL)"""
_S = """(SELECT p_type AS type_name, 'size' AS attr, 'int' AS spec_type, CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) - 10 AS DOUBLE) AS hi, min(p_size) > 0 AS required FROM part GROUP BY 1
  UNION ALL SELECT 'ANY', 'price', 'float', 0.0, NULL, true UNION ALL SELECT 'ANY', 'size', 'float', 45.0, NULL, false)"""
_INH = f"(SELECT name, c.ancestor, c.depth, s.attr, s.spec_type, s.lo, s.hi, s.required, row_number() OVER (PARTITION BY name, s.attr ORDER BY c.depth, c.ancestor) AS rank FROM {_C} c JOIN {_S} s ON c.ancestor = s.type_name)"
_O = "(SELECT (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS x, o_totalprice > 150000 AS y, c_mktsegment AS z, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey)"
_DO = f"""(SELECT x, sum(ny / n * nz / (SELECT count(*) FROM {_O})) AS p FROM (SELECT x, z, count(*) AS n, count(*) FILTER (y) AS ny FROM {_O} GROUP BY ALL) JOIN (SELECT z, count(*) AS nz FROM {_O} GROUP BY 1) USING (z) GROUP BY x)"""
_TOP = f"(SELECT patient_id, event_id, r, value / 50 AS v, k / 10 AS k FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY t_start, event_id) - 1 AS r FROM {E}) WHERE r < 8)"
_PHI = f"""(WITH e AS {_TOP}, d AS (SELECT patient_id, count(*) AS d FROM e GROUP BY 1), m AS (SELECT patient_id, d, unnest(range(0, CAST(2 ** d AS BIGINT))) AS m FROM d),
  v AS (SELECT m.patient_id, m.d, m.m, coalesce(least(1.0, greatest(0.0, sum(e.v + e.k) / (2 * count(e.r)) / 10)), 0.0) AS v FROM m LEFT JOIN e ON e.patient_id = m.patient_id AND (m.m >> CAST(e.r AS BIGINT)) & 1 = 1 GROUP BY ALL)
  SELECT e.patient_id, e.event_id, sum(factorial(CAST(bit_count(a.m) AS INT)) * factorial(CAST(a.d - bit_count(a.m) - 1 AS INT)) / factorial(CAST(a.d AS INT)) * (b.v - a.v)) AS phi
  FROM e JOIN v a ON a.patient_id = e.patient_id AND (a.m >> CAST(e.r AS BIGINT)) & 1 = 0 JOIN v b ON b.patient_id = e.patient_id AND b.m = a.m + (CAST(1 AS BIGINT) << CAST(e.r AS BIGINT)) GROUP BY ALL)"""
_CF = f"""(WITH e AS (SELECT * FROM (SELECT patient_id, event_id, row_number() OVER (PARTITION BY patient_id ORDER BY t_start, event_id) - 1 AS r, value / 50 AS v, k / 10 AS k FROM {E})),
  p AS (SELECT patient_id, sum(v + k) AS s, 2 * count(*) AS n FROM e GROUP BY 1),
  c AS (SELECT patient_id, event_id, r, a.i, a.attr, CASE a.i WHEN 0 THEN v ELSE k END AS x, f.j, f.f FROM e, (VALUES (0, 'value'), (1, 'k')) a(i, attr), (VALUES (0, 0.5), (1, 0.25), (2, 0.1), (3, 0.0)) f(j, f)),
  s AS (SELECT c.*, least(1.0, greatest(0.0, s / n / 10)) AS score, least(1.0, greatest(0.0, (s - x * (1 - f)) / n / 10)) AS new_score FROM c JOIN p USING (patient_id))
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY r, i, j) AS q FROM s WHERE new_score <= score - 0.05) WHERE q = 1)"""
_FED = """(SELECT n_name AS institution_id, count(DISTINCT c_custkey) AS n, 0.5 + n_nationkey / 4.0 AS epsilon FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey)"""

_VERSION = "CASE WHEN t_start >= TIMESTAMP '2024-01-22' THEN 'v3' WHEN t_start >= TIMESTAMP '2024-01-12' AND t_start < TIMESTAMP '2024-01-20' THEN 'v2' WHEN t_start >= TIMESTAMP '2024-01-05' AND t_start < TIMESTAMP '2024-01-12' THEN 'v1' ELSE 'v3' END"
_MOVED = f"(SELECT *, v = 'v2' AND event_type <> 'error' AS moved FROM (SELECT *, {_VERSION} AS v FROM {E}))"

SQL = {
    "type_closure": f"SELECT name, ancestor, depth FROM {_C}",
    "type_depths": f"SELECT name, max(depth) AS depth FROM {_C} GROUP BY 1",
    "subtype_events": f"SELECT p_partkey AS event_id, p_brand AS event_type FROM part WHERE p_brand IN (SELECT name FROM {_C} WHERE ancestor = (SELECT min(p_type) FROM part))",
    "type_conflicts": f"SELECT name, attr, 'type_mismatch' AS conflict FROM {_INH} GROUP BY name, attr HAVING count(DISTINCT spec_type) > 1 UNION ALL SELECT name, attr, 'disjoint_range' FROM {_INH} GROUP BY name, attr HAVING max(lo) > min(hi)",
    "required_attributes": f"SELECT name, attr FROM {_INH} GROUP BY ALL HAVING bool_or(required)",
    "attribute_validation": f"""SELECT attr, ok, count(*) AS n FROM (SELECT 'other' AS attr, false AS ok FROM part UNION ALL SELECT 'price', true FROM part
      UNION ALL SELECT 'size', p_size >= lo AND p_size <= hi FROM part JOIN {_INH} i ON i.name = p_brand AND i.attr = 'size' AND i.rank = 1) GROUP BY ALL""",
    "backdoor_effect": f"SELECT x, round(p, 6) AS p FROM {_DO}",
    "risk_difference": f"SELECT round(sum(CASE WHEN x = 1 THEN p ELSE -p END), 6) AS difference FROM {_DO}",
    "corr_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]),
    "pc_skeleton_orders": """WITH o AS (SELECT count(*) AS n, sum(l_extendedprice) AS p, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
      r AS (SELECT corr(n, p) AS np, corr(n, q) AS nq, corr(p, q) AS pq, count(*) AS m FROM o),
      t AS (SELECT 'n_lines' AS a, 'price' AS b, np AS r, nq AS ra, pq AS rb, m FROM r UNION ALL SELECT 'n_lines', 'quantity', nq, np, pq, m FROM r UNION ALL SELECT 'price', 'quantity', pq, np, nq, m FROM r),
      z AS (SELECT *, (r - ra * rb) / sqrt((1 - ra * ra) * (1 - rb * rb)) AS g FROM t)
      SELECT a, b FROM z WHERE abs(0.5 * ln((1 + r) / (1 - r))) * sqrt(m - 3) >= 1.96 AND abs(0.5 * ln((1 + g) / (1 - g))) * sqrt(m - 4) >= 1.96""",
    "partial_corr": """SELECT round(p, 6) AS r, abs(0.5 * ln((1 + p) / (1 - p))) * sqrt(n - 3) < 1.96 AS independent FROM (SELECT (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS p, n FROM
      (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz, count(*) AS n FROM lineitem))""",
    "ate_regression": f"""SELECT round((covar_pop(x, o_totalprice) * var_pop(c_acctbal) - covar_pop(c_acctbal, o_totalprice) * covar_pop(x, c_acctbal)) / (var_pop(x) * var_pop(c_acctbal) - covar_pop(x, c_acctbal) ** 2), 4) AS ate FROM {_O}""",
    "shapley_top8": f"SELECT patient_id, event_id, round(phi + 1e-9, 5) AS phi FROM {_PHI}",
    "shapley_explaining": f"SELECT patient_id, event_id, round(phi + 1e-9, 5) AS phi FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(phi) DESC, event_id) AS q FROM {_PHI} WHERE phi >= 0.05) WHERE q <= 5",
    "counterfactuals": f"SELECT patient_id, event_id, attr, round(score, 6) AS score, round(new_score, 6) AS new_score FROM {_CF}",
    "federated_counts": f"SELECT institution_id, n, epsilon, CAST(n AS DOUBLE) AS released, CASE WHEN epsilon <= 1 THEN 'stark' WHEN epsilon <= 5 THEN 'moderat' ELSE 'schwach' END AS level, round(2 / (epsilon * epsilon), 6) AS variance FROM {_FED}",
    "federated_total": f"SELECT count(*) AS institutions, CAST(sum(n) AS DOUBLE) AS total, round(sqrt(sum(2 / (epsilon * epsilon))), 6) AS std_error FROM {_FED}",
    "migrate_events": f"SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' ELSE event_type END AS event_type, 'eur' AS unit, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS k FROM {E} WHERE event_type <> 'error'",
    "migration_result": "SELECT count(*) FILTER (event_type <> 'error') AS migrated, count(*) FILTER (event_type = 'error') AS rejected FROM events",
    "migration_log": f"SELECT event_id, 'v2' AS from_version, 'v3' AS to_version, CASE WHEN moved THEN 'migrated' ELSE 'rejected' END AS status FROM {_MOVED} WHERE v = 'v2'",
    "migration_run": f"SELECT CASE WHEN moved THEN 'v3' ELSE v END AS version_id, CASE WHEN moved AND event_type = 'click' THEN 'tap' ELSE event_type END AS event_type, CASE WHEN moved THEN 'eur' END AS unit, count(*) AS n FROM {_MOVED} GROUP BY ALL",
    "type_removal": f"""WITH t AS {_T}, k AS (SELECT * FROM t WHERE name <> (SELECT min(p_type) FROM part) AND parent <> (SELECT min(p_type) FROM part))
      SELECT * FROM k UNION ALL SELECT name, 'ANY' FROM t WHERE parent = (SELECT min(p_type) FROM part) AND name NOT IN (SELECT name FROM k)""",
    "type_neighbours": f"SELECT 'parent' AS side, parent AS name FROM {_T} WHERE name = (SELECT min(p_type) FROM part) UNION ALL SELECT 'child', name FROM {_T} WHERE parent = (SELECT min(p_type) FROM part)",
    "nearest_resources": f"""SELECT name AS event_type, resource FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth, ancestor) AS q FROM (SELECT name, ancestor, depth,
      CASE WHEN starts_with(ancestor, 'PROMO') THEN 'Procedure' WHEN starts_with(ancestor, 'STANDARD') THEN 'Condition' WHEN ancestor = 'ANY' THEN 'Observation' END AS resource FROM {_C}) WHERE resource IS NOT NULL) WHERE q = 1""",
    "strata_grid": """SELECT c_mktsegment, c_nationkey, count(c_custkey) AS n FROM (SELECT * FROM (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT c_nationkey FROM customer)) LEFT JOIN customer USING (c_mktsegment, c_nationkey) GROUP BY ALL""",
    "federated_simulation": "SELECT 'institution_' || (i + 1) AS institution_id, CAST(52 AS BIGINT) AS n, CAST(2.0 AS DOUBLE) AS epsilon, CAST(52 AS DOUBLE) AS released, 'moderat' AS level, CAST(0.5 AS DOUBLE) AS variance FROM range(4) r(i)",
    "version_asof": f"""SELECT CASE WHEN t_start >= TIMESTAMP '2024-01-22' THEN 'v3' WHEN t_start >= TIMESTAMP '2024-01-12' AND t_start < TIMESTAMP '2024-01-20' THEN 'v2'
      WHEN t_start >= TIMESTAMP '2024-01-05' AND t_start < TIMESTAMP '2024-01-12' THEN 'v1' ELSE 'v3' END AS version_id, count(*) AS n FROM {E} GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "do_monte_carlo", "pc_structure", "bootstrap_structure", "ate_refutation", "sufficient_explanations", "bounded_explanations", "federated_noisy", "dp_release"]}
