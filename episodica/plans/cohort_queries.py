"""Cohort, temporal, episode and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import cohort, episodes, intervals, sequence
from ..operators.cohort import Cohort
from ..schema import interval_events, micros, num, point_events
from .base import E, I, r6

BUYERS = Cohort(event_type="purchase", vals=[("value", ">", 50.0)], min_count=3, aggregate=("mean", "value", ">", 60.0))
ERRORS = Cohort(event_type="error", min_count=2)
DELTA = 0.5


def cohort_purchase_mean(spark, d):
    rows = point_events(spark, d)
    found = BUYERS.run(rows)
    mean = rows.where(BUYERS.matches()).groupBy("patient_id").agg(r6(F.avg(num("value"))).alias("mean_value"))
    return found.join(mean, "patient_id")


def cohort_predicates(spark, d):
    predicate = (cohort.has_type("click", ["view"]) & cohort.val("k", "<=", 40)) | ~cohort.val("value", "!=", 100) | cohort.attr("k", 7)
    return Cohort(predicate=predicate, min_count=1).run(point_events(spark, d))


def cohort_zero(spark, d):
    return Cohort(event_type="purchase", vals=[("value", ">", 480.0)], min_count=0).run(point_events(spark, d))


def cohort_aggregates(spark, d):
    rows = point_events(spark, d)
    kinds = {"max": (">=", 480.0), "min": ("<", 5.0), "count": (">=", 20.0), "mean": ("<=", 240.0)}
    parts = [Cohort(event_type="view", aggregate=(fn, "value", *rule)).run(rows).select(F.lit(fn).alias("fn"), "patient_id", "n_events") for fn, rule in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cohort_intersect(spark, d):
    rows = point_events(spark, d)
    return cohort.intersect(BUYERS.run(rows), ERRORS.run(rows))


def cohort_union(spark, d):
    rows = point_events(spark, d)
    return cohort.union(BUYERS.run(rows), ERRORS.run(rows))


def cohort_difference(spark, d):
    rows = point_events(spark, d)
    return cohort.difference(ERRORS.run(rows), BUYERS.run(rows))


def cohort_complement(spark, d):
    rows = point_events(spark, d)
    return cohort.complement(rows, BUYERS.run(rows))


def followed_by(spark, d):
    return cohort.followed_by(point_events(spark, d), F.col("event_type") == "click", F.col("event_type") == "purchase", within_days=1.0)


def _two(spark, d):
    """A customer's interval events of two priorities."""
    rows = interval_events(spark, d).select("patient_id", "event_id", "event_type", "t_start", "t_end")
    return rows.where("event_type = '1-URGENT'"), rows.where("event_type = '5-LOW'")


def _pairs(spark, d):
    """All pairs of a customer's interval events of two priorities: an equi-join with the relation as a column."""
    rows = interval_events(spark, d).select("patient_id", "event_id", "event_type", "t_start", "t_end")
    a = rows.where("event_type = '1-URGENT'").select("patient_id", *[F.col(c).alias(f"a_{c}") for c in rows.columns if c != "patient_id"])
    b = rows.where("event_type = '5-LOW'").select("patient_id", *[F.col(c).alias(f"b_{c}") for c in rows.columns if c != "patient_id"])
    return a.join(b, "patient_id")


def allen_matrix(spark, d):
    return intervals.relation_matrix(*_two(spark, d))


def intervals_near(spark, d):
    """Pairs that share a point of time or lie at most ten days apart, by relation and distance."""
    rows = intervals.interval_join(*_two(spark, d), within_days=10.0)
    ends = [F.col(c) for c in ("a_t_start", "a_t_end", "b_t_start", "b_t_end")]
    return rows.select("a_event_id", "b_event_id", "relation", r6(temporal.distance_days("delta_gap", *ends)).alias("gap"))


def intervals_during(spark, d):
    """Per patient, the pairs in which one event lies inside the other."""
    rows = intervals.interval_join(*_two(spark, d), relations=("during", "contains"))
    return rows.groupBy("patient_id", "relation").agg(F.count("*").alias("n"))


def pairs_before(spark, d):
    """Per patient, how many pairs have the first event end before the second starts."""
    return intervals.count_before(*_two(spark, d)).where("n > 0")


def trel_fixed(spark, d):
    rows = interval_events(spark, d)
    rows = rows.withColumns({"other_t_start": F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'"), "other_t_end": F.expr("TIMESTAMP_NTZ '1996-12-31 00:00:00'")})
    return rows.where(cohort.trel("during") & cohort.dist("delta_start", 10, 100)).select("event_id", "patient_id")


def distances(spark, d):
    ends = [F.col(c) for c in ("a_t_start", "a_t_end", "b_t_start", "b_t_end")]
    rows = _pairs(spark, d)
    return rows.select("a_event_id", "b_event_id", *[r6(temporal.distance_days(k, *ends)).alias(k) for k in ("delta_start", "delta_end_start", "delta_gap")])


def fuzzy_exact(spark, d):
    ends = {"a": micros("a_t_start"), "b": micros("a_t_end"), "c": micros("b_t_start"), "d": micros("b_t_end")}
    rows = _pairs(spark, d).select("a_event_id", "b_event_id", *[c.cast("double").alias(k) for k, c in ends.items()])
    out = temporal.fuzzy_distribution(rows, key=["a_event_id", "b_event_id"], sigma=F.lit(0.0), n_samples=2)
    return out.groupBy("relation").agg(F.sum("p").alias("total"))


def fuzzy_distribution(spark, d):
    ends = {"a": micros("a_t_start"), "b": micros("a_t_end"), "c": micros("b_t_start"), "d": micros("b_t_end")}
    rows = _pairs(spark, d).select("a_event_id", "b_event_id", *[(c / 8.64e10).alias(k) for k, c in ends.items()])
    return temporal.fuzzy_distribution(rows, key=["a_event_id", "b_event_id"], sigma=F.lit(5.0))


def _episodes(spark, d):
    return episodes.build_episodes(point_events(spark, d), DELTA)


def build_episodes(spark, d):
    rows = _episodes(spark, d)
    return rows.select("patient_id", "ep_index", "t_begin", "t_end", "n_events", F.array_join("event_types", ",").alias("event_types"), "dominant_type", r6("duration_days").alias("duration_days"))


def episode_gaps(spark, d):
    return episodes.with_gaps(_episodes(spark, d)).select("patient_id", "ep_index", r6("gap_days").alias("gap_days"))


def interval_episodes(spark, d):
    rows = episodes.build_episodes(interval_events(spark, d), 30.0)
    return rows.select("patient_id", "ep_index", "t_begin", "t_end", "n_events")


def trajectories(spark, d):
    rows = episodes.trajectories(_episodes(spark, d))
    return rows.select("patient_id", "n_episodes", F.array_join("sequence", ">").alias("sequence"), r6("total_days").alias("total_days"), r6("mean_gap_days").alias("mean_gap_days"))


def trajectory_validation(spark, d):
    rows = episodes.validate_trajectories(_episodes(spark, d), min_episodes=23)
    return rows.select("patient_id", "n_episodes", F.array_join("violations", ",").alias("violations"), "valid")


def delta_median(spark, d):
    rows = episodes.learn_deltas(point_events(spark, d), floor=0.1)
    return rows.select("event_type", "n_gaps", r6("delta_days").alias("delta_days"))


def next_type_markov(spark, d):
    rows = episodes.top_next(episodes.transitions(_episodes(spark, d)), 3)
    return rows.select("context", "next_type", "n", r6("p").alias("p"), r6("mean_gap_days").alias("mean_gap_days"), "rank")


def predict_next(spark, d):
    eps = _episodes(spark, d)
    rows = episodes.predict_next(eps, episodes.transitions(eps))
    return rows.select("patient_id", "context", "next_type", r6("confidence").alias("confidence"), r6("gap_days").alias("gap_days"))


def sequences(spark, d):
    return sequence.sequences(point_events(spark, d)).select("patient_id", F.array_join("tokens", ",").alias("tokens"))


def frequent_patterns(spark, d):
    rows = sequence.mine_patterns(sequence.sequences(point_events(spark, d)), min_length=2, max_length=4, min_support=0.2)
    return rows.select(F.array_join("pattern", ">").alias("pattern"), "length", "n", r6("support").alias("support"))


def pattern_types(spark, d):
    rows = sequence.mine_patterns(sequence.sequences(point_events(spark, d)), min_length=2, max_length=4, min_support=0.2)
    return sequence.pattern_types(rows, "Pattern")


def _report(spark, d, **how):
    rule = cohort.Cohort(event_type="purchase", vals=[("value", ">", 100)], min_count=3, aggregate=("mean", "value", ">", 250))
    return rule.report(point_events(spark, d), **how)


def cohort_report(spark, d):
    return _report(spark, d)


def cohort_report_size(spark, d):
    return cohort.report_size(_report(spark, d, max_patients=100))


def role_patterns(spark, d):
    """Patterns of speaker roles over whole conversations."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    seqs = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("tokens"))
    rows = sequence.mine_patterns(seqs, min_length=2, max_length=3, min_support=0.05)
    return rows.select(F.array_join("pattern", ">").alias("pattern"), "length", "n", r6("support").alias("support"))


#: conversation := system? (user assistant)+ as a grammar in normal form
DIALOGUE = sequence.Grammar({"S": [("U", "A"), ("P", "S"), ("Y", "S")], "P": [("U", "A")], "U": [("user",)], "A": [("assistant",)], "Y": [("system",)]})


def cyk_parse(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    seqs = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("tokens"))
    return sequence.cyk(seqs, DIALOGUE).select("conv_id", "matches")


def beam_parse(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    seqs = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("tokens"))
    return sequence.cyk(seqs, DIALOGUE, beam=100).select("conv_id", "matches")


_BUY = f"SELECT patient_id FROM {E} WHERE event_type = 'purchase' AND value > 50 GROUP BY 1 HAVING count(*) >= 3 AND avg(value) > 60"
_ERR = f"SELECT patient_id FROM {E} WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2"
_PAIR = f"""(SELECT patient_id, a.event_id AS a_event_id, b.event_id AS b_event_id, a.t_start AS a, a.t_end AS b, b.t_start AS c, b.t_end AS d
  FROM {I} a JOIN {I} b USING (patient_id) WHERE a.event_type = '1-URGENT' AND b.event_type = '5-LOW')"""
_ALLEN = """CASE WHEN b < c THEN 'before' WHEN b = c THEN 'meets' WHEN a < c AND c < b AND b < d THEN 'overlaps' WHEN a = c AND b < d THEN 'starts'
  WHEN a > c AND b < d THEN 'during' WHEN b = d AND a > c THEN 'finishes' WHEN a = c AND b = d THEN 'equals' WHEN b = d AND a < c THEN 'finished_by'
  WHEN a < c AND b > d THEN 'contains' WHEN a = c AND b > d THEN 'started_by' WHEN c < a AND a < d AND d < b THEN 'overlapped_by' WHEN a = d THEN 'met_by' WHEN a > d THEN 'after' END"""


def _days(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 8.64e10"


def _numbered(source: str, delta: float) -> str:
    gap = _days("lag(t_end) OVER w", "t_start")
    return f"""(SELECT *, CAST(sum(f) OVER (PARTITION BY patient_id ORDER BY t_start, event_id) AS INTEGER) AS ep_index FROM
      (SELECT *, CASE WHEN {gap} > {delta} THEN 1 ELSE 0 END AS f FROM {source} WINDOW w AS (PARTITION BY patient_id ORDER BY t_start, event_id)))"""


_EP = f"""(SELECT patient_id, ep_index, min(b) AS t_begin, max(e) AS t_end, CAST(sum(n) AS BIGINT) AS n_events, string_agg(event_type, ',' ORDER BY event_type) AS event_types,
  first(event_type ORDER BY n DESC, event_type) AS dominant_type FROM (SELECT patient_id, ep_index, event_type, count(*) AS n, min(t_start) AS b, max(t_end) AS e FROM {_numbered(E, DELTA)} GROUP BY ALL) GROUP BY ALL)"""
_GAP = f"(SELECT *, greatest(0.0, {_days('lag(t_end) OVER w', 't_begin')}) AS g, lag(t_end) OVER w IS NULL AS first FROM {_EP} WINDOW w AS (PARTITION BY patient_id ORDER BY ep_index))"
_GAPS = f"(SELECT *, CASE WHEN NOT first THEN g END AS gap_days FROM {_GAP})"
_MARKOV = f"""(SELECT *, n / sum(n) OVER (PARTITION BY context) AS p FROM (SELECT context, dominant_type AS next_type, count(*) AS n, avg(gap_days) AS mean_gap_days
  FROM (SELECT *, lag(dominant_type) OVER (PARTITION BY patient_id ORDER BY ep_index) AS context FROM {_GAPS}) WHERE context IS NOT NULL GROUP BY ALL))"""


def _grams(seqs: str, low: int, high: int) -> str:
    return f"""(SELECT DISTINCT id, n, array_to_string(s[i:i + n - 1], '>') AS pattern FROM (SELECT id, s, n, unnest(range(1, len(s) - n + 2)) AS i FROM {seqs}, range({low}, {high + 1}) r(n) WHERE len(s) >= n))"""


_SEQ = f"(SELECT patient_id AS id, list(event_type ORDER BY t_start, event_id) AS s FROM {E} GROUP BY 1)"
_ROLES = "(SELECT conv_id AS id, list(role ORDER BY turn, role) AS s FROM conversations GROUP BY 1)"


def _patterns(seqs: str, low: int, high: int, support: float) -> str:
    total = f"(SELECT count(*) FROM {seqs})"
    return f"SELECT pattern, CAST(n AS INTEGER) AS length, count(*) AS n, round(count(*) / {total}, 6) AS support FROM {_grams(seqs, low, high)} g GROUP BY pattern, g.n HAVING count(*) >= {support} * {total} - 1e-9"


_REPORT = f"SELECT patient_id, count(*) FILTER (value > 100) AS n_events, count(*) FILTER (value > 100) >= 3 AND coalesce(avg(value) FILTER (value > 100) > 250, false) AS in_cohort FROM {E} WHERE event_type = 'purchase' GROUP BY 1"
SQL = {
    "cohort_purchase_mean": f"SELECT patient_id, count(*) AS n_events, round(avg(value), 6) AS mean_value FROM {E} WHERE event_type = 'purchase' AND value > 50 GROUP BY 1 HAVING count(*) >= 3 AND avg(value) > 60",
    "cohort_predicates": f"SELECT patient_id, count(*) AS n_events FROM {E} WHERE (event_type IN ('click', 'view') AND k <= 40) OR NOT value <> 100 OR k = 7 GROUP BY 1",
    "cohort_zero": f"SELECT patient_id, count(*) FILTER (event_type = 'purchase' AND value > 480) AS n_events FROM {E} GROUP BY 1",
    "cohort_aggregates": " UNION ALL ".join(
        f"SELECT '{fn}' AS fn, patient_id, count(*) AS n_events FROM {E} WHERE event_type = 'view' GROUP BY patient_id HAVING {agg}(value) {rule}" for fn, agg, rule in (("max", "max", ">= 480"), ("min", "min", "< 5"), ("count", "count", ">= 20"), ("mean", "avg", "<= 240"))
    ),
    "cohort_intersect": f"{_BUY} INTERSECT {_ERR}",
    "cohort_union": f"{_BUY} UNION {_ERR}",
    "cohort_difference": f"{_ERR} EXCEPT {_BUY}",
    "cohort_complement": f"SELECT DISTINCT patient_id FROM {E} EXCEPT {_BUY}",
    "followed_by": f"""SELECT patient_id, count(*) AS n_pairs FROM (SELECT *, min(CASE WHEN event_type = 'purchase' THEN t_start END) OVER (PARTITION BY patient_id ORDER BY t_start, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM {E})
      WHERE event_type = 'click' AND {_days('t_end', 'nx')} BETWEEN 0 AND 1 GROUP BY 1""",
    "allen_matrix": f"SELECT {_ALLEN} AS relation, count(*) AS n FROM {_PAIR} GROUP BY 1",
    "intervals_near": f"SELECT a_event_id, b_event_id, {_ALLEN} AS relation, round(greatest(0.0, {_days('b', 'c')}, {_days('d', 'a')}), 6) AS gap FROM {_PAIR} WHERE greatest(0.0, {_days('b', 'c')}, {_days('d', 'a')}) <= 10",
    "intervals_during": f"SELECT patient_id, relation, count(*) AS n FROM (SELECT patient_id, {_ALLEN} AS relation FROM {_PAIR}) WHERE relation IN ('during', 'contains') GROUP BY ALL",
    "pairs_before": f"SELECT patient_id, count(*) AS n FROM {_PAIR} WHERE b < c GROUP BY 1",
    "trel_fixed": f"SELECT event_id, patient_id FROM {I} WHERE t_start > TIMESTAMP '1996-06-01' AND t_end < TIMESTAMP '1996-12-31' AND abs({_days('t_start', chr(39).join(['TIMESTAMP ', '1996-06-01', '']))}) BETWEEN 10 AND 100",
    "distances": f"SELECT a_event_id, b_event_id, round(abs({_days('a', 'c')}), 6) AS delta_start, round(abs({_days('b', 'c')}), 6) AS delta_end_start, round(greatest(0.0, {_days('b', 'c')}, {_days('d', 'a')}), 6) AS delta_gap FROM {_PAIR}",
    "fuzzy_exact": f"SELECT {_ALLEN} AS relation, CAST(count(*) AS DOUBLE) AS total FROM {_PAIR} GROUP BY 1",
    "build_episodes": f"SELECT patient_id, ep_index, t_begin, t_end, n_events, event_types, dominant_type, round({_days('t_begin', 't_end')}, 6) AS duration_days FROM {_EP}",
    "episode_gaps": f"SELECT patient_id, ep_index, round(gap_days, 6) AS gap_days FROM {_GAPS}",
    "interval_episodes": f"SELECT patient_id, ep_index, min(t_start) AS t_begin, max(t_end) AS t_end, count(*) AS n_events FROM {_numbered(I, 30.0)} GROUP BY ALL",
    "trajectories": f"SELECT patient_id, count(*) AS n_episodes, string_agg(dominant_type, '>' ORDER BY ep_index) AS sequence, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE {_days('min(t_begin)', 'max(t_end)')} END, 6) AS total_days, round(avg(gap_days), 6) AS mean_gap_days FROM {_GAPS} GROUP BY 1",
    "trajectory_validation": f"SELECT patient_id, count(*) AS n_episodes, CASE WHEN count(*) < 23 THEN 'too_few_episodes' ELSE '' END AS violations, count(*) >= 23 AS valid FROM {_EP} GROUP BY 1",
    "delta_median": f"SELECT event_type, count(*) AS n_gaps, round(greatest(0.1, median(g)), 6) AS delta_days FROM (SELECT event_type, {_days('lag(t_start) OVER (PARTITION BY patient_id, event_type ORDER BY t_start, event_id)', 't_start')} AS g FROM {E}) WHERE g IS NOT NULL GROUP BY 1",
    "next_type_markov": f"SELECT context, next_type, n, round(p, 6) AS p, round(mean_gap_days, 6) AS mean_gap_days, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY p DESC, next_type) AS rank FROM {_MARKOV}) WHERE rank <= 3",
    "predict_next": f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY p DESC, next_type) AS rank FROM {_MARKOV}) WHERE rank = 1),
      l AS (SELECT patient_id, last(dominant_type ORDER BY ep_index) AS context FROM {_EP} GROUP BY 1)
      SELECT patient_id, context, coalesce(next_type, context) AS next_type, round(coalesce(p, 0.3), 6) AS confidence, round(coalesce(mean_gap_days, 30.0), 6) AS gap_days FROM l LEFT JOIN b USING (context)""",
    "sequences": f"SELECT patient_id, string_agg(event_type, ',' ORDER BY t_start, event_id) AS tokens FROM {E} GROUP BY 1",
    "frequent_patterns": _patterns(_SEQ, 2, 4, 0.2),
    "pattern_types": f"SELECT 'P_' || replace(pattern, '>', '_') AS name, 'Pattern' AS parent FROM ({_patterns(_SEQ, 2, 4, 0.2)})",
    "cohort_report": _REPORT,
    "cohort_report_size": f"SELECT count(*) FILTER (in_cohort) AS cohort_size, count(*) AS total_patients, CAST(sum(n_events) AS BIGINT) AS n_events FROM (SELECT * FROM ({_REPORT}) ORDER BY patient_id LIMIT 100)",
    "role_patterns": _patterns(_ROLES, 2, 3, 0.05),
    "cyk_parse": f"SELECT id AS conv_id, regexp_full_match(array_to_string(s, ' ') || ' ', '(system )*(user assistant (system )*)*user assistant ') AS matches FROM {_ROLES}",
    "beam_parse": f"SELECT id AS conv_id, regexp_full_match(array_to_string(s, ' ') || ' ', '(system )*(user assistant (system )*)*user assistant ') AS matches FROM {_ROLES}",
}
QUERIES = {name: globals()[name] for name in [*SQL, "fuzzy_distribution"]}
