"""Store, lookup, reference and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import audit, privacy, store, tables
from ..schema import interval_events, num, part_of, point_events, preceded_by
from .base import E, I, P, flat, r6, scratch

_DAY = "TIMESTAMP '2024-01-05 00:00:00'"


def _ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def all_ordered(spark, d):
    return point_events(spark, d).select("event_id", "patient_id", "event_type", "t_start").orderBy("t_start", "event_id")


def get_event(spark, d):
    return flat(point_events(spark, d).where(F.col("event_id") == "17"), "event_id", "patient_id", "event_type", "t_start")


def upsert_events(spark, d):
    events = point_events(spark, d)
    fixed = events.where("event_type = 'error'").withColumn("event_type", F.lit("fixed"))
    new = events.where("event_type = 'signup'").withColumn("event_id", F.concat(F.lit("n"), "event_id"))
    return flat(store.upsert(events, fixed.unionByName(new))[0], "event_id", "patient_id", "event_type")


def update_events(spark, d):
    events = point_events(spark, d)
    changes = events.where("event_type = 'error'").withColumn("event_type", F.lit("fixed"))
    unknown = changes.withColumn("event_id", F.concat(F.lit("n"), "event_id"))
    return flat(store.update(events, changes.unionByName(unknown)), "event_id", "event_type")


def delete_cascade(spark, d):
    events = point_events(spark, d)
    return store.delete(events, preceded_by(events), events.where("event_type = 'click'"))[1].select("event_id", "ref_id", "relation")


def event_count(spark, d):
    return point_events(spark, d).agg(F.count("*").alias("n"))


def find_by_patient(spark, d):
    found = store.by_patient(point_events(spark, d), "7", t_from=_ntz("2024-01-05 00:00:00"), t_to=_ntz("2024-01-20 00:00:00"), limit=20)
    return found.select("event_id", "event_type", "t_start")


def find_by_type(spark, d):
    return point_events(spark, d).where("event_type = 'purchase'").orderBy("t_start", "event_id").limit(500).select("event_id", "patient_id")


def window_overlap(spark, d):
    low, high = _ntz("1996-01-01 00:00:00"), _ntz("1996-03-31 00:00:00")
    return interval_events(spark, d).where(temporal.overlaps_window(F.col("t_start"), F.col("t_end"), low, high)).select("event_id", "patient_id", "t_start", "t_end")


def attribute_equals(spark, d):
    return point_events(spark, d).where(F.col("cat").getItem("k") == "42").select("event_id", "patient_id")


def embedded(spark, d):
    return interval_events(spark, d).groupBy("event_type").agg(F.count_if(temporal.is_embedded()).alias("embedded"), F.count("*").alias("n"))


def durations(spark, d):
    seconds = temporal.duration_seconds(F.col("t_start"), F.col("t_end"))
    strict = temporal.overlaps_strictly(F.col("t_start"), F.col("t_end"), F.col("stay_start"), F.col("stay_end"))
    return interval_events(spark, d).select("event_id", r6(seconds).alias("seconds"), strict.alias("in_stay"))


def relation_names(spark, d):
    names = [*store.INVERSE, "Bad", "has blank", "_ok1", "1st", ""]
    rows = spark.createDataFrame([(n,) for n in names], "relation string")
    return rows.select("relation", store.is_valid_relation(F.col("relation")).alias("valid"), store.inverse_of(F.col("relation")).alias("inverse"))


def patient_summary(spark, d):
    return store.patient_summary(point_events(spark, d))


def type_counts(spark, d):
    return store.type_counts(point_events(spark, d))


def top_types(spark, d):
    return store.type_counts(interval_events(spark, d)).limit(10)


def db_stats(spark, d):
    events = point_events(spark, d)
    return store.stats(events, preceded_by(events))


def first_per_patient(spark, d):
    return store.first_per_patient(point_events(spark, d), 5).select("event_id", "patient_id", "rank")


def refs_map(spark, d):
    events = interval_events(spark, d).select("event_id", "patient_id")
    rows = store.with_references(events, part_of(spark, d))
    return rows.select("event_id", F.array_join(F.transform(F.map_entries("references"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("refs"))


def inverse_refs(spark, d):
    events = point_events(spark, d)
    targets = events.where("event_type = 'purchase'").select(F.col("event_id").alias("ref_id"))
    return store.referenced_by(preceded_by(events), targets).select("event_id", "ref_id", store.inverse_of(F.col("relation")).alias("inverse"))


def refs_by_relation(spark, d):
    edges = preceded_by(point_events(spark, d)).unionByName(part_of(spark, d))
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("ref_id").alias("targets"))


def json_round_trip(spark, d):
    back = store.from_json(store.to_json(point_events(spark, d)))
    return back.select("event_id", "patient_id", "event_type", "t_start", r6(num("value")).alias("value"), num("k").cast("long").alias("k"))


def _audit(spark, d):
    rows = point_events(spark, d)
    return rows.select(F.col("event_id").cast("long").alias("audit_id"), F.col("t_start").alias("timestamp"), F.col("event_type").alias("action"), privacy.pseudonym(F.col("patient_id"), "salt").alias("patient_hash"), (num("value") >= 50).alias("success"))


def audit_query(spark, d):
    return store.audit_query(_audit(spark, d), action="error", success=False, since=_ntz("2024-01-05 00:00:00"), limit=200)


def audit_entries(spark, d):
    rows = point_events(spark, d).select(F.col("event_type").alias("action"), F.col("event_id").alias("resource_id"), F.when(F.col("event_type") != "error", F.col("patient_id")).alias("patient_id"), (num("value") >= 50).alias("success"))
    return audit.entries(rows, "salt").select("action", "user", "resource_id", "patient_hash", "success")


def audit_count(spark, d):
    return audit.count(_audit(spark, d))


def json_full_round_trip(spark, d):
    """Stays, text attributes and references of interval events through JSON."""
    back = store.from_json(store.to_json(store.with_references(interval_events(spark, d), part_of(spark, d))))
    refs = F.array_join(F.transform(F.map_entries("references"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return back.select("event_id", "patient_id", "event_type", "t_start", "t_end", "stay_start", "stay_end", r6(num("quantity")).alias("quantity"), F.col("cat").getItem("flag").alias("flag"), refs.alias("refs"))


def pseudonyms(spark, d):
    rows = point_events(spark, d).select("patient_id").distinct()
    return rows.select("patient_id", privacy.pseudonym(F.col("patient_id"), "salt").alias("pseudonym"))


def fingerprints(spark, d):
    rows = interval_events(spark, d).select(privacy.fingerprint(F.col("num")).alias("names"), privacy.safe_path(F.concat(F.lit("/a/b/"), "event_type")).alias("last"))
    return rows.groupBy("names", "last").agg(F.count("*").alias("n"))


_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in store.INVERSE.items())
def _table(spark, d):
    """The point events as a table on disk, a column ``note`` saying where a row is from."""
    path = scratch(spark, "events")
    rows = point_events(spark, d).select("event_id", "patient_id", "event_type", "t_start", F.lit("old").alias("note"))
    tables.create(rows, path, 16)
    return path, rows


def table_upsert(spark, d):
    """Every tenth event replaced, as many new ones added, then all read back from disk."""
    path, rows = _table(spark, d)
    tenth = rows.where("event_id % 10 = 0")
    changes = tenth.withColumn("event_type", F.lit("changed")).unionByName(tenth.withColumn("event_id", F.concat(F.lit("n"), "event_id")))
    tables.upsert(spark, path, changes.withColumn("note", F.lit("new")))
    return tables.read(spark, path)


def table_update(spark, d):
    """Changes for ids that exist and for some that do not; the latter leave no trace."""
    path, rows = _table(spark, d)
    tenth = rows.where("event_id % 10 = 3").withColumn("note", F.lit("updated"))
    tables.update(spark, path, tenth.unionByName(tenth.withColumn("event_id", F.concat(F.lit("n"), "event_id"))))
    return tables.read(spark, path)


def table_delete(spark, d):
    path, rows = _table(spark, d)
    tables.delete(spark, path, rows.where("event_type = 'click'").select("event_id"))
    return tables.read(spark, path)


def references_layouts(spark, d):
    """References of which one part was written before relations were kept, brought up to date and read."""
    path = scratch(spark, "refs")
    refs = preceded_by(point_events(spark, d)).select("event_id", "ref_id", "relation")
    refs.where("event_id % 2 = 0").select("event_id", "ref_id").write.parquet(f"{path}/batch=1")
    refs.where("event_id % 2 = 1").write.parquet(f"{path}/batch=2")
    tables.upgrade_references(spark, path)
    return tables.read_references(spark, path)


_NOTED = f"SELECT event_id, patient_id, event_type, t_start, 'old' AS note FROM {E}"
SQL = {
    "table_upsert": f"""SELECT event_id, patient_id, CASE WHEN CAST(event_id AS BIGINT) % 10 = 0 THEN 'changed' ELSE event_type END AS event_type, t_start, CASE WHEN CAST(event_id AS BIGINT) % 10 = 0 THEN 'new' ELSE 'old' END AS note FROM {E}
      UNION ALL SELECT 'n' || event_id, patient_id, event_type, t_start, 'new' FROM {E} WHERE CAST(event_id AS BIGINT) % 10 = 0""",
    "table_update": f"SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 10 = 3 THEN 'updated' ELSE note END AS note) FROM ({_NOTED})",
    "table_delete": f"SELECT * FROM ({_NOTED}) WHERE event_type <> 'click'",
    "references_layouts": f"SELECT event_id, ref_id, CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN 'references' ELSE relation END AS relation FROM {P}",
    "all_ordered": f"SELECT event_id, patient_id, event_type, t_start FROM {E} ORDER BY t_start, event_id",
    "get_event": f"SELECT event_id, patient_id, event_type, t_start, round(value, 6) AS value FROM {E} WHERE event_id = '17'",
    "upsert_events": f"SELECT event_id, patient_id, CASE event_type WHEN 'error' THEN 'fixed' ELSE event_type END AS event_type, round(value, 6) AS value FROM {E} UNION ALL SELECT 'n' || event_id, patient_id, event_type, round(value, 6) FROM {E} WHERE event_type = 'signup'",
    "update_events": f"SELECT event_id, CASE event_type WHEN 'error' THEN 'fixed' ELSE event_type END AS event_type, round(value, 6) AS value FROM {E}",
    "delete_cascade": f"SELECT p.event_id, p.ref_id, p.relation FROM {P} p JOIN {E} e ON p.event_id = e.event_id WHERE e.event_type <> 'click'",
    "event_count": "SELECT count(*) AS n FROM events",
    "find_by_patient": f"SELECT event_id, event_type, t_start FROM {E} WHERE patient_id = '7' AND t_start BETWEEN {_DAY} AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY t_start, event_id LIMIT 20",
    "find_by_type": f"SELECT event_id, patient_id FROM {E} WHERE event_type = 'purchase' ORDER BY t_start, event_id LIMIT 500",
    "window_overlap": f"SELECT event_id, patient_id, t_start, t_end FROM {I} WHERE t_end >= TIMESTAMP '1996-01-01 00:00:00' AND t_start <= TIMESTAMP '1996-03-31 00:00:00'",
    "attribute_equals": f"SELECT event_id, patient_id FROM {E} WHERE k = 42",
    "embedded": f"SELECT event_type, count(*) FILTER (stay_start <= t_start AND t_start <= t_end AND t_end <= stay_end) AS embedded, count(*) AS n FROM {I} GROUP BY 1",
    "durations": f"SELECT event_id, round((epoch_us(t_end) - epoch_us(t_start)) / 1e6, 6) AS seconds, t_start < stay_end AND stay_start < t_end AS in_stay FROM {I}",
    "relation_names": f"SELECT relation, regexp_matches(relation, '^[a-z_][a-z0-9_]*$') AS valid, coalesce(i, 'inverse_of_' || relation) AS inverse FROM (VALUES {_NAMES}, ('Bad', NULL), ('has blank', NULL), ('_ok1', NULL), ('1st', NULL), ('', NULL)) v(relation, i)",
    "patient_summary": f"SELECT patient_id, count(*) AS n_events, min(t_start) AS first, max(t_end) AS last FROM {E} GROUP BY 1",
    "type_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "top_types": f"SELECT event_type, count(*) AS n FROM {I} GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10",
    "db_stats": f"SELECT count(*) AS events, count(DISTINCT patient_id) AS patients, count(DISTINCT event_type) AS types, (SELECT count(*) FROM {P}) AS refs FROM {E}",
    "first_per_patient": f"SELECT event_id, patient_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY t_start, event_id) AS rank FROM {E}) WHERE rank <= 5",
    "refs_map": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id, concat(l_orderkey, '=part_of') AS refs FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "inverse_refs": f"SELECT p.event_id, p.ref_id, 'succeeded_by' AS inverse FROM {P} p JOIN {E} e ON p.ref_id = e.event_id WHERE e.event_type = 'purchase'",
    "refs_by_relation": f"SELECT relation, count(*) AS n, count(DISTINCT ref_id) AS targets FROM (SELECT ref_id, relation FROM {P} UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'part_of' FROM lineitem) GROUP BY 1",
    "json_round_trip": f"SELECT event_id, patient_id, event_type, t_start, round(value, 6) AS value, CAST(k AS BIGINT) AS k FROM {E}",
    "audit_query": f"SELECT CAST(event_id AS BIGINT) AS audit_id, t_start AS timestamp, event_type AS action, 'p#' || left(sha256('salt' || patient_id), 8) AS patient_hash, value >= 50 AS success FROM {E} WHERE event_type = 'error' AND value < 50 AND t_start >= {_DAY} ORDER BY audit_id DESC LIMIT 200",
    "audit_entries": f"SELECT event_type AS action, CAST(NULL AS VARCHAR) AS user, event_id AS resource_id, CASE WHEN event_type <> 'error' THEN 'p#' || left(sha256('salt' || patient_id), 8) END AS patient_hash, value >= 50 AS success FROM {E}",
    "audit_count": "SELECT count(*) AS n FROM events",
    "json_full_round_trip": f"SELECT event_id, patient_id, event_type, CAST(t_start AS TIMESTAMP) AS t_start, CAST(t_end AS TIMESTAMP) AS t_end, CAST(stay_start AS TIMESTAMP) AS stay_start, CAST(stay_end AS TIMESTAMP) AS stay_end, round(quantity, 6) AS quantity, flag, split_part(event_id, '-', 1) || '=part_of' AS refs FROM {I}",
    "pseudonyms": f"SELECT DISTINCT patient_id, 'p#' || left(sha256('salt' || patient_id), 8) AS pseudonym FROM {E}",
    "fingerprints": f"SELECT 'discount,price,quantity' AS names, event_type AS last, count(*) AS n FROM {I} GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in SQL}
