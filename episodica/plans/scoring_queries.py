"""Extraction, validation, anomaly, risk, rule and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..schema import num, point_events, table
from .base import E, r6

#: Ranges and weights for the attributes of the test tables.
RANGES = {"value": (50.0, 300.0), "k": (10.0, 60.0)}
WEIGHTS = {"value": 0.004, "k": -0.05, "n_ereignisse": 0.01, "n_diagnosen": -0.02}
KEYWORDS = {"licensed": ("License", "L1", 0.9), "password": ("Secret", "S1", 0.8), "the": ("English", "E1", 0.6)}
NUMBERS = {"token": ("Note", "token"), "version": ("Note", "version"), "by-nc": ("Note", "cc")}


def extract_conditions(spark, d):
    return scoring.extract_conditions(table(spark, d, "documents"), conditions=KEYWORDS)


def extract_values(spark, d):
    rows = scoring.extract_values(table(spark, d, "documents"), values=NUMBERS)
    return rows.select("doc_id", "event_type", "attr", r6("value").alias("value"), "confidence")


def _uncertain(spark, d):
    rows = point_events(spark, d).withColumn("confidence", 1 - num("k") / 100)
    return rows.withColumn("patient_id", F.when(num("k") == 3, F.lit(None)).otherwise(F.col("patient_id")))


def validation_report(spark, d):
    rows = scoring.validate(_uncertain(spark, d), c_min=0.5, required=["value"])
    return rows.select("event_id", F.array_join("violations", ",").alias("violations"), "accepted")


def confidence_summary(spark, d):
    return scoring.confidence_summary(_uncertain(spark, d), 0.9)


def anomaly_rolling(spark, d):
    rows = scoring.detect_anomalies(point_events(spark, d), ranges=RANGES, threshold=0.25)
    return rows.select("event_id", *[r6(c).alias(c) for c in ("ref_score", "z_score", "score", "certainty")])


def anomaly_summary(spark, d):
    rows = scoring.anomaly_summary(scoring.detect_anomalies(point_events(spark, d), ranges=RANGES, threshold=0.25))
    return rows.select("total", "anomalies", F.round("rate", 3).alias("rate"), F.round("mean_score", 3).alias("mean_score"))


def risk_score(spark, d):
    rows = scoring.risk(point_events(spark, d), weights=WEIGHTS, diagnosis="error")
    return rows.select("patient_id", F.round("score", 3).alias("score"), "level")


def _labels(spark, d):
    return point_events(spark, d).select("event_id", F.when(F.col("event_type").isin("click", "view"), "browse").otherwise("act").alias("label"))


def rule_candidates(spark, d):
    rows = scoring.learn_rules(point_events(spark, d), _labels(spark, d), ["value", "k"], min_support=0.1, min_confidence=0.3)
    return rows.select("label", "attr", "op", r6("threshold").alias("threshold"), *[r6(c).alias(c) for c in ("support", "confidence", "lift")])


def rule_predictions(spark, d):
    rules = [{"attr": "k", "op": ">", "threshold": 60.0, "label": "high"}, {"attr": "value", "op": "<=", "threshold": 100.0, "label": "low"}]
    return scoring.apply_rules(point_events(spark, d), rules).groupBy(F.coalesce("predicted", F.lit("none")).alias("predicted")).agg(F.count("*").alias("n"))


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (1 / (1 + F.exp(-(F.col("n_chars") / 2000.0 - 1)))).alias("p"))
    return docs.join(table(spark, d, "labels"), "doc_id")


def log_loss(spark, d):
    return scoring.log_loss(_scored(spark, d), "quality", "p").select(r6("loss").alias("loss"))


def f1_loss(spark, d):
    return scoring.f1_loss(_scored(spark, d), F.col("p") > 0.4, F.col("quality") == 1).select(r6("loss").alias("loss"))


def platt_calibration(spark, d):
    rows = _scored(spark, d)
    model = scoring.fit_platt(rows, "p", "quality")
    return rows.select("doc_id", r6(scoring.calibrate(F.col("p"), model)).alias("calibrated"))


def text_pipeline(spark, d):
    """Text to events, validated and weighed: extraction, validation and per-document summary in one plan."""
    docs = table(spark, d, "documents")
    found = scoring.extract_conditions(docs, conditions=KEYWORDS)
    events = found.select(F.col("doc_id").cast("string").alias("patient_id"), F.col("label").alias("event_type"), F.lit("2024-01-01").cast("timestamp_ntz").alias("t_start"), "confidence", F.create_map(F.lit("code"), F.col("code")).alias("cat"))
    rows = scoring.validate(events, c_min=0.7, required=["code"])
    return rows.groupBy("patient_id").agg(F.count("*").alias("n_events"), F.count_if("accepted").alias("n_accepted"), r6(F.max("confidence")).alias("best"))


def anomaly_reasons(spark, d):
    rows = scoring.detect_anomalies(point_events(spark, d), ranges=RANGES, threshold=0.25)
    return rows.select("event_id", F.array_join(F.transform("reasons", lambda r: r["attr"]), ",").alias("outside"))


def anomaly_calibrated(spark, d):
    rows = scoring.detect_anomalies(point_events(spark, d), ranges=RANGES, threshold=0.5, calibration=(4.0, -1.0))
    return rows.select("event_id", r6("score").alias("score"), r6("certainty").alias("certainty"))


def risk_labels(spark, d):
    return scoring.risk_labels(point_events(spark, d), weights=WEIGHTS, diagnosis="error")


LAYERS = {
    "ranges": {"token": (0.0, 5.0), "version": (1.0, 2.0)},
    "weights": {"token": 0.02, "version": 0.1, "n_ereignisse": 0.3, "n_diagnosen": -0.2},
    "rules": [{"attr": "token", "op": ">", "threshold": 3.0, "label": "many"}, {"attr": "version", "op": ">", "threshold": 1.5, "label": "new"}],
}


def layer_chain(spark, d):
    rows = scoring.layers(table(spark, d, "documents"), conditions=KEYWORDS, values=NUMBERS, c_min=0.7, threshold=0.3, **LAYERS)
    return rows.select("patient_id", "extracted", "accepted", "n_anomalies", F.round("risk_score", 3).alias("risk_score"), "risk_level", "prediction")


_UNSURE = f"(SELECT *, 1 - k / 100 AS confidence, CASE WHEN k = 3 THEN NULL ELSE patient_id END AS pid FROM {E})"
_KEYS = ", ".join(f"('{k}', '{a}', '{b}', {c}::DOUBLE)" for k, (a, b, c) in KEYWORDS.items())
_Z = """CASE WHEN count({a}) OVER w >= 3 AND stddev_pop({a}) OVER w > 1e-6 THEN abs({a} - avg({a}) OVER w) / stddev_pop({a}) OVER w END"""
_ANOMALY = f"""(SELECT event_id, ref AS ref_score, z AS z_score, 0.7 * ref + 0.3 * z AS score FROM (SELECT event_id,
  (least(1.0, greatest(50 - value, value - 300, 0) / 250) + least(1.0, greatest(10 - k, k - 60, 0) / 50)) / 2 AS ref,
  CASE WHEN z1 IS NULL AND z2 IS NULL THEN 0.0 ELSE least(1.0, (coalesce(z1, 0) + coalesce(z2, 0)) / ((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT) / 2.5) END AS z
  FROM (SELECT *, {_Z.format(a="value")} AS z1, {_Z.format(a="k")} AS z2 FROM {E} WINDOW w AS (PARTITION BY patient_id ORDER BY t_start, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))))"""
_NUM = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS event_type, '{a}' AS attr, regexp_extract(lower(text), '{k}\\s*[:\\s]\\s*(\\d+[.,]\\d+)', 1) AS raw FROM documents" for k, (kind, a) in NUMBERS.items())
_SCORED = "(SELECT p, quality FROM (SELECT doc_id, 1 / (1 + exp(-(n_chars / 2000.0 - 1))) AS p FROM documents) JOIN labels USING (doc_id))"

SQL = {
    "extract_conditions": f"SELECT doc_id, keyword, label, code, confidence FROM documents, (VALUES {_KEYS}) v(keyword, label, code, confidence) WHERE contains(lower(text), keyword)",
    "extract_values": f"SELECT doc_id, event_type, attr, round(CAST(replace(raw, ',', '.') AS DOUBLE), 6) AS value, CAST(0.9 AS DOUBLE) AS confidence FROM ({_NUM}) WHERE raw <> ''",
    "validation_report": f"SELECT event_id, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'confidence' END, CASE WHEN pid IS NULL THEN 'patient_id' END) AS violations, NOT (confidence < 0.5 OR pid IS NULL) AS accepted FROM {_UNSURE}",
    "confidence_summary": f"SELECT count(*) AS total, count(*) FILTER (confidence >= 0.9) AS accepted, round(count(*) FILTER (confidence >= 0.9) / count(*), 4) AS acceptance_rate FROM {_UNSURE}",
    "anomaly_rolling": f"SELECT event_id, round(ref_score, 6) AS ref_score, round(z_score, 6) AS z_score, round(score, 6) AS score, round(1 - abs(score - 0.25), 6) AS certainty FROM {_ANOMALY}",
    "anomaly_summary": f"SELECT count(*) AS total, count(*) FILTER (score >= 0.25) AS anomalies, round(round(count(*) FILTER (score >= 0.25) / count(*), 4), 3) AS rate, round(round(avg(score), 4), 3) AS mean_score FROM {_ANOMALY}",
    "risk_score": f"""SELECT patient_id, round(s, 3) AS score, CASE WHEN s > 0.6 THEN 'hoch' WHEN s > 0.3 THEN 'mittel' ELSE 'niedrig' END AS level FROM (SELECT patient_id,
      round(1 / (1 + exp(-(0.004 * avg(value) - 0.05 * avg(k) + 0.01 * count(*) - 0.02 * count(*) FILTER (event_type = 'error')))), 4) AS s FROM {E} GROUP BY 1)""",
    "rule_candidates": f"""WITH x AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'act' END AS label, value, k FROM {E}),
      u AS (SELECT label, 'value' AS attr, value AS x FROM x UNION ALL SELECT label, 'k', k FROM x),
      t AS (SELECT attr, x AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY attr) AS c FROM (SELECT DISTINCT attr, x FROM u)) WHERE c >= 2 AND r = c // 2),
      s AS (SELECT u.label, attr, threshold, CASE WHEN x > threshold THEN '>' ELSE '<=' END AS op FROM u JOIN t USING (attr)),
      o AS (SELECT label, attr, op, threshold, count(*) AS own FROM s GROUP BY ALL), g AS (SELECT *, sum(own) OVER (PARTITION BY attr, op) AS n FROM o),
      c AS (SELECT label, count(*) AS nl FROM x GROUP BY 1), b AS (SELECT label, nl, sum(nl) OVER () AS na FROM c)
      SELECT label, attr, op, round(threshold, 6) AS threshold, round(n / na, 6) AS support, round(own / n, 6) AS confidence, round(own / n / (nl / na), 6) AS lift FROM g JOIN b USING (label)
      WHERE n / na >= 0.1 AND own / n >= 0.3""",
    "rule_predictions": f"SELECT CASE WHEN k > 60 THEN 'high' WHEN value <= 100 THEN 'low' ELSE 'none' END AS predicted, count(*) AS n FROM {E} GROUP BY 1",
    "anomaly_reasons": f"SELECT event_id, concat_ws(',', CASE WHEN value < 50 OR value > 300 THEN 'value' END, CASE WHEN k < 10 OR k > 60 THEN 'k' END) AS outside FROM {E}",
    "anomaly_calibrated": f"SELECT event_id, round(c, 6) AS score, round(1 - abs(c - 0.5), 6) AS certainty FROM (SELECT event_id, 1 / (1 + exp(-(4 * score - 1))) AS c FROM {_ANOMALY})",
    "risk_labels": f"""SELECT event_id, CASE WHEN s > 0.6 THEN 'hoch' WHEN s > 0.3 THEN 'mittel' ELSE 'niedrig' END AS label FROM {E} JOIN (SELECT patient_id,
      round(1 / (1 + exp(-(0.004 * avg(value) - 0.05 * avg(k) + 0.01 * count(*) - 0.02 * count(*) FILTER (event_type = 'error')))), 4) AS s FROM {E} GROUP BY 1) USING (patient_id)""",
    "layer_chain": f"""WITH v AS (SELECT doc_id, event_type, attr, CAST(replace(raw, ',', '.') AS DOUBLE) AS x FROM ({_NUM}) WHERE raw <> ''),
      e AS (SELECT CAST(doc_id AS VARCHAR) AS patient_id, concat_ws(':', doc_id, 'c', keyword) AS event_id, CAST(NULL AS DOUBLE) AS token, CAST(NULL AS DOUBLE) AS version, 1 AS diagnosis, confidence FROM documents, (VALUES {_KEYS}) k(keyword, label, code, confidence) WHERE contains(lower(text), keyword)
        UNION ALL SELECT CAST(doc_id AS VARCHAR), concat_ws(':', doc_id, 'v', attr), CASE attr WHEN 'token' THEN x END, CASE attr WHEN 'version' THEN x END, 0, 0.9 FROM v),
      k AS (SELECT *, 0.7 * coalesce(least(1.0, greatest(-token, token - 5, 0) / 5), least(1.0, greatest(1 - version, version - 2, 0)), 0) AS score, CASE WHEN token > 3 THEN 'many' WHEN version > 1.5 THEN 'new' END AS label FROM e WHERE confidence >= 0.7),
      a AS (SELECT patient_id, count(*) FILTER (score >= 0.3) AS n_anomalies, (array_agg(label ORDER BY event_id))[1] AS prediction, round(1 / (1 + exp(-(0.02 * coalesce(avg(token), 0) + 0.1 * coalesce(avg(version), 0) + 0.3 * count(*) - 0.2 * sum(diagnosis)))), 4) AS s FROM k GROUP BY 1)
      SELECT patient_id, extracted, accepted, n_anomalies, round(s, 3) AS risk_score, CASE WHEN s > 0.6 THEN 'hoch' WHEN s > 0.3 THEN 'mittel' WHEN s IS NOT NULL THEN 'niedrig' END AS risk_level, prediction
      FROM (SELECT patient_id, count(*) AS extracted, count(*) FILTER (confidence >= 0.7) AS accepted FROM e GROUP BY 1) LEFT JOIN a USING (patient_id)""",
    "log_loss": f"SELECT round(avg(-(quality * ln(q) + (1 - quality) * ln(1 - q))), 6) AS loss FROM (SELECT quality, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM {_SCORED})",
    "f1_loss": f"SELECT round(1 - 2.0 * tp / (2.0 * tp + fp + fn), 6) AS loss FROM (SELECT count(*) FILTER (p > 0.4 AND quality = 1) AS tp, count(*) FILTER (p > 0.4 AND quality <> 1) AS fp, count(*) FILTER (p <= 0.4 AND quality = 1) AS fn FROM {_SCORED})",
    "text_pipeline": f"SELECT CAST(doc_id AS VARCHAR) AS patient_id, count(*) AS n_events, count(*) FILTER (confidence >= 0.7) AS n_accepted, round(max(confidence), 6) AS best FROM documents, (VALUES {_KEYS}) v(keyword, label, code, confidence) WHERE contains(lower(text), keyword) GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in [*SQL, "platt_calibration"]}
