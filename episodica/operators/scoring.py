"""Text extraction, validation, anomaly and risk scores, rule learning and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import num
from .ranks import middle_distinct

#: Different scores that a calibration descends in the driver; more are summed by Spark at every step.
POINTS = 200_000

#: Reference ranges of the anomaly score.
RANGES = {
    "qlaktat": (0.5, 2.0),
    "kreatinin": (0.6, 1.2),
    "haemoglobin": (12.0, 17.5),
    "leukozyten": (4.0, 11.0),
    "crp": (0.0, 5.0),
    "troponin": (0.0, 14.0),
    "natrium": (135.0, 145.0),
    "kalium": (3.5, 5.0),
    "sofa_score": (0.0, 2.0),
    "apache_ii": (0.0, 10.0),
}
#: Weights of the risk score.
WEIGHTS = {"qlaktat": 0.15, "sofa_score": 0.12, "kreatinin": 0.08, "alter": 0.05, "n_diagnosen": 0.06, "n_ereignisse": 0.04, "crp": 0.05, "troponin": 0.10, "apache_ii": 0.08}
#: Keyword -> (label, code, confidence).
CONDITIONS = {
    "herzinsuffizienz": ("Herzinsuffizienz", "I50.0", 0.85),
    "herzinfarkt": ("Herzinfarkt", "I21.9", 0.85),
    "diabetes": ("DM Typ 2", "E11.9", 0.75),
    "pneumonie": ("Pneumonie", "J18.9", 0.80),
    "sepsis": ("Sepsis", "A41.9", 0.85),
    "nierenversagen": ("Nierenversagen", "N17.9", 0.80),
    "vorhofflimmern": ("Vorhofflimmern", "I48.9", 0.80),
    "schlaganfall": ("Schlaganfall", "I63.9", 0.85),
    "bluthochdruck": ("Bluthochdruck", "I10", 0.75),
    "copd": ("COPD", "J44.9", 0.80),
}
#: Text key -> (event type, attribute).
VALUES = {
    "laktat": ("Laborbefund", "qlaktat"),
    "kreatinin": ("Laborbefund", "kreatinin"),
    "haemoglobin": ("Laborbefund", "haemoglobin"),
    "leukozyten": ("Laborbefund", "leukozyten"),
    "crp": ("Laborbefund", "crp"),
    "troponin": ("Laborbefund", "troponin"),
    "procalcitonin": ("Laborbefund", "procalcitonin"),
    "natrium": ("Laborbefund", "natrium"),
    "kalium": ("Laborbefund", "kalium"),
    "sofa": ("Score", "sofa_score"),
    "apache": ("Score", "apache_ii"),
}
HISTORY, LEAST_VALUES, LEAST_SIGMA, Z_SCALE, REF_SHARE = 100, 3, 1e-6, 2.5, 0.7


def extract_conditions(docs: DataFrame, *, key: str = "doc_id", text: str = "text", conditions: dict = CONDITIONS) -> DataFrame:
    """One row per document and keyword found (substring, lower case): label, code, confidence."""
    known = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(v[0]).alias("label"), F.lit(v[1]).alias("code"), F.lit(v[2]).alias("confidence")) for k, v in conditions.items()])
    low = docs.select(F.col(key), F.lower(F.col(text)).alias("__t"))
    return low.select(key, F.explode(F.filter(known, lambda x: F.contains(F.col("__t"), x["keyword"]))).alias("x")).select(key, "x.*")


def extract_values(docs: DataFrame, *, key: str = "doc_id", text: str = "text", values: dict = VALUES) -> DataFrame:
    """First decimal value after each text key (comma or point; whole numbers do not count)."""
    low = docs.select(F.col(key), F.lower(F.col(text)).alias("__t"))
    found = [
        F.struct(F.lit(kind).alias("event_type"), F.lit(name).alias("attr"), F.nullif(F.regexp_extract("__t", rf"{k}\s*[:\s]\s*(\d+[.,]\d+)", 1), F.lit("")).alias("raw")) for k, (kind, name) in values.items()
    ]
    rows = low.select(key, F.explode(F.array(*found)).alias("x")).select(key, "x.*").where("raw IS NOT NULL")
    return rows.select(key, "event_type", "attr", F.replace("raw", F.lit(","), F.lit(".")).cast("double").alias("value"), F.lit(0.90).alias("confidence"))


def validate(events: DataFrame, *, c_min: float = 0.5, required: list[str] | None = None) -> DataFrame:
    """Events plus ``violations`` (array) and ``accepted``."""
    tests = [
        F.when(F.coalesce(F.col("confidence") < c_min, F.lit(True)), F.lit("confidence")),
        *[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in ("event_type", "t_start", "patient_id")],
        *[F.when(F.col("cat").getItem(a).isNull(), F.lit(f"missing:{a}")) for a in required or []],
    ]
    return events.withColumn("violations", F.array_compact(F.array(*tests))).withColumn("accepted", F.size("violations") == 0)


def confidence_summary(events: DataFrame, c_min: float = 0.9) -> DataFrame:
    held = F.count_if(F.col("confidence") >= c_min)
    return events.agg(F.count("*").alias("total"), held.alias("accepted"), F.bround(held / F.greatest(F.count("*"), F.lit(1)), 4).alias("acceptance_rate"))


def reference_score(ranges: dict = RANGES) -> Column:
    """Mean over the present attributes of min(1, distance from the range / its width); 0 if none is present."""
    far = [F.when(num(a).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(lo) - num(a), num(a) - F.lit(hi), F.lit(0.0)) / F.lit(hi - lo))) for a, (lo, hi) in ranges.items()]
    present = sum((x.isNotNull().cast("int") for x in far), F.lit(0))
    return F.when(present > 0, sum((F.coalesce(x, F.lit(0.0)) for x in far), F.lit(0.0)) / present).otherwise(0.0)


def z_score(names: list[str]) -> Column:
    """Mean |z| of the present attributes against the patient's last ``HISTORY`` events before, scaled, at most 1."""
    w = Window.partitionBy("patient_id").orderBy("t_start", "event_id").rowsBetween(-HISTORY, -1)
    zs = []
    for a in names:
        usable = (F.count(num(a)).over(w) >= LEAST_VALUES) & (F.stddev_pop(num(a)).over(w) > LEAST_SIGMA)
        zs.append(F.when(usable, F.abs(num(a) - F.avg(num(a)).over(w)) / F.stddev_pop(num(a)).over(w)))
    n = sum((z.isNotNull().cast("int") for z in zs), F.lit(0))
    return F.when(n > 0, F.least(F.lit(1.0), sum((F.coalesce(z, F.lit(0.0)) for z in zs), F.lit(0.0)) / n / Z_SCALE)).otherwise(0.0)


def reasons(ranges: dict = RANGES) -> Column:
    """The attributes outside their range, each with its value and the bounds, in the order of ``ranges``."""
    far = [F.when((num(a) < lo) | (num(a) > hi), F.struct(F.lit(a).alias("attr"), num(a).alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))) for a, (lo, hi) in ranges.items()]
    return F.array_compact(F.array(*far))


def detect_anomalies(events: DataFrame, *, ranges: dict = RANGES, threshold: float = 0.5, calibration: tuple[float, float] | None = None) -> DataFrame:
    """Events plus ref_score, z_score, score, anomaly, certainty and reasons: 0.7 reference range + 0.3 history.

    With ``calibration`` (of :func:`fit_platt`) the score is calibrated before it meets the threshold.
    """
    rows = events.withColumns({"ref_score": reference_score(ranges), "z_score": z_score(list(ranges)), "reasons": reasons(ranges)})
    rows = rows.withColumn("score", calibrate(REF_SHARE * F.col("ref_score") + (1 - REF_SHARE) * F.col("z_score"), calibration))
    return rows.withColumns({"anomaly": F.col("score") >= threshold, "certainty": 1 - F.abs(F.col("score") - threshold)})


def anomaly_summary(scored: DataFrame) -> DataFrame:
    hits = F.count_if("anomaly")
    return scored.agg(F.count("*").alias("total"), hits.alias("anomalies"), F.bround(hits / F.greatest(F.count("*"), F.lit(1)), 4).alias("rate"), F.bround(F.avg("score"), 4).alias("mean_score"))


def risk(events: DataFrame, *, weights: dict = WEIGHTS, diagnosis: str = "Diagnose") -> DataFrame:
    """Per patient: logistic score of mean attributes, event and diagnosis counts (which override attributes)."""
    counts = {"n_ereignisse": F.count("*"), "n_diagnosen": F.count_if(F.col("event_type") == diagnosis)}
    feature = lambda a: counts[a].cast("double") if a in counts else F.coalesce(F.avg(num(a)), F.lit(0.0))
    rows = events.groupBy("patient_id").agg(*[feature(a).alias(f"f_{k}") for k, a in enumerate(weights)])
    linear = sum((F.lit(w) * F.col(f"f_{k}") for k, w in enumerate(weights.values())), F.lit(0.0))
    score = F.bround(1 / (1 + F.exp(-linear)), 4)
    rows = rows.select("patient_id", score.alias("score"))
    return rows.withColumn("level", F.when(F.col("score") > 0.6, "hoch").when(F.col("score") > 0.3, "mittel").otherwise("niedrig"))


def risk_labels(events: DataFrame, *, weights: dict = WEIGHTS, diagnosis: str = "Diagnose") -> DataFrame:
    """``event_id, label``: every event with the risk level of its patient, as :func:`learn_rules` takes them."""
    levels = risk(events, weights=weights, diagnosis=diagnosis).select("patient_id", F.col("level").alias("label"))
    return events.select("event_id", "patient_id").join(levels, "patient_id").select("event_id", "label")


def extract_events(docs: DataFrame, *, key: str = "doc_id", text: str = "text", conditions: dict = CONDITIONS, values: dict = VALUES, diagnosis: str = "Diagnose") -> DataFrame:
    """Events of what the texts say; the document is the patient and its entry time the start of all.

    Without a column ``t_start`` all start at 1970, which leaves the order to the ids.
    """
    at = F.col("t_start") if "t_start" in docs.columns else F.lit("1970-01-01").cast("timestamp_ntz")
    times = docs.select(key, at.alias("t_start"))
    of = lambda mark, name, kind, number, texts: (F.concat_ws(":", F.col(key), F.lit(mark), name).alias("event_id"), F.col(key).cast("string").alias("patient_id"), kind.alias("event_type"), number.alias("num"), texts.alias("cat"), "confidence", key)
    said = extract_conditions(docs, key=key, text=text, conditions=conditions)
    said = said.select(*of("c", F.col("keyword"), F.lit(diagnosis), F.create_map().cast("map<string,double>"), F.create_map(F.lit("code"), "code", F.lit("label"), "label")))
    read = extract_values(docs, key=key, text=text, values=values)
    read = read.select(*of("v", F.col("attr"), F.col("event_type"), F.create_map("attr", "value"), F.create_map("attr", F.col("value").cast("string"))))
    both = said.unionByName(read)
    if "t_start" not in docs.columns:
        return both.drop(key).withColumn("t_start", at)
    return both.join(times, key).drop(key)


def layers(docs: DataFrame, *, key: str = "doc_id", text: str = "text", conditions: dict = CONDITIONS, values: dict = VALUES, ranges: dict = RANGES, weights: dict = WEIGHTS, rules: list = (), c_min: float = 0.5, threshold: float = 0.5, diagnosis: str = "Diagnose") -> DataFrame:
    """All layers over texts: extraction, validation, anomalies, risk and rules; one row per document with a finding.

    ``patient_id, extracted, accepted, n_anomalies, risk_score, risk_level, prediction``. The layers after
    the first see accepted events only; without any the rest is null. The rules judge a document's first event.
    """
    found = validate(extract_events(docs, key=key, text=text, conditions=conditions, values=values, diagnosis=diagnosis), c_min=c_min)
    counts = found.groupBy("patient_id").agg(F.count("*").alias("extracted"), F.count_if("accepted").alias("accepted"))
    kept = found.where("accepted")
    scored = apply_rules(detect_anomalies(kept, ranges=ranges, threshold=threshold), list(rules))
    scored = scored.groupBy("patient_id").agg(F.count_if("anomaly").alias("n_anomalies"), F.min_by("predicted", F.struct("t_start", "event_id")).alias("prediction"))
    level = risk(kept, weights=weights, diagnosis=diagnosis).select("patient_id", F.col("score").alias("risk_score"), F.col("level").alias("risk_level"))
    return counts.join(scored, "patient_id", "left").join(level, "patient_id", "left")


def log_loss(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    return rows.agg(F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("loss"))


def f1_loss(rows: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    both, only_p, only_t = (F.count_if(c) for c in (predicted & truth, predicted & ~truth, ~predicted & truth))
    return rows.agg((1 - F.coalesce(F.try_divide(2.0 * both, 2.0 * both + only_p + only_t), F.lit(0.0))).alias("loss"))


def learn_rules(events: DataFrame, labels: DataFrame, names: list[str], *, min_support: float = 0.05, min_confidence: float = 0.6, max_rules: int = 20) -> DataFrame:
    """Rules ``attr op threshold -> label``: label, attr, op, threshold, support, confidence, lift.

    ``labels`` has (event_id, label). An attribute's threshold is element floor(k/2) of its k >= 2
    sorted distinct values; support is the share of all events that meet ``attr op threshold``. All
    candidates are counted in one grouped pass over (attribute, label, side of the threshold).
    """
    labelled = events.join(labels.select("event_id", "label"), "event_id")
    rows = labelled.select("label", F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), num(a).alias("x")) for a in names])).alias("y"))
    rows = rows.select("label", "y.*").where("x IS NOT NULL")
    thresholds = middle_distinct(rows, "attr", "x").withColumnRenamed("x", "threshold")
    # One threshold for each of the given names, so this side is always tiny.
    sided = rows.join(F.broadcast(thresholds), "attr").withColumn("op", F.when(F.col("x") > F.col("threshold"), ">").otherwise("<="))
    counts = sided.groupBy("attr", "threshold", "op", "label").agg(F.count("*").alias("n_own"))
    sides = counts.groupBy("attr", "op").agg(F.sum("n_own").alias("n"))
    base = labelled.groupBy("label").agg(F.count("*").alias("n_label"))
    whole = base.agg(F.sum("n_label").alias("n_all"))
    out = counts.join(sides, ["attr", "op"]).join(base, "label").crossJoin(F.broadcast(whole))  # one row
    support, confidence = F.col("n") / F.col("n_all"), F.col("n_own") / F.col("n")
    out = out.select("label", "attr", "op", "threshold", support.alias("support"), confidence.alias("confidence"), (confidence / (F.col("n_label") / F.col("n_all"))).alias("lift"))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).orderBy(F.desc("lift"), "label", "attr", "op").limit(max_rules)


def apply_rules(events: DataFrame, rules: list) -> DataFrame:
    """Events plus ``predicted``: the label of the first rule whose antecedent holds, else null."""
    found = [F.when(num(r["attr"]) > r["threshold"] if r["op"] == ">" else num(r["attr"]) <= r["threshold"], F.lit(r["label"])) for r in rules]
    return events.withColumn("predicted", F.coalesce(*found) if found else F.lit(None).cast("string"))


def fit_platt(scored: DataFrame, score: str, label: str, *, steps: int = 500, rate: float = 0.1) -> tuple[float, float] | None:
    """Platt scaling sigma(A s + B) by gradient descent over all points; None below five points.

    Rows with a null are no points. Equal scores are summed first, which changes nothing in the gradient.
    Up to ``POINTS`` different scores are descended in the driver; of more, every step is one distributed
    sum over the table of scores.
    """
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    points = scored.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("s")).agg(F.count("*").alias("c"), F.sum(y).alias("pos")).persist()
    try:
        n, different = points.agg(F.sum("c"), F.count("*")).first()
        if (n or 0) < 5:
            return None
        near = np.array(points.collect(), dtype=float).T if different <= POINTS else None
        a, b = 1.0, 0.0
        for _ in range(steps):
            if near is not None:
                d = near[1] / (1 + np.exp(-np.clip(a * near[0] + b, -700, 700))) - near[2]
                g_a, g_b = float(d @ near[0]), float(d.sum())
            else:
                d = F.col("c") / (1 + F.exp(-(F.lit(a) * F.col("s") + F.lit(b)))) - F.col("pos")
                g_a, g_b = points.agg(F.sum(d * F.col("s")), F.sum(d)).first()
            a, b = a - rate * g_a / n, b - rate * g_b / n
        return a, b
    finally:
        points.unpersist()


def calibrate(score: Column, model: tuple[float, float] | None) -> Column:
    return score if model is None else 1 / (1 + F.exp(-(F.lit(model[0]) * score + F.lit(model[1]))))
