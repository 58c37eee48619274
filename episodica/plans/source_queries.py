"""HL7 and FHIR import and export, and streaming queries, on messages rendered from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..schema import attrs, num, point_events, preceded_by, table, texts
from ..sources import fhir, hl7
from ..streaming import ingest
from .base import E, P, r6, scratch

_CODES = {"signup": "ADT^A01", "click": "ADT^A03", "view": "ORU^R01", "purchase": "ORU^R01", "error": "ADT^A99"}


def _messages(spark, d):
    """Raw text, one message per event, two messages a row: admissions, discharges and observations."""
    rows = table(spark, d, "events")
    code = F.create_map(*[F.lit(x) for p in _CODES.items() for x in p])[F.col("event_type")]
    at = F.date_format("ts", "yyyyMMddHHmmss")
    loinc = F.when(F.col("event_type") == "view", "8867-4^Heart rate").otherwise("2524-7^Lactate")
    lines = [
        F.concat(F.lit("MSH|^~\\&|APP|FAC|RX|RF|"), at, F.lit("||"), code, F.lit("|M"), "event_id", F.lit("|P|2.5")),
        F.concat(F.lit("EVN|x|"), at),
        F.concat(F.lit("PID|1||P"), "user_id", F.lit("^^^H")),
        F.when(F.col("event_type") == "click", F.lit("DG1|1||I21.0^Infarkt")),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("PV1|1|I|3A^12|||2B^1|44^Dr|||||||||||||||||||||||||||||||||||||"), at)),
        F.when(F.col("event_type").isin("view", "purchase"), F.concat(F.lit("OBX|1|NM|"), loinc, F.lit("||"), F.replace(F.col("value").cast("string"), F.lit("."), F.when(F.col("event_type") == "view", ".").otherwise(",")), F.lit("|u|0-9|N"))),
    ]
    return rows.select(F.concat(F.concat_ws("\r", *lines), F.lit("\r")).alias("raw"), "event_id")


def hl7_segments(spark, d):
    parsed = hl7.parse(hl7.split_messages(_messages(spark, d)))
    names = F.array_join(F.transform("segments", lambda s: F.get(s, F.lit(0))), ",")
    return parsed.select(hl7.field(hl7.segment("MSH"), 10).alias("control_id"), names.alias("segments"), hl7.field(hl7.segment("MSH"), 9).alias("kind"))


def hl7_events(spark, d):
    rows = hl7.to_events(hl7.parse(hl7.split_messages(_messages(spark, d))))
    return rows.select("control_id", "patient_id", "event_type", "t_start", "stay_start", "stay_end", r6("value").alias("value"), "loinc_code", "patient_class", "station")


def hl7_live_events(spark, d):
    rows = hl7.to_live_events(hl7.parse(hl7.split_messages(_messages(spark, d))))
    a = lambda k: F.col("attrs").getItem(k)
    return rows.select("control_id", "n", "patient_id", "event_type", "t_start", "confidence", a("attr").alias("attr"), r6(a("number").cast("double")).alias("number"), a("code").alias("code"), a("station").alias("station"))


#: Message kinds of the listener's other branches, dealt to events by their number.
_BRANCHES = ("ADT^A02", "ADT^A04", "ADT^A06", "ADT^A07", "ADT^A08", "ADT^A11", "ADT^A12", "ADT^A13", "ADT^A28", "ADT^A40", "ORM^O01", "OML^O21", "SIU^S12", "SIU^S15", "SIU^S14", "MDM^T02", "BAR^P01", "DFT^P03")


def _line(name: str, **fields):
    """A segment with the fields ``f<number>`` filled; numbers as in the standard."""
    last = max(int(k[1:]) for k in fields)
    return F.concat_ws("|", F.lit(name), *[fields.get(f"f{n}", F.lit("")) for n in range(1, last + 1)])


def hl7_live_branches(spark, d):
    """Transfers, registrations, cancellations, merges, orders, appointments, documents, diagnoses and charges."""
    rows = table(spark, d, "events")
    kind = F.get(F.array(*map(F.lit, _BRANCHES)), F.pmod("event_id", F.lit(len(_BRANCHES))).cast("int"))
    after = lambda hours: F.date_format(F.col("ts") + F.expr(f"INTERVAL {hours} HOUR"), "yyyyMMddHHmmss")
    of = lambda *kinds: kind.isin(*kinds)
    t = F.lit
    lines = [
        F.concat(t("MSH|^~\\&|APP|FAC|RX|RF|"), after(0), t("||"), kind, t("|M"), "event_id", t("|P|2.5")),
        _line("EVN", f1=t("x"), f2=after(0)),
        _line("PID", f1=t("1"), f3=F.concat(t("P"), "user_id", t("^^^H"))),
        F.when(F.startswith(kind, t("ADT")), _line("PV1", f1=t("1"), f2=t("I"), f3=t("3A^12"), f6=t("2B^1"), f7=t("44^Dr"))),
        F.when(F.startswith(kind, t("ADT")), _line("MRG", f1=F.concat(t("OLD"), "user_id", t("^^^H")))),
        F.when(of("ORM^O01", "OML^O21"), F.concat_ws("\r", _line("OBR", f1=t("1"), f4=t("718-7^Hb"), f7=after(1)), _line("OBR", f1=t("2"), f4=t("X1")))),
        F.when(F.startswith(kind, t("SIU")), _line("SCH", f1=t("1"), f7=t("Kontrolle^x"), f11=after(2))),
        F.when(of("MDM^T02"), F.concat_ws("\r", _line("OBX", f1=t("1"), f5=t("Befund eins")), _line("OBX", f1=t("2"), f5=t("")), _line("OBX", f1=t("3"), f5=t("zwei")))),
        F.when(of("BAR^P01"), F.concat_ws("\r", _line("DG1", f1=t("1"), f3=t("I21.0^Infarkt")), _line("DG1", f1=t("2"), f3=t("")), _line("PR1", f1=t("1"), f3=t("5-470^x"), f5=after(3)))),
        F.when(of("DFT^P03"), _line("FT1", f1=t("1"), f4=after(1), f19=t("C19^y"))),
    ]
    found = hl7.to_live_events(hl7.parse(hl7.split_messages(rows.select(F.concat_ws("\r", *lines).alias("raw")))))
    a = lambda k: F.col("attrs").getItem(k).alias(k)
    return found.select("control_id", "n", "patient_id", "event_type", "t_start", "confidence", *map(a, ("code", "text", "reason", "station", "station_from", "patient_class", "doctor", "prior_id")))


def hl7_event_times(spark, d):
    """Where a message's time comes from: each source in turn is missing, with all those before it."""
    rows = table(spark, d, "events").withColumn("b", F.pmod("event_id", F.lit(6)))
    at = lambda k: F.when(F.col("b") <= k, F.date_format(F.col("ts") + F.expr(f"INTERVAL {k} HOUR"), "yyyyMMddHHmmss")).otherwise("")
    t = F.lit
    lines = [
        F.concat(t("MSH|^~\\&|APP|FAC|RX|RF|"), at(4), t("||ADT^A08|M"), "event_id", t("|P|2.5")),
        _line("EVN", f1=t("x"), f2=at(0)),
        _line("PID", f1=t("1"), f3=F.concat(t("P"), "user_id")),
        _line("PV1", f1=t("1"), f2=t("I"), f44=at(1)),
        _line("OBR", f1=t("1"), f7=at(3)),
        _line("OBX", f1=t("1"), f14=at(2)),
    ]
    found = hl7.to_events(hl7.parse(hl7.split_messages(rows.select(F.concat_ws("\r", *lines).alias("raw")))))
    return found.select("control_id", "event_type", "t_start", "stay_start", "stay_end")


def hl7_acknowledgements(spark, d):
    parsed = hl7.parse(hl7.split_messages(_messages(spark, d)))
    return parsed.select(hl7.field(hl7.segment("MSH"), 10).alias("control_id"), hl7.acknowledgement(F.lit("AA")).alias("ack"))


def hl7_times(spark, d):
    """Partial times of 14 down to 4 digits, with fractions and zones."""
    texts = ["20240105083015.123+0100", "202401050830", "2024010508", "20240105", "202401", "2024", "", "x", "20241301"]
    return spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", hl7.timestamp(F.col("raw")).alias("t"))


def fhir_round_trip(spark, d):
    back = fhir.from_resources(fhir.to_resources(point_events(spark, d)))
    return back.select("event_id", "patient_id", "event_type", "t_start", "t_end", r6(num("value")).alias("value"), "confidence")


_ROLES = {"signup": "Diagnose", "click": "Medikation", "view": "Beobachtung", "purchase": "Prozedur", "error": "Alarm"}


def _clinical(spark, d):
    """Point events of four kinds of resources, with texts, doses and references."""
    events = point_events(spark, d)
    rows = store.with_references(events, preceded_by(events))
    kind = F.create_map(*[F.lit(x) for p in _ROLES.items() for x in p])[F.col("event_type")]
    dose = F.col("event_type") == "click"
    return rows.withColumns({
        "event_type": kind,
        "num": attrs(value=F.when(~dose, num("value")), dose=F.when(dose, num("value")), k=num("k")),
        "cat": texts(value=F.when(~dose, num("value")), dose=F.when(dose, num("value")), k=num("k"), unit=F.lit("mg"), route=F.when(dose, "oral"), severity=F.when(F.col("event_type") == "signup", "mild"), note=F.concat(F.lit('a "quoted" \\ note '), "event_type")),
    })


def _readable(rows):
    refs = F.array_join(F.transform(F.array_sort(F.map_entries("references")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    text = lambda a: F.col("cat").getItem(a).alias(a)
    return rows.select("event_id", "patient_id", "event_type", "t_start", "t_end", "stay_start", "stay_end", r6(num("value")).alias("value"), r6(num("dose")).alias("dose"), num("k").cast("long").alias("k"), *map(text, ("unit", "route", "severity", "note")), refs.alias("refs"), "confidence")


def fhir_clinical(spark, d):
    """Events of four kinds to resources and back, with all attributes, stays and references."""
    return _readable(fhir.from_resources(fhir.to_resources(_clinical(spark, d))))


def fhir_clinical_bundles(spark, d):
    events = _clinical(spark, d)
    return _readable(fhir.from_bundles(fhir.to_bundles(fhir.to_resources(events), events)))


def fhir_general(spark, d):
    """Resources as other systems write them: foreign codes, plain times, components, one kind that is skipped."""
    rows = table(spark, d, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    head = F.concat(F.lit('"id":"r'), "event_id", F.lit('","subject":{"reference":"urn:uuid:'), "user_id", F.lit('"},'))
    code = lambda c, t: F.lit(f'"code":{{"coding":[{{"system":"http://loinc.org","code":"{c}","display":"{t}"}}]}},')
    part = F.concat(F.lit('"component":[{"code":{"coding":[{"code":"8480-6","display":"systolic"}]},"valueQuantity":{"value":'), F.col("value").cast("string"), F.lit("}}]}"))
    body = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"resourceType":"Observation",'), head, code("85354-9", "Pressure"), F.lit('"effectiveDateTime":"'), at, F.lit('+02:00",'), part))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"resourceType":"Procedure",'), head, F.lit('"code":{"text":"Biopsy"},"performedPeriod":{"start":"'), at, F.lit('Z","end":"'), at, F.lit('Z"},"reason":[{"reference":{"reference":"Condition/c1"}}]}')))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"resourceType":"Device",'), head, F.lit('"x":1}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"resourceType":"Condition",'), head, F.lit('"severity":{"coding":[{"code":"255604002"}]},"onsetDateTime":"'), at, F.lit('"}')))
        .otherwise(F.lit("no json"))
    )
    found = fhir.from_resources(rows.select(body.alias("json")))
    return found.select("event_id", "patient_id", "event_type", "t_start", "t_end", r6(num("systolic")).alias("systolic"), F.col("cat").getItem("severity").alias("severity"), F.col("references").getItem("c1").alias("c1"))


def fhir_bundles(spark, d):
    events = point_events(spark, d)
    bundles = fhir.to_bundles(fhir.to_resources(events), events)
    return bundles.select("patient_id", F.size(F.from_json("bundle", fhir.BUNDLE)["entry"]).alias("entries"))


def _bundles(spark, d):
    rows = table(spark, d, "events")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    entry = lambda url, body: F.concat(F.lit('{"fullUrl":"urn:uuid:'), url, F.lit('","resource":'), F.to_json(body), F.lit("}"))
    subject = F.struct(F.concat(F.lit("urn:uuid:P"), "user_id").alias("reference"))
    coding = lambda code, system, text: F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"), F.lit(text).alias("display"))).alias("coding"))
    visit = F.when(F.col("value") > 250, F.struct(F.concat(F.lit("urn:uuid:enc-"), "user_id").alias("reference")))
    code = F.when(F.col("event_type") == "view", "8867-4").when(F.col("event_type") == "click", "27113001").otherwise("0")
    resource = F.struct(F.lit("Observation").alias("resourceType"), F.concat(F.lit("o"), "event_id").alias("id"), subject.alias("subject"), visit.alias("encounter"), coding(code, "http://x.example/codes", "d").alias("code"), iso("ts").alias("effectiveDateTime"), F.struct("value", F.lit("u").alias("unit")).alias("valueQuantity"))
    per = rows.groupBy("user_id").agg(F.min("ts").alias("b"), F.max("ts").alias("e"), F.array_join(F.collect_list(entry(F.concat(F.lit("o"), "event_id"), resource)), ",").alias("all"))
    period = F.struct(iso("b").alias("start"), iso("e").alias("end"))
    enc = F.struct(F.lit("Encounter").alias("resourceType"), F.concat(F.lit("enc-"), "user_id").alias("id"), subject.alias("subject"), F.array(coding(F.lit("50849002"), "http://snomed.info/sct", "er")).alias("type"), period.alias("period"))
    body = F.concat(F.lit('{"resourceType":"Bundle","entry":['), entry(F.concat(F.lit("enc-"), "user_id"), enc), F.lit(","), "all", F.lit("]}"))
    return per.select(F.col("user_id").cast("string").alias("file"), body.alias("bundle"))


def bundle_import(spark, d):
    rows = fhir.import_bundles(_bundles(spark, d))
    return rows.select("event_id", "patient_id", "event_type", "t_start", "stay_start", "stay_end", r6("value").alias("value"), "code")


def stream_ingest(spark, d):
    """Messages through a file stream: events of the good ones, dead letters for the rest, counted by type."""
    base = scratch(spark, "stream")
    bad = F.when(F.col("event_id") == 0, F.lit("MSH|bad\r")).otherwise(F.lit(""))
    _messages(spark, d).select(F.concat("raw", bad).alias("value")).write.option("maxRecordsPerFile", 50_000).text(f"{base}/in", lineSep="\r")
    query = ingest.ingest(ingest.message_stream(spark, f"{base}/in"), events_path=f"{base}/events", dead_path=f"{base}/dead", checkpoint=f"{base}/checkpoint")
    query.awaitTermination()
    found = spark.read.parquet(f"{base}/events").groupBy("event_type").agg(F.count("*").alias("n"))
    dead = spark.read.parquet(f"{base}/dead").groupBy(F.concat(F.lit("dead: "), "reason").alias("event_type")).agg(F.count("*").alias("n"))
    return found.unionByName(dead)


def stream_acknowledged(spark, d):
    """What one ingest writes to its four sinks, counted: events, dead letters, answers and audit entries."""
    base = scratch(spark, "stream")
    bad = F.when(F.col("event_id") == 0, F.lit("MSH|bad\r")).otherwise(F.lit(""))
    _messages(spark, d).select(F.concat("raw", bad).alias("value")).write.option("maxRecordsPerFile", 50_000).text(f"{base}/in", lineSep="\r")
    paths = {f"{k}_path": f"{base}/{k}" for k in ("events", "dead", "ack", "audit")}
    ingest.ingest(ingest.message_stream(spark, f"{base}/in"), **paths, checkpoint=f"{base}/checkpoint", salt="s").awaitTermination()
    kinds = {"events": F.lit("stored"), "dead": F.col("reason"), "ack": F.concat(F.lit("ACK "), F.regexp_extract("ack", r"ACK\^(\w+)", 1)), "audit": F.concat(F.lit("audit "), F.col("success").cast("string"))}
    out = None
    for k, kind in kinds.items():
        rows = spark.read.parquet(paths[f"{k}_path"]).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _out(stream, columns, mode="append"):
    """All rows that a bounded stream gives, by way of Parquet in the shared folder.

    In complete mode every batch replaces the one before it.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:
        query = writer.format("parquet").start(f"{base}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*columns)


def _event_stream(spark, d):
    """The event table as a file stream with the canonical columns."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return rows.select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("patient_id"), "event_type", F.col("ts").alias("t_start"), F.create_map(F.lit("value"), F.col("value")).alias("num"))


def stream_counts(spark, d):
    rows = _out(ingest.windowed_counts(_event_stream(spark, d), window="1 day"), ["start", "event_type", "n"], "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_z(spark, d):
    ingest.list_state(spark)
    rows = _out(ingest.streaming_z(_event_stream(spark, d), "value"), ["patient_id", "event_id", "z"])
    return rows.select("patient_id", "event_id", r6("z").alias("z"))


_AT = "date_trunc('second', ts)"
_KIND = "CASE event_type WHEN 'signup' THEN 'ADT^A01' WHEN 'click' THEN 'ADT^A03' WHEN 'error' THEN 'ADT^A99' ELSE 'ORU^R01' END"
_NAME = "CASE event_type WHEN 'signup' THEN 'Aufnahme' WHEN 'click' THEN 'Entlassung' WHEN 'error' THEN 'HL7_ADT_A99' WHEN 'view' THEN 'Herzfrequenz' ELSE 'HL7_ORU_R01' END"
_CLINICAL = f"""SELECT e.event_id, patient_id, CASE event_type WHEN 'signup' THEN 'Diagnose' WHEN 'click' THEN 'Medikation' WHEN 'view' THEN 'Beobachtung' WHEN 'purchase' THEN 'Prozedur' ELSE 'Alarm' END AS event_type, t_start, t_end, stay_start, stay_end,
  CASE WHEN event_type <> 'click' THEN round(value, 6) END AS value, CASE event_type WHEN 'click' THEN round(value, 6) END AS dose, CAST(k AS BIGINT) AS k, 'mg' AS unit, CASE event_type WHEN 'click' THEN 'oral' END AS route,
  CASE event_type WHEN 'signup' THEN 'mild' END AS severity, 'a "quoted" \\ note ' || event_type AS note, coalesce(ref_id || '=preceded_by', '') AS refs, CAST(1.0 AS DOUBLE) AS confidence FROM {E} e LEFT JOIN {P} p ON e.event_id = p.event_id"""
SQL = {
    "hl7_segments": f"SELECT 'M' || event_id AS control_id, 'MSH,EVN,PID' || CASE event_type WHEN 'click' THEN ',DG1' WHEN 'signup' THEN ',PV1' WHEN 'error' THEN '' ELSE ',OBX' END AS segments, {_KIND} AS kind FROM events",
    "hl7_events": f"""SELECT 'M' || event_id AS control_id, 'P' || user_id AS patient_id, {_NAME} AS event_type, {_AT} AS t_start,
      CASE event_type WHEN 'signup' THEN {_AT} ELSE {_AT} - INTERVAL 1 HOUR END AS stay_start, {_AT} + INTERVAL 1 HOUR AS stay_end, CASE event_type WHEN 'view' THEN round(value, 6) END AS value,
      CASE event_type WHEN 'view' THEN '8867-4' WHEN 'purchase' THEN '2524-7' END AS loinc_code, CASE event_type WHEN 'signup' THEN 'I' END AS patient_class, CASE event_type WHEN 'signup' THEN '3A' END AS station FROM events""",
    "hl7_live_events": f"""WITH e AS (SELECT 'M' || event_id AS control_id, 'P' || user_id AS patient_id, event_type AS k, {_AT} AS t_start, round(value, 6) AS v FROM events)
      SELECT control_id, 0 AS n, patient_id, CASE k WHEN 'signup' THEN 'Aufnahme' WHEN 'click' THEN 'Entlassung' WHEN 'error' THEN 'HL7Unbekannt' WHEN 'view' THEN 'Vitalzeichen' ELSE 'Laborbefund' END AS event_type, t_start,
        CAST(CASE WHEN k IN ('view', 'purchase') THEN 0.98 WHEN k = 'error' THEN 0.3 ELSE 1.0 END AS DOUBLE) AS confidence, CASE k WHEN 'view' THEN 'herzfrequenz' WHEN 'purchase' THEN 'qlaktat' END AS attr,
        CASE WHEN k IN ('view', 'purchase') THEN v END AS number, CAST(NULL AS VARCHAR) AS code, CASE k WHEN 'signup' THEN '3A' END AS station FROM e
      UNION ALL SELECT control_id, 1, patient_id, 'Entlassdiagnose', t_start, CAST(0.95 AS DOUBLE), NULL, NULL, 'I21.0', NULL FROM e WHERE k = 'click'""",
    "hl7_live_branches": f"""WITH e AS (SELECT 'M' || event_id AS control_id, 'P' || user_id AS patient_id, user_id, ({list(_BRANCHES)})[event_id % {len(_BRANCHES)} + 1] AS kind, {_AT} AS t FROM events),
      x AS (SELECT control_id, kind, unnest([0, 1, 2]) AS n, patient_id, user_id, t FROM e),
      y AS (SELECT *, kind[:3] AS k,
        CASE WHEN kind[:3] = 'ADT' THEN n = 0 WHEN kind[:3] IN ('ORM', 'OML') THEN n < 2 WHEN kind = 'BAR^P01' THEN n <> 1 ELSE n = 0 END AS there FROM x)
      SELECT control_id, n, patient_id, CASE WHEN k = 'ADT' THEN CASE kind[5:] WHEN 'A02' THEN 'Verlegung' WHEN 'A04' THEN 'Registrierung' WHEN 'A06' THEN 'StatusaenderungAmbulantStationaer' WHEN 'A07' THEN 'StatusaenderungStationaerAmbulant'
          WHEN 'A08' THEN 'PatientenUpdate' WHEN 'A11' THEN 'AufnahmeStornierung' WHEN 'A12' THEN 'VerlegungStornierung' WHEN 'A13' THEN 'EntlassungStornierung' WHEN 'A28' THEN 'PatientenAnlage' ELSE 'PatientenMerge' END
        WHEN k IN ('ORM', 'OML') THEN 'Auftrag' WHEN k = 'SIU' THEN CASE kind[5:] WHEN 'S12' THEN 'Termin' WHEN 'S15' THEN 'TerminStornierung' ELSE 'TerminAenderung' END WHEN k = 'MDM' THEN 'Dokument' WHEN k = 'BAR' AND n = 0 THEN 'Diagnose' ELSE 'Prozedur' END AS event_type,
        t + CASE WHEN k IN ('ORM', 'OML') AND n = 0 OR k = 'DFT' THEN INTERVAL 1 HOUR WHEN k = 'SIU' THEN INTERVAL 2 HOUR WHEN k = 'BAR' AND n = 2 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS t_start,
        CAST(CASE WHEN k IN ('ADT', 'SIU') THEN 1.0 WHEN k IN ('ORM', 'OML') THEN 0.95 WHEN k = 'MDM' THEN 0.9 ELSE 0.99 END AS DOUBLE) AS confidence,
        CASE WHEN k IN ('ORM', 'OML') THEN CASE n WHEN 0 THEN '718-7' ELSE 'X1' END WHEN k = 'BAR' THEN CASE n WHEN 0 THEN 'I21.0' ELSE '5-470' END WHEN k = 'DFT' THEN 'C19' END AS code,
        CASE WHEN k IN ('ORM', 'OML') AND n = 0 THEN 'Hb' WHEN k = 'BAR' AND n = 0 THEN 'Infarkt' WHEN k = 'MDM' THEN 'Befund eins' || chr(10) || 'zwei' END AS text,
        CASE k WHEN 'SIU' THEN 'Kontrolle' END AS reason, CASE k WHEN 'ADT' THEN '3A' END AS station, CASE kind WHEN 'ADT^A02' THEN '2B' END AS station_from, CASE k WHEN 'ADT' THEN 'I' END AS patient_class,
        CASE k WHEN 'ADT' THEN '44' END AS doctor, CASE kind WHEN 'ADT^A40' THEN 'OLD' || user_id END AS prior_id
      FROM y WHERE there""",
    "hl7_event_times": f"""SELECT 'M' || event_id AS control_id, 'Patienten_Update' AS event_type, t + to_hours(b) AS t_start,
        CASE WHEN b <= 1 THEN t + INTERVAL 1 HOUR ELSE t + to_hours(b) - INTERVAL 1 HOUR END AS stay_start,
        CASE WHEN b <= 1 THEN t + INTERVAL 2 HOUR ELSE t + to_hours(b) + INTERVAL 1 HOUR END AS stay_end
      FROM (SELECT event_id, event_id % 6 AS b, {_AT} AS t FROM events) WHERE b < 5""",
    "hl7_acknowledgements": f"""SELECT 'M' || event_id AS control_id, 'MSH|^~\\&|RX|RF|APP|FAC|' || strftime(ts, '%Y%m%d%H%M%S') || '||ACK^' || split_part({_KIND}, '^', 2) || '|ACKM' || event_id || '|P|2.5' || chr(13) || 'MSA|AA|M' || event_id || chr(13) AS ack FROM events""",
    "hl7_times": """SELECT * FROM (VALUES ('20240105083015.123+0100', TIMESTAMP '2024-01-05 08:30:15'), ('202401050830', TIMESTAMP '2024-01-05 08:30:00'), ('2024010508', TIMESTAMP '2024-01-05 08:00:00'), ('20240105', TIMESTAMP '2024-01-05'),
      ('202401', TIMESTAMP '2024-01-01'), ('2024', TIMESTAMP '2024-01-01'), ('', NULL), ('x', NULL), ('20241301', NULL)) v(raw, t)""",
    "fhir_round_trip": f"SELECT event_id, patient_id, event_type, t_start, t_end, round(value, 6) AS value, CAST(1.0 AS DOUBLE) AS confidence FROM {E}",
    "fhir_bundles": f"SELECT patient_id, CAST(count(*) AS INTEGER) AS entries FROM {E} GROUP BY 1",
    "fhir_clinical": _CLINICAL,
    "fhir_clinical_bundles": _CLINICAL,
    "fhir_general": """SELECT 'r' || event_id AS event_id, CAST(user_id AS VARCHAR) AS patient_id, CASE event_type WHEN 'view' THEN 'Pressure' WHEN 'click' THEN 'Biopsy' ELSE 'Condition' END AS event_type, t - CASE event_type WHEN 'view' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS t_start, t - CASE event_type WHEN 'view' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS t_end,
      CASE event_type WHEN 'view' THEN round(value, 6) END AS systolic, CASE event_type WHEN 'purchase' THEN '255604002' END AS severity, CASE event_type WHEN 'click' THEN 'response_to' END AS c1 FROM (SELECT *, date_trunc('second', ts) AS t FROM events) WHERE event_type IN ('view', 'click', 'purchase')""",
    "bundle_import": f"""WITH u AS (SELECT user_id, {_AT.replace('ts', 'min(ts)')} AS b, {_AT.replace('ts', 'max(ts)')} AS e FROM events GROUP BY 1)
      SELECT 'o' || event_id AS event_id, 'P' || user_id AS patient_id, CASE event_type WHEN 'view' THEN 'Herzfrequenz' WHEN 'click' THEN 'Körpergewicht' ELSE 'FHIR_Observation' END AS event_type, {_AT} AS t_start,
        CASE WHEN value > 250 THEN b ELSE {_AT} - INTERVAL 1 HOUR END AS stay_start, CASE WHEN value > 250 THEN e ELSE {_AT} + INTERVAL 1 HOUR END AS stay_end, round(value, 6) AS value,
        CASE event_type WHEN 'view' THEN '8867-4' WHEN 'click' THEN '27113001' ELSE '0' END AS code FROM events JOIN u USING (user_id)
      UNION ALL SELECT 'enc-' || user_id, 'P' || user_id, 'Notaufnahme', b, b, e, NULL, '50849002' FROM u""",
    "stream_ingest": f"SELECT {_NAME} AS event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'dead: unreadable', 1",
    "stream_acknowledged": f"""SELECT 'stored' AS kind, count(*) AS n FROM events UNION ALL SELECT 'unreadable', 1
      UNION ALL SELECT 'ACK ' || split_part({_KIND}, '^', 2), count(*) FROM events GROUP BY 1
      UNION ALL SELECT 'audit true', count(*) FROM events UNION ALL SELECT 'audit false', 1""",
    "stream_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_z": f"""SELECT patient_id, event_id, round(CASE WHEN count(value) OVER w >= 3 AND stddev_pop(value) OVER w > 1e-6 THEN abs(value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0.0 END, 6) AS z
      FROM {E} WINDOW w AS (PARTITION BY patient_id ORDER BY t_start, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""",
}
QUERIES = {name: globals()[name] for name in SQL}
