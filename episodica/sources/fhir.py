"""FHIR bundles: events to resources and back, and bundle import with encounters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files
from .hl7 import LOINC, _map

#: Codes of the bundle importer.
BUNDLE_LOINC = {k: LOINC[k] for k in ("8867-4", "8480-6", "8462-4", "8310-5", "29463-7", "8302-2", "39156-5", "2345-7", "2160-0", "718-7", "6690-2", "789-8", "777-3")}
SNOMED = {
    "184099003": "Geburtsdatum",
    "364075005": "Herzfrequenz",
    "271649006": "Blutdruck",
    "8462-4": "Blutdruck",
    "27113001": "Körpergewicht",
    "50373000": "Körpergröße",
    "386725007": "Körpertemperatur",
    "185345009": "Aufnahme",
    "185349003": "Routine_Untersuchung",
    "50849002": "Notaufnahme",
    "184516000": "Patientenkontakt",
}
RESOURCES = ("Observation", "Condition", "Procedure", "MedicationRequest", "MedicationAdministration", "Immunization")

_CODING = "array<struct<system:string,code:string,display:string>>"
_CONCEPT = f"struct<coding:{_CODING},text:string>"
_REF = "struct<reference:string>"
_PERIOD = "struct<start:string,end:string>"
RESOURCE = (
    f"struct<resourceType:string,id:string,status:string,subject:{_REF},patient:{_REF},encounter:{_REF},code:{_CONCEPT},medicationCodeableConcept:{_CONCEPT},vaccineCode:{_CONCEPT},severity:{_CONCEPT},"
    f"type:array<{_CONCEPT}>,effectiveDateTime:string,onsetDateTime:string,performedDateTime:string,authoredOn:string,occurrenceDateTime:string,issued:string,recordedDate:string,"
    f"effectivePeriod:{_PERIOD},performedPeriod:{_PERIOD},period:{_PERIOD},valueQuantity:struct<value:double,unit:string>,valueCodeableConcept:{_CONCEPT},valueString:string,valueBoolean:boolean>"
)
BUNDLE = f"struct<resourceType:string,entry:array<struct<fullUrl:string,resource:{RESOURCE}>>>"


def resource_type(event_type: Column) -> Column:
    """Substring hints, in order; else Observation."""
    low = F.lower(event_type)
    has = lambda *words: F.rlike(low, F.lit("|".join(words)))
    return F.when(has("diagnose", "diagnosis"), "Condition").when(has("beobachtung", "observation", "messung"), "Observation").when(has("medikation", "medication"), "MedicationAdministration").when(has("prozedur", "procedure"), "Procedure").otherwise("Observation")


def _iso(t: str) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def nearest_resource(closed: DataFrame, declared: DataFrame) -> DataFrame:
    """``event_type, resource``: what a type or else its nearest ancestor declares (``name, resource``)."""
    above = closed.join(declared.where("resource IS NOT NULL").select(F.col("name").alias("ancestor"), "resource"), "ancestor")
    return above.groupBy(F.col("name").alias("event_type")).agg(F.min_by("resource", F.struct("depth", "ancestor")).alias("resource"))


#: Own code system, and own extensions for what the resources have no field for.
SYSTEM, URL = "urn:episodica:type", "urn:episodica:"
_QUANTITY = "struct<value:double,unit:string,code:string>"
_LINK = "struct<reference:string,extension:array<struct<url:string,valueString:string>>>"
#: The parts of the four resources that become events.
SINGLE = (
    f"resourceType string, id string, subject {_REF}, patient {_REF}, code {_CONCEPT}, medication struct<concept:{_CONCEPT}>, medicationCodeableConcept {_CONCEPT}, severity {_CONCEPT}, "
    f"dosage struct<dose:{_QUANTITY},route:{_CONCEPT}>, effectiveDateTime string, onsetDateTime string, occurrenceDateTime string, performedDateTime string, recordedDate string, issued string, "
    f"effectivePeriod {_PERIOD}, onsetPeriod {_PERIOD}, occurrencePeriod {_PERIOD}, occurencePeriod {_PERIOD}, performedPeriod {_PERIOD}, valueQuantity {_QUANTITY}, valueString string, valueBoolean boolean, "
    f"valueCodeableConcept {_CONCEPT}, component array<struct<code:{_CONCEPT},valueQuantity:{_QUANTITY}>>, derivedFrom array<{_LINK}>, evidence array<struct<reference:{_LINK}>>, reason array<struct<reference:{_LINK}>>, "
    f"extension array<struct<url:string,valueString:string,valueDecimal:double,valuePeriod:{_PERIOD}>>"
)
#: What a reference means where the resource does not say.
MEANS = {"Observation": "observation_of", "Condition": "confirms"}


def to_resources(events: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """``event_id, resource_type, json``: one resource per event.

    ``resources`` (see :func:`nearest_resource`) names the resource of some types; the others go by hints in
    their names. Value, unit, dose, route and severity have fields of their own, other numbers of an
    observation are components; stay, confidence and the rest are extensions. References (a map column
    ``references``) become links with their relation.
    """
    have = set(events.columns)
    if resources is not None:
        events = events.join(resources.select("event_type", F.col("resource").alias("__resource")), "event_type", "left")
    kind = resource_type(F.col("event_type")) if resources is None else F.coalesce("__resource", resource_type(F.col("event_type")))
    is_a = lambda *names: kind.isin(*names)
    when = lambda name, c: F.when(kind == name, c)
    concept = lambda c: F.struct(F.array(F.struct(F.lit(SYSTEM).alias("system"), c.alias("code"), c.alias("display"))).alias("coding"), c.alias("text"))
    number, no_text = lambda a: F.col("num").getItem(a), F.lit(None).cast("string")
    text = lambda a: F.col("cat").getItem(a) if "cat" in have else no_text
    quantity = lambda c: F.struct(c.alias("value"), text("unit").alias("unit"))

    def extension(name, string=None, decimal=None, period=None):
        empty = F.lit(None).cast(_PERIOD)
        return F.struct(F.concat(F.lit(URL), name).alias("url"), (no_text if string is None else string).alias("valueString"), (F.lit(None).cast("double") if decimal is None else decimal).alias("valueDecimal"), (empty if period is None else period).alias("valuePeriod"))

    period = F.struct(_iso("t_start").alias("start"), _iso("t_end").alias("end"))
    extra = [F.array(extension(F.lit("confidence"), decimal=F.col("confidence").cast("double")))]
    if {"stay_start", "stay_end"} <= have:
        extra.append(F.array(extension(F.lit("stay"), period=F.struct(_iso("stay_start").alias("start"), _iso("stay_end").alias("end")))))
    others = F.map_filter("num", lambda k, v: v.isNotNull() & ~(is_a("Observation") | (is_a("MedicationAdministration") & (k == "dose"))))
    extra.append(F.transform(F.map_entries(others), lambda e: extension(F.concat(F.lit("number:"), e["key"]), decimal=e["value"])))
    if "cat" in have:
        own = (is_a("Observation") & number("value").isNotNull() | is_a("MedicationAdministration") & number("dose").isNotNull(), "unit"), (is_a("MedicationAdministration") & number("dose").isNotNull(), "route"), (is_a("Condition"), "severity")
        placed = lambda k: F.coalesce((own[0][0] & (k == "unit")) | (own[1][0] & (k == "route")) | (own[2][0] & (k == "severity")), F.lit(False))
        left = F.map_filter("cat", lambda k, v: v.isNotNull() & F.col("num").getItem(k).isNull() & ~placed(k))
        extra.append(F.transform(F.map_entries(left), lambda e: extension(F.concat(F.lit("text:"), e["key"]), string=e["value"])))
    components = F.filter(F.map_entries("num"), lambda e: (e["key"] != "value") & e["value"].isNotNull())
    components = F.transform(components, lambda e: F.struct(concept(e["key"]).alias("code"), F.struct(e["value"].alias("value")).alias("valueQuantity")))
    links = []
    if "references" in have:
        link = lambda e: F.struct(F.concat(F.lit("Event/"), e["key"]).alias("reference"), F.array(F.struct(F.lit(f"{URL}relation").alias("url"), e["value"].alias("valueString"))).alias("extension"))
        named = F.transform(F.map_entries("references"), link)
        named = F.when(F.size(named) > 0, named)
        wrapped = F.transform(named, lambda x: F.struct(x.alias("reference")))
        links = [when("Observation", named).alias("derivedFrom"), when("Condition", wrapped).alias("evidence"), F.when(~is_a("Observation", "Condition"), wrapped).alias("reason")]
    one = lambda c: F.when(c.isNotNull(), F.struct(F.array(F.struct(c.alias("code"))).alias("coding")))
    body = F.struct(
        kind.alias("resourceType"),
        F.col("event_id").alias("id"),
        F.when(~is_a("Condition"), F.when(is_a("Observation"), "final").otherwise("completed")).alias("status"),
        F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("subject"),
        F.when(~is_a("MedicationAdministration"), concept(F.col("event_type"))).alias("code"),
        when("MedicationAdministration", F.struct(concept(F.col("event_type")).alias("concept"))).alias("medication"),
        when("Condition", one(text("severity"))).alias("severity"),
        F.when(is_a("MedicationAdministration") & number("dose").isNotNull(), F.struct(quantity(number("dose")).alias("dose"), one(text("route")).alias("route"))).alias("dosage"),
        when("Condition", _iso("t_start")).alias("onsetDateTime"),
        when("Observation", period).alias("effectivePeriod"),
        F.when(is_a("MedicationAdministration", "Procedure"), period).alias("occurrencePeriod"),
        F.when(is_a("Observation") & number("value").isNotNull(), quantity(number("value"))).alias("valueQuantity"),
        F.when(is_a("Observation") & (F.size(components) > 0), components).alias("component"),
        *links,
        F.concat(*extra).alias("extension"),
    )
    return events.select("event_id", kind.alias("resource_type"), F.to_json(body).alias("json"))


def _time(text: Column) -> Column:
    """ISO time in UTC: an offset is applied; a time without one is UTC already."""
    zone = F.regexp_extract(text, r"T.*?(Z|[+-]\d{2}:?\d{2})$", 1)
    plain = F.try_to_timestamp(F.replace(F.left(text, F.length(text) - F.length(zone)), F.lit("T"), F.lit(" "))).cast("timestamp_ntz")
    digits = F.regexp_replace(zone, ":", "")
    minutes = F.substring(digits, 2, 2).cast("int") * 60 + F.substring(digits, 4, 2).cast("int")
    signed = F.when(F.startswith(digits, F.lit("-")), minutes).otherwise(-minutes)
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.length(digits) == 5, signed).otherwise(0))
    return F.when(text.isNotNull(), plain + shift)


def _last_of_each(entries: Column) -> Column:
    """Entries (key, value) without those that a later one of the same key replaces, or without a key or value."""
    known = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return F.get(F.transform(F.array(known), lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["key"] == e["key"])))), F.lit(0))


def from_resources(rows: DataFrame) -> DataFrame:
    """Events from the JSON of observations, conditions, procedures and medication administrations.

    The type is the code of the own system, else the first display or code, else the resource's name. What is
    no such resource, or has no patient, gives no row. A condition ends at its onset; an own period gives both
    ends, and without a stay the event is its own stay.
    """
    # The generator keeps the parse out of the expressions below, which would repeat it.
    x = rows.select(F.explode(F.array(F.from_json("json", SINGLE))).alias("x")).select("x.*")
    x = x.where(F.col("resourceType").isin("Observation", "Condition", "Procedure", "MedicationAdministration") & F.col("id").isNotNull())
    code = F.coalesce("code", "medication.concept", "medicationCodeableConcept")
    first = F.get(code["coding"], F.lit(0))
    own = F.get(F.filter(code["coding"], lambda c: c["system"] == SYSTEM), F.lit(0))["code"]
    start = F.coalesce("effectivePeriod.start", "onsetPeriod.start", "occurrencePeriod.start", "occurencePeriod.start", "performedPeriod.start", "effectiveDateTime", "onsetDateTime", "occurrenceDateTime", "performedDateTime", "issued", "recordedDate")
    end = F.coalesce("effectivePeriod.end", "onsetPeriod.end", "occurrencePeriod.end", "occurencePeriod.end", "performedPeriod.end", start)
    named = lambda mark: F.filter(F.coalesce("extension", F.array().cast(x.schema["extension"].dataType)), lambda e: e["url"].startswith(URL + mark))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    after = lambda e, mark: F.substring(e["url"], len(URL + mark) + 1, 10_000)
    part = lambda c: F.coalesce(F.get(F.filter(c["code"]["coding"], lambda k: k["system"] == SYSTEM), F.lit(0))["code"], F.get(c["code"]["coding"], F.lit(0))["display"], F.get(c["code"]["coding"], F.lit(0))["code"], c["code"]["text"])
    parts = F.transform("component", lambda c: entry(part(c), c["valueQuantity"]["value"]))
    numbers = F.concat(
        F.array(entry(F.lit("value"), F.col("valueQuantity.value")), entry(F.lit("dose"), F.col("dosage.dose.value"))),
        F.coalesce(parts, F.array().cast("array<struct<key:string,value:double>>")),
        F.transform(named("number:"), lambda e: entry(after(e, "number:"), e["valueDecimal"])),
    )
    told = F.coalesce(F.get("valueCodeableConcept.coding", F.lit(0))["display"], "valueString", F.col("valueBoolean").cast("string"))
    unit = F.coalesce("valueQuantity.unit", "valueQuantity.code", "dosage.dose.unit")
    texts = F.concat(
        F.array(entry(F.lit("value"), told), entry(F.lit("unit"), unit), entry(F.lit("route"), F.get("dosage.route.coding", F.lit(0))["code"]), entry(F.lit("severity"), F.get("severity.coding", F.lit(0))["code"])),
        F.transform(named("text:"), lambda e: entry(after(e, "text:"), e["valueString"])),
    )
    links = F.coalesce("derivedFrom", F.transform("evidence", lambda r: r["reference"]), F.transform("reason", lambda r: r["reference"]))
    meant = F.coalesce(*[F.when(F.col("resourceType") == k, v) for k, v in MEANS.items()], F.lit("response_to"))
    told_by = lambda r: F.get(F.filter(r["extension"], lambda e: e["url"] == f"{URL}relation"), F.lit(0))["valueString"]
    links = F.transform(links, lambda r: entry(F.element_at(F.split(r["reference"], "/", 2), -1), F.coalesce(told_by(r), meant)))
    stay = F.get(named("stay"), F.lit(0))["valuePeriod"]
    found = x.select(
        F.col("id").alias("event_id"),
        F.regexp_replace(F.coalesce("subject.reference", "patient.reference"), "^(Patient/|urn:uuid:)", "").alias("patient_id"),
        F.coalesce(own, first["display"], first["code"], code["text"], "resourceType").alias("event_type"),
        _time(start).alias("t_start"),
        _time(end).alias("t_end"),
        F.coalesce(_time(stay["start"]), _time(start)).alias("stay_start"),
        F.coalesce(_time(stay["end"]), _time(end)).alias("stay_end"),
        _last_of_each(numbers).alias("num"),
        _last_of_each(texts).alias("texts"),
        F.coalesce(_last_of_each(links), F.create_map().cast("map<string,string>")).alias("references"),
        F.coalesce(F.get(named("confidence"), F.lit(0))["valueDecimal"], F.lit(1.0)).alias("confidence"),
    )
    # Every attribute as text: the numbers, and the texts that are no number's name.
    plain = F.map_filter("texts", lambda k, v: F.col("num").getItem(k).isNull())
    cat = F.map_concat(F.transform_values("num", lambda k, v: v.cast("string")), plain)
    return found.where("patient_id IS NOT NULL").withColumn("cat", cat).drop("texts")


def from_bundles(bundles: DataFrame) -> DataFrame:
    """Events of all entries of the bundles that :func:`from_resources` reads; others are skipped."""
    entries = F.from_json("bundle", "entry array<struct<resource:string>>")["entry"]
    return from_resources(bundles.select(F.explode(entries).alias("x")).select(F.col("x.resource").alias("json")))


def to_bundles(resources: DataFrame, by: DataFrame) -> DataFrame:
    """``patient_id, bundle``: a collection bundle per patient; ``by`` has (event_id, patient_id)."""
    rows = resources.join(by.select("event_id", "patient_id"), "event_id")
    entries = F.array_sort(F.collect_list(F.struct("event_id", "json")))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('{"resource":'), e["json"], F.lit("}"))), ",")
    return rows.groupBy("patient_id").agg(F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), joined, F.lit("]}")).alias("bundle"))


def write_bundles(bundles: DataFrame, path: str) -> None:
    """Write ``bundle`` as text files of one bundle a line; a folder that is there already is an error.

    JSON texts hold no line break outside of strings, and none inside of them.
    """
    bundles.select(F.regexp_replace("bundle", "[\r\n]+", " ").alias("value")).write.text(path)


def read_bundles(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """``file, bundle``: a bundle per file, or with ``lines`` one per line, as :func:`write_bundles` leaves them."""
    if lines:
        rows = spark.read.text(path).where(F.trim("value") != "")
        at = F.concat(F.input_file_name(), F.lit("#"), F.monotonically_increasing_id().cast("string"))
        return rows.select(at.alias("file"), F.col("value").alias("bundle"))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("bundle"))


def import_directory(spark: SparkSession, path: str, *, pattern: str = "*.json", limit: int | None = None, code_map: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of the bundles in ``path``, the first ``limit`` files by name, and the files that are none.

    A file that is no JSON object, or no bundle, is set aside as ``file, reason``; it counts towards the limit.
    """
    files = read_files(spark, path, pattern, limit)
    kind = F.try_variant_get(F.try_parse_json("raw"), "$.resourceType", "string")
    reason = F.when(F.try_parse_json("raw").isNull(), "no json").when(~kind.eqNullSafe(F.lit("Bundle")), "no bundle")
    good = files.where(reason.isNull()).select("file", F.col("raw").alias("bundle"))
    return import_bundles(good, code_map=code_map), files.where(reason.isNotNull()).select("file", reason.alias("reason"))


def import_bundles(bundles: DataFrame, *, code_map: dict | None = None, include_encounters: bool = True, key: str = "file") -> DataFrame:
    """Events of FHIR bundles: stays come from the encounter that a resource names (by id or full URL).

    Resources and encounters of one bundle meet by a left join on (bundle, reference). Unreadable
    bundles give no rows; resources without a time or patient are dropped.
    """
    entries = bundles.select(key, F.explode(F.from_json("bundle", BUNDLE)["entry"]).alias("x")).select(key, F.col("x.fullUrl").alias("url"), "x.resource.*")
    entries = entries.withColumn("patient_id", F.element_at(F.split(F.coalesce("subject.reference", "patient.reference"), "[/:]"), -1))
    visits = entries.where("resourceType = 'Encounter'")
    start, end = _time(F.col("period.start")), _time(F.col("period.end"))
    own = visits.select(key, F.array_distinct(F.array_compact(F.array("id", F.element_at(F.split("url", "[/:]"), -1)))).alias("names"), start.alias("stay_start"), F.coalesce(end, start + F.expr("INTERVAL 1 HOUR")).alias("stay_end"))
    own = own.select(key, F.explode("names").alias("ref"), "stay_start", "stay_end").dropDuplicates([key, "ref"])

    at = F.coalesce(*[_time(F.col(c)) for c in ("effectiveDateTime", "onsetDateTime", "performedDateTime", "authoredOn", "occurrenceDateTime", "issued", "recordedDate", "effectivePeriod.start", "performedPeriod.start", "period.start")])
    coding = F.get(F.coalesce("code.coding", "medicationCodeableConcept.coding", "vaccineCode.coding"), F.lit(0))
    hour = F.expr("INTERVAL 1 HOUR")
    found = entries.where(F.col("resourceType").isin(*RESOURCES)).withColumn("ref", F.element_at(F.split("encounter.reference", "[/:]"), -1))
    text = F.coalesce(F.col("valueBoolean").cast("string"), "valueString", F.get("valueCodeableConcept.coding", F.lit(0))["display"])
    found = found.join(own, [key, "ref"], "left").select(
        F.col("id").alias("event_id"), "patient_id", _lookup(coding, F.col("resourceType"), code_map).alias("event_type"), at.alias("t_start"), at.alias("t_end"),
        F.coalesce("stay_start", at - hour).alias("stay_start"), F.coalesce("stay_end", at + hour).alias("stay_end"),
        F.col("valueQuantity.value").alias("value"), F.col("valueQuantity.unit").alias("unit"), text.alias("text"), coding["code"].alias("code"), coding["display"].alias("display"), "status",
        F.coalesce(F.get("severity.coding", F.lit(0))["display"], "severity.text").alias("severity"),
    )
    if include_encounters:
        first = F.get(F.flatten(F.transform("type", lambda t: t["coding"])), F.lit(0))
        kind = F.coalesce(_lookup(first, F.lit(None).cast("string"), code_map), F.lit("Aufnahme"))
        nothing = F.lit(None).cast("string")
        found = found.unionByName(
            visits.select(
                F.col("id").alias("event_id"), "patient_id", kind.alias("event_type"), start.alias("t_start"), (start + F.expr("INTERVAL 1 MINUTE")).alias("t_end"), start.alias("stay_start"), F.coalesce(end, start + hour).alias("stay_end"),
                F.lit(None).cast("double").alias("value"), nothing.alias("unit"), nothing.alias("text"), first["code"].alias("code"), first["display"].alias("display"), "status", nothing.alias("severity"),
            )
        )
    return found.where("patient_id IS NOT NULL AND t_start IS NOT NULL")


def _lookup(coding: Column, kind: Column, code_map: dict | None) -> Column:
    """Own map, then the system's map, then LOINC, then SNOMED, else FHIR_<type>."""
    code, system = coding["code"], F.lower(F.coalesce(coding["system"], F.lit("")))
    own = [_map(code_map)[code]] if code_map else []
    loinc, snomed = _map(BUNDLE_LOINC)[code], _map(SNOMED)[code]
    hinted = F.when(F.contains(system, F.lit("loinc")), loinc).when(F.contains(system, F.lit("snomed")), snomed)
    return F.coalesce(*own, hinted, loinc, snomed, F.concat(F.lit("FHIR_"), kind))
