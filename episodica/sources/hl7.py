"""HL7 v2 text as DataFrames: split, parse, map to events, acknowledge.

Everything is string and array expressions on a column of raw text, so a directory of messages is parsed
where it is read. A message is an array of segments, a segment an array of fields (MSH-1, the field
separator, included), so field n of any segment is element n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import read_files

#: Admission triggers.
ADT = {
    "A01": "Aufnahme",
    "A02": "Verlegung",
    "A03": "Entlassung",
    "A04": "Ambulanz_Registrierung",
    "A05": "Voraufnahme",
    "A06": "Stationaer_Wechsel",
    "A07": "Ambulant_Wechsel",
    "A08": "Patienten_Update",
    "A11": "Aufnahme_Storno",
    "A12": "Verlegung_Storno",
    "A13": "Entlassung_Storno",
}
#: Observation codes.
LOINC = {
    "8867-4": "Herzfrequenz",
    "8480-6": "Blutdruck_systolisch",
    "8462-4": "Blutdruck_diastolisch",
    "8310-5": "Körpertemperatur",
    "29463-7": "Körpergewicht",
    "8302-2": "Körpergröße",
    "39156-5": "BMI",
    "2345-7": "Glucose",
    "2160-0": "Kreatinin",
    "718-7": "Hämoglobin",
    "6690-2": "Leukozyten",
    "789-8": "Erythrozyten",
    "777-3": "Thrombozyten",
    "2951-2": "Natrium",
    "2823-3": "Kalium",
    "2075-0": "Chlorid",
    "1742-6": "ALT",
    "1920-8": "AST",
}
#: Live listener, code -> attribute; and the vital signs.
ATTRIBUTES = {
    "2524-7": "qlaktat",
    "2160-0": "kreatinin",
    "718-7": "haemoglobin",
    "6690-2": "leukozyten",
    "1988-5": "crp",
    "10839-9": "troponin",
    "33959-8": "procalcitonin",
    "2951-2": "natrium",
    "2823-3": "kalium",
    "59408-5": "spo2",
    "8867-4": "herzfrequenz",
    "8480-6": "blutdruck_systolisch",
    "8462-4": "blutdruck_diastolisch",
    "8310-5": "koerpertemperatur",
    "29463-7": "koerpergewicht",
    "8302-2": "koerpergroesse",
}
VITALS = ("59408-5", "8867-4", "8480-6", "8462-4", "8310-5", "29463-7", "8302-2")
#: Live listener, event types of admission triggers, scheduling and cancellation.
LIVE = {
    "A01": "Aufnahme",
    "A02": "Verlegung",
    "A03": "Entlassung",
    "A04": "Registrierung",
    "A06": "StatusaenderungAmbulantStationaer",
    "A07": "StatusaenderungStationaerAmbulant",
    "A08": "PatientenUpdate",
    "A11": "AufnahmeStornierung",
    "A12": "VerlegungStornierung",
    "A13": "EntlassungStornierung",
    "A28": "PatientenAnlage",
    "A40": "PatientenMerge",
}


#: Where a message's time is looked for, in order.
TIMES = (("EVN", 2), ("PV1", 44), ("OBX", 14), ("OBR", 7), ("MSH", 7))
FIELD, COMPONENT = "\x01", "\x02"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, raw``: whole files of a directory or pattern."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))


def import_directory(spark: SparkSession, path: str, *, pattern: str = "*.hl7", limit: int | None = None, code_map: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of the files in ``path``, the first ``limit`` by name, and the files that give none.

    Events have ``file`` and ``nth``, their place in the file by time (ties as in the file). A file without a message,
    or none that has a patient and a time, is set aside as ``file, reason``; it counts towards the limit.
    """
    files = read_files(spark, path, pattern, limit)
    found = to_events(parse(split_messages(files)), code_map, keep=("file",))
    order = Window.partitionBy("file").orderBy("t_start", "control_id")
    events = found.withColumn("nth", F.row_number().over(order) - 1)
    some = F.size(F.filter(F.split(F.regexp_replace("raw", "[\\x0B\\x1C]", ""), "[\r\n]+"), lambda s: F.startswith(s, F.lit("MSH")))) > 0
    dead = files.join(found.select("file").distinct(), "file", "left_anti")
    return events, dead.select("file", F.when(some, "no patient or time").otherwise("no message").alias("reason"))


def _newlines(text: Column) -> Column:
    """Every kind of line end (\\r\\n, \\r, \\n) as \\n."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_messages(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per message: text is cut before every line that starts with MSH; MLLP frames are dropped."""
    framed = F.contains(F.col(raw), F.lit("\x0B")) | F.contains(F.col(raw), F.lit("\x1C"))
    text = _newlines(F.when(framed, F.regexp_replace(raw, "[\\x0B\\x1C]", "")).otherwise(F.col(raw)))
    # The pattern is only asked where there is another MSH than the first.
    parts = F.when(F.locate("MSH", F.col(raw), 2) > 0, F.split(text, r"(?m)(?=^MSH)")).when(F.col(raw).isNotNull(), F.array(text))
    parts = F.filter(parts, lambda m: F.startswith(m, F.lit("MSH")))
    return rows.withColumn("message", F.explode(F.transform(parts, lambda m: F.rtrim(m)))).drop(raw)


def parse(rows: DataFrame, message: str = "message") -> DataFrame:
    """Plus ``segments array<array<string>>`` and ``comp``, the component separator; unreadable: null.

    A message's own separators are first turned into fixed ones, so that splitting needs no pattern
    per row; components stay marked by ``COMPONENT`` until :func:`field` takes them apart.
    """
    text = _newlines(F.col(message))
    sep, comp = F.substring(text, 4, 1), F.substring(text, 5, 1)
    fixed = F.replace(F.replace(text, sep, F.lit(FIELD)), comp, F.lit(COMPONENT))
    fixed = F.when(comp == FIELD, F.call_function("translate", text, F.concat(sep, comp), F.lit(FIELD + COMPONENT))).otherwise(fixed)
    lines = F.filter(F.split(fixed, "\n"), lambda s: F.length(F.trim(s)) > 0)

    def fields(s: Column) -> Column:
        # MSH-1 is the separator itself.
        return F.when(F.startswith(s, F.lit("MSH")), F.array_insert(F.split(s, FIELD), 2, sep)).otherwise(F.split(s, FIELD))

    good = F.startswith(text, F.lit("MSH")) & (F.length(F.substring_index(text, "\n", 1)) > 8)
    return once(rows, "*", F.when(good, F.transform(lines, fields)).alias("segments"), comp.alias("comp"))


def once(rows: DataFrame, *cols) -> DataFrame:
    """``select`` whose expressions are computed once a row, however often later columns use them.

    Plain projections are merged, and an expression is then repeated for every use; a generator is not.
    """
    names = rows.select(*cols).columns
    return rows.select(F.explode(F.array(F.struct(*cols))).alias("__once")).select(*[F.col("__once").getField(c).alias(c) for c in names])


def segment(name: str) -> Column:
    """The first segment of that name, null if there is none."""
    return F.get(F.filter("segments", lambda s: F.get(s, F.lit(0)) == name), F.lit(0))


def all_segments(name: str) -> Column:
    return F.filter("segments", lambda s: F.get(s, F.lit(0)) == name)


def field(seg: Column, n: int, comp: int | None = None) -> Column:
    """Field ``n`` (component ``comp``, from 1), null if empty or absent."""
    x = F.get(seg, F.lit(n))
    x = F.replace(x, F.lit(COMPONENT), F.col("comp")) if comp is None else F.split_part(x, F.lit(COMPONENT), F.lit(comp))
    return F.nullif(F.trim(x), F.lit(""))


def timestamp(x: Column) -> Column:
    """Times of 14, 12, 10, 8, 6 or 4 digits; fractions and zones are dropped."""
    d = F.nullif(F.regexp_extract(x, r"^((?:\d\d){2,7})", 1), F.lit(""))
    padded = F.concat(d, F.substring(F.lit("00000101000000"), F.length(d) + 1, F.lit(14)))
    return F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def patient() -> Column:
    return field(segment("PID"), 3, 1)


def kind() -> Column:
    return field(segment("MSH"), 9, 1)


def trigger() -> Column:
    return field(segment("MSH"), 9, 2)


def fields(messages: DataFrame, keep: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """One row per parsed message: ``keep``, ``more`` (of columns named like the segments) and what events are made of.

    An unreadable message has none of those fields.
    """
    # Segments, then fields, then times are columns of their own, so that each is computed once.
    names = ("MSH", "EVN", "PID", "PV1", "OBR", "OBX")
    rows = once(messages, *keep, "comp", *[segment(s).alias(s) for s in names])
    seg = lambda s, n, comp=None: field(F.col(s), n, comp)
    rows = once(
        rows,
        *keep,
        *[c.alias(k) for k, c in more.items()],
        seg("MSH", 10).alias("control_id"),
        seg("PID", 3, 1).alias("patient_id"),
        seg("MSH", 9, 1).alias("kind"),
        seg("MSH", 9, 2).alias("trigger"),
        seg("OBX", 5).alias("value"),
        seg("OBX", 6, 1).alias("unit"),
        seg("OBX", 3, 1).alias("loinc_code"),
        seg("OBX", 3, 2).alias("loinc_display"),
        seg("PV1", 2).alias("patient_class"),
        seg("PV1", 3, 1).alias("station"),
        *[timestamp(seg(s, n)).alias(f"t{k}") for k, (s, n) in enumerate(TIMES)],
        timestamp(seg("PV1", 45)).alias("left"),
    )
    times = [f"t{k}" for k in range(len(TIMES))]
    return rows.withColumns({"t_start": F.coalesce(*times), "admitted": F.col("t1")}).drop(*times)


def to_events(messages: DataFrame, code_map: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One event per parsed message, with the columns ``keep``; messages without patient or time are dropped."""
    return events(fields(messages.where("segments IS NOT NULL"), keep), code_map, keep)


def events(rows: DataFrame, code_map: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events of :func:`to_events` from the ``fields`` of messages."""
    is_adt, is_oru = F.col("kind") == "ADT", F.col("kind") == "ORU"
    own = _map(code_map)[F.when(is_adt, F.col("trigger")).when(is_oru, F.col("loinc_code"))] if code_map else F.lit(None).cast("string")
    default = F.when(is_adt, _map(ADT)[F.col("trigger")]).when(is_oru, _map(LOINC)[F.col("loinc_code")])
    hour = F.expr("INTERVAL 1 HOUR")
    return rows.where("patient_id IS NOT NULL AND t_start IS NOT NULL").select(
        *keep,
        "control_id",
        "patient_id",
        F.coalesce(own, default, F.concat_ws("_", F.lit("HL7"), "kind", "trigger")).alias("event_type"),
        "t_start",
        F.coalesce("admitted", F.col("t_start") - hour).alias("stay_start"),
        F.coalesce("left", F.coalesce("admitted", "t_start") + hour).alias("stay_end"),
        F.col("value").try_cast("double").alias("value"),
        "unit",
        "loinc_code",
        "loinc_display",
        "patient_class",
        "station",
        F.col("t_start").alias("t_end"),
    )


def to_live_events(messages: DataFrame) -> DataFrame:
    """The listener's richer mapping: one row per event, several per message.

    ``control_id, patient_id, event_type, t_start, confidence, attrs``. Triggers are compared exactly; a
    missing patient is UNKNOWN; unknown messages give HL7Unbekannt with confidence 0.3.
    """
    at, kind, trigger = F.col("__at"), F.col("__kind"), F.col("__trigger")
    none = F.array().cast("array<struct<event_type:string,confidence:double,t_start:timestamp_ntz,attrs:map<string,string>>>")

    def event(name: Column, confidence: float, time: Column = at, **attrs: Column) -> Column:
        held = F.map_filter(F.create_map(*[x for k, c in attrs.items() for x in (F.lit(k), c)]), lambda k, v: v.isNotNull()) if attrs else F.create_map().cast("map<string,string>")
        return F.struct(name.cast("string").alias("event_type"), F.lit(confidence).alias("confidence"), F.coalesce(time, at).alias("t_start"), held.alias("attrs"))

    def each(name: str, make) -> Column:
        return F.transform(all_segments(name), make)

    pv1, sch, mrg = F.col("PV1"), F.col("SCH"), F.col("MRG")
    adt = event(
        _map(LIVE)[trigger], 1.0, station=field(pv1, 3, 1), station_from=F.when(trigger == "A02", field(pv1, 6, 1)), patient_class=field(pv1, 2), doctor=field(pv1, 7, 1), prior_id=F.when(trigger == "A40", field(mrg, 1, 1))
    )
    diagnosis = lambda label, c: each("DG1", lambda s: event(F.when(field(s, 3, 1).isNotNull(), F.lit(label)), c, code=field(s, 3, 1), text=field(s, 3, 2)))
    observed = each(
        "OBX",
        lambda s: event(
            F.when(field(s, 3, 1).isin(*VITALS), "Vitalzeichen").otherwise("Laborbefund"),
            0.98,
            timestamp(field(s, 14)),
            loinc_code=field(s, 3, 1),
            loinc_name=F.coalesce(field(s, 3, 2), field(s, 3)),
            obs_value=field(s, 5),
            obs_unit=field(s, 6),
            ref_range=field(s, 7),
            obs_flag=field(s, 8),
            attr=_map(ATTRIBUTES)[field(s, 3, 1)],
            number=F.replace(field(s, 5), F.lit(","), F.lit(".")).try_cast("double").cast("string"),
        ),
    )
    orders = each("OBR", lambda s: event(F.lit("Auftrag"), 0.95, timestamp(field(s, 7)), code=field(s, 4, 1), text=field(s, 4, 2)))
    dates = F.array(event(F.when(trigger == "S12", "Termin").when(trigger == "S15", "TerminStornierung").otherwise("TerminAenderung"), 1.0, timestamp(field(sch, 11)), reason=field(sch, 7, 1)))
    document = F.array(event(F.lit("Dokument"), 0.90, text=F.left(F.array_join(F.array_compact(each("OBX", lambda s: field(s, 5))), "\n"), F.lit(2000))))
    procedures = each("PR1", lambda s: event(F.lit("Prozedur"), 0.99, timestamp(field(s, 5)), code=field(s, 3, 1)))
    charges = each("FT1", lambda s: event(F.lit("Prozedur"), 0.99, timestamp(field(s, 4)), code=field(s, 19, 1)))
    known = _map(LIVE)[trigger].isNotNull()
    found = (
        F.when((kind == "ADT") & known, F.concat(F.array(adt), F.when(trigger == "A03", diagnosis("Entlassdiagnose", 0.95)).otherwise(none)))
        .when(kind == "ORU", observed)
        .when(kind.isin("ORM", "OML"), orders)
        .when(kind == "SIU", dates)
        .when(kind == "MDM", document)
        .when(kind == "BAR", F.concat(diagnosis("Diagnose", 0.99), procedures))
        .when(kind == "DFT", charges)
        .otherwise(F.array(event(F.lit("HL7Unbekannt"), 0.3, message=F.concat_ws("^", kind, trigger))))
    )
    # Segments, then what is asked of every message, are columns of their own, so that each is computed once.
    names = ("MSH", "EVN", "PID", "PV1", "SCH", "MRG")
    rows = messages.where("segments IS NOT NULL").select("segments", "comp", *[segment(s).alias(s) for s in names])
    asked = {"control_id": ("MSH", 10), "patient_id": ("PID", 3, 1), "__kind": ("MSH", 9, 1), "__trigger": ("MSH", 9, 2)}
    time = F.coalesce(timestamp(field(F.col("EVN"), 2)), timestamp(field(F.col("MSH"), 7)))
    rows = rows.select("segments", "comp", "PV1", "SCH", "MRG", *[field(F.col(s), *n).alias(k) for k, (s, *n) in asked.items()], time.alias("__at"))
    rows = rows.select("control_id", F.coalesce("patient_id", F.lit("UNKNOWN")).alias("patient_id"), F.posexplode(found).alias("n", "e"))
    return rows.select("control_id", "patient_id", "n", "e.*").where("event_type IS NOT NULL")


def acknowledgement(code: Column, msh: Column | None = None) -> Column:
    """ACK text for a parsed message: sender and receiver swapped, code AA, AE or AR.

    ``msh`` is the message's MSH segment where it is a column of its own.
    """
    msh = segment("MSH") if msh is None else msh
    x = lambda n: F.coalesce(field(msh, n), F.lit(""))
    head = F.concat_ws("|", F.lit("MSH"), F.lit("^~\\&"), x(5), x(6), x(3), x(4), x(7), F.lit(""), F.concat(F.lit("ACK^"), F.coalesce(field(msh, 9, 2), F.lit(""))), F.concat(F.lit("ACK"), x(10)), F.coalesce(F.nullif(x(11), F.lit("")), F.lit("P")), F.coalesce(F.nullif(x(12), F.lit("")), F.lit("2.5")))
    return F.concat(head, F.lit("\r"), F.concat_ws("|", F.lit("MSA"), code, x(10)), F.lit("\r"))
