"""Event-store operators: lookups, upserts, deletes, references and summaries as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relation names and their inverses.
INVERSE = {
    "caused_by": "caused",
    "triggered_by": "triggered",
    "response_to": "responded_with",
    "observation_of": "observed_by",
    "confirms": "confirmed_by",
    "rules_out": "ruled_out_by",
    "side_effect_of": "had_side_effect",
    "part_of": "contains",
    "preceded_by": "succeeded_by",
    "replaces": "replaced_by",
    "references": "referenced_by",
    "indicates": "indicated_by",
    "contraindicates": "contraindicated_by",
}


def by_patient(events: DataFrame, patient_id: str, *, t_from=None, t_to=None, event_type: str | None = None, version_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Events of a patient by start; both bounds test the start, inclusively."""
    rows = events.where(F.col("patient_id") == patient_id)
    if t_from is not None:
        rows = rows.where(F.col("t_start") >= t_from)
    if t_to is not None:
        rows = rows.where(F.col("t_start") <= t_to)
    if event_type is not None:
        rows = rows.where(F.col("event_type") == event_type)
    if version_id is not None:
        rows = rows.where(F.col("version_id") == version_id)
    rows = rows.orderBy("t_start", "event_id")
    return rows if limit is None else rows.limit(limit)


def append(new: DataFrame, path: str) -> None:
    """Append ``new`` to the event table at ``path`` under fresh random ids."""
    new.withColumn("event_id", F.expr("uuid()")).write.mode("append").parquet(path)


def upsert(events: DataFrame, changes: DataFrame, *, refs: DataFrame | None = None, new_refs: DataFrame | None = None):
    """Insert or replace by event_id; a replaced event loses its old outgoing references.

    Returns (events, refs). The change set decides where ids repeat; within it the last by ``seq``
    (if that column exists) or else the greatest row wins.
    """
    order = ["seq"] if "seq" in changes.columns else [c for c, t in changes.dtypes if not t.startswith("map") and c != "event_id"]
    last = Window.partitionBy("event_id").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    fresh = changes.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank", "seq")
    kept = events.join(fresh.select("event_id"), "event_id", "left_anti").unionByName(fresh)
    if refs is None:
        return kept, None
    old = refs.join(fresh.select("event_id"), "event_id", "left_anti")
    return kept, old if new_refs is None else old.unionByName(new_refs.dropDuplicates(["event_id", "ref_id"]))


def update(events: DataFrame, changes: DataFrame) -> DataFrame:
    """As :func:`upsert`, but only ids that exist are changed and references stay."""
    known = changes.join(events.select("event_id"), "event_id", "left_semi")
    return upsert(events, known)[0]


def delete(events: DataFrame, refs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the events in ``ids(event_id)`` and their outgoing references; incoming ones stay."""
    ids = ids.select("event_id").distinct()
    return events.join(ids, "event_id", "left_anti"), refs.join(ids, "event_id", "left_anti")


def with_references(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Events plus ``references`` map ref_id -> relation (empty if none)."""
    pairs = refs.groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("ref_id", F.coalesce("relation", F.lit("references")))))).alias("references"))
    return events.join(pairs, "event_id", "left").withColumn("references", F.coalesce("references", F.create_map().cast("map<string,string>")))


def referenced_by(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that point to ``targets(ref_id)``."""
    return refs.join(targets.select("ref_id").distinct(), "ref_id", "left_semi")


def inverse_of(relation: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    return F.coalesce(known[relation], F.concat(F.lit("inverse_of_"), relation))


def is_valid_relation(name: Column) -> Column:
    return F.coalesce(name.rlike("^[a-z_][a-z0-9_]*$"), F.lit(False))


def patient_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("patient_id").agg(F.count("*").alias("n_events"), F.min("t_start").alias("first"), F.max("t_end").alias("last"))


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


def stats(events: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: events, patients, types, references."""
    own = events.agg(F.count("*").alias("events"), F.countDistinct("patient_id").alias("patients"), F.countDistinct("event_type").alias("types"))
    return own.crossJoin(refs.agg(F.count("*").alias("refs")))  # one row each


def first_per_patient(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events of every patient."""
    w = Window.partitionBy("patient_id").orderBy("t_start", "event_id")
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


_TIMES = ("t_start", "t_end", "stay_start", "stay_end")


def _bytes(text: Column | str, start: Column, size: Column) -> Column:
    """Part of a text by bytes, which need no counting of characters."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(text.cast("binary"), start, size).cast("string")


def to_json(events: DataFrame) -> DataFrame:
    """``event_id, json``: times as ISO text, numbers as numbers, other attributes as text, references as a map.

    References come from a column ``references`` (:func:`with_references`); stays and text attributes are
    written where the events have them.
    """
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    have = events.columns
    rest = [F.col("references")] if "references" in have else []
    body = F.to_json(F.struct("event_id", "patient_id", "event_type", *[iso(c) for c in _TIMES if c in have], *rest, "confidence"))
    written = {"__body": body, "__num": F.to_json(F.map_filter("num", lambda k, v: v.isNotNull()))}
    if "cat" in have:
        written["__cat"] = F.to_json(F.map_filter("cat", lambda k, v: v.isNotNull() & F.col("num").getItem(k).isNull()))
    rows = events.select("event_id", *(c.alias(name) for name, c in written.items()))
    inner = lambda c: F.nullif(_bytes(c, F.lit(2), F.octet_length(c) - 2), F.lit(""))
    attributes = F.concat(F.lit(',"attributes":{'), F.concat_ws(",", *map(inner, [*written][1:])), F.lit("}}"))
    return rows.select("event_id", F.concat(_bytes("__body", F.lit(1), F.octet_length("__body") - 1), attributes).alias("json"))


_SPACE, _PLAIN = r"[ \t\n\r]*+", r'"[^"\\\x00-\x1f]*+"'
_LINK = f"{_PLAIN}{_SPACE}:{_SPACE}{_PLAIN}"
#: The key references with an object of texts without escapes.
_LINKS = rf'"references"(?<=[{{, \t\n\r]"references"){_SPACE}:{_SPACE}\{{{_SPACE}(?:{_LINK}(?:{_SPACE},{_SPACE}{_LINK})*+)?+{_SPACE}\}}'
#: Stands in the text for the references that were taken out of it.
_TAKEN = "#references#"


def _without_links(rows: DataFrame) -> DataFrame:
    """``json`` and ``__links``: a plain map of references is taken out of the text, if there is one at its top level.

    The ids in it are all different, and the JSON parser keeps a table of the names of objects: it grows with
    every new name and is searched and copied for every text, which costs far more than to read the text.
    Maps with escapes, repeated keys or in unclear places stay in the text (``__links`` is null).
    """
    # A text in which the key comes once more holds no mark after parsing, as the last one counts.
    rows = rows.select("json", F.nullif(F.regexp_extract("json", _LINKS, 0), F.lit("")).alias("__found"))
    rows = rows.select("json", "__found", F.call_function("substring_index", "json", "__found", F.lit(1)).alias("__before"))
    # Nothing but the outer object is open before the key, and no text in single quotes.
    bare = F.regexp_replace("__before", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    depth = F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))
    top = F.rlike("__before", F.lit(r"^\s*+\{[^{']*+$")) | ((depth == 1) & ~F.contains(bare, F.lit("'")))
    after = _bytes("json", F.octet_length("__before") + F.octet_length("__found") + 1, F.octet_length("json"))
    rows = rows.select("json", "__before", after.alias("__after"), F.when(top, F.split("__found", '"')).alias("__words"))
    # "references":{"id":"relation","id":"relation"}: ids are the words 3, 7, ..., relations 5, 9, ...
    every = lambda k: F.transform(F.sequence(F.lit(k), F.size("__words") - 1, F.lit(4)), lambda i: F.get("__words", i))
    ids = F.when(F.size("__words") > 5, every(3))
    rows = rows.select("json", "__before", "__after", ids.alias("__ids"), F.when(F.size("__words") > 5, every(5)).alias("__relations"))
    rows = rows.select("json", "__before", "__after", F.when(F.size(F.array_distinct("__ids")) == F.size("__ids"), F.map_from_arrays("__ids", "__relations")).alias("__links"))
    short = F.concat("__before", F.lit(f'"references":"{_TAKEN}"'), "__after")
    return rows.select(F.when(F.col("__links").isNull(), F.col("json")).otherwise(short).alias("json"), "__links")


def from_json(rows: DataFrame) -> DataFrame:
    """Events from JSON with ``num``, ``cat``, ``references``; a text that reads as a number is in ``num`` too.

    References may be a map or a list of ids (relation "references"). Without confidence it is 1, without
    an id a random one is drawn; a text that is no object gives no row.
    """
    kind = "event_id string, patient_id string, event_type string, t_start string, t_end string, stay_start string, stay_end string, attributes map<string,string>, references string, confidence double"
    x = _without_links(rows).select("__links", F.explode(F.array(F.from_json("json", kind))).alias("x")).select("__links", "x.*").where("patient_id IS NOT NULL")
    listed = F.map_from_entries(F.transform(F.array_distinct(F.from_json("references", "array<string>")), lambda r: F.struct(r, F.lit("references"))))
    references = F.when(F.ltrim("references").startswith("["), listed).otherwise(F.from_json("references", "map<string,string>"))
    cat = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    number = F.map_filter(F.transform_values(cat, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    return x.select(
        F.coalesce("event_id", F.expr("uuid()")).alias("event_id"), "patient_id", "event_type",
        *[F.col(c).try_cast("timestamp_ntz").alias(c) for c in _TIMES],
        number.alias("num"), cat.alias("cat"), F.coalesce(F.when(F.col("references") == _TAKEN, F.col("__links")), references, F.create_map().cast("map<string,string>")).alias("references"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def audit_query(audit: DataFrame, *, action=None, user=None, patient_hash=None, since=None, until=None, success=None, limit: int = 100) -> DataFrame:
    """Audit rows that meet all given filters (bounds inclusive), newest first."""
    for column, value in (("action", action), ("user", user), ("patient_hash", patient_hash), ("success", success)):
        if value is not None:
            audit = audit.where(F.col(column) == value)
    if since is not None:
        audit = audit.where(F.col("timestamp") >= since)
    if until is not None:
        audit = audit.where(F.col("timestamp") <= until)
    return audit.orderBy(F.desc("audit_id")).limit(limit)
