"""Type hierarchies: closure, depth, inherited attributes, conflicts and attribute validation.

types: name, parent (one row per edge; null parent: a root)
type_attrs: type_name, attr, spec_type, lo, hi, values array<string>, required
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CycleError(ValueError):
    pass


def topological(edges: list[tuple[str, str | None]]) -> list[str]:
    """Names of a declared schema, parents first; a cycle raises. Declarations are small."""
    parents: dict[str, set] = {}
    for child, parent in edges:
        parents.setdefault(child, set()).update({parent} - {None})
    for parent in {p for ps in parents.values() for p in ps}:
        parents.setdefault(parent, set())
    out: list[str] = []
    while parents:
        free = sorted(n for n, ps in parents.items() if not ps)
        if not free:
            raise CycleError(f"cycle among {sorted(parents)}")
        out += free
        parents = {n: ps - set(free) for n, ps in parents.items() if n not in free}
    return out


def from_dict(spark, declared: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(types, type_attrs) from schema entries ``name, parent(s), attributes{attr: {type, range, values, required}}``."""
    edges, attrs = [], []
    for entry in declared:
        parents = entry.get("parents") or [entry.get("parent")]
        edges += [(entry["name"], p) for p in parents or [None]]
        for name, spec in (entry.get("attributes") or {}).items():
            lo, hi = spec.get("range") or (None, None)
            attrs.append((entry["name"], name, spec.get("type", "any"), None if lo is None else float(lo), None if hi is None else float(hi), [str(v) for v in spec.get("values") or []] or None, bool(spec.get("required"))))
    topological(edges)
    return spark.createDataFrame(edges, "name string, parent string"), spark.createDataFrame(attrs, "type_name string, attr string, spec_type string, lo double, hi double, values array<string>, required boolean")


def parents_of(types: DataFrame, name: str) -> DataFrame:
    return types.where((F.col("name") == name) & F.col("parent").isNotNull()).select("parent").distinct()


def children_of(types: DataFrame, name: str) -> DataFrame:
    return types.where(F.col("parent") == name).select("name").distinct()


def remove_type(types: DataFrame, name: str, *, top: str | None = None) -> DataFrame:
    """Types without ``name``; children that had no other parent hang below ``top`` (null: become roots)."""
    if top is not None and name == top:
        raise ValueError("the root cannot be removed")
    others = types.where(F.col("name") != name)
    kept = others.where(F.col("parent").isNull() | (F.col("parent") != name))
    orphans = others.where(F.col("parent") == name).select("name").distinct().join(kept.select("name"), "name", "left_anti")
    return kept.unionByName(orphans.select("name", F.lit(top).cast("string").alias("parent")))


def to_dict(types: DataFrame, type_attrs: DataFrame) -> list[dict]:
    """The declared schema as entries that :func:`from_dict` reads; a schema is written by hand, so it is small."""
    out = {r.name: {"name": r.name, "parents": sorted(r.parents)} for r in types.groupBy("name").agg(F.collect_set("parent").alias("parents")).collect()}
    for r in type_attrs.orderBy("type_name", "attr").collect():
        spec = {"type": r.spec_type, "required": r.required}
        if r.lo is not None or r.hi is not None:
            spec["range"] = [r.lo, r.hi]
        if r["values"] is not None:
            spec["values"] = list(r["values"])
        out.setdefault(r.type_name, {"name": r.type_name, "parents": []}).setdefault("attributes", {})[r.attr] = spec
    return [out[k] for k in sorted(out)]


def to_text(types: DataFrame, type_attrs: DataFrame) -> str:
    return json.dumps(to_dict(types, type_attrs), ensure_ascii=False, indent=2)


def declared(text: str) -> list[dict]:
    """The entries of a schema in JSON, or in YAML where a reader for it is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"neither JSON nor YAML: {e}") from e


def from_text(spark, text: str) -> tuple[DataFrame, DataFrame]:
    """(types, type_attrs) of a schema, see :func:`declared`."""
    return from_dict(spark, declared(text))


def closure(types: DataFrame) -> DataFrame:
    """``name, ancestor, depth``: reflexive transitive closure with the longest path as depth.

    One join a level: a pair is kept once a level however many paths lead to it, so diamonds do not
    multiply. A cycle is an error.
    """
    up = types.where("parent IS NOT NULL").select(F.col("name").alias("ancestor"), F.col("parent").alias("above")).distinct()
    names = types.select("name").union(types.select("parent")).where("name IS NOT NULL").distinct()
    n, level, found = names.count(), names.select("name", F.col("name").alias("ancestor")), []
    while not found or not level.isEmpty():
        if len(found) > n:
            raise ValueError("the type hierarchy has a cycle")
        found.append(level.withColumn("depth", F.lit(len(found))))
        level = level.join(up, "ancestor").select("name", F.col("above").alias("ancestor")).distinct().persist()
    return reduce(DataFrame.union, found).groupBy("name", "ancestor").agg(F.max("depth").alias("depth"))


def _has(closed: DataFrame, name: str, ancestor: str) -> bool:
    return not closed.where((F.col("name") == name) & (F.col("ancestor") == ancestor)).isEmpty()


def add_type(types: DataFrame, closed: DataFrame, name: str, parent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(types, closure) with a new type below ``parent`` (null: a root). The closure gains the ancestors of one row only."""
    if not name or _has(closed, name, name):
        raise ValueError(f"{name!r} is no new name")
    if parent is not None and not _has(closed, parent, parent):
        raise ValueError(f"there is no type {parent!r}")
    spark = types.sparkSession
    row = spark.createDataFrame([(name, parent)], "name string, parent string")
    own = spark.createDataFrame([(name, name, 0)], "name string, ancestor string, depth int")
    above = closed.where(F.col("name") == parent).select(F.lit(name).alias("name"), "ancestor", (F.col("depth") + 1).alias("depth"))
    return types.unionByName(row), closed.unionByName(own).unionByName(above) if parent is not None else closed.unionByName(own)


def add_edge(types: DataFrame, closed: DataFrame, child: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(types, closure) with one more parent of an existing type; an edge that closes a cycle is an error.

    Only pairs through the new edge are new or deeper: all below ``child`` with all above ``parent``.
    A parent that is there already changes nothing.
    """
    for name in (child, parent):
        if not _has(closed, name, name):
            raise ValueError(f"there is no type {name!r}")
    if _has(closed, parent, child):
        raise ValueError("the edge would close a cycle")
    row = types.sparkSession.createDataFrame([(child, parent)], "name string, parent string")
    # The row without a parent that a root may have says nothing any more.
    kept = types.where(~((F.col("name") == child) & F.col("parent").isNull()))
    below = closed.where(F.col("ancestor") == child).select("name", F.col("depth").alias("down"), F.lit(child).alias("via"))
    above = closed.where(F.col("name") == parent).select("ancestor", F.col("depth").alias("up"), F.lit(child).alias("via"))
    through = below.join(above, "via").select("name", "ancestor", (F.col("down") + F.col("up") + 1).alias("depth"))
    deepest = closed.unionByName(through).groupBy("name", "ancestor").agg(F.max("depth").alias("depth"))
    return kept.unionByName(row).distinct(), deepest


def depths(closed: DataFrame) -> DataFrame:
    return closed.groupBy("name").agg(F.max("depth").alias("depth"))


def descendants(closed: DataFrame, ancestor: str) -> DataFrame:
    return closed.where(F.col("ancestor") == ancestor).select("name")


def events_of(events: DataFrame, closed: DataFrame, ancestor: str) -> DataFrame:
    """Events whose type is ``ancestor`` or below it: a semi join on the closure."""
    return events.join(descendants(closed, ancestor).withColumnRenamed("name", "event_type"), "event_type", "left_semi")


def inherited(closed: DataFrame, type_attrs: DataFrame) -> DataFrame:
    """Every spec that a type has itself or from an ancestor, with its distance; nearest first by ``rank``."""
    rows = closed.join(type_attrs.withColumnRenamed("type_name", "ancestor"), "ancestor")
    w = Window.partitionBy("name", "attr").orderBy("depth", "ancestor")
    return rows.withColumn("rank", F.row_number().over(w))


def conflicts(closed: DataFrame, type_attrs: DataFrame) -> DataFrame:
    """``name, attr, conflict``: type_mismatch, disjoint_range or enum_not_subset among inherited specs.

    The range and enum tests decide satisfiability, since attributes are constrained one by one.
    """
    specs = inherited(closed, type_attrs)
    own = F.max(F.when(F.col("rank") == 1, F.col("values")))
    common = specs.where("values IS NOT NULL")
    w = Window.partitionBy("name", "attr")
    outside = common.withColumn("own", F.max_by("values", -F.col("rank")).over(w)).where(F.size(F.array_except("own", "values")) > 0)
    per = specs.groupBy("name", "attr").agg(F.countDistinct("spec_type").alias("kinds"), F.max("lo").alias("lo"), F.min("hi").alias("hi"), own.alias("own"))
    first = per.select("name", "attr", F.explode(F.array_compact(F.array(F.when(F.col("kinds") > 1, F.lit("type_mismatch")), F.when(F.col("lo") > F.col("hi"), F.lit("disjoint_range"))))).alias("conflict"))
    return first.unionByName(outside.select("name", "attr", F.lit("enum_not_subset").alias("conflict")).distinct())


def required(closed: DataFrame, type_attrs: DataFrame) -> DataFrame:
    return inherited(closed, type_attrs).groupBy("name", "attr").agg(F.bool_or("required").alias("required")).where("required").select("name", "attr")


def spec_holds(value: Column, spec_type: Column, lo: Column, hi: Column, values: Column) -> Column:
    """Whether a value (as text) meets a spec: its type and inclusive range, or the enum's values."""
    number = value.try_cast("double")
    in_range = F.coalesce(number >= lo, F.lit(True)) & F.coalesce(number <= hi, F.lit(True))
    typed = (
        F.when(spec_type == "int", F.coalesce(value.rlike(r"^[+-]?\d+$"), F.lit(False)))
        .when(spec_type == "float", number.isNotNull())
        .when(spec_type == "bool", F.lower(value).isin("true", "false"))
        .otherwise(F.lit(True))
    )
    return F.when(spec_type == "enum", F.coalesce(F.array_contains(values, value), F.lit(False))).otherwise(typed & in_range)


def validate_attributes(events: DataFrame, closed: DataFrame, type_attrs: DataFrame) -> DataFrame:
    """``event_id, attr, value, ok`` for every attribute; an attribute that no type declares is not ok."""
    nearest = inherited(closed, type_attrs).where("rank = 1").select(F.col("name").alias("event_type"), "attr", "spec_type", "lo", "hi", "values", F.lit(True).alias("declared"))
    rows = events.select("event_id", "event_type", F.explode("cat").alias("attr", "value"))
    rows = rows.join(nearest, ["event_type", "attr"], "left")
    ok = F.coalesce(F.col("declared"), F.lit(False)) & F.coalesce(spec_holds(F.col("value"), F.col("spec_type"), F.col("lo"), F.col("hi"), F.col("values")), F.lit(False))
    return rows.select("event_id", "attr", "value", ok.alias("ok"))
