"""Schema versions and event migrations.

A migration is a list of operations (kind, arguments) that folds into one projection over the events:
("ren_type", old, new), ("rem_type", name), ("rem_attr", name), ("add_attr", name, default),
("chg_attr", name, "str" | "int" | "float"), ("add_type", ...), ("move_type", ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def migrate(events: DataFrame, operations: list[tuple]) -> DataFrame:
    """Events plus ``rejected`` (a removed type) with new ``event_type`` and ``cat`` attributes (text).

    A cast that fails leaves the value; a default is added only where the attribute is absent; ids, patients
    and times never change. Operations on types alone have no effect on events.
    """
    kind, attrs, rejected = F.col("event_type"), F.col("cat"), F.lit(False)
    for op, *args in operations:
        if op == "ren_type":
            kind = F.when(kind == args[0], F.lit(args[1])).otherwise(kind)
        elif op == "rem_type":
            rejected = rejected | F.coalesce(kind == args[0], F.lit(False))
        elif op == "rem_attr":
            attrs = _without(attrs, args[0])
        elif op == "add_attr":
            if args[1] is not None:
                attrs = F.when(F.map_contains_key(attrs, args[0]), attrs).otherwise(F.map_concat(attrs, F.create_map(F.lit(args[0]), F.lit(str(args[1])))))
        elif op == "chg_attr":
            attrs = _cast(attrs, *args)
        elif op not in ("add_type", "move_type"):
            raise ValueError(f"unknown operation {op}")
    return events.withColumns({"event_type": kind, "cat": attrs, "rejected": rejected})


def _without(attrs: Column, name: str) -> Column:
    return F.map_filter(attrs, lambda k, v: k != name)


def _cast(attrs: Column, name: str, to: str) -> Column:
    def new(v: Column) -> Column:
        if to == "int":
            return F.coalesce(v.try_cast("double").cast("long").cast("string"), v)
        return F.coalesce(v.try_cast("double").cast("string"), v) if to == "float" else v

    return F.transform_values(attrs, lambda k, v: F.when(k == name, new(v)).otherwise(v))


def migration_result(migrated: DataFrame) -> DataFrame:
    return migrated.agg(F.count_if(~F.col("rejected")).alias("migrated"), F.count_if("rejected").alias("rejected"))


def run_migration(events: DataFrame, operations: list[tuple], from_version: str, to_version: str, *, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, log) after the migration of the events with ``version_id`` = ``from_version``.

    Rejected events stay as they were, in their old version; the log has one row per event tried:
    event_id, from_version, to_version, status. A dry run changes nothing but gives the same log.
    """
    of_version = F.coalesce(F.col("version_id") == from_version, F.lit(False))
    tried = migrate(events.where(of_version), operations)
    status = F.when(F.col("rejected"), "rejected").otherwise("migrated")
    log = tried.select("event_id", F.lit(from_version).alias("from_version"), F.lit(to_version).alias("to_version"), status.alias("status"))
    if dry_run:
        return events, log
    # One pass: every row carries what it was, and takes what it becomes only if it moves.
    both = migrate(events.withColumn("__old", F.struct(*events.columns)), operations)
    old = lambda c: F.col("__old").getField(c)
    moves = F.coalesce(old("version_id") == from_version, F.lit(False)) & ~F.col("rejected")
    new = {c: F.lit(to_version) if c == "version_id" else F.col(c) for c in events.columns}
    return both.select(*[F.when(moves, new[c]).otherwise(old(c)).alias(c) for c in events.columns]), log


def register(versions: list[dict], version: dict) -> list[dict]:
    """Versions with ``version`` in place of one of the same id."""
    return [*[v for v in versions if v["version_id"] != version["version_id"]], dict(version)]


def current(versions: list[dict]) -> dict:
    """The newest begun version without an end; an error if there is none."""
    active = [v for v in versions if v["t_begin"] is not None and v["t_end"] is None]
    if not active:
        raise LookupError("no active version")
    return max(active, key=lambda v: v["t_begin"])


def compatibility(operations: list[tuple]) -> dict[str, bool]:
    """Backward: old events stay readable; forward: new events are readable by the old schema."""
    kinds = {op for op, *_ in operations}
    backward = not kinds & {"rem_type", "ren_type", "chg_attr"}
    forward = not kinds & {"add_type", "ren_type", "chg_attr", "rem_attr"}
    return {"backward": backward, "forward": forward, "full": backward and forward}


def migration_path(migrations: list[tuple[str, str, list]], start: str, target: str) -> list[tuple] | None:
    """Operations along the shortest chain of (from, to, operations); None if there is none."""
    seen, todo = {start: []}, [start]
    while todo:
        at = todo.pop(0)
        if at == target:
            return seen[at]
        for a, b, ops in migrations:
            if a == at and b not in seen:
                seen[b] = seen[at] + list(ops)
                todo.append(b)
    return None


def activate(versions: list[dict], version_id: str, at) -> list[dict]:
    """Versions with ``version_id`` begun at ``at`` and the active one ended then."""
    out = []
    for v in versions:
        v = dict(v)
        if v["version_id"] == version_id:
            v.update(t_begin=at, t_end=None)
        elif v["t_begin"] is not None and v["t_end"] is None:
            v["t_end"] = at
        out.append(v)
    return out


def with_version(events: DataFrame, versions: list[tuple]) -> DataFrame:
    """Events plus the version valid at their start: the newest with t_begin <= t < t_end, else the current.

    Versions (version_id, t_begin, t_end) are a declared list, so they fold into one CASE over literals:
    an as-of join without a join.
    """
    newest = sorted(versions, key=lambda v: v[1], reverse=True)
    current = next((v[0] for v in newest if v[2] is None), None)
    found = F.lit(current)
    for version_id, begin, end in reversed(newest):
        inside = F.col("t_start") >= F.lit(begin)
        if end is not None:
            inside = inside & (F.col("t_start") < F.lit(end))
        found = F.when(inside, F.lit(version_id)).otherwise(found)
    return events.withColumn("version_id", found)
