"""Command line over the Spark operators: ``python -m episodica.cli stats|mine|import|export|validate|types ...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import sequence, store, typesys
from .sources import fhir, hl7


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="episodica")
    commands = parser.add_subparsers(dest="command", required=True)
    stats = commands.add_parser("stats", help="event, patient and type counts of an event table")
    stats.add_argument("events")
    mine = commands.add_parser("mine", help="frequent contiguous patterns")
    mine.add_argument("events")
    mine.add_argument("--min-support", type=float, default=0.5)
    mine.add_argument("--min-length", type=int, default=2)
    mine.add_argument("--max-length", type=int, default=5)
    mine.add_argument("--limit", type=int, default=20)
    load = commands.add_parser("import", help="HL7 files or FHIR bundles to an event table")
    load.add_argument("kind", choices=["hl7", "fhir"])
    load.add_argument("path")
    load.add_argument("target")
    load.add_argument("--limit", type=int, default=None, help="with a directory: so many files, by name")
    out = commands.add_parser("export", help="an event table, or one patient of it, as FHIR bundles, one a line")
    out.add_argument("events")
    out.add_argument("target")
    out.add_argument("--patient", default=None)
    for name, says in (("validate", "check a type schema (JSON or YAML)"), ("types", "print the tree of a type schema")):
        commands.add_parser(name, help=says).add_argument("schema")
    args = parser.parse_args(argv)
    if args.command in ("validate", "types"):
        return _schema(args.command, Path(args.schema).read_text(encoding="utf-8"))
    spark = SparkSession.builder.appName("episodica").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "stats":
        events = spark.read.parquet(args.events)
        events.agg(F.count("*").alias("events"), F.countDistinct("patient_id").alias("patients"), F.countDistinct("event_type").alias("types")).show()
        store.type_counts(events).show(10, truncate=False)
    elif args.command == "mine":
        found = sequence.mine_patterns(sequence.sequences(spark.read.parquet(args.events)), min_length=args.min_length, max_length=args.max_length, min_support=args.min_support)
        found.select(F.array_join("pattern", " -> ").alias("pattern"), "n", "support").show(args.limit, truncate=False)
    elif args.command == "export":
        events = spark.read.parquet(args.events)
        events = events if args.patient is None else events.where(F.col("patient_id") == args.patient)
        fhir.write_bundles(fhir.to_bundles(fhir.to_resources(events), events), args.target)
    else:
        source = hl7 if args.kind == "hl7" else fhir
        rows, dead = source.import_directory(spark, args.path, pattern="*", limit=args.limit)
        if args.kind == "hl7":
            rows = rows.withColumn("event_id", F.coalesce("control_id", F.expr("uuid()"))).drop("file", "nth")
        rows.write.mode("append").parquet(args.target)
        for r in dead.orderBy("file").limit(20).collect():
            print(f"skipped {r.file}: {r.reason}", file=sys.stderr)
    return 0


def _schema(command: str, text: str) -> int:
    """Check a schema, or print its types as a tree; a type with several parents stands below each."""
    try:
        declared = typesys.declared(text)
        edges = [(e["name"], p) for e in declared for p in e.get("parents") or [e.get("parent")]]
        typesys.topological(edges)
        known = {e["name"] for e in declared}
        unknown = sorted({p for _, p in edges if p is not None} - known)
        if unknown:
            raise ValueError(f"unknown parents: {', '.join(unknown)}")
    except (ValueError, KeyError, TypeError) as e:
        print(f"invalid: {e}", file=sys.stderr)
        return 1
    if command == "validate":
        print(f"valid: {len(known)} types")
        return 0
    todo = [(n, 0) for n in sorted({n for n, p in edges if p is None}, reverse=True)]
    while todo:
        name, depth = todo.pop()
        print("  " * depth + name)
        todo += [(n, depth + 1) for n in sorted({n for n, p in edges if p == name}, reverse=True)]
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
