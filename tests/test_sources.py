"""Directories with bad files, replayed batches, late starts of streams, offsets."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from episodica.sources import fhir, hl7
from episodica.streaming import ingest

TAIL = "||ORU^R01|{id}|P|2.5\rPID|1||{who}\r"


def message(id_, at, who="P1", sender="LAB"):
    return f"MSH|^~\\&|{sender}|F|R|RF|{at}" + TAIL.format(id=id_, who=who)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "hl7"
    d.mkdir()
    (d / "b.hl7").write_bytes((message("M3", "20260103") + message("M2", "20260102")).encode())
    (d / "a.hl7").write_bytes(b"\x0b" + message("M1", "20260101", "P\xe4").encode("latin-1") + b"\x1c\r")
    (d / "a2.hl7").write_bytes(b"\x00\x01 no message at all")
    (d / "c.hl7").write_bytes(message("M4", "").encode())
    (d / "d.txt").write_bytes(message("M5", "20260105").encode())
    return str(d)


def names(rows):
    return [r.file.rsplit("/", 1)[1] for r in rows]


def test_hl7_directory(spark, folder):
    events, dead = hl7.import_directory(spark, folder)
    rows = events.orderBy("file", "nth").collect()
    assert [(r.control_id, r.nth) for r in rows] == [("M1", 0), ("M2", 0), ("M3", 1)]
    assert names(rows) == ["a.hl7", "b.hl7", "b.hl7"] and rows[0].patient_id == "P�"
    assert sorted(zip(names(dead.collect()), [r.reason for r in dead.collect()], strict=True)) == [("a2.hl7", "no message"), ("c.hl7", "no patient or time")]
    events, dead = hl7.import_directory(spark, folder, limit=2)
    assert [r.control_id for r in events.collect()] == ["M1"] and names(dead.collect()) == ["a2.hl7"]
    events, dead = hl7.import_directory(spark, folder, pattern="*.txt", limit=0)
    assert events.count() == dead.count() == 0
    with pytest.raises(PySparkException):
        hl7.import_directory(spark, folder + "-none")


def test_bundle_directory(spark, tmp_path):
    def bundle(k):
        body = {"resourceType": "Observation", "id": f"o{k}", "subject": {"reference": "Patient/p"}, "effectiveDateTime": "2026-01-01T10:00:00+02:00"}
        return json.dumps({"resourceType": "Bundle", "entry": [{"resource": body}]})

    for k, text in enumerate((bundle(0), "not json", bundle(2), bundle(3), '{"resourceType": "Patient"}')):
        (tmp_path / f"{k}.json").write_text(text)
    events, dead = fhir.import_directory(spark, str(tmp_path))
    assert sorted(r.event_id for r in events.collect()) == ["o0", "o2", "o3"]
    assert sorted(r.reason for r in dead.collect()) == ["no bundle", "no json"]
    events, dead = fhir.import_directory(spark, str(tmp_path), limit=2)
    assert [(r.event_id, r.t_start) for r in events.collect()] == [("o0", datetime(2026, 1, 1, 8))] and names(dead.collect()) == ["1.json"]


def test_offsets_become_utc(spark):
    said = {
        "2026-01-01T10:00:00+02:00": datetime(2026, 1, 1, 8),
        "2026-01-01T10:00:00.5-0530": datetime(2026, 1, 1, 15, 30, 0, 500000),
        "2026-01-01T10:00:00Z": datetime(2026, 1, 1, 10),
        "2026-01-01T10:00:00": datetime(2026, 1, 1, 10),
        "2026-01-01": datetime(2026, 1, 1),
        "2026-01": datetime(2026, 1, 1),
        "yesterday": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in said], "x string").select("x", fhir._time(F.col("x")).alias("t"))
    assert {r.x: r.t for r in rows.collect()} == said


def test_a_repeated_batch_leaves_each_sink_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.hl7").write_text(message("M1", "20260101") + message("M2", "") + "MSH|bad\r", newline="")
    paths = {f"{k}_path": str(tmp_path / k) for k in ("events", "dead", "ack", "audit")}
    for k in (1, 2):  # a checkpoint that is lost makes the same batch come again
        ingest.ingest(ingest.message_stream(spark, str(tmp_path / "in")), **paths, checkpoint=str(tmp_path / f"c{k}"), salt="s").awaitTermination()
    read = {k: spark.read.parquet(p).collect() for k, p in paths.items()}
    assert [r.control_id for r in read["events_path"]] == ["M1"]
    assert sorted(r.reason for r in read["dead_path"]) == ["no time", "unreadable"]
    assert sorted((r.control_id, r.code) for r in read["ack_path"]) == [("M1", "AA"), ("M2", "AA")]
    audit = {r.details: (r.success, r.user, r.patient_hash is not None) for r in read["audit_path"]}
    assert audit["hl7v2 msg_id=M1 type=ORU^R01"] == (True, "mllp:LAB", True)
    assert len(audit) == 3 and sum(ok for ok, _, _ in audit.values()) == 1
    assert not any(r.patient_hash == "P1" for r in read["audit_path"])
    ingest.clear_dead_letters(spark, paths["dead_path"], before=1)
    assert ingest.dead_letters(spark, paths["dead_path"]).count() == 0
    with pytest.raises(ValueError):
        ingest.ingest(ingest.message_stream(spark, str(tmp_path / "in")), **{**paths, "checkpoint": "x"})


def test_a_batch_holds_a_bounded_share_of_the_files(spark, tmp_path, monkeypatch):
    """Many waiting files are taken in several batches, of which only plain fields are kept, and nothing is lost."""
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.hl7").write_text(message(f"M{k}", "20260101" if k else "") + message(f"N{k}", "20260102") + "MSH|bad\r", newline="")
    kept, persist = [], type(spark.range(0)).persist
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda rows, *a: kept.append(rows) or persist(rows, *a))
    monkeypatch.setattr(ingest, "CORE_BYTES", 10, raising=False)  # less than a file
    paths = {f"{k}_path": str(tmp_path / k) for k in ("events", "dead", "ack", "audit")}
    ingest.ingest(ingest.message_stream(spark, str(tmp_path / "in")), **paths, checkpoint=str(tmp_path / "c"), salt="s").awaitTermination()
    read = {k: spark.read.parquet(p).collect() for k, p in paths.items()}
    assert len({r.batch for r in read["events_path"]}) == 4
    assert kept and not any("segments" in rows.columns for rows in kept)
    assert sorted(r.control_id for r in read["events_path"]) == sorted([f"N{k}" for k in range(4)] + [f"M{k}" for k in range(4) if k])
    assert sorted((r.reason, r.message.startswith("MSH|")) for r in read["dead_path"]) == [("no time", True)] + [("unreadable", True)] * 4
    assert sorted(r.control_id for r in read["ack_path"]) == sorted(f"{x}{k}" for x in "MN" for k in range(4))
    assert {r.ack for r in read["ack_path"] if r.control_id == "N1"} == {"MSH|^~\\&|R|RF|LAB|F|20260102||ACK^R01|ACKN1|P|2.5\rMSA|AA|N1\r"}
    assert sum(r.success for r in read["audit_path"]) == 7 and len(read["audit_path"]) == 12


def test_scores_follow_time_within_a_batch_of_any_size(spark, tmp_path):
    """One patient, 25,000 events in a batch and 30 in the next, dealt out of order over files and frames."""
    rng, t0 = random.Random(6), datetime(2026, 1, 1)
    xs = [None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(25_030)]
    rows = [("p", f"e{k:06d}", t0 + timedelta(minutes=k // 2), x) for k, x in enumerate(xs)]
    first, then = rows[:25_000], rows[25_000:]
    rng.shuffle(first)
    schema = "patient_id string, event_id string, t_start timestamp_ntz, value double"
    ingest.list_state(spark)
    for k, part in enumerate((first, then)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("num", F.create_map(F.lit("value"), "value"))
        ingest.streaming_z(stream, "value").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == (25_000, 25_030)[k]
    found = {r.event_id: r.z for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for k in [*range(0, 25_030, 97), *range(24_990, 25_030)]:
        known = [x for x in xs[max(0, k - 100) : k] if x is not None]
        want = abs(xs[k] - np.mean(known)) / np.std(known) if xs[k] is not None and len(known) >= 3 and np.std(known) > 1e-6 else 0.0
        assert math.isclose(found[f"e{k:06d}"], want, abs_tol=1e-9), k


def test_live_events_look_for_a_segment_once(spark):
    """Each segment of a message is looked for once, not anew for every rule that asks for its fields."""
    raw = spark.createDataFrame([("MSH|^~\\&|A|B|C|D|20240105083015||ADT^A03|M1|P|2.5\rPID|1||P1^^^H\rDG1|1||I21.0^x\r",)], "raw string")
    parsed = hl7.parse(hl7.split_messages(raw))
    found = hl7.to_live_events(parsed)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("= MSH)") <= 2
    assert [(r.n, r.event_type, r.control_id, r.patient_id) for r in found.orderBy("n").collect()] == [(0, "Entlassung", "M1", "P1"), (1, "Entlassdiagnose", "M1", "P1")]
