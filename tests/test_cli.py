"""The command line on small tables and folders."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from episodica import cli
from episodica.sources import fhir

TYPES = [{"name": "finding"}, {"name": "lab", "parent": "finding"}, {"name": "stay"}, {"name": "lab_in_stay", "parents": ["lab", "stay"]}]


@pytest.fixture
def session(spark, monkeypatch):
    """The commands take the running session."""
    return spark


def test_types_and_validation(tmp_path, capsys):
    good, cycle, odd, broken = (tmp_path / f"{n}.json" for n in "abcd")
    good.write_text(json.dumps(TYPES))
    cycle.write_text(json.dumps([{"name": "x", "parent": "y"}, {"name": "y", "parent": "x"}]))
    odd.write_text(json.dumps([{"name": "x", "parent": "nowhere"}]))
    broken.write_text("{[")
    assert cli.main(["validate", str(good)]) == 0 and "4 types" in capsys.readouterr().out
    assert [cli.main(["validate", str(p)]) for p in (cycle, odd, broken)] == [1, 1, 1]
    assert cli.main(["types", str(good)]) == 0
    assert capsys.readouterr().out.splitlines() == ["finding", "  lab", "    lab_in_stay", "stay", "  lab_in_stay"]
    yaml = tmp_path / "e.yaml"
    yaml.write_text("- name: finding\n- name: lab\n  parent: finding\n")
    pytest.importorskip("yaml")
    assert cli.main(["types", str(yaml)]) == 0 and capsys.readouterr().out == "finding\n  lab\n"


def test_import_and_export(session, tmp_path, capsys):
    spark, at = session, datetime(2026, 1, 1)
    (tmp_path / "in").mkdir()
    for k, text in enumerate(("{}", *(json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Observation", "id": f"o{k}", "subject": {"reference": f"Patient/p{k}"}, "effectiveDateTime": "2026-01-01T10:00:00Z"}}]}) for k in range(3)))):
        (tmp_path / "in" / f"{k}.json").write_text(text)
    assert cli.main(["import", "fhir", str(tmp_path / "in"), str(tmp_path / "t"), "--limit", "3"]) == 0
    assert "0.json: no bundle" in capsys.readouterr().err
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["o0", "o1"]

    schema = "event_id string, patient_id string, event_type string, t_start timestamp_ntz, t_end timestamp_ntz, stay_start timestamp_ntz, stay_end timestamp_ntz, confidence double, num map<string,double>, cat map<string,string>"
    rows = spark.createDataFrame([(f"e{k}", f"p{k % 2}", "Alarm", at, at, at, at, 1.0, {"value": float(k)}, {"value": str(k)}) for k in range(4)], schema)
    rows = rows.withColumn("references", F.create_map().cast("map<string,string>"))
    rows.write.parquet(str(tmp_path / "events"))
    assert cli.main(["export", str(tmp_path / "events"), str(tmp_path / "out"), "--patient", "p1"]) == 0
    found = fhir.from_bundles(fhir.read_bundles(spark, str(tmp_path / "out"), lines=True)).collect()
    assert sorted((r.event_id, r.patient_id) for r in found) == [("e1", "p1"), ("e3", "p1")]
