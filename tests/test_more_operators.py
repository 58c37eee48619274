"""Cases of the operators that their SQL comparison does not reach."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from episodica.functions import temporal
from episodica.operators import audit, causal, evolution, privacy, scoring, sequence, store, typesys
from episodica.operators.cohort import Cohort, report_size
from episodica.sources import fhir
from episodica.streaming import ingest
from tests.test_operators import events


def test_audit_is_appended_and_exported(spark, tmp_path):
    rows = spark.createDataFrame([("login", "u1", "p1", True), ("read", "u2", None, None)], "action string, user string, patient_id string, success boolean")
    audit.record(rows, str(tmp_path / "log"), "salt")
    audit.record(rows.where("action = 'read'"), str(tmp_path / "log"), "salt")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert audit.count(log).first().n == 3 and log.select("audit_id").distinct().count() == 3
    assert {(r.action, r.patient_hash, r.success) for r in log.collect()} == {("login", rows.select(privacy.pseudonym(F.lit("p1"), "salt")).first()[0], True), ("read", None, True)}
    assert audit.export_csv(log, str(tmp_path / "csv")) == 3
    assert [r.audit_id for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("audit_id").collect()] == sorted(r.audit_id for r in log.collect())
    assert audit.export_csv(log.limit(0), str(tmp_path / "none")) == 0


def test_report_of_named_patients(spark):
    rows = events(spark, [("p", "A", 0, {"x": 5}), ("p", "A", 1, {"x": 7}), ("q", "B", 2, {})])
    named = spark.createDataFrame([("p",), ("q",), ("new",)], "patient_id string")
    found = Cohort(event_type="A", min_count=2).report(rows, patients=named)
    assert {tuple(r) for r in found.collect()} == {("p", 2, True), ("q", 0, False), ("new", 0, False)}
    assert tuple(report_size(found).first()) == (1, 3, 2)
    assert [r.patient_id for r in Cohort().report(rows, max_patients=1).collect()] == ["p"]
    assert tuple(report_size(Cohort().report(rows.limit(0))).first()) == (0, 0, 0)


def test_append_gives_fresh_ids(spark, tmp_path):
    rows = events(spark, [("p", "A", 0, {})])
    for _ in range(2):
        store.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).select("event_id").distinct().count() == 2


def test_json_of_other_writers(spark):
    base = {"patient_id": "p", "event_type": "A", "t_start": "2026-01-01T08:00:00", "t_end": "2026-01-01T09:00:00.5"}
    texts = [json.dumps(base | {"event_id": "a", "references": ["x", "y", "x"], "attributes": {"n": 4, "s": 'q"t', "b": True}}), json.dumps(base | {"references": {"x": "confirms"}, "confidence": 0.5}), "[", "{}"]
    found = store.from_json(spark.createDataFrame([(t,) for t in texts], "json string")).orderBy("confidence").collect()
    assert len(found) == 2 and found[0].event_id and found[0].references == {"x": "confirms"} and found[0].num == {}
    assert found[1].references == {"x": "references", "y": "references"} and found[1].num == {"n": 4.0} and found[1].cat == {"n": "4", "s": 'q"t', "b": "true"}
    assert found[1].t_end == datetime(2026, 1, 1, 9, 0, 0, 500000)


def test_grammar_with_patterns():
    rules = {"S": [("A", "R"), ("A", "A")], "R": [("B", "R"), ("B", "A")], "A": [("a",)], "B": [("b",), ("c",)]}
    g = sequence.Grammar(rules, "S", {("B", ("b",)): 0.9, ("B", ("c",)): 0.1})
    longer = sequence.extend_with_patterns(g, [("b", "a"), ("B", "R"), ("a",)])
    for text in ("aa", "aba", "abca", "acbba", "ab", "", "ba"):
        was, now = g.parse(list(text)), longer.parse(list(text))
        assert (was[0] > -math.inf) == (now[0] > -math.inf)
    tree = longer.parse(list("aba"))[1]
    assert "(P_0 (P_T_b b) (P_T_a a))" in tree  # the pattern takes part in a parse from the start symbol
    assert longer.probabilities["B", ("b",)] == 0.9
    for left in rules:
        assert sum(p for (x, _), p in longer.probabilities.items() if x == left) == pytest.approx(1)
    whole = sequence.extend_with_patterns(g, [("a", "b", "a")])
    assert whole.parse(list("aba"))[1].startswith("(S (P_T_a a) (P_0_0")
    long = ["a", *["b"] * 60, "a"]
    assert g.parse(long)[1].count("(") == g.parse(long)[1].count(")")
    assert sequence._bracket(_deep(5000)).endswith(")" * 5000)


def _deep(n):
    tree = ("A", "a")
    for _ in range(n):
        tree = ("R", ("B", "b"), tree)
    return tree


def test_monte_carlo_nears_the_adjustment(spark):
    rows = spark.range(40_000).selectExpr("id", "id % 3 AS z", "(id % 7 < 2 + id % 3) AS t", "(id % 11 < 3 + id % 3) AS y")
    exact = {r.t: r.p for r in causal.do_backdoor(rows, "t", F.col("y"), ["z"]).collect()}
    drawn = {r.t: r.p for r in causal.do_monte_carlo(rows, "t", F.col("y"), ["z"], key=[F.col("id")], n_samples=10_000).collect()}
    every = {r.t: r.p for r in causal.do_monte_carlo(rows, "t", F.col("y"), ["z"], key=[F.col("id")], n_samples=40_000).collect()}
    assert drawn.keys() == exact.keys() and all(abs(drawn[t] - exact[t]) < 0.01 for t in exact)
    assert every == pytest.approx(exact)
    with pytest.raises(ValueError):
        causal.strata(rows, ["z", "id"])
    assert causal.strata(rows, []).first().n == 40_000


def test_graph_export():
    g = causal.Graph([("Z", "X"), ("X", "Y")])
    assert causal.Graph.from_dict(g.to_dict()).edges == g.edges
    assert g.gml().count("node [") == 3 and 'label "Z"' in g.gml() and g.gml().count("edge [") == 2


def test_migration_run_keeps_patients_and_times(spark):
    rows = events(spark, [("p", "A", 0, {"x": 1}), ("p", "B", 1, {"x": 2}), ("q", "A", 2, {"x": 3})]).withColumn("version_id", F.when(F.col("patient_id") == "p", "v1"))
    steps = [("ren_type", "A", "C"), ("rem_type", "B")]
    after, log = evolution.run_migration(rows, steps, "v1", "v2")
    assert {(r.event_id, r.event_type, r.version_id) for r in after.collect()} == {("e000", "C", "v2"), ("e001", "B", "v1"), ("e002", "A", None)}
    assert {(r.event_id, r.status) for r in log.collect()} == {("e000", "migrated"), ("e001", "rejected")}
    key = ["event_id", "patient_id", "t_start", "t_end"]
    assert sorted(after.select(key).collect()) == sorted(rows.select(key).collect())
    same, tried = evolution.run_migration(rows, steps, "v1", "v2", dry_run=True)
    assert sorted(map(str, same.collect())) == sorted(map(str, rows.collect())) and tried.count() == 2


def test_version_registry():
    at = datetime(2026, 1, 1)
    versions = evolution.register([], {"version_id": "v1", "t_begin": at, "t_end": None})
    versions = evolution.register(versions, {"version_id": "v2", "t_begin": None, "t_end": None})
    assert evolution.current(versions)["version_id"] == "v1"
    versions = evolution.activate(versions, "v2", datetime(2026, 2, 1))
    assert evolution.current(versions)["version_id"] == "v2"
    with pytest.raises(LookupError):
        evolution.current([])


def test_schema_text_round_trip(spark):
    declared = [{"name": "A", "attributes": {"x": {"type": "int", "range": [0, 9]}}}, {"name": "B", "parents": ["A"], "attributes": {"k": {"type": "enum", "values": ["u", "v"], "required": True}}}]
    types, attrs = typesys.from_text(spark, json.dumps(declared))
    again = typesys.from_text(spark, typesys.to_text(types, attrs))
    for one, other in zip((types, attrs), again, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    left = typesys.remove_type(types, "A")
    assert [tuple(r) for r in left.collect()] == [("B", None)]
    with pytest.raises(ValueError):
        typesys.remove_type(types, "TOP", top="TOP")


def test_cohort_ids_are_withheld_under_a_budget(spark):
    rows = events(spark, [("p", "A", 0, {}), ("p", "A", 1, {}), ("q", "A", 2, {})])
    size, ids = privacy.release_matches(rows)
    assert size == 2.0 and ids.count() == 2
    budget = privacy.Budget(1.0)
    size, ids = privacy.release_matches(rows, budget, 1.0, seed=1)
    assert size >= 0 and ids is None and budget.left == 0
    noisy = privacy.simulate_federation(spark, epsilon=1.0, seed=4).collect()
    assert len(noisy) == 3 and all(r.n == 30 and r.released >= 0 for r in noisy) and len({r.released for r in noisy}) == 3


def test_relation_confidence(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 5.0, 6.0), (2, 0.0, 1.0, 1.0, 2.0)], "id long, a double, b double, c double, d double")
    found = {r.id: r.p for r in temporal.relation_confidence(rows, "before", key=["id"], sigma=F.lit(0.1), n_samples=400).collect()}
    assert found[1] == 1.0 and 0.3 < found[2] < 0.7


def test_layers_without_accepted_findings(spark):
    docs = spark.createDataFrame([(1, "Sepsis, Laktat: 9,5"), (2, "Diabetes"), (3, ""), (4, None)], "doc_id long, text string")
    found = {r.patient_id: r for r in scoring.layers(docs, c_min=0.8, rules=[{"attr": "qlaktat", "op": ">", "threshold": 4.0, "label": "high"}]).collect()}
    assert (found["1"].extracted, found["1"].accepted, found["1"].n_anomalies) == (2, 2, 1)
    assert (found["2"].extracted, found["2"].accepted, found["2"].risk_level) == (1, 0, None)
    assert found.keys() == {"1", "2"}
    assert scoring.layers(docs.limit(0)).count() == 0


def test_bundle_severity(spark):
    body = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Condition", "id": "c", "subject": {"reference": "Patient/p"}, "onsetDateTime": "2026-01-01", "code": {"coding": [{"code": "x"}]}, "severity": {"coding": [{"display": "Severe"}]}}}]}
    rows = spark.createDataFrame([("f", json.dumps(body))], "file string, bundle string")
    assert fhir.import_bundles(rows).first().severity == "Severe"
    found = fhir.from_bundles(rows).first()
    assert (found.event_id, found.event_type, found.t_end) == ("c", "x", datetime(2026, 1, 1))


def test_status_of_an_ingest(spark, tmp_path):
    good = "MSH|^~\\&|A|F|R|RF|20260101080000||ORU^R01|M1|P|2.5\rPID|1||P1\r"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.hl7").write_text(good + "MSH|bad\r", newline="")
    paths = {k: str(tmp_path / k) for k in ("events_path", "dead_path", "checkpoint")}
    ingest.ingest(ingest.message_stream(spark, str(tmp_path / "in")), **paths).awaitTermination()
    found = {r.kind: (r.batches, r.n) for r in ingest.queue_status(spark, paths["events_path"], paths["dead_path"]).collect()}
    assert found == {"stored": (1, 1), "dead": (1, 1)}
