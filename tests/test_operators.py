"""Cases of the domain operators that the SQL comparison does not reach."""

import itertools
import math
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import causal, cohort, episodes, evolution, explain, privacy, scoring, sequence, store, typesys
from episodica.operators.cohort import Cohort
from episodica.plans import cohort_queries, model_queries

EVENT = "event_id string, patient_id string, event_type string, t_start timestamp_ntz, t_end timestamp_ntz, num map<string,double>, cat map<string,string>, confidence double"
T0 = datetime(2026, 1, 1, 8)


def events(spark, rows):
    """(patient, type, hours, attributes) with text for every attribute and numbers where they are numeric."""
    out = []
    for k, (p, kind, hours, attrs) in enumerate(rows):
        begin, end = hours if isinstance(hours, tuple) else (hours, hours)
        numeric = {a: float(v) for a, v in attrs.items() if isinstance(v, (int, float))}
        out.append((f"e{k:03}", p, kind, T0 + timedelta(hours=begin), T0 + timedelta(hours=end), numeric, {a: str(v) for a, v in attrs.items()}, 1.0))
    return spark.createDataFrame(out, EVENT)


def test_predicates(spark):
    rows = events(spark, [("p", "A", 0, {"x": 5}), ("p", "A", 1, {"x": "7.5"}), ("p", "A", 2, {}), ("p", "B", 3, {"x": True})])
    hit = lambda c: [r.event_id for r in rows.where(c).orderBy("event_id").collect()]
    assert hit(cohort.val("x", ">", 4)) == ["e000", "e001"]
    assert hit(cohort.val("x", "!=", 5)) == ["e001", "e003"]
    assert hit(cohort.val("x", "~", 5)) == []
    assert hit(cohort.attr("x", None)) == ["e002"]
    assert hit(~cohort.val("x", ">", 4)) == ["e002", "e003"]
    assert hit(cohort.has_type("A") & ~cohort.attr("x", 5)) == ["e001", "e002"]


def test_cohort_without_values_or_matches(spark):
    rows = events(spark, [("p", "A", 0, {"x": "text"}), ("q", "A", 1, {"x": 2}), ("r", "B", 1, {})])
    assert [r.patient_id for r in Cohort(event_type="A", aggregate=("count", "x", ">=", 0)).run(rows).collect()] == ["q"]
    assert {r.patient_id: r.n_events for r in Cohort(event_type="A", min_count=0).run(rows).collect()} == {"p": 1, "q": 1, "r": 0}
    assert Cohort(event_type="A").run(rows.limit(0)).count() == 0


def test_episode_gap_rule(spark):
    day = 24.0
    rows = events(spark, [("p", "A", (0, 10 * day), {}), ("p", "B", (day, 2 * day), {}), ("p", "A", 3 * day, {}), ("p", "A", 4 * day, {}), ("p", "A", 5 * day + 0.001, {})])
    found = episodes.number_episodes(rows, 1.0).orderBy("event_id").collect()
    assert [r.ep_index for r in found] == [0, 0, 0, 0, 1]  # equality stays inside; the long first event does not bridge


def test_prediction_of_an_unseen_context(spark):
    rows = events(spark, [("p", "A", 0, {}), ("p", "B", 100, {}), ("q", "Z", 0, {})])
    eps = episodes.build_episodes(rows, 1.0)
    found = {r.patient_id: r for r in episodes.predict_next(eps, episodes.transitions(eps)).collect()}
    assert (found["q"].next_type, found["q"].confidence, found["q"].gap_days) == ("Z", 0.3, 30.0)


@pytest.mark.parametrize(
    "seqs, how, has, lacks",
    [
        (["KLKL", "MKL", "LK"], {"min_support": 0.6}, {"KL": 2 / 3, "LK": 2 / 3}, ["MK", "KLK"]),
        (["RST", "TSR", "STR", "TRS"], {"min_support": 0.75, "min_length": 1}, {"R": 1.0, "S": 1.0, "T": 1.0}, ["RS", "ST", "TR"]),
        (["VVVV", "VVV", "WVVW"], {"min_length": 2, "max_length": 3, "min_support": 0.6}, {"VV": 1.0, "VVV": 2 / 3}, ["VVVV", "WV"]),
        (["G", "", "H"], {"min_support": 0.1}, {}, ["GH"]),
    ],
)
def test_mining(spark, seqs, how, has, lacks):
    rows = spark.createDataFrame([(str(k), list(s)) for k, s in enumerate(seqs)], "patient_id string, tokens array<string>")
    found = {"".join(r.pattern): r.support for r in sequence.mine_patterns(rows, **how).collect()}
    assert has.items() <= found.items() and not found.keys() & set(lacks)


def test_mining_against_brute_force(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ABC", k=rng.randint(0, 9))) for _ in range(60)]
    rows = spark.createDataFrame([(str(k), list(s)) for k, s in enumerate(seqs)], "patient_id string, tokens array<string>")
    found = {"".join(r.pattern): r.n for r in sequence.mine_patterns(rows, min_length=1, max_length=4, min_support=0.1).collect()}
    grams = {s[i : i + n] for s in seqs for n in range(1, 5) for i in range(len(s) - n + 1)}
    assert found == {g: c for g in grams if (c := sum(g in s for s in seqs)) >= 6}
    with pytest.raises(ValueError):
        sequence.mine_patterns(rows, min_length=3, max_length=2)


RULES = {"S": [("IN", "REST"), ("IN", "OUT")], "REST": [("CARE", "OUT"), ("CARE", "REST")], "IN": [("admit",)], "CARE": [("scan",), ("dose",)], "OUT": [("leave",)]}


def test_grammar(spark):
    g = sequence.Grammar(RULES)
    texts = ["admit scan dose leave", "scan leave admit", "", "admit leave"]
    rows = spark.createDataFrame([(t, t.split()) for t in texts], "t string, tokens array<string>")
    for beam in (None, 100):
        got = {r.t: r.matches for r in sequence.cyk(rows, g, beam=beam).collect()}
        assert got == dict(zip(texts, (True, False, False, True), strict=True))
    assert g.parse("admit dose leave".split())[1] == "(S (IN admit) (REST (CARE dose) (OUT leave)))"
    for bad in ({"S": [("A",)], "A": [("a",)]}, {"S": [("A", "A", "A")], "A": [("a",)]}):
        with pytest.raises(ValueError):
            sequence.Grammar(bad)
    longer = sequence.extend_with_patterns(g, [("scan", "dose", "scan"), ("CARE", "REST")])
    assert "P_0" in longer.rules and longer.parse("admit scan dose scan leave".split())[0] > -math.inf


def test_store_cascade_and_upsert(spark):
    rows = events(spark, [("p", "A", 0, {}), ("p", "B", 1, {})])
    refs = spark.createDataFrame([("e001", "e000", None)], "event_id string, ref_id string, relation string")
    ids = rows.where("event_id = 'e001'")
    kept, edges = store.delete(rows, refs, ids)
    assert kept.count() == 1 and edges.count() == 0
    assert store.delete(rows, refs, rows.where("event_id = 'e000'"))[1].count() == 1
    changed, edges = store.upsert(rows, ids.withColumn("event_type", F.lit("C")), refs=refs)
    assert {r.event_type for r in changed.collect()} == {"A", "C"} and edges.count() == 0
    assert store.with_references(rows, refs).where("event_id = 'e001'").first().references == {"e000": "references"}


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Laktat: 4,5 und laktat 9.1; CRP 12"), (2, "Sepsis, sepsis!")], "doc_id long, text string")
    assert [(r.attr, r.value) for r in scoring.extract_values(docs).collect()] == [("qlaktat", 4.5)]
    assert [(r.doc_id, r.code) for r in scoring.extract_conditions(docs).collect()] == [(2, "A41.9")]


def test_anomaly_history(spark):
    rows = events(spark, [("p", "L", k, {"x": float(x)}) for k, x in enumerate((1, 2, 3, 10, 2))] + [("q", "L", k, {"x": 5.0}) for k in range(5)])
    found = {r.event_id: r for r in scoring.detect_anomalies(rows, ranges={"x": (0.0, 4.0)}).collect()}
    assert found["e002"].z_score == 0 and found["e003"].z_score == 1.0 and found["e003"].ref_score == 1.0
    assert found["e009"].z_score == 0.0  # no spread


def test_platt(spark):
    rows = spark.createDataFrame([(i / 100, int(i > 50)) for i in range(100)], "s double, y int")
    a, b = scoring.fit_platt(rows, "s", "y")
    assert a > 1 and b < 0
    assert scoring.fit_platt(rows.limit(4), "s", "y") is None


def test_types(spark):
    """Probes of water and of ground: a name of their attribute is declared again further down, with another kind and range."""
    declared = [
        {"name": "probe", "attributes": {"ph": {"type": "float", "range": [7.5, 14], "required": True}, "layer": {"type": "enum", "values": ["top", "deep"]}}},
        {"name": "ground_probe", "parent": "probe", "attributes": {"ph": {"type": "int", "range": [1, 6]}}},
        {"name": "peat_probe", "parents": ["ground_probe", "probe"]},
    ]
    types, attrs = typesys.from_dict(spark, declared)
    closed = typesys.closure(types)
    assert {(r.name, r.ancestor): r.depth for r in closed.where("name <> ancestor").collect()} == {("ground_probe", "probe"): 1, ("peat_probe", "ground_probe"): 1, ("peat_probe", "probe"): 2}
    found = {(r.name, r.conflict) for r in typesys.conflicts(closed, attrs).collect()}
    assert found == {(n, c) for n in ("ground_probe", "peat_probe") for c in ("type_mismatch", "disjoint_range")}
    cases = [({"ph": 4}, True), ({"ph": 9}, False), ({"ph": "sour"}, False), ({"layer": "deep"}, True), ({"layer": "sky"}, False), ({"colour": 3}, False)]
    rows = events(spark, [("p", "peat_probe", 0, given) for given, _ in cases])
    assert [r.ok for r in typesys.validate_attributes(rows, closed, attrs).orderBy("event_id").collect()] == [ok for _, ok in cases]
    with pytest.raises(typesys.CycleError):
        typesys.topological([("peat", "moor"), ("moor", "bog"), ("bog", "peat")])


def _walks(graph, x, y):
    """All simple paths from x to y along edges of either direction."""
    inner = sorted(graph.nodes - {x, y})
    for n in range(len(inner) + 1):
        for middle in itertools.permutations(inner, n):
            path = [x, *middle, y]
            if all((a, b) in graph.edges or (b, a) in graph.edges for a, b in itertools.pairwise(path)):
                yield path


def _blocked(graph, path, given):
    for a, b, c in zip(path, path[1:], path[2:], strict=False):
        collides = (a, b) in graph.edges and (c, b) in graph.edges
        if (not ({b} | graph.descendants(b)) & given) if collides else b in given:
            return True
    return False


def test_graphs_against_their_paths():
    rng = random.Random(12)
    for _ in range(60):
        names = rng.sample("abcdefgh", 5)
        graph = causal.Graph()
        graph.nodes |= set(names)
        for k, a in enumerate(names):
            for b in names[k + 1 :]:
                if rng.random() < 0.45:
                    graph.add(a, b)
        x, y = rng.sample(names, 2)
        given = set(rng.sample(sorted(set(names) - {x, y}), rng.randint(0, 3)))
        walks = list(_walks(graph, x, y))
        assert graph.separated(x, y, given) == all(_blocked(graph, w, given) for w in walks)
        back = [w for w in walks if (w[1], w[0]) in graph.edges]
        assert graph.backdoor_paths(x, y) == sorted(back)
        sound = not given & graph.descendants(x) and all(_blocked(graph, w, given) for w in back)
        assert (graph.backdoor_violations(x, y, given) == []) == sound
        assert graph.backdoor_set(x, y) == {a for a, b in graph.edges if b == x and a != y}
        place = {n: k for k, n in enumerate(graph.order())}
        assert len(place) == 5 and all(place[a] < place[b] for a, b in graph.edges)
        for a, b in sorted(graph.edges)[:1]:
            with pytest.raises(ValueError):
                graph.add(b, a)
    assert graph.backdoor_set("x", "y") is None


def test_effect_and_structure(spark):
    rng = np.random.default_rng(0)
    z = (rng.random(2000) < 0.5).astype(float)
    t = (rng.random(2000) < 0.3 + 0.4 * z).astype(float)
    y = 0.5 * t + 0.6 * z + rng.normal(0, 0.3, 2000)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(z, t, y, strict=True)], "z double, t double, y double")
    assert abs(causal.ate(rows, "t", "y", ["z"]) - 0.5) < 0.1
    found = causal.refute(rows, "t", "y", ["z"])
    assert abs(found["placebo"]) < 0.1 and abs(found["subset"] - 0.5) < 0.1
    a, b = rng.normal(size=(2, 3000))
    c = a + b + rng.normal(0, 0.3, 3000)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, strict=True)], "a double, b double, c double")
    assert causal.learn_structure(rows, ["a", "b", "c"]).collect() == [("a", "c", True), ("b", "c", True)]
    edges = causal.bootstrap_edges(rows, ["a", "b", "c"], runs=8).where("stable").collect()
    assert {(r.source, r.target) for r in edges} == {("a", "c"), ("b", "c")}


def test_shapley_is_efficient(spark):
    rows = events(spark, [("p", "L", k, {"x": float(v)}) for k, v in enumerate((1, 5, 9, 2))] + [("q", "L", 0, {"x": 4.0})])
    phi = {r.patient_id: r.s for r in explain.shapley(rows, ["x"], digits=None).groupBy("patient_id").agg(F.sum("phi").alias("s")).collect()}
    assert abs(phi["p"] - 4.25 / 10) < 1e-9 and abs(phi["q"] - 0.4) < 1e-9
    first = explain.counterfactuals(rows, ["x"], target_reduction=0.1).where("patient_id = 'p'").first()
    assert (first.event_id, first.now) == ("e001", 0.5)
    found = {r.patient_id: r for r in explain.sufficient(rows, ["x"], epsilon=0.01).collect()}
    assert found["p"].is_sufficient and found["q"].event_ids == ["e004"]
    assert all(len(r.event_ids) <= 2 for r in explain.sufficient(rows, ["x"], epsilon=0.0, k_max=2).collect())


def test_explanations_see_all_events(spark):
    rows = events(spark, [("p", "L", k, {"x": 0.0}) for k in range(60)] + [("p", "L", 60, {"x": 305.0})])
    found = explain.counterfactuals(rows, ["x"], target_reduction=0.2).first()
    assert (found.event_id, found.now, round(found.score, 6)) == ("e060", 152.5, 0.5)
    found = explain.sufficient(rows, ["x"], epsilon=0.0).first()
    assert abs(found.full_score - 0.5) < 1e-9 and found.is_sufficient and "e060" in found.event_ids
    assert abs(explain.sufficient(rows, ["x"], epsilon=0.0, k_max=2).first().full_score - 0.5) < 1e-9


def test_counterfactual_query_is_whole(spark):
    d, sql = "/root/testdata/sf0.001", model_queries.SQL["counterfactuals"].replace("score - 0.05", "score - 0.005")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
        want = c.execute(f"SELECT patient_id, event_id, attr, score, new_score FROM ({sql.replace(' WHERE r < 5', '')})").fetchall()
    got = explain.counterfactuals(model_queries._scaled(spark, d), ["value", "k"], target_reduction=0.005).select("patient_id", "event_id", "attr", "score", "new_score").collect()
    assert want
    line = lambda r: (r[0], r[1], r[2], round(r[3], 5), round(r[4], 5))
    assert sorted(map(line, got)) == sorted(map(line, want))


def test_fuzzy_query_takes_all_pairs(spark, monkeypatch):
    d, how = "/root/testdata/sf0.001", {}
    monkeypatch.setattr(cohort_queries.temporal, "fuzzy_distribution", lambda pairs, **given: how.update(given) or pairs)
    assert cohort_queries.fuzzy_distribution(spark, d).count() == cohort_queries._pairs(spark, d).count()
    assert how.get("n_samples", 1000) == 1000


def test_privacy(spark):
    rng = random.Random(0)
    draws = [privacy.laplace(2.0, rng) for _ in range(40_000)]
    assert abs(sum(draws) / len(draws)) < 0.1 and abs(sum(map(abs, draws)) / len(draws) - 2) < 0.1
    noise = spark.range(40_000).select(privacy.laplace_column(F.lit(2.0), "id").alias("x")).agg(F.avg("x"), F.avg(F.abs("x"))).first()
    assert abs(noise[0]) < 0.1 and abs(noise[1] - 2) < 0.1
    budget = privacy.Budget(1.0)
    assert budget.spend(0.4) == 0.4 and abs(budget.spend() - 0.6) < 1e-12
    with pytest.raises(privacy.BudgetExhausted):
        budget.spend(0.1)
    assert spark.range(1).select(privacy.pseudonym(F.lit(None), "s").alias("p")).first().p == "p#none"


def test_migration(spark):
    rows = events(spark, [("p", "A", 0, {"x": "1.7"}), ("p", "A", 1, {"x": "abc", "unit": "mg"}), ("p", "B", 2, {})])
    done = evolution.migrate(rows, [("ren_type", "A", "C"), ("chg_attr", "x", "int"), ("add_attr", "unit", "g"), ("rem_type", "B")]).orderBy("event_id").collect()
    assert [r.cat.get("x") for r in done] == ["1", "abc", None] and [r.cat["unit"] for r in done] == ["g", "mg", "g"]
    assert [(r.event_type, r.rejected) for r in done] == [("C", False), ("C", False), ("B", True)]
    assert evolution.migration_path([("1", "2", ["a"]), ("2", "3", ["b"]), ("1", "4", [])], "1", "3") == ["a", "b"]
    assert evolution.migration_path([], "1", "2") is None
    assert evolution.compatibility([("add_attr", "x", 1)]) == {"backward": True, "forward": True, "full": True}
