"""The pipeline against its stages' rules, step by step."""

import re
from collections import Counter

import corpus_pipeline
from episodica.llm import decontaminate, toxicity

from .test_pairs import brute_components

D = "/root/testdata/sf0.001"


def test_stages(spark, monkeypatch):
    # Fewer steps of learning: the stages are tested, not the model.
    monkeypatch.setattr(toxicity, "UPDATES", 60)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    whole = Counter(map(tuple, docs.collect()))
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, D)
        rows = out.collect()
        kept[name] = rows
        assert {tuple(r[c] for c in docs.columns) for r in rows} <= whole.keys()
        before = at.collect()
        if name == "near_duplicates":
            found = brute_components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(d for d, (_, c) in found.items() if c == d)
        elif name == "decontamination":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before if not decontaminate.brute_force(r.text, bench)[1])
        elif name == "mixing":
            times = Counter(r.doc_id for r in rows)
            assert max(times.values()) <= 3
            words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rs)
            assert abs(words(rows) - words(before)) <= 0.2 * words(before)
        elif name == "sharding":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before)
            assert {(r.shard, r.slot) for r in rows} == {(s, k) for s, n in Counter(r.shard for r in rows).items() for k in range(n)}
        if name != "sharding":
            assert out.columns == docs.columns
            at = spark.createDataFrame(rows, docs.schema)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert len(kept["toxicity"]) >= 0.7 * sum(not labels.get(d[0]) for d in whole)


def test_run_is_the_stages_in_order(spark, monkeypatch):
    """``run`` writes and rereads between stages; its rows are those of the stages called by hand."""
    monkeypatch.setattr(toxicity, "UPDATES", 60)
    at = spark.read.parquet(f"{D}/documents.parquet")
    columns = at.columns
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, spark.createDataFrame(at.collect(), at.schema), D)
    found = corpus_pipeline.run(spark, D)
    assert set(columns) <= set(found.columns) and found.columns == at.columns
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == Counter(tuple(r[c] for c in columns) for r in at.collect())


def test_stages_of_odd_tables(spark, monkeypatch):
    """Null, empty and repeated texts, null ids and an empty table pass every stage."""
    monkeypatch.setattr(toxicity, "UPDATES", 60)
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words " * 30, "en", "a", 5), (3, "same words " * 30, "en", "a", 5), (None, "no id", "en", None, 5), (4, "   ", "en", "b", 3)]
    for own in (rows, []):
        at = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, D)
            got = out.collect()
            assert {r.doc_id for r in got} <= {r[0] for r in own}
            if own and name not in ("mixing", "sharding"):  # the mix may take a document no times
                assert {1, 2, 4} <= {r.doc_id for r in got}
            if name != "sharding":
                at = spark.createDataFrame(got, schema)
