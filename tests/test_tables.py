"""Tables on disk, stored models, the shared budget, and edits of the type hierarchy."""

import random
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from episodica.operators import models, privacy, tables, typesys

SCHEMA = "event_id string, patient_id string, event_type string, t_start timestamp_ntz"


def events(spark, ids, kind="a"):
    return spark.createDataFrame([(i, "p", kind, datetime(2026, 1, 1)) for i in ids], SCHEMA)


def files(path):
    found = {}
    for f in Path(path, "data").glob("id_part=*/*.parquet"):
        found.setdefault(int(f.parent.name.split("=")[1]), set()).add(f.name)
    return found


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create(events(spark, [*map(str, range(200)), None]), path, parts=8)
    before = files(path)
    assert set(before) == set(range(8))
    touched = tables.upsert(spark, path, events(spark, ["7", "new"], "b"))
    after = files(path)
    assert 1 <= len(touched) <= 2
    assert all(before[k] == after[k] for k in range(8) if k not in touched) and all(before[k] != after[k] for k in touched)
    rows = {r.event_id: r.event_type for r in tables.read(spark, path).collect()}
    assert len(rows) == 202 and rows["7"] == rows["new"] == "b" and rows["8"] == "a" and None in rows
    before = files(path)
    assert tables.update(spark, path, events(spark, ["8", "none"], "c")) and tables.delete(spark, path, events(spark, ["9"]))
    rows = {r.event_id: r.event_type for r in tables.read(spark, path).collect()}
    assert len(rows) == 201 and rows["8"] == "c" and "9" not in rows and "none" not in rows
    assert tables.upsert(spark, path, events(spark, [])) == []
    with pytest.raises(Exception):
        tables.create(events(spark, ["x"]), path)


def test_a_partition_that_is_emptied_stays_empty(spark, tmp_path):
    path, ids = str(tmp_path / "t"), [str(k) for k in range(60)]
    tables.create(events(spark, ids), path, parts=4)
    part = events(spark, ids).where(tables.part_of(4) == 2)
    tables.delete(spark, path, part)
    left = tables.read(spark, path)
    assert left.count() == 60 - part.count() and left.where(tables.part_of(4) == 2).isEmpty()
    tables.upsert(spark, path, part)
    assert tables.read(spark, path).count() == 60


def test_old_references_are_upgraded_once(spark, tmp_path):
    path = str(tmp_path / "refs")
    old = spark.createDataFrame([("a", "b"), ("c", "d")], "event_id string, ref_id string")
    old.write.parquet(f"{path}/batch=1")
    assert {r.relation for r in tables.read_references(spark, path).collect()} == {"references"}
    old.withColumn("relation", F.lit("part_of")).write.parquet(f"{path}/batch=2")
    assert tables.upgrade_references(spark, path) == [1] and tables.upgrade_references(spark, path) == []
    assert sorted(r.relation for r in tables.read_references(spark, path).collect()) == ["part_of"] * 2 + ["references"] * 2


def test_a_stream_takes_the_model_in_use(spark, tmp_path):
    path, out = str(tmp_path / "models"), str(tmp_path / "out")
    assert models.current(spark, path) is None
    model = lambda then: spark.createDataFrame([("a", then)], "event_type string, next_type string")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    go = lambda: models.predict_stream(stream(), path, out_path=out, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert models.save(model("x"), path) == 1
    events(spark, ["1"]).write.parquet(str(tmp_path / "in"))
    go()
    assert models.save(model("y"), path) == 2
    events(spark, ["2"]).unionByName(events(spark, ["3"], "unknown")).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    models.use(spark, path, 1)
    events(spark, ["4"]).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    found = {r.event_id: (r.next_type, r.model) for r in spark.read.parquet(out).collect()}
    assert found == {"1": ("x", 1), "2": ("y", 2), "3": (None, 2), "4": ("x", 1)}
    assert models.load(spark, path, 2).first().next_type == "y"


def test_a_running_stream_changes_its_model(spark, tmp_path):
    path, out = str(tmp_path / "models"), str(tmp_path / "out")
    model = lambda then: spark.createDataFrame([("a", then)], "event_type string, next_type string")
    models.save(model("x"), path)
    events(spark, ["1"]).write.parquet(str(tmp_path / "in"))
    query = models.predict_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), path, out_path=out, checkpoint=str(tmp_path / "c"), once=False)
    try:
        query.processAllAvailable()
        models.save(model("y"), path)
        events(spark, ["2"]).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r.event_id: r.next_type for r in spark.read.parquet(out).collect()} == {"1": "x", "2": "y"}


def test_sessions_share_one_budget(spark, tmp_path):
    path = str(tmp_path / "ledger")
    two = [privacy.StoredBudget(spark, path, 1.0) for _ in range(2)]
    got, refused = [], []

    def spend(budget):
        for _ in range(8):
            try:
                got.append(budget.spend(0.1))
            except privacy.BudgetExhausted:
                refused.append(budget)

    threads = [threading.Thread(target=spend, args=(b,)) for b in two]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(got) == pytest.approx(1.0) and len(got) == 10 and len(refused) == 6
    again = privacy.StoredBudget(spark, path, 1.0)
    assert again.left == pytest.approx(0.0)
    with pytest.raises(privacy.BudgetExhausted):
        again.spend()
    with pytest.raises(ValueError):
        privacy.StoredBudget(spark, path, 2.0)
    (Path(path) / "000000011").write_text("")  # a session that died while it wrote
    assert privacy.StoredBudget(spark, path, 1.0).left == 0.0


def test_federated_noise_needs_a_seed(spark):
    rows = spark.createDataFrame([("i", "p")], "institution_id string, patient_id string")
    with pytest.raises(ValueError):
        privacy.federated_counts(rows, rows.selectExpr("institution_id", "1.0d as epsilon"))


def test_edits_keep_the_closure(spark):
    rng, edges = random.Random(8), [("t0", None)]
    types = spark.createDataFrame(edges, "name string, parent string")
    closed = typesys.closure(types)
    names = ["t0"]
    for k in range(1, 51):
        if rng.random() < 0.5 or len(names) < 3:
            parent = rng.choice([*names, None])
            types, closed = typesys.add_type(types, closed, f"t{k}", parent)
            names.append(f"t{k}")
        else:
            child, parent = rng.sample(names, 2)
            below = {r.name for r in closed.where(F.col("ancestor") == child).collect()}
            if parent in below:
                with pytest.raises(ValueError):
                    typesys.add_edge(types, closed, child, parent)
            else:
                types, closed = typesys.add_edge(types, closed, child, parent)
        # The plan would grow with every edit; rows are as they would be read back from a table.
        types, closed = (spark.createDataFrame(x.collect(), x.schema) for x in (types, closed))
    whole = {tuple(r) for r in typesys.closure(types).select("name", "ancestor", "depth").collect()}
    assert {tuple(r) for r in closed.select("name", "ancestor", "depth").collect()} == whole
    for bad in (lambda: typesys.add_type(types, closed, "t0"), lambda: typesys.add_type(types, closed, "new", "none"), lambda: typesys.add_edge(types, closed, "t0", "t0"), lambda: typesys.add_edge(types, closed, "none", "t0")):
        with pytest.raises(ValueError):
            bad()
