"""Decontamination, toxicity, mixing and sharding."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from episodica.llm import decontaminate, mixing, sharding, toxicity

from .cases import ODD, documents

D = "/root/testdata/sf0.01"


def test_wu_manber_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice("a b c d e A É 1".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((0, 1, 3, 9, 10, 11, 14, 30))] + [(7, None), (8, "?!"), (3, "b-b-b")]
    own = [" ".join(word() for _ in range(n)) for n in (0, 1, 5, 40, 200)] + [f"x, {t.upper()}; y" for _, t in items if t] + ODD
    docs, bench = documents(spark, own), spark.createDataFrame(items, "item_id long, text string")
    for windows in (250_000, 3):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", windows)
        found = decontaminate.find_benchmark(docs, bench)
        for r in found.where("doc_id IS NOT NULL").collect():
            got = (r["__ep_words"], sum(s.b - s.a for s in r["__ep_spans"]), hashlib.sha256(",".join(r["__ep_items"]).encode()).hexdigest())
            assert got == decontaminate.brute_force(r.text, [(str(i), t) for i, t in items])
    assert decontaminate.find_benchmark(docs, bench.limit(0)).where("size(__ep_spans) > 0").count() == 0
    assert decontaminate.remove_contaminated(docs.limit(0), bench).count() == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert all((crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_shares_grams_with_misspellings():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("aeinrst", k=5))
    clean = [" ".join(word() for _ in range(60)) for _ in range(150)]
    bad = [" ".join([*(word() for _ in range(30)), rng.choice(("blockhead", "blockheads", "scoundrel")), *(word() for _ in range(30))]) for _ in range(60)]
    model = toxicity.train([t.encode() for t in clean + bad], [0] * 150 + [1] * 60)
    value = lambda w: np.mean(model.weights[toxicity.grams(w)])
    assert min(value(b"bl0ckhead"), value(b"scoundrell")) > max(value(word().encode()) for _ in range(50))


def test_toxicity_odd_cases(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.fit(docs, labels.limit(0)).prior == 0.0
    assert toxicity.remove_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 1")).prior == 1.0
    assert toxicity.remove_toxic(docs, labels.where("toxic = 0")).columns == docs.columns


def test_toxicity_repeats_and_borders(spark):
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    for word in (b"scoundrel", b"quiet"):
        weights[toxicity.grams(word)] = 8.0 if word == b"scoundrel" else -1.0
    model, calm = toxicity.Model(weights, -4.0, 0.25), ["quiet"] * 200
    texts = [" ".join(calm), " ".join(["scoundrel"] * 24), *(" ".join(calm[:k] + ["scoundrel"] * 12 + calm[k:]) for k in (0, 13, 94, 99, 200))]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert got[0] < 0.1 and min(got[1:-1]) > 0.3 and got[-1] == 0.25


def test_targets_water_filling():
    got = mixing.targets({"a": 100, "b": 10, "c": 0, None: 50}, {"a": 1, "b": 3, "c": 1, None: 1})
    assert got["b"] == 30 and got["c"] == 0 and abs(sum(got.values()) - 160) < 1e-9
    assert abs(got["a"] - 65) < 1e-9 and abs(got[None] - 65) < 1e-9


def test_split_quotas_are_exact():
    quota = mixing.split_quotas([7, 0, 100, 33], 6, seed=3)
    assert quota.sum(1).tolist() == [7, 0, 100, 33]
    assert max(quota.sum(0)) - min(quota.sum(0)) <= 3
    assert (quota == mixing.split_quotas([7, 0, 100, 33], 6, seed=3)).all()


def test_mix_takes_what_was_drawn(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    per = {r.doc_id: r for r in mixing.op6_mixing(spark, D).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for doc_id, r in per.items():
        assert r.taken <= 3 * r.size and r.taken == r.size * r.times
        taken[source[doc_id]] += r.taken
        target[source[doc_id]] = r.target
        largest[source[doc_id]] = max(largest[source[doc_id]], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    out = mixing.mix(docs)
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: r.times for d, r in per.items() if r.times})
    again = {(r.doc_id, r.mix_shard) for r in mixing.mix(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.mix_shard) for r in out.collect()} == again


def test_mix_odd_cases(spark):
    docs = documents(spark, [*ODD, *(f"w{i} some more words" for i in range(60))])
    assert mixing.mix(docs).columns == [*docs.columns, "mix_shard"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_query_counts_the_dealt_rows(spark, monkeypatch, tmp_path):
    docs = documents(spark, [*ODD, *(f"w{i} some more words" for i in range(300))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    dealt, deal, planned = [], mixing.split_quotas, mixing.op6_mixing(spark, str(tmp_path)).collect()
    monkeypatch.setattr(mixing, "split_quotas", lambda *how: dealt.append(deal(*how)) or dealt[-1])
    rows = mixing.op6_mixing(spark, str(tmp_path)).collect()
    assert len(dealt) == 1 and dealt[0].sum() > 0
    assert Counter(rows) == Counter(planned) and len(rows) == docs.count()
    held = Counter(r.doc_id for r in mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    times = Counter()
    for r in rows:
        times[r.doc_id] += r.times
        assert r.taken == r.size * r.times
    assert +times == held


def test_shards(spark):
    for docs in (spark.read.parquet(f"{D}/documents.parquet"), documents(spark, ODD + ["same text"] * 300)):
        for target in (sharding.TARGET_BYTES, 500):
            out = sharding.assign_shards(docs, 8, target_bytes=target)
            rows = out.collect()
            assert len(rows) == docs.count()
            size = [16 + len((r.text or "").encode()) for r in rows]
            assert [r.size for r in rows] == size
            held = Counter()
            for r in rows:
                held[r.shard] += r.size
            assert max(held.values()) - min(held[s] for s in range(8)) <= 2 * max(size)
            for s in range(8):
                assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(docs.limit(0), 8).count() == 0


def test_shards_divide_a_hot_text(spark, monkeypatch):
    rows = [(i, "one text that was copied very often") for i in range(1200)] + [(i, f"text {i} " * (i % 7)) for i in range(2000, 3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cells, own = [], sharding._placed
    monkeypatch.setattr(sharding, "_placed", lambda df, splits: cells.append(own(df, splits)) or cells[-1])
    for few in (10_000, 0):
        monkeypatch.setattr(sharding, "FEW", few)
        out = sharding.assign_shards(docs, 4, target_bytes=1000).collect()
        held = Counter()
        for r in out:
            held[r.shard] += r.size
        assert len(out) == len(rows) and max(held.values()) - min(held.values()) <= 2 * max(r.size for r in out)
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(4))
        assert cells[0].groupBy("__ep_range", "__ep_part", "__ep_sub").agg(F.sum("__ep_size").alias("b")).agg(F.max("b")).first()[0] <= 1000
        cells.clear()


def test_sharding_query(spark):
    rows = {r.doc_id: r for r in sharding.op10_sharding(spark, D).collect()}
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held, slots = Counter(), {}
    for d in docs:
        raw, r = (d.text or "").encode(), rows[d.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, crc32(raw), "bytes", None) and 0 <= r.shard < 40
        held[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(held.values()) - min(held.values()) <= 2 * max(r.size for r in rows.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mix_repeats_no_text_too_often(spark):
    rows = [(i, "a", "w " * 20) for i in range(200)] + [(1000 + i, "b", "" if i % 2 else "w w") for i in range(40)] + [(2000 + i, "c", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix_shard", F.lit("own"))
    held = Counter(r.doc_id for r in mixing.mix(docs, weights={"a": 1, "b": 50, "c": 1}).collect())
    assert max(held.values()) == 3 and all(held[1000 + i] == 3 for i in range(40)) and held[2000] == 1
    assert mixing.targets({"a": 5, "b": 5}, {"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}


def test_one_long_item_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 100)
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(420))
    words = long.split()
    docs = spark.createDataFrame([(k, " ".join(words[k * 20 : k * 20 + 15])) for k in range(20)] + [(99, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, long), (1, long), (None, words[0])], "item_id long, text string")
    sizes, scan = [], decontaminate._scan
    monkeypatch.setattr(decontaminate, "_scan", lambda d, t, w: sizes.append(len(w)) or scan(d, t, w))
    got = {r.doc_id: (sum(s.b - s.a for s in r["__ep_spans"]), r["__ep_items"]) for r in decontaminate.find_benchmark(docs, bench).collect()}
    assert len(sizes) == 5 and max(sizes) <= 200
    assert got == {99: (0, []), 0: (15, ["1", "null"]), **{k: (15, ["1"]) for k in range(1, 20)}}


def test_shards_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    a = sharding.assign_shards(docs, 8).select("doc_id", "shard", "slot")
    b = sharding.assign_shards(docs.repartition(5, F.rand(1)), 8).select("doc_id", "shard", "slot")
    assert a.exceptAll(b).count() == 0


def test_repeated_rows_do_not_fill_the_sample(spark):
    rows = spark.range(1_000_000).selectExpr("0L as __ep_key", "7L as __ep_id", "cast(20 as long) as __ep_size")
    rows = rows.unionByName(spark.range(30_000).selectExpr("xxhash64(id) as __ep_key", "id as __ep_id", "cast(20 as long) as __ep_size"))
    drawn = sharding._sample(rows, 20 * 1_030_000)
    assert 1 <= drawn.count() < 20_000
    cuts = sharding._splitters(rows, 20 * 1_030_000, 64)
    assert cuts == sorted(set(cuts)) and len(cuts) <= 64
