"""Language ID: code lengths against plainly counted context trees, odd texts, held-out accuracy."""

import random
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest

from episodica.llm import language
from episodica.llm.language import ORDER

from .cases import ODD, documents


def trees(texts):
    tree = defaultdict(Counter)
    for text in texts:
        data = b"\n" * ORDER + text
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                tree[data[i - k : i]][data[i]] += 1
    return tree


def brute_bits(tree, text):
    data, bits = b"\n" * ORDER + text, 0.0
    for i in range(ORDER, len(data)):
        for k in range(ORDER, -1, -1):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += log2(whole / seen[data[i]])
                break
            bits += log2(whole / len(seen))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_counted_trees(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 64)  # texts are cut into pieces, and several share one
    rng = random.Random(1)
    made = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    texts = {"x": [made(b"abc d", 300), made(b"abc", 5), b"a"], "y": [made(b"bcd\xc3\xa9 ", 400)], "z": [b"\n\n\n\n\n\x00\xff"]}
    model = language.train(texts)
    asked = [made(b"abcd \xc3\xa9q\x00\n", rng.randint(1, 200)) for _ in range(40)] + [b"", b"\xff", made(b"abc d", 1000)]
    found = model.totals(asked)
    for k, name in enumerate(model.names):
        own = trees(texts[name])
        assert np.allclose(found[:, k], [brute_bits(own, t) for t in asked], rtol=1e-5, atol=1e-3)


def test_index_finds_exactly_its_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    index = language.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, 5000, dtype=np.uint64), keys)
    assert (index.find(other) == -1).all()
    assert (language.Index(keys[:0]).find(other) == -1).all()


def test_odd_texts(spark):
    docs = documents(spark, ODD)
    model = language.fit(docs)
    assert model.names == ["en"]
    rows = language.predict(docs, model, output="lang", score="score").collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang, r.score) == (("en", 1.0) if letters else ("und", 0.0))
    nothing = docs.limit(0)
    assert language.predict(nothing, model).count() == 0
    empty = language.fit(nothing)
    assert {(r.lang_pred, r.kept) for r in language.predict(docs, empty, score="kept").collect()} == {("und", 0.0)}


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_BYTES", 4000)
    rows = [(1, "the same words again " * 5, "en")] * 500 + [(k, f"autre texte {k} " * 3, "fr") for k in range(300)] + [(k, "other words " + "xyz"[k % 3] * (k % 40), "en") for k in range(300, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    found = {(r.lang, r.lang_pred) for r in language.predict(docs, model).select("lang", "lang_pred").distinct().collect()}
    assert found == {("en", "en"), ("fr", "fr")}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "text", str(k)) for k in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.fit(docs)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = language.op11_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
