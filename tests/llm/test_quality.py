import re
from collections import Counter

from episodica.llm import quality

from .cases import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(rows):
    for r in rows:
        assert tuple(r[c] for c in NAMES) == brute(r.text), r.text[:80]
        assert not (r.base_failed and r.kept)


def test_counts_match_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(quality.clean_lines(rows).collect())


def test_odd_cases(spark):
    docs = documents(spark, ODD)
    rows = quality.clean_lines(docs).collect()
    assert len(rows) == len(ODD) + 2
    check(rows)
    assert quality.clean_lines(docs.limit(0)).count() == 0


def test_verdicts(spark):
    names = "river town plain hill lake shore field road wood moor farm mill".split()
    texts = [
        "\n".join(f"One {a} beside that {b} was quiet, {a} dwellers say." for a, b in zip(names, reversed(names))),
        "\n".join(f"home{i} | about{i} | shop{i} | help{i} | news{i} | jobs{i}" for i in range(20)),
        "\n".join(f"wo{i}rd*** th{i}at### of&&& b{i}c$$$ de%%% f{i}g***." for i in range(20)),
        "\n".join(f"WHAT{chr(65 + i)}!! IS!! TH{chr(65 + i)}S!! NOW!! AND{chr(65 + i)}!!" for i in range(20)),
    ]
    rows = quality.clean_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert not any(r.base_failed for r in rows)
    assert [r.kept for r in rows] == [True, False, False, False]


def test_labelled_quality(spark):
    d = "/root/testdata/sf0.1"
    kept = quality.op9_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    share = {(r.quality, r.kept): r["count"] for r in kept.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert share[(1, True)] > 0.97 * (share[(1, True)] + share.get((1, False), 0))
    assert share.get((0, False), 0) > 0.9 * (share.get((0, False), 0) + share.get((0, True), 0))
