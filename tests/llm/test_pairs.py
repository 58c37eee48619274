"""Near-duplicates and line dedup against brute force."""

import random
import re

import pytest

from episodica.llm import linededup, neardup

from .cases import ODD, documents


def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((6, 30, 120)))]
        out.append(" ".join(base))
        for k in range(rng.choice((0, 2, 25))):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy).replace(" ", rng.choice((" ", "  ", "\n"))).upper() if k % 3 == 0 else " ".join(copy))
    return out


def test_components_match_brute_force(spark):
    own = texts() + ODD + ["a b c", "A B\tc", "a b c d"]
    rows = list(enumerate(own))
    found = neardup.near_duplicates(documents(spark, own)).collect()
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None}
    assert got == want
    assert len(found) == len(own) + 2


@pytest.mark.parametrize("block", [2, 5])
def test_blocks_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    own = []
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        own.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(list(enumerate(own)))


def test_keep_one_and_empty(spark):
    docs = documents(spark, ["a b c d e f"] * 3 + ["other words are in here now", None, ""])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.keep_one(docs.limit(0)).count() == 0


def brute_lines(rows):
    def close(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        if len(a) == len(b):
            return a[k + 1 :] == b[k + 1 :]
        return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]

    places = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                places.setdefault(line, (doc_id, no))
    # Earliest first: a line stays unless an earlier one that stays is near; the first such one stands for it.
    owner, staying = {}, []
    for line in sorted(places, key=places.get):
        near = [x for x in staying if close(x, line)]
        owner[line] = near[0] if near else line
        if not near:
            staying.append(line)
    return {(d, no): places[owner[line]] for d, text in rows for no, line in enumerate((text or "").split("\n")) if line in places}


@pytest.mark.parametrize("piece", [4, 256])
def test_lines_match_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(linededup, "PIECE", piece)
    rng = random.Random(2)
    base = ["".join(rng.choices("abcde ", k=n)) + "." for n in (5, 12, 20, 25, 40, 300) for _ in range(3)]
    own = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(line))
                line[k : k + rng.choice((0, 1))] = rng.choice(("", "ü", "x"))
            lines.append("".join(line))
        own.append("\n".join(lines))
    own += ODD
    docs = documents(spark, own)
    rows = list(enumerate(own))
    got = {(r.id, r.no): (r.of_id, r.of_no) for r in linededup.line_classes(docs).collect() if r.id is not None}
    assert got == brute_lines(rows)
    clean = linededup.dedup_lines(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert linededup.line_classes(docs.limit(0)).count() == 0


def test_lines_of_repeated_and_missing_ids(spark):
    rows = [(5, "first line here\nan own line"), (5, "second text here\nan own line"), (5, "second text here\nan own line"), (None, "second text here!"), (None, "only here, no id"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = sorted(((r.doc_id or 99), r.text) for r in linededup.dedup_lines(docs).where("text IS NOT NULL").collect())
    one = clean[0][1], clean[1][1], clean[2][1]
    assert sorted(one)[-1] in ("second text here", "second text here\nan own line") and sum("own" in x for x in set(one)) == 1
    assert clean[3:] == [(99, ""), (99, "only here, no id")]


def test_permuted_lines_stay_linear(spark, monkeypatch):
    rng = random.Random(6)
    lines = {"record no " + "".join(rng.sample("0123456789", 10)) for _ in range(6000)} | {f"row {a}{b}" for a in "abcdefghij" for b in range(60)}
    docs = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string")
    sizes, own = [], linededup._near_pairs
    monkeypatch.setattr(linededup, "_near_pairs", lambda pairs, texts: sizes.append(pairs.count()) or own(pairs, texts))
    linededup.line_classes(docs).count()
    assert sizes and max(sizes) <= 4 * len(lines)
