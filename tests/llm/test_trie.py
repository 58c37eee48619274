"""The prefix trie against direct enumeration, and odd rows."""

import random
from collections import defaultdict
from zlib import crc32

from episodica.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, n_convs int, depth int"


def brute(rows):
    """Nodes of the rebuilt conversations by path: (members, children, leaves, savings, ends)."""
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [x[2:] for x in sorted(t)] for c, t in talks.items()}
    paths = {}
    for c, own in talks.items():
        h = crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(talks.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        leaf = lambda p: not any(q[:-1] == p for q in members if q)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        children = sum(1 for p in under if len(p) == len(path) + 1)
        out.append((own[0], len(path), members[path[:-1]][0] if path else None, len(own), children, sum(map(leaf, under)), saved, [c for c in own if paths[c] == path]))
    return sorted(out, key=str)


def found(spark, rows):
    turns, ids = trie.rebuild(spark.createDataFrame(rows, SCHEMA).repartition(3))
    nodes, ends = trie.trie(turns, ids)
    ended = defaultdict(list)
    for r in ends.collect():
        ended[bytes(r.node)].append(r.conv_id)
    nodes = nodes.collect()
    assert len({bytes(r.node) for r in nodes}) == len(nodes)
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sorted(ended[bytes(r.node)])) for r in nodes), key=str)


def test_trie_equals_enumeration(spark):
    rng = random.Random(7)
    rows = []
    for c in [*range(-3, 25), 1000, 1001]:
        same = rng.random() < 0.5
        for t in range(rng.choice([1, 2, 5, 9, 12, 33])):
            text = f"t{t}" if same else rng.choice(["t0", "ä", "b", None, ""])
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]) if not same else "user", text, "x", 1, 2))
    rows += rows[-2:] + [(None, 1, "user", "nobody's", "x", 1, 2)]
    assert found(spark, rows) == brute(rows)


def test_odd_tables(spark):
    assert found(spark, []) == []
    alone = [(7, None, None, None, None, None, None)]
    assert found(spark, alone) == brute(alone)
    # Without its base, a conversation whose own turns end before h has none at all.
    silent = next(c for c in range(1, 200) if c % 5 and crc32(str(c).encode()) % 9 > 0)
    assert found(spark, [(silent, 0, "user", "x" * 100_000, None, None, None)]) == [(silent, 0, None, 1, 0, 1, 0, [silent])]


def test_chain_takes_logarithmic_rounds(spark, monkeypatch):
    written = []
    keep = trie.stash
    monkeypatch.setattr(trie, "stash", lambda df, name: written.append(name) or keep(df, name))
    nodes = spark.createDataFrame([(k, k - 1 if k else None, 1) for k in range(100)], "node long, parent long, n long")
    assert {r.node: r.n for r in trie.roll_up(nodes, ["n"]).collect()} == {k: 100 - k for k in range(100)}
    assert len(written) <= 8
