"""Conversation repair against all edits there are, on small conversations, and odd rows."""

import itertools
import random
import re
from hashlib import sha256

from episodica.llm import repair
from episodica.llm.repair import _close, _Conversation, _step

LEGAL = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Least (cost, audit) over every edit of every row and up to two inserted turns at each place."""
    inserts = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    each = []
    for initial, fault in rows:
        options = [("D", "", 2)]
        if fault not in (1, 2):
            cut = 5 if fault == 3 else 0
            options += [("K", initial, cut), ("R", "u", cut + 1), ("R", "a", cut + 1)]
        each.append(options)
    best = None
    for edits in itertools.product(*each):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "".join(places[0]), "I" * len(places[0]), 5 * len(places[0])
            for (edit, role, c), more in zip(edits, places[1:], strict=True):
                roles, audit, cost = roles + role + "".join(more), audit + edit + "I" * len(more), cost + c + 5 * len(more)
            if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_search_equals_all_edits():
    rng = random.Random(3)
    for _ in range(120):
        rows = [(rng.choice("suuaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
        talk, layer = _Conversation(), _close([(0, ""), None, None, None])
        edits = [e for k, (i, f) in enumerate(rows) for e in talk.add(k, i, str(k), f)]
        for i, f in rows:
            layer = _step(layer, i, f)
        rest, told = talk.end()
        assert told[-2:] == brute(rows) == min(x for x in (layer[0], layer[3]) if x)
        assert LEGAL.fullmatch("".join(r[0] for _, e, r, _ in edits + rest if e != "D"))
        assert "".join(e for _, e, _, _ in edits + rest) == told[-1]


def test_long_conversations_are_not_held():
    talk = _Conversation()
    most = 0
    for k in range(5000):
        talk.add(k, "assistant" if k % 6 == 0 else "user", f"text {k}.", 0)
        most = max(most, len(talk.rows), *(len(x[1]) for x in talk.layer if x))
    assert most < 20


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, edit string, report int, n int, __x int"
    extra = ("clash", 1, 2, 3)
    rows = [
        (1, 0, "system", "Be kind.", *extra),
        (1, 1, "user", "Hi.", *extra),
        (1, 1, "user", "Hi.", *extra),
        (1, 2, "assistant", "Hello." + " x" * 50000 + ".", *extra),
        (2, None, None, None, *extra),
        (2, 5, "", "Say it.", *extra),
        (3, 9, "assistant", "Cut", *extra),
        (None, 2, "assistant", "B.", *extra),
        (None, 1, "user", "A.", *extra),
        (None, 7, None, "  \n", *extra),
    ]
    edits = repair.repair(spark.createDataFrame(rows, schema).repartition(3))
    told = {r.conv_id: r for r in repair.report(edits).collect()}
    assert {k: (r.audit, r.cost) for k, r in told.items()} == {1: ("KKDK", 2), 2: ("DD", 4), 3: ("D", 2), None: ("KKD", 2)}
    assert (told[1].duplicate, told[2].blank, told[3].truncated, told[1].illegal, told[None].gaps) == (1, 1, 1, 1, 4)
    left = [(r.role, r.text[:6]) for r in repair.repaired(edits).where("conv_id = 1").orderBy("turn").collect()]
    assert left == [("system", "Be kin"), ("user", "Hi."), ("assistant", "Hello.")]
    assert repair.report(repair.repair(spark.createDataFrame([], schema))).count() == 0


def test_conversation_without_rows_after_damage(spark, tmp_path):
    # crc32("130:0") % 20 == 0 and so on: ids are searched for, whose only row is dropped.
    from zlib import crc32

    gone = next(k for k in range(1000) if crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = repair.op13_repair(spark, str(tmp_path)).collect()
    assert (row.conv_id, row.cost, row.audit, row.gaps, row.repaired_sha256) == (gone, 0, "", 0, sha256(b"").hexdigest())
