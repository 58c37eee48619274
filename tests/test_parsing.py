"""Chart parsing over arrays against a plain chart, cell by cell; long sequences."""

import math
import random
import time

import pytest

from episodica.operators import sequence


def plain(grammar, tokens, beam=None):
    """The chart as a dictionary of spans; of equals the earliest split wins, then the first production."""
    n, cell = len(tokens), {}
    for span in range(1, n + 1):
        for i in range(n - span + 1):
            best = {}
            for left, productions in grammar.rules.items():
                for k in range(1, span) if span > 1 else [0]:
                    for p in productions:
                        chance = grammar.probabilities[left, tuple(p)]
                        if chance <= 0 or len(p) != (2 if span > 1 else 1):
                            continue
                        if span == 1:
                            found = (math.log(chance), f"({left} {p[0]})") if p[0] == tokens[i] else None
                        else:
                            a, b = cell[i, k].get(p[0]), cell[i + k, span - k].get(p[1])
                            found = (math.log(chance) + a[0] + b[0], f"({left} {a[1]} {b[1]})") if a and b else None
                        if found and (left not in best or best[left][0] < found[0]):
                            best[left] = found
            if beam and span > 1:
                best = dict(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:beam])
            cell[i, span] = best
    return cell[0, n].get(grammar.start, (-math.inf, None)) if n else (-math.inf, None)


def grammar(rng):
    names = ["S", "A", "B", "C"][: rng.randint(2, 4)]
    rules = {x: list({rng.choice([(rng.choice("xyz"),), (rng.choice(names), rng.choice(names))]) for _ in range(rng.randint(1, 4))} | {(rng.choice("xyz"),)}) for x in names}
    chances = {(x, p): rng.choice([0.5, 0.25, 0.125, rng.random()]) for x, ps in rules.items() for p in ps}
    return sequence.Grammar(rules, "S", chances)


@pytest.mark.parametrize("beam", [None, 1, 2])
def test_parses_equal_a_plain_chart(beam):
    rng = random.Random(beam or 9)
    parsed = 0
    for _ in range(40):
        g = grammar(rng)
        texts = [[rng.choice("xyz") for _ in range(rng.randint(0, 7))] for _ in range(6)]
        for tokens, (p, tree) in zip(texts, g.parse_all(texts, beam), strict=True):
            want = plain(g, tokens, beam)
            assert tree == want[1] and (p == want[0] or math.isclose(p, want[0]))
            parsed += tree is not None
    assert parsed > 20


def test_a_thousand_tokens_in_seconds():
    g = sequence.Grammar({"S": [("A", "S"), ("S", "B"), ("x",)], "A": [("x",), ("A", "A")], "B": [("y",), ("B", "B")]})
    start = time.time()
    p, tree = g.parse(["x"] * 500 + ["y"] * 500)
    assert math.isfinite(p) and tree.count("(S ") >= 1 and tree.count(" x)") == tree.count(" y)") == 500
    assert time.time() - start < 120


def test_sequences_that_cannot_match(spark):
    g = sequence.Grammar({"S": [("A", "A")], "A": [("x",)]})
    rows = spark.createDataFrame([(1, ["x", "x"]), (2, ["x"]), (3, []), (4, None), (5, ["x", "x"]), (6, ["?", "x"])], "id int, tokens array<string>")
    found = {r.id: (r.matches, r.probability, r.tree) for r in sequence.cyk(rows, g).collect()}
    assert found[1] == found[5] == (True, 1.0, "(S (A x) (A x))")
    assert {found[k] for k in (2, 3, 4, 6)} == {(False, 0.0, None)}
