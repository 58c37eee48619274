"""Event sequences, contiguous pattern mining and context-free grammars over event types."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequences(events: DataFrame) -> DataFrame:
    """``patient_id, tokens``: types in order of start, ties by event_id."""
    rows = events.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("t_start", "event_id", "event_type"))).alias("s"))
    return rows.select("patient_id", F.transform("s", lambda x: x["event_type"]).alias("tokens"))


def mine_patterns(seqs: DataFrame, *, min_length: int = 2, max_length: int = 5, min_support: float = 0.3) -> DataFrame:
    """Contiguous patterns: ``pattern, length, n, support`` with support = sequences that hold it / all.

    Every sequence emits its distinct n-grams once; they are counted with map-side partial sums, so the
    shuffle carries patterns and counts, not sequences. Ordered by support, then longer, then by name.
    """
    if min_length < 1 or max_length < min_length or not 0 <= min_support <= 1:
        raise ValueError("need 1 <= min_length <= max_length and 0 <= min_support <= 1")
    total = seqs.count()
    size = F.size("tokens")

    def of(n: int):
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice("tokens", i, n))

    grams = F.array_distinct(F.flatten(F.array(*[of(n) for n in range(min_length, max_length + 1)])))
    counted = seqs.select(F.explode(grams).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    kept = counted.where((F.col("n") >= min_support * total - 1e-9) & (F.col("n") > 0))
    return kept.select("pattern", F.size("pattern").alias("length"), "n", (F.col("n") / max(total, 1)).alias("support")).orderBy(F.desc("support"), F.desc("length"), "pattern")


@dataclass
class Grammar:
    """Probabilistic grammar in Chomsky normal form: ``{nonterminal: [production, ...]}``.

    A production is (terminal,) or (nonterminal, nonterminal). Missing probabilities are uniform.
    """

    rules: dict[str, list[tuple[str, ...]]]
    start: str = "S"
    probabilities: dict[tuple[str, tuple[str, ...]], float] = field(default_factory=dict)

    def __post_init__(self):
        for left, productions in self.rules.items():
            for p in productions:
                if len(p) not in (1, 2) or len(p) == 1 and p[0] in self.rules or len(p) == 2 and not all(x in self.rules for x in p):
                    raise ValueError(f"not in normal form: {left} -> {' '.join(p)}")
                self.probabilities.setdefault((left, tuple(p)), 1 / len(productions))

    def parse(self, tokens, beam: int | None = None) -> tuple[float, str | None]:
        """Best log probability (-inf: no parse) and its tree in brackets; see :meth:`parse_all`."""
        return self.parse_all([list(tokens)], beam)[0]

    def parse_all(self, sequences: list[list[str]], beam: int | None = None) -> list[tuple[float, str | None]]:
        """:meth:`parse` of many sequences; those of one length share the numpy planes of a chart.

        Of equally good parses the one with the earliest split wins, then the first production. With
        ``beam`` only that many nonterminals of each span are kept, the best by probability, then name.
        """
        chart = _Chart(self)
        out: list = [(-math.inf, None)] * len(sequences)
        by_length: dict[int, list[int]] = {}
        for at, tokens in enumerate(sequences):
            by_length.setdefault(len(tokens), []).append(at)
        for n, places in by_length.items():
            room = max(1, PLANES // (len(chart.names) * (n + 1) ** 2))
            for lo in range(0, len(places) if n else 0, room):
                some = places[lo : lo + room]
                for at, found in zip(some, chart.fill([sequences[k] for k in some], n, beam), strict=True):
                    out[at] = found
        return out


#: Numbers in a plane of a chart, over all nonterminals and sequences that are parsed together.
PLANES = 4_000_000


class _Chart:
    """Chart parsing over arrays: a span length at a time, all starts, splits and sequences at once."""

    def __init__(self, grammar: Grammar):
        self.names = sorted(grammar.rules)
        self.start = self.names.index(grammar.start) if grammar.start in grammar.rules else None
        number = {name: k for k, name in enumerate(self.names)}
        self.terminal: dict[str, list[tuple[int, float]]] = {}
        self.binary: list[list[tuple[int, int, float]]] = [[] for _ in self.names]
        for left, productions in grammar.rules.items():
            for production in dict.fromkeys(map(tuple, productions)):
                p = grammar.probabilities[left, production]
                if p > 0 and len(production) == 1:
                    self.terminal.setdefault(production[0], []).append((number[left], math.log(p)))
                elif p > 0:
                    self.binary[number[left]].append((number[production[0]], number[production[1]], math.log(p)))

    def fill(self, sequences: list[list[str]], n: int, beam: int | None) -> list[tuple[float, str | None]]:
        m, size = len(self.names), len(sequences)
        # Scores by nonterminal, sequence, start and length; and the same by end, so that splits are slices of both.
        starts = np.full((m, size, n + 1, n + 1), -np.inf)
        ends = np.full((m, size, n + 1, n + 1), -np.inf)
        split = np.zeros((m, size, n + 1, n + 1), np.int32)
        rule = np.zeros((m, size, n + 1, n + 1), np.int16)
        for b, tokens in enumerate(sequences):
            for i, t in enumerate(tokens):
                for left, p in self.terminal.get(t, ()):
                    starts[left, b, i, 1] = ends[left, b, i + 1, 1] = p
        live = [bool(np.isfinite(starts[k]).any()) for k in range(m)]
        for span in range(2, n + 1):
            here = n - span + 1
            best = np.full((m, size, here), -np.inf)
            for left, productions in enumerate(self.binary):
                for number, (x, y, p) in enumerate(productions):
                    if not live[x] or not live[y]:
                        continue
                    both = (p + starts[x, :, :here, 1:span]) + ends[y, :, span:, span - 1 : 0 : -1]
                    at = both.argmax(2)
                    score = np.take_along_axis(both, at[:, :, None], 2)[:, :, 0]
                    better = (score > best[left]) | (np.isfinite(score) & (score == best[left]) & (at + 1 < split[left, :, :here, span]))
                    best[left][better] = score[better]
                    split[left, :, :here, span][better] = at[better] + 1
                    rule[left, :, :here, span][better] = number
            if beam and beam < m:
                order = np.argsort(-best, axis=0, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(np.arange(m)[:, None, None], order.shape), 0)
                best[rank >= beam] = -np.inf
            starts[:, :, :here, span] = best
            ends[:, :, span:, span] = best
            live = [a or bool(np.isfinite(best[k]).any()) for k, a in enumerate(live)]
        none = (-math.inf, None)
        if self.start is None:
            return [none] * size
        return [(float(starts[self.start, b, 0, n]), self._tree(tokens, b, n, split, rule)) if np.isfinite(starts[self.start, b, 0, n]) else none for b, tokens in enumerate(sequences)]

    def _tree(self, tokens: list[str], b: int, n: int, split, rule) -> str:
        """The tree in brackets; a stack instead of recursion, as a long sequence gives a deep tree."""
        out, todo = [], [(self.start, 0, n)]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                out.append(at)
                continue
            left, i, span = at
            if span == 1:
                out.append(f"({self.names[left]} {tokens[i]})")
                continue
            k = int(split[left, b, i, span])
            x, y, _ = self.binary[left][rule[left, b, i, span]]
            out.append(f"({self.names[left]} ")
            todo += [")", (y, i + k, span - k), " ", (x, i, k)]
        return "".join(out)


def cyk(seqs: DataFrame, grammar: Grammar, *, beam: int | None = None) -> DataFrame:
    """``seqs`` plus ``matches``, ``probability``, ``tree`` (null with a beam) by chart parsing, Arrow batches.

    Equal sequences are parsed once: they are grouped first, so hot sequences cost one parse. A sequence
    of n tokens takes memory of n^2 numbers for each nonterminal. Null sequences do not match.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = grammar.parse_all([[] if t is None else list(t) for t in batch["tokens"]], beam)
            yield batch.assign(matches=[p > -math.inf for p, _ in found], probability=[math.exp(p) for p, _ in found], tree=[None if beam else t for _, t in found])

    once = seqs.select("tokens").distinct().mapInPandas(run, "tokens array<string>, matches boolean, probability double, tree string")
    if "tokens" in seqs.columns and seqs.schema["tokens"].nullable:
        same = once.withColumnRenamed("tokens", "__tokens")
        return seqs.join(same, F.col("tokens").eqNullSafe(F.col("__tokens")), "left").drop("__tokens")
    return seqs.join(once, "tokens", "left")


def extend_with_patterns(grammar: Grammar, patterns: list[tuple[str, ...]], prefix: str = "P_") -> Grammar:
    """A grammar in which each pattern of two or more symbols is a nonterminal of its own, used by the rules.

    Patterns are binarized to the right, longest first; terminals get pre-terminals. Where a rule has a child
    that derives the pattern, half of the rule's probability goes to the same rule with the pattern's
    nonterminal in that place, so the language stays and parses show the pattern. If the start symbol itself
    derives it, it takes over the pattern's production, as normal form has no rule of one nonterminal.
    """
    rules = {k: list(v) for k, v in grammar.rules.items()}
    chance = dict(grammar.probabilities)

    def add(left: str, production: tuple[str, ...], p: float = 1.0) -> None:
        if production not in rules.setdefault(left, []):
            rules[left].append(production)
            chance[left, production] = 0.0
        chance[left, production] += p

    def symbol(x: str) -> str:
        if x in grammar.rules:
            return x
        if f"{prefix}T_{x}" not in rules:
            add(f"{prefix}T_{x}", (x,))
        return f"{prefix}T_{x}"

    for k, pattern in sorted(enumerate(patterns), key=lambda x: (-len(x[1]), x[0])):
        if len(pattern) < 2:
            continue
        whole = f"{prefix}{k}"
        fits = _deriving(grammar, pattern)
        parts = [symbol(x) for x in pattern]
        lefts = [whole, *(f"{whole}_{j}" for j in range(len(parts) - 2))]
        for j, left in enumerate(lefts):
            add(left, (parts[j], lefts[j + 1] if j + 1 < len(lefts) else parts[j + 1]))
        for left, productions in grammar.rules.items():
            for p in productions:
                if len(p) < 2:
                    continue
                for at in (0, 1):
                    if p[at] in fits and (half := chance[left, tuple(p)] / 2) > 0:
                        chance[left, tuple(p)] -= half
                        add(left, (whole, p[1]) if at == 0 else (p[0], whole), half)
        if grammar.start in fits:
            old = {p: chance[grammar.start, tuple(p)] for p in rules[grammar.start]}
            for p, c in old.items():
                chance[grammar.start, tuple(p)] = c / 2
            add(grammar.start, rules[whole][0], sum(old.values()) / 2)
    return Grammar(rules, grammar.start, chance)


def _deriving(grammar: Grammar, pattern: tuple[str, ...]) -> set[str]:
    """Nonterminals that derive exactly the symbols of ``pattern`` (terminals or nonterminals)."""
    n = len(pattern)
    cell = {(i, i + 1): {x} | {left for left, ps in grammar.rules.items() if (x,) in map(tuple, ps)} for i, x in enumerate(pattern)}
    for span in range(2, n + 1):
        for i in range(n - span + 1):
            pairs = {(b, c) for k in range(i + 1, i + span) for b in cell[i, k] for c in cell[k, i + span]}
            cell[i, i + span] = {left for left, ps in grammar.rules.items() if any(tuple(p) in pairs for p in ps)}
    return cell[0, n]


def pattern_types(patterns: DataFrame, parent: str) -> DataFrame:
    """``name, parent``: mined patterns as types below ``parent``, to append to a type table."""
    return patterns.select(F.concat(F.lit("P_"), F.array_join("pattern", "_")).alias("name"), F.lit(parent).alias("parent")).distinct()
