"""Causal graphs, backdoor adjustment, treatment effects and structure learning.

Graphs have tens of nodes and stay on the driver; everything about data is an aggregate: adjustment is
a grouped count, and independence tests and regressions read one covariance matrix from one pass.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Critical values of the normal distribution by alpha.
CRITICAL = {0.01: 2.576, 0.05: 1.96, 0.1: 1.645}


class Graph:
    """A directed acyclic graph; an edge that closes a cycle is refused."""

    def __init__(self, edges: list[tuple[str, str]] = ()):
        self.nodes: set[str] = set()
        self.edges: set[tuple[str, str]] = set()
        for edge in edges:
            self.add(*edge)

    def add(self, a: str, b: str) -> None:
        if a == b or a in self.reach(b, self.children):
            raise ValueError(f"{a} -> {b} closes a cycle")
        self.nodes |= {a, b}
        self.edges.add((a, b))

    def parents(self, x: str) -> set[str]:
        return {a for a, b in self.edges if b == x}

    def children(self, x: str) -> set[str]:
        return {b for a, b in self.edges if a == x}

    def reach(self, x: str, step) -> set[str]:
        seen, todo = set(), [x]
        while todo:
            for y in step(todo.pop()) - seen:
                seen.add(y)
                todo.append(y)
        return seen

    def descendants(self, x: str) -> set[str]:
        return self.reach(x, self.children)

    def ancestors(self, x: str) -> set[str]:
        return self.reach(x, self.parents)

    def order(self) -> list[str]:
        out, left = [], set(self.nodes)
        while left:
            free = sorted(n for n in left if not self.parents(n) & left)
            out += free
            left -= set(free)
        return out

    def backdoor_set(self, x: str, y: str) -> set[str] | None:
        """Parents of ``x`` that do not descend from it; None if a node is missing."""
        if not {x, y} <= self.nodes:
            return None
        return self.parents(x) - self.descendants(x) - {y}

    def separated(self, x: str, y: str, given: set[str] = frozenset()) -> bool:
        """d-separation on the moral graph of the ancestors."""
        keep = {x, y, *given}
        keep |= set().union(*(self.ancestors(n) for n in keep))
        links = {frozenset(e) for e in self.edges if set(e) <= keep}
        for n in keep:
            links |= {frozenset(p) for p in combinations(sorted(self.parents(n) & keep), 2)}
        near = lambda n: {m for e in links if n in e for m in e - {n}} - set(given)
        return y not in self.reach(x, near)

    def backdoor_violations(self, x: str, y: str, given: set[str]) -> list[str]:
        out = [f"{z} descends from {x}" for z in sorted(given & self.descendants(x))]
        cut = Graph([e for e in self.edges if e[0] != x])
        cut.nodes |= self.nodes
        if not cut.separated(x, y, given):
            out.append("an open backdoor path remains")
        return out

    def backdoor_paths(self, x: str, y: str) -> list[list[str]]:
        """Simple paths x <- ... y in the undirected graph."""
        near = lambda n: sorted(self.parents(n) | self.children(n))
        done, todo = [], [[x, p] for p in sorted(self.parents(x))]
        while todo:
            path = todo.pop()
            if path[-1] == y:
                done.append(path)
                continue
            todo += [[*path, n] for n in near(path[-1]) if n not in path]
        return sorted(done)

    def dot(self) -> str:
        return "digraph {\n" + "".join(f'  "{a}" -> "{b}";\n' for a, b in sorted(self.edges)) + "}\n"

    def gml(self) -> str:
        names = {n: k for k, n in enumerate(sorted(self.nodes))}
        lines = [f'  node [ id {k} label "{n}" ]' for n, k in names.items()]
        lines += [f"  edge [ source {names[a]} target {names[b]} ]" for a, b in sorted(self.edges)]
        return "\n".join(["graph [", "  directed 1", *lines, "]"]) + "\n"

    def to_dict(self) -> dict:
        return {"nodes": sorted(self.nodes), "edges": [list(e) for e in sorted(self.edges)]}

    @classmethod
    def from_dict(cls, declared: dict) -> Graph:
        graph = cls([tuple(e) for e in declared.get("edges", [])])
        graph.nodes |= set(declared.get("nodes", []))
        return graph


def do_backdoor(rows: DataFrame, x: str, y: Column, z: list[str]) -> DataFrame:
    """``x, p``: P(y | do(x)) = sum over z of P(y | x, z) P(z), from counts.

    One aggregation by (x, z); P(z) and the sum come from its result. Strata without the value of x
    are left out of its sum, as their conditional probability is unknown.
    """
    cells = rows.groupBy(x, *z).agg(F.count("*").alias("__n"), F.count_if(y).alias("__n_y"))
    weights = cells.groupBy(*z).agg(F.sum("__n").alias("__n_z"))
    total = weights.agg(F.sum("__n_z").alias("__n_all"))
    joined = cells.join(weights, z) if z else cells.crossJoin(weights)  # without z: one row
    joined = joined.crossJoin(F.broadcast(total))  # one row
    return joined.groupBy(x).agg(F.sum(F.col("__n_y") / F.col("__n") * F.col("__n_z") / F.col("__n_all")).alias("p"))


def do_monte_carlo(rows: DataFrame, x: str, y: Column, z: list[str], *, key: list[Column], n_samples: int = 10_000, seed: int = 0) -> DataFrame:
    """``x, p``: the mean of P(y | x, z) over about ``n_samples`` rows, drawn by a hash of ``key``.

    A drawn row brings its own z, so strata come up as often as they occur and need no further weight.
    """
    cells = rows.groupBy(x, *z).agg((F.count_if(y) / F.count("*")).alias("__p"))
    u = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    total = rows.agg(F.count("*").alias("__total"))
    drawn = rows.select(*z, u.alias("__u")).crossJoin(F.broadcast(total))  # one row
    drawn = drawn.where(F.col("__u") * F.col("__total") < n_samples).groupBy(*z).agg(F.count("*").alias("__n"))
    joined = cells.join(drawn, z) if z else cells.crossJoin(drawn)  # without z: one row
    return joined.groupBy(x).agg((F.sum(F.col("__p") * F.col("__n")) / F.sum("__n")).alias("p"))


#: Most values of one confounder in a grid of strata.
DOMAIN = 1000


def strata(rows: DataFrame, z: list[str]) -> DataFrame:
    """All combinations of the values of ``z``, also those that no row has, with ``n`` rows each.

    Confounders have few values; one with more than ``DOMAIN`` is refused before any are combined.
    """
    if not z:
        return rows.agg(F.count("*").alias("n"))
    sizes = rows.agg(*[F.countDistinct(c) for c in z]).first()
    if max(sizes) > DOMAIN:
        raise ValueError(f"{z[sizes.index(max(sizes))]} has more than {DOMAIN} values")
    grid = rows.agg(*[F.collect_set(c).alias(c) for c in z])
    for c in z:
        grid = grid.withColumn(c, F.explode(c))
    counts = rows.groupBy(*z).agg(F.count("*").alias("n"))
    return grid.join(counts, z, "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Blocks of rows that a bootstrap draws from.
BLOCKS = 4096


def moments(rows: DataFrame, names: list[str], weight: Column | None = None, by: str | None = None):
    """(n, means, covariance) of the columns from one aggregation; with ``by`` a dict of them.

    Rows with a null in any of the columns are left out.
    """
    rows = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in names))
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    if weight is None:
        aggs = [F.count("*").cast("double"), *[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in pairs]]
    else:
        aggs = [F.sum(w), *[F.sum(w * F.col(c)) for c in names], *[F.sum(w * F.col(names[i]) * F.col(names[j])) for i, j in pairs]]
    aggs = [a.alias(f"m{k}") for k, a in enumerate(aggs)]
    found = {}
    for r in (rows.groupBy(by).agg(*aggs) if by else rows.agg(F.lit(None).alias("__by"), *aggs)).collect():
        v = [float(x or 0) for x in r[1:]]
        n, mean = v[0], np.array(v[1 : len(names) + 1])
        cov = np.zeros((len(names),) * 2)
        for (i, j), c in zip(pairs, v[len(names) + 1 :], strict=True):
            cov[i, j] = cov[j, i] = c
        if weight is not None and n:
            mean = mean / n
            cov = cov / n - np.outer(mean, mean)
        found[r[0]] = (n, mean, cov)
    return found if by else found[None]


def partial_correlation(cov: np.ndarray, i: int, j: int, given: tuple[int, ...] = (), n: float = math.inf) -> float:
    """Correlation of i and j given others, from their covariances; 0 below 3 rows or without variance."""
    if n < 3 or cov[i, i] < 1e-20 or cov[j, j] < 1e-20:
        return 0.0
    own = [i, j]
    part = cov[np.ix_(own, own)]
    if given:
        across = cov[np.ix_(own, list(given))]
        part = part - across @ np.linalg.pinv(cov[np.ix_(given, given)]) @ across.T
    scale = math.sqrt(max(part[0, 0], 0) * max(part[1, 1], 0))
    return float(part[0, 1] / scale) if scale > 1e-12 else 0.0


def fisher_z(r: float, n: float) -> float:
    """How many standard errors a correlation of ``n`` rows is from 0; a full one counts as almost full."""
    return math.atanh(min(abs(r), 1 - 1e-12)) * math.sqrt(max(n - 3, 1))


def independent(cov: np.ndarray, n: float, i: int, j: int, given=(), alpha: float = 0.05) -> bool:
    return n >= 5 and fisher_z(partial_correlation(cov, i, j, tuple(given), n), n) < CRITICAL.get(alpha, 1.96)


def pc(names: list[str], n: float, cov: np.ndarray, *, alpha: float = 0.05, max_cond: int = 3) -> list[tuple[str, str, bool]]:
    """PC algorithm on one covariance matrix: (a, b, directed); undirected edges in name order."""
    k, near, cut = len(names), {i: set(range(len(names))) - {i} for i in range(len(names))}, {}
    for size in range(max_cond + 1):
        for i, j in combinations(range(k), 2):
            if j not in near[i]:
                continue
            for given in sorted({*combinations(sorted(near[i] - {j}), size), *combinations(sorted(near[j] - {i}), size)}):
                if independent(cov, n, i, j, given, alpha):
                    near[i].discard(j)
                    near[j].discard(i)
                    cut[i, j] = set(given)
                    break
    directed = set()
    for i, j in combinations(range(k), 2):
        if j not in near[i]:
            for m in near[i] & near[j]:
                if m not in cut.get((i, j), set()):
                    directed |= {(i, m), (j, m)}
    out = []
    for i, j in combinations(range(k), 2):
        if j in near[i]:
            a, b = (i, j) in directed, (j, i) in directed
            out.append((names[j], names[i], True) if b and not a else (names[i], names[j], a and not b))
    return out


def learn_structure(rows: DataFrame, names: list[str], **how) -> DataFrame:
    """``source, target, directed`` by the PC algorithm."""
    n, _, cov = moments(rows, names)
    return rows.sparkSession.createDataFrame(pc(names, n, cov, **how), "source string, target string, directed boolean")


def bootstrap_edges(rows: DataFrame, names: list[str], *, runs: int = 100, stable: float = 0.7, seed: int = 5, key: Column | None = None, **how) -> DataFrame:
    """``source, target, confidence, stable``: share of Poisson bootstrap samples with the edge.

    Rows are dealt to ``BLOCKS`` blocks by a hash of ``key`` (default: their values) and the blocks are
    drawn again with Poisson weights: one pass gives the sums of all blocks, whose number does not
    depend on the rows. Where keys repeat, equal keys are drawn together.
    """
    key = F.xxhash64(*names) if key is None else key
    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.count("*").cast("double"), *[F.sum(F.col(c).cast("double")) for c in names], *[F.sum(F.col(names[i]).cast("double") * F.col(names[j])) for i, j in pairs]]
    blocks = known.groupBy(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BLOCKS)).alias("__block")).agg(*[x.alias(f"__m{k}") for k, x in enumerate(sums)])
    held = np.array(sorted(map(tuple, blocks.collect())), dtype=float).reshape(-1, len(sums) + 1)[:, 1:]
    found: dict[tuple[str, str], int] = {}
    for drawn in np.random.default_rng(seed).poisson(1.0, (runs, len(held))) @ held:
        n = drawn[0]
        mean, cov = drawn[1 : len(names) + 1] / max(n, 1), np.zeros((len(names),) * 2)
        for (i, j), x in zip(pairs, drawn[len(names) + 1 :], strict=True):
            cov[i, j] = cov[j, i] = x / max(n, 1) - mean[i] * mean[j]
        for a, b, _ in pc(names, n, cov, **how):
            found[a, b] = found.get((a, b), 0) + 1
    out = [(a, b, c / runs, c / runs >= stable) for (a, b), c in sorted(found.items())]
    return rows.sparkSession.createDataFrame(out, "source string, target string, confidence double, stable boolean")


def ate(rows: DataFrame, treatment: str, outcome: str, confounders: list[str]) -> float:
    """Linear adjustment: the treatment's coefficient from the normal equations of one pass."""
    names = [treatment, *confounders, outcome]
    _, _, cov = moments(rows, names)
    return float((np.linalg.pinv(cov[:-1, :-1]) @ cov[:-1, -1])[0])


def refute(rows: DataFrame, treatment: str, outcome: str, confounders: list[str], *, seed: int = 7, key: Column | None = None) -> dict[str, float]:
    """The effect again with a placebo treatment, a random common cause, and on a random part."""
    key = F.xxhash64(treatment, outcome, *confounders) if key is None else key
    u = lambda s: F.shiftrightunsigned(F.xxhash64(key, F.lit(seed + s)), 11) / F.lit(float(1 << 53))
    return {
        "estimate": ate(rows, treatment, outcome, confounders),
        "placebo": ate(rows.withColumn(treatment, (u(1) < 0.5).cast("double")), treatment, outcome, confounders),
        "random_cause": ate(rows.withColumn("__cause", u(2)), treatment, outcome, [*confounders, "__cause"]),
        "subset": ate(rows.where(u(3) < 0.8), treatment, outcome, confounders),
    }
