"""Differential privacy, pseudonyms and federated counts.

Noise is drawn once on the driver for released numbers (a retried task must not draw again), from a
seed; per-institution noise is derived from hashes, so it does not depend on the partitioning.
"""

from __future__ import annotations

import math
import random
import time
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import num


class BudgetExhausted(RuntimeError):
    pass


class Budget:
    """Ledger of one dataset: spending is recorded before anything is released."""

    def __init__(self, total: float = 10.0):
        self.total, self.spent, self._lock = float(total), 0.0, Lock()

    @property
    def left(self) -> float:
        return max(0.0, self.total - self.spent)

    def spend(self, epsilon: float | None = None) -> float:
        """``epsilon`` (all that is left if None); raises if more than is left by over 1e-10."""
        with self._lock:
            epsilon = self.left if epsilon is None else float(epsilon)
            if epsilon <= 0 or self.spent + epsilon > self.total + 1e-10:
                raise BudgetExhausted(f"asked for {epsilon}, {self.left} left")
            self.spent += epsilon
            return epsilon


class StoredBudget(Budget):
    """A budget that several sessions share: an append-only ledger of numbered files.

    An entry is claimed by creating the file of the next number, which fails if another session was
    first; then everything is read and checked anew. So what is recorded never exceeds the total. An
    entry whose amount is not readable, as its writer died, counts as all that was left. Creating a file
    exclusively must be atomic in the file system (as in HDFS and local ones; object stores need their own
    lock).
    """

    def __init__(self, spark, path: str, total: float = 10.0):
        super().__init__(total)
        self._jvm = spark.sparkContext._jvm
        self._at = lambda *parts: self._jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at())
        # The total is an entry, too: the first session's holds for all.
        if not self._claim(0, self.total):
            for _ in range(100):
                if (held := self._amount(0)) is not None:
                    break
                time.sleep(0.05)
            if held != self.total:
                raise ValueError(f"the ledger at {path} has the total {held}")
        self._read()

    def _claim(self, number: int, amount: float) -> bool:
        at = self._at(f"{number:09d}")
        if self._fs.getUri().getScheme() == "file":  # Hadoop's local files are looked up, then made: not in one step
            try:
                with open(at.toUri().getPath(), "x") as out:
                    out.write(repr(amount))
            except FileExistsError:
                return False
            return True
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(repr(amount).encode()))
        out.close()
        return True

    def _amount(self, number: int) -> float | None:
        at = self._at(f"{number:09d}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            said = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return float(said) if said else None

    def _read(self) -> int:
        """Sum what is recorded; returns the next number."""
        n = max(int(s.getPath().getName()) for s in self._fs.listStatus(self._at()) if s.getPath().getName().isdigit())
        amounts = [self._amount(k) for k in range(1, n + 1)]
        self.spent = self.total if None in amounts else min(self.total, sum(amounts))
        return n + 1

    def spend(self, epsilon: float | None = None) -> float:
        with self._lock:
            while True:
                number = self._read()
                asked = self.left if epsilon is None else float(epsilon)
                if asked <= 0 or self.spent + asked > self.total + 1e-10:
                    raise BudgetExhausted(f"asked for {asked}, {self.left} left")
                if self._claim(number, asked):
                    self.spent += asked
                    return asked


def level(epsilon: Column) -> Column:
    """Strength of the guarantee."""
    return F.when(epsilon <= 1, "stark").when(epsilon <= 5, "moderat").otherwise("schwach")


def laplace(scale: float, rng: random.Random) -> float:
    u = rng.random() - 0.5
    return -scale * math.copysign(1.0, u) * math.log(1 - 2 * abs(u)) if abs(u) < 0.5 else 0.0


def laplace_column(scale: Column, *key: Column | str, seed: int = 0) -> Column:
    """Laplace noise from a hash of ``key`` by the inverse distribution function."""
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53)) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def dp_count(events: DataFrame, budget: Budget, epsilon: float | None = None, *, seed: int | None = None) -> float:
    """Noisy number of distinct patients, at least 0 (sensitivity 1)."""
    epsilon = budget.spend(epsilon)
    n = events.agg(F.countDistinct("patient_id")).first()[0]
    return max(0.0, n + laplace(1 / epsilon, random.Random(seed)))


def dp_mean(events: DataFrame, attr: str, lo: float, hi: float, budget: Budget, epsilon: float | None = None, *, seed: int | None = None) -> float:
    """Noisy mean of a numeric attribute whose values are clipped to [lo, hi], so that the guarantee holds."""
    epsilon = budget.spend(epsilon)
    x = F.least(F.greatest(num(attr), F.lit(float(lo))), F.lit(float(hi)))
    n, mean = events.agg(F.count(x), F.avg(x)).first()
    return (mean or 0.0) + laplace((hi - lo) / max(n, 1) / epsilon, random.Random(seed))


def dp_pattern_support(n: int, total: int, budget: Budget, epsilon: float | None = None, *, seed: int | None = None) -> float:
    epsilon = budget.spend(epsilon)
    return min(1.0, max(0.0, n / max(total, 1) + laplace(1 / max(total, 1) / epsilon, random.Random(seed))))


def federated_counts(patients: DataFrame, epsilons: DataFrame, *, noise: bool = True, seed: int | None = None) -> DataFrame:
    """Per institution its count, epsilon, released (noisy, at least 0) count, level and variance 2 / eps^2.

    ``patients`` has (institution_id, patient_id), ``epsilons`` (institution_id, epsilon); an
    institution without patients counts 0. Noise needs a ``seed`` that nobody else knows: with it the
    noise can be computed from the institution's name, and taken away again.
    """
    if noise and seed is None:
        raise ValueError("noise needs a secret seed")
    counts = patients.groupBy("institution_id").agg(F.countDistinct("patient_id").alias("n"))
    rows = epsilons.join(counts, "institution_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    drawn = laplace_column(1 / F.col("epsilon"), "institution_id", seed=seed) if noise else F.lit(0.0)
    return rows.select("institution_id", "n", "epsilon", F.greatest(F.lit(0.0), F.col("n") + drawn).alias("released"), level(F.col("epsilon")).alias("level"), (2 / (F.col("epsilon") * F.col("epsilon"))).alias("variance"))


def federated_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("institutions"), F.sum("released").alias("total"), F.sqrt(F.sum("variance")).alias("std_error"))


def pseudonym(value: Column, salt: str) -> Column:
    """``p#`` and 8 hex digits of a salted hash; null is ``p#none``."""
    return F.coalesce(F.concat(F.lit("p#"), F.left(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), F.lit(8))), F.lit("p#none"))


def fingerprint(attributes: Column) -> Column:
    """Names of the attributes, sorted, without their values."""
    return F.array_join(F.array_sort(F.map_keys(attributes)), ",")


def safe_path(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def release_matches(matches: DataFrame, budget: Budget | None = None, epsilon: float | None = None, *, seed: int | None = None) -> tuple[float, DataFrame | None]:
    """(size, ids) of a cohort; under a budget the size is noisy and the ids are withheld."""
    if budget is None:
        ids = matches.select("patient_id").distinct()
        return float(ids.count()), ids
    return dp_count(matches, budget, epsilon, seed=seed), None


def simulate_federation(spark, *, institutions: int = 3, patients: int = 100, fraction: float = 0.3, epsilon: float = 1.0, noise: bool = True, seed: int | None = None) -> DataFrame:
    """Released counts of invented institutions, each with the whole part of ``fraction`` of its patients in the cohort."""
    name = lambda c: F.concat(F.lit("institution_"), (F.col(c) + 1).cast("string"))
    own = spark.range(institutions).select(name("id").alias("institution_id"), F.explode(F.sequence(F.lit(1), F.lit(patients))).alias("patient_id"))
    budgets = spark.range(institutions).select(name("id").alias("institution_id"), F.lit(float(epsilon)).alias("epsilon"))
    return federated_counts(own.where(F.col("patient_id") <= int(patients * fraction)), budgets, noise=noise, seed=seed)
