"""Allen's interval relations, distances and fuzzy intervals as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import days, micros

#: The order in which the relations are tested; it decides for point events.
RELATIONS = ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "finished_by", "contains", "started_by", "overlapped_by", "met_by", "after")


def holds(relation: str, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b] stands in ``relation`` to [c, d]."""
    return {
        "before": lambda: b < c,
        "meets": lambda: b == c,
        "overlaps": lambda: (a < c) & (c < b) & (b < d),
        "starts": lambda: (a == c) & (b < d),
        "during": lambda: (a > c) & (b < d),
        "finishes": lambda: (b == d) & (a > c),
        "equals": lambda: (a == c) & (b == d),
        "finished_by": lambda: (b == d) & (a < c),
        "contains": lambda: (a < c) & (b > d),
        "started_by": lambda: (a == c) & (b > d),
        "overlapped_by": lambda: (c < a) & (a < d) & (d < b),
        "met_by": lambda: a == d,
        "after": lambda: a > d,
    }[relation]()


def allen_relation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """First relation in the fixed order that holds; null if an end lies before its start."""
    first = F.when((b < a) | (d < c), F.lit(None))
    for relation in RELATIONS:
        first = first.when(holds(relation, a, b, c, d), F.lit(relation))
    return first


def event_relation(left: str, right: str) -> Column:
    """Relation of two joined events with column prefixes; a missing end is the start."""
    end = lambda p: F.coalesce(F.col(f"{p}t_end"), F.col(f"{p}t_start"))
    return allen_relation(F.col(f"{left}t_start"), end(left), F.col(f"{right}t_start"), end(right))


def distance_days(kind: str, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Days between [a, b] and [c, d]: delta_start, delta_end_start or delta_gap (at least 0); else null."""
    if kind == "delta_start":
        return F.abs(days(a, c))
    if kind == "delta_end_start":
        return F.abs(days(b, c))
    if kind == "delta_gap":
        return F.greatest(F.lit(0.0), days(b, c), days(d, a))
    return F.lit(None).cast("double")


def overlaps_window(start: Column, end: Column, ws: Column, we: Column) -> Column:
    """Closed overlap; written as two comparisons that Parquet can filter by."""
    return (end >= ws) & (start <= we)


def overlaps_strictly(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def duration_seconds(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def is_embedded() -> Column:
    return (F.col("stay_start") <= F.col("t_start")) & (F.col("t_start") <= F.col("t_end")) & (F.col("t_end") <= F.col("stay_end"))


#: No draw lies farther from its mean than this many sigma: 53 bits end at sqrt(-2 ln 2**-54) = 8.652.
FARTHEST = 8.7
_CROSSED = (("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"))
_M1, _M2, _M3, _M5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(value: int | np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of an int, going on from the hash ``seed`` of the columns before it."""
    h = seed + (_M5 + np.uint64(4))
    h = h ^ (np.asarray(value, np.uint64) * _M1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _M2 + _M3
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(29)
    h *= _M3
    h ^= h >> np.uint64(32)
    return h


def _relation_index(a, b, c, d) -> np.ndarray:
    """Place in ``RELATIONS`` of the first relation that holds; as :func:`allen_relation`, without reversed ends."""
    held = [b < c, b == c, (a < c) & (c < b) & (b < d), (a == c) & (b < d), (a > c) & (b < d), (b == d) & (a > c), (a == c) & (b == d)]
    held += [(b == d) & (a < c), (a < c) & (b > d), (a == c) & (b > d), (c < a) & (a < d) & (d < b), a == d, a > d]
    return np.select(held, list(range(len(RELATIONS))), -1).astype(np.int8)


def _drawn_counts(key: np.ndarray, ends: np.ndarray, sigma: np.ndarray, n_samples: int, seed: int) -> np.ndarray:
    """Draws of each pair (row) in each of ``RELATIONS``; ``ends`` are a, b, c, d, ``key`` the hash of the key.

    A draw is the same as if all its four normals were made, but only those are that can matter: of ends
    that come within reach of one of the other interval, and in draws whose radii bridge the gap.
    """
    counts = np.zeros((len(key), len(RELATIONS)), np.int64)
    other = [1, 0, 3, 2]
    lost = np.isnan(ends)
    ends, size = np.where(lost, ends[other], ends), np.abs(sigma)
    gaps = np.stack([np.abs(ends["abcd".index(x)] - ends["abcd".index(y)]) for x, y in _CROSSED])
    slack = 1e-15 * np.abs(ends).max(0)
    near = gaps <= 2 * FARTHEST * size + 8 * slack
    moving = np.stack([near[0] | near[1], near[2] | near[3], near[0] | near[2], near[1] | near[3]]) & ~lost
    gap = np.where(near, gaps, np.inf).min(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(size > 0, np.maximum((gap - 8 * slack) / size - 1e-6, 0), 0)
    # Two radii bridge the gap only if one is at least half of it, which is a bound on its uniform number.
    bound = (np.exp(-reach * reach / 8) * float(1 << 53) + 2).astype(np.uint64)
    sort = lambda x: (np.minimum(x[0], x[1]), np.maximum(x[0], x[1]), np.minimum(x[2], x[3]), np.maximum(x[2], x[3]))
    middle = _relation_index(*sort(ends))
    unit = lambda h: ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    number = lambda j, h: _hash_int(seed & 0xFFFFFFFF, _hash_int(j, h))
    draws = np.arange(1, n_samples + 1, dtype=np.uint64)
    kinds = moving.T @ np.array([1, 2, 4, 8])
    step = max(1, 8_000 // n_samples)
    for kind in np.unique(kinds):
        rows, moved = np.flatnonzero(kinds == kind), [j for j in range(4) if kind >> j & 1]
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            base = _hash_int(draws[None, :], key[some, None])
            first = [number(2 * j, base) for j in moved]
            low = first[0] >> np.uint64(11)
            for h in first[1:]:
                low = np.minimum(low, h >> np.uint64(11))
            at = np.flatnonzero(low <= bound[some, None])
            pair = some[at // n_samples]
            x = [ends[j][pair] for j in range(4)]
            for j, h in zip(moved, first, strict=True):
                radius = np.sqrt(-2 * np.log(unit(h.ravel()[at])))
                x[j] = x[j] + sigma[pair] * (radius * np.cos(2 * 3.141592653589793 * unit(number(2 * j + 1, base.ravel()[at]))))
            x = [np.where(lost[j][pair], x[other[j]], x[j]) for j in range(4)] if lost.any() else x
            found = _relation_index(*sort(x))
            counts[some, middle[some]] += n_samples - np.bincount(at // n_samples, minlength=len(some))
            np.add.at(counts, (pair, found), 1)
    return counts


def fuzzy_distribution(pairs: DataFrame, *, key: list[str], sigma: Column, n_samples: int = 1000, seed: int = 42) -> DataFrame:
    """Share of each relation when the ends a, b, c, d are normal with ``sigma``: key, relation, p.

    Draws come from hashes of the key and the draw number (Box-Muller), so they do not depend on the
    partitioning. Ends that come out reversed are swapped; of a missing one its interval is the other, and
    without both, or without sigma, there is no relation (null). Keys are unique: a key that repeats
    has rows for each of its pairs. Pairs whose ends are too far apart for any draw to change their order,
    all of them at sigma 0, are decided without draws.
    """
    rows = pairs.select(*key, *[F.col(x).cast("double").alias(x) for x in "abcd"], sigma.cast("double").alias("sigma"))
    whole = {x: F.coalesce(F.col(x), F.col(y)) for x, y in ("ab", "ba", "cd", "dc")}
    lost = F.col("sigma").isNull() | F.coalesce("a", "b").isNull() | F.coalesce("c", "d").isNull()
    far = [F.abs(whole[x] - whole[y]) > 2 * FARTHEST * F.abs("sigma") + 1e-14 * F.greatest(F.abs(whole[x]), F.abs(whole[y])) for x, y in _CROSSED]
    decided = lost | F.coalesce((sigma.cast("double") == 0) | (far[0] & far[1] & far[2] & far[3]), F.lit(False))
    ends = [F.when(~lost, f(p, q)) for p, q in (("a", "b"), ("c", "d")) for f in (F.least, F.greatest)]
    sure = rows.where(decided).select(*key, allen_relation(*ends).alias("relation"), F.lit(1.0).alias("p"))

    def run(batches):
        for batch in batches:
            ends = np.stack([batch[x].to_numpy(zero_copy_only=False) for x in "abcd"])
            counts = _drawn_counts(batch["__hash"].to_numpy().view(np.uint64), ends, batch["sigma"].to_numpy(zero_copy_only=False), n_samples, seed)
            row, relation = np.nonzero(counts)
            held = batch.select(key).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(RELATIONS).take(pa.array(relation)), pa.array(counts[row, relation] / n_samples)], names=[*key, "relation", "p"])

    # Draws cost far more than the bytes of a pair tell, so the pairs are dealt out by their number.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.where(~decided).select(*key, *"abcd", "sigma", F.xxhash64(*key).alias("__hash")).repartition(parts, "__hash")
    schema = rows.select(*key).schema.add("relation", "string").add("p", "double")
    return sure.unionByName(asked.mapInArrow(run, schema))


def relation_confidence(pairs: DataFrame, relation: str, *, key: list[str], sigma: Column, n_samples: int = 1000, seed: int = 42) -> DataFrame:
    """``key, p``: the share of draws with one relation, 0 where none has it (see :func:`fuzzy_distribution`)."""
    p = F.max(F.when(F.col("relation") == relation, F.col("p")))
    return fuzzy_distribution(pairs, key=key, sigma=sigma, n_samples=n_samples, seed=seed).groupBy(*key).agg(F.coalesce(p, F.lit(0.0)).alias("p"))
