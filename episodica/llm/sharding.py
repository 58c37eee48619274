"""Sharding by sampled splitters [native].

1. A size-weighted sample of record keys is drawn (Poisson sampling by a hash of the key, so reruns
   agree); quantiles of the sample become the splitters of ``8 * n_shards`` key ranges.
2. The exact bytes of every range are counted. An overfull range (more than ``target_bytes``) is
   subdivided into equal key intervals, and a sub-range that is still overfull, as copies of one text
   are, at the quantiles of its own keys, again and again until none is; keys that are equal are
   divided by a hash of the whole row, so only rows equal in every column stay together.
3. Prefix sums over the sub-ranges and, within each, over its records give every record its exact
   byte offset in key order; the shard is ``offset * n_shards / total``. Law: ``bytes``.

The key is 40 bits of a hash of the text, then 23 bits of a hash of the id: copies of one text are
neighbours, while a text that holds a third of all rows still divides into millions of sub-keys.
Nothing that grows with the data reaches the driver: it sees the sample (at most about
``2 * SAMPLE`` keys) and one count for each shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table, text_or_empty, unit

RANGES_PER_SHARD = 8
SAMPLE = 8192
TARGET_BYTES = 64 << 20
KEY_BITS = 63
#: An overfull sub-range is divided so many ways in a round; so many rounds fit the digits of a long.
WAYS, ROUNDS = 32, 9
#: Up to so many cells are broadcast (about 5 MB); rows of more are met by a salted shuffle.
FEW, SALTS = 10_000, 16


def _key(id_col: str, text_col: str) -> Column:
    copies = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text_or_empty(text_col)), 24), 23)
    return copies.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(7)), 41))


def _sample(keys: DataFrame, total: int) -> DataFrame:
    """Keys and weights drawn by size. All rows of a key are drawn as one, so about ``SAMPLE`` keys at most come
    to the driver, however often rows are repeated."""
    step = max(1.0, total / SAMPLE)
    sizes = keys.groupBy("__ep_key").agg(F.sum("__ep_size").alias("s"))
    return sizes.where(unit(F.col("__ep_key"), F.lit(3)) < F.col("s") / F.lit(step)).select("__ep_key", F.greatest(F.col("s").cast("double"), F.lit(step)).alias("w"))


def _splitters(keys: DataFrame, total: int, n_ranges: int) -> list[int]:
    drawn = sorted(tuple(r) for r in _sample(keys, total).collect())
    whole, seen, cuts = sum(w for _, w in drawn), 0.0, []
    for k, w in drawn:
        if seen >= whole * (len(cuts) + 1) / n_ranges and (not cuts or k > cuts[-1]):
            cuts.append(k)
        seen += w
    return cuts


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of splitters at or below ``key``: a binary search over a literal array."""
    if not cuts:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda lo, s: F.when(F.coalesce(F.get(bounds, lo + s - 1) <= key, F.lit(False)), lo + s).otherwise(lo),
    )


def _cut(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Cells of ``splits`` divided at its cuts: ``__ep_sub`` gets one more digit of base ``2 * WAYS``."""
    cell = ["__ep_range", "__ep_part", "__ep_sub"]
    if splits.count() <= FEW:
        df = df.join(F.broadcast(splits), cell, "left")
    else:  # a cell of many rows is met in SALTS parts
        salted = splits.withColumn("__ep_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn("__ep_salt", F.pmod(F.xxhash64("__ep_key", "__ep_tie"), F.lit(SALTS)).cast("int")).join(salted, [*cell, "__ep_salt"], "left").drop("__ep_salt")
    value = F.when(F.col("__ep_by_key"), F.col("__ep_key")).otherwise(F.col("__ep_tie"))
    at = F.size(F.filter(F.coalesce("__ep_cuts", F.array().cast("array<bigint>")), lambda c: c <= value))
    return df.withColumn("__ep_sub", F.col("__ep_sub") * (2 * WAYS) + at).drop("__ep_cuts", "__ep_by_key")


def _placed(df: DataFrame, splits: list[DataFrame]) -> DataFrame:
    df = df.withColumn("__ep_sub", F.lit(0).cast("long"))
    for s in splits:
        df = _cut(df, s)
    return df


def _subdivide(keys: DataFrame, target_bytes: int) -> list[DataFrame]:
    """Rounds of cuts, one row per overfull cell each, after which no cell that can be divided is overfull."""
    cell, done, left = ["__ep_range", "__ep_part", "__ep_sub"], [], keys.withColumn("__ep_sub", F.lit(0).cast("long"))
    shares = F.array(*[F.lit(k / WAYS) for k in range(1, WAYS)])
    while len(done) < ROUNDS:
        size = left.groupBy(*cell).agg(F.sum("__ep_size").alias("b"), *[f("__ep_" + c).alias(n + c) for c in ("key", "tie") for n, f in (("lo_", F.min), ("hi_", F.max))])
        size = size.where((F.col("b") > target_bytes) & ((F.col("lo_key") < F.col("hi_key")) | (F.col("lo_tie") < F.col("hi_tie"))))
        over = stash(size.select(*cell, (F.col("lo_key") < F.col("hi_key")).alias("__ep_by_key")), "shard-over")
        n = over.count()
        if not n:
            break
        left = left.join(F.broadcast(over) if n <= FEW else over, cell)
        value = F.when(F.col("__ep_by_key"), F.col("__ep_key")).otherwise(F.col("__ep_tie"))
        cuts = left.groupBy(*cell, "__ep_by_key").agg(F.percentile_approx(value, shares).alias("c"))
        # A value that fills whole shares is cut off on both sides.
        both = F.flatten(F.transform("c", lambda c: F.array(c, F.least(c, F.lit(2**63 - 2)) + 1)))
        done.append(stash(cuts.select(*cell, "__ep_by_key", F.array_distinct(both).alias("__ep_cuts")), "shard-cuts"))
        left = stash(_cut(left.drop("__ep_by_key"), done[-1]), "shard-left")
    return done


def assign_shards(docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``size``, ``law``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 bytes of the text plus 16 (null text: 16). Shards have near-equal bytes:
    each holds its share of the total up to one record, however long its text. Slots run from 0 without gaps. Null ids and
    empty or null texts are ordinary keys, equal rows get different slots, an empty table gives no
    rows. Columns of ``docs`` with these four names are replaced.
    """
    named = docs.drop("size", "law", "shard", "slot")
    plain = named.columns
    hashable = [F.col(c) for c, t in named.dtypes if "map<" not in t and "variant" not in t]
    keyed = named.select(
        "*",
        F.xxhash64(*hashable).alias("__ep_tie"),
        _key(id_col, text_col).alias("__ep_key"),
        F.col(id_col).alias("__ep_id"),
        (F.octet_length(text_or_empty(text_col)) + F.lit(16)).cast("long").alias("__ep_size"),
    )
    keys = stash(keyed.select("__ep_key", "__ep_id", "__ep_tie", "__ep_size"), "shard-keys")
    total = keys.agg(F.sum("__ep_size")).first()[0] or 0
    cuts = _splitters(keys, total, n_shards * RANGES_PER_SHARD) if total else []
    edges = [0, *cuts, (1 << KEY_BITS) - 1]
    in_range = lambda df: df.withColumn("__ep_range", _range_of(F.col("__ep_key"), cuts))

    # Exact bytes of at most 8 * n_shards + 1 ranges decide which are overfull.
    held = {r: b for r, b in in_range(keys).groupBy("__ep_range").agg(F.sum("__ep_size")).collect()}
    parts = [max(1, math.ceil(held.get(r, 0) / target_bytes)) for r in range(len(cuts) + 1)]
    width = [max(1, -(-(edges[r + 1] - edges[r]) // n)) for r, n in enumerate(parts)]
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")

    def in_part(df: DataFrame) -> DataFrame:
        at = F.col("__ep_range")
        inside = F.col("__ep_key") - F.get(listed(edges[:-1]), at)
        return in_range(df).withColumn("__ep_part", F.floor(inside / F.get(listed(width), at)).cast("int"))

    splits = _subdivide(in_part(keys), target_bytes)
    placed = lambda df: _placed(in_part(df), splits)
    cell = ["__ep_range", "__ep_part", "__ep_sub"]
    counted = placed(keys).groupBy(*cell).agg(F.sum("__ep_size").alias("b"), F.count("*").alias("n"))
    before = Window.partitionBy("__ep_range").orderBy("__ep_part", "__ep_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts, at = [], 0
    for r in range(len(cuts) + 1):
        starts.append(at)
        at += held.get(r, 0)
    bases = counted.select(
        *cell, (F.get(listed(starts), F.col("__ep_range")) + F.coalesce(F.sum("b").over(before), F.lit(0))).alias("__ep_base")
    )
    bases = stash(bases, "shard-bases")

    order = [F.col("__ep_key"), F.col("__ep_tie"), F.col("__ep_id").asc_nulls_first()]
    so_far = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("__ep_base") + F.coalesce(F.sum("__ep_size").over(so_far), F.lit(0))
    shard = F.least(F.floor(offset * F.lit(n_shards) / F.lit(max(total, 1))).cast("int"), F.lit(n_shards - 1))
    rows = placed(keyed).join(bases, cell).withColumn("shard", shard)

    # Slots: rank within (range, part, shard), after the records of that shard in earlier parts.
    cells = rows.groupBy("shard", *cell).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", *cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__ep_first"))
    rank = Window.partitionBy(*cell, "shard").orderBy(*order)
    return rows.join(cells, [*cell, "shard"]).select(
        *plain,
        F.col("__ep_size").alias("size"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__ep_first") + F.row_number().over(rank) - 1).cast("long").alias("slot"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bytes`` law over 40 shards: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    Only digests are selected, so the shuffles carry keys and sizes, not texts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(text_or_empty()).alias("text_crc32"))
    shards = assign_shards(docs, 40)
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
SQL: dict[str, str] = {}
