"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: every source gets a share of the whole size by weight, at most ``max_repeats`` times its own
size; what a capped source cannot use is shared again by weight.

Every source is cut into blocks by a hash of its records; the hash makes the block order a random
permutation. A source's draw is so many whole passes over its blocks, then its first blocks in
permuted order, the last of them only up to a cut key, so that the words taken meet the target up to
one record. The blocks drawn are dealt to output shards: a binary tree over the shards splits the
exact block quotas of all sources by multivariate hypergeometric draws, so every shard gets the same
number of blocks and, on average, the mix itself. Records of a shard are then shuffled locally.

The driver holds one row per source and the quota table (sources x shards), never one per record.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stash, table

#: Records in a block on average; a source has at most MAX_BLOCKS blocks.
BLOCK_ROWS = 64
MAX_BLOCKS = 4096
#: More sources are refused: the driver holds their quotas.
MAX_SOURCES = 100_000


def targets(sizes: dict, weights: dict, max_repeats: float = 3.0) -> dict:
    """Water filling: ``{source: target}``; sums to the sum of ``sizes`` unless every source is capped."""
    whole, capped = float(sum(sizes.values())), {}
    free = {s: float(w) for s, w in weights.items() if sizes[s] > 0}
    while free:
        rest, by = whole - sum(capped.values()), sum(free.values())
        if by <= 0:
            break
        over = [s for s, w in free.items() if rest * w / by > max_repeats * sizes[s]]
        if not over:
            capped.update({s: rest * w / by for s, w in free.items()})
            break
        for s in over:
            capped[s] = max_repeats * sizes[s]
            del free[s]
    return {s: capped.get(s, 0.0) for s in sizes}


def split_quotas(blocks: list[int], n_shards: int, seed: int = 0) -> np.ndarray:
    """``blocks[s]`` blocks of each source over ``n_shards``: exact totals, equal shards (up to one block)."""
    rng, out = np.random.default_rng(seed), np.zeros((len(blocks), n_shards), dtype=np.int64)
    if not blocks:
        return out
    todo = [(0, n_shards, np.asarray(blocks, dtype=np.int64))]
    while todo:
        lo, hi, quota = todo.pop()
        if hi - lo == 1:
            out[:, lo] = quota
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(quota, int(quota.sum()) * (mid - lo) // (hi - lo), method="marginals")
        todo += [(lo, mid, left), (mid, hi, quota - left)]
    return out


def _plan(docs: DataFrame, source_col: str, id_col: str, size: Column, weights, max_repeats: float, seed: int):
    """Draw for each source: columns source, source_size, target, passes, blocks, cut block, cut key."""
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    sized = stash(docs.select(F.col(source_col).alias("s"), key.alias("k"), size.alias("n")), "mix-sizes")
    per = sized.groupBy("s").agg(F.sum("n").alias("words"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group rare sources first")
    per = sorted(per, key=lambda r: (r.s is None, r.s or ""))
    sizes = {r.s: int(r.words) for r in per}
    weight = weights(list(sizes)) if callable(weights) else {s: weights.get(s, 0) for s in sizes}
    target = targets(sizes, weight, max_repeats)
    # The splitting tree draws from fewer than 10**9 blocks in all.
    most = int(min(MAX_BLOCKS, max(1, 9 * 10**8 // (len(per) * (math.ceil(max_repeats) + 1) or 1))))
    n_blocks = {r.s: int(min(most, max(1, r.rows // BLOCK_ROWS))) for r in per}
    passes = {s: int(target[s] // sizes[s]) if sizes[s] else 0 for s in sizes}
    rest = {s: target[s] - passes[s] * sizes[s] for s in sizes}
    rows = [(s, sizes[s], target[s], n_blocks[s], passes[s], rest[s]) for s in sizes]
    kinds = f"s {sized.schema['s'].dataType.simpleString()}, source_size long, target double, n_blocks int, passes int, rest double"
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, kinds)

    # Words of at most MAX_BLOCKS blocks a source; their prefix sums give the block that the rest ends in.
    blocks = _on_source(sized, plan).groupBy("s", _block(F.col("k"), F.col("n_blocks")).alias("b")).agg(F.sum("n").alias("w"), F.first("rest").alias("rest"))
    till = Window.partitionBy("s").orderBy("b")
    ends = blocks.withColumn("till", F.sum("w").over(till)).where(F.col("till") > F.col("rest"))
    ends = ends.groupBy("s").agg(F.min("b").alias("cut"), F.min_by(F.col("rest") - (F.col("till") - F.col("w")), "b").alias("left"))
    # In that block, records are taken in key order while they fit (up to half a record over).
    inner = _on_source(sized, plan).join(F.broadcast(ends.withColumnRenamed("s", "__s")), F.col("s").eqNullSafe(F.col("__s")))
    inner = inner.where(_block(F.col("k"), F.col("n_blocks")) == F.col("cut")).groupBy("s", "k").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    inner = inner.withColumn("till", F.sum("n").over(Window.partitionBy("s").orderBy("k"))).where(F.col("till") - F.col("n") / 2 <= F.col("left"))
    cut = {r.s: r.cut for r in ends.select("s", "cut").collect()}
    cut_key = {r.s: r.k for r in inner.groupBy("s").agg(F.max("k").alias("k")).collect()}
    none = -(1 << 63)
    # A source at its cap has no rest, so no record is taken once more; one of empty texts only is taken whole.
    drawn = [(*r[:5], -1 if r[1] and r[5] <= 0 else cut.get(r[0], r[3]), cut_key.get(r[0], none)) for r in rows]
    return drawn, spark.createDataFrame(drawn, kinds.replace("rest double", "cut int, cut_key long"))


def _block(key: Column, n_blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), n_blocks).cast("int")


def _on_source(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Sources are few (one row each, collected before), so their plan is broadcast up to 100,000 of them."""
    plan = plan.withColumnRenamed("s", "__ep_s")
    return df.join(F.broadcast(plan), F.col("s").eqNullSafe(F.col("__ep_s"))).drop("__ep_s")


def draw(docs: DataFrame, *, weights, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_repeats: float = 3.0, seed: int = 11):
    """``(docs with __ep_ columns of the draw, drawn plan rows)``; see the module's docstring.

    Added: ``__ep_size`` (words), ``__ep_source_size``, ``__ep_target``, ``__ep_times`` (how often the
    record is taken), ``__ep_block``. A null source is a source of its own, null and empty texts have
    size 0 and are taken with their block, long texts are taken whole or not at all, records with one
    id are taken alike, an empty table gives no rows.
    """
    drawn, plan = _plan(docs, source_col, id_col, n_words(F.col(text_col)), weights, max_repeats, seed)
    plan = plan.select([F.col(c).alias(f"__ep_{c}") for c in plan.columns])
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = docs.join(F.broadcast(plan), F.col(source_col).eqNullSafe(F.col("__ep_s")))
    block = _block(key, F.col("__ep_n_blocks"))
    more = (block < F.col("__ep_cut")) | ((block == F.col("__ep_cut")) & (key <= F.col("__ep_cut_key")))
    rows = rows.withColumns({"__ep_size": n_words(F.col(text_col)), "__ep_block": block, "__ep_key": key, "__ep_times": F.col("__ep_passes") + more.cast("int")})
    return rows, drawn


def by_rank(sources: list) -> dict:
    """Weights 1, 2, 3, 1, ... by code point order of the sources, null last."""
    return {s: 1 + i % 3 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def mix(docs: DataFrame, *, weights=by_rank, n_shards: int = 16, seed: int = 11, **columns) -> DataFrame:
    """The mix itself: records repeated as often as drawn, in shards, shuffled inside them.

    Columns of ``docs`` plus ``mix_shard`` (a column of that name is replaced). Equal inputs and seeds
    give equal shards. For odd cases see ``draw``.
    """
    docs = docs.drop("mix_shard")
    rows, drawn = draw(docs, weights=weights, seed=seed, **columns)
    return _deal(rows, drawn, docs.columns, n_shards, seed)


def _deal(rows: DataFrame, drawn: list, columns: list[str], n_shards: int, seed: int) -> DataFrame:
    """``columns`` and ``mix_shard`` of the records drawn, as often as they are taken."""
    # A pass over n blocks, then blocks 0..cut: draw number pass * n_blocks + block, dealt by quota.
    quota = split_quotas([r[4] * r[3] + min(r[5] + 1, r[3]) for r in drawn], n_shards, seed)
    kind = rows.schema["__ep_s"].dataType.simpleString()
    ends = [(r[0], [int(x) for x in np.cumsum(q)]) for r, q in zip(drawn, quota, strict=True)]
    ends = rows.sparkSession.createDataFrame(ends, f"__ep_q {kind}, __ep_ends array<bigint>")
    rows = rows.join(F.broadcast(ends), F.col("__ep_s").eqNullSafe(F.col("__ep_q"))).where("__ep_times > 0")
    rows = rows.withColumn("__ep_pass", F.explode(F.sequence(F.lit(0), F.col("__ep_times") - 1)))
    # The copies of a block have draw numbers a whole pass apart, so they land in different shards.
    number = F.col("__ep_pass") * F.col("__ep_n_blocks") + F.col("__ep_block")
    shard = F.size(F.filter("__ep_ends", lambda e: e <= number))
    rows = rows.withColumn("mix_shard", F.least(shard, F.lit(n_shards - 1)))
    spread = F.pmod(F.xxhash64("__ep_key", "__ep_pass"), F.lit(8))
    rows = rows.repartition(F.col("mix_shard"), spread).sortWithinPartitions("mix_shard", F.xxhash64("__ep_key", "__ep_pass", F.lit(seed)))
    return rows.select(*columns, "mix_shard")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), times.

    The mix is dealt and written with its texts; taken and times are counted in what was written.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    seed = 11
    rows, drawn = draw(docs, weights=by_rank, seed=seed)
    mixed = stash(_deal(rows, drawn, docs.columns, 16, seed), "mix")
    key = ["doc_id", "source", "size"]
    whole = rows.select("doc_id", "source", F.col("__ep_size").alias("size"), F.col("__ep_source_size").cast("long").alias("source_size"), F.col("__ep_target").alias("target"), F.lit(1).alias("copies"), F.lit(0).alias("dealt"))
    held = mixed.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), F.lit(0).alias("copies"), F.lit(1).alias("dealt"))
    # Records alike in all three are taken alike, so they share what was dealt of them.
    per = whole.unionByName(held).groupBy(*key).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("copies").alias("copies"), F.sum("dealt").alias("dealt"))
    per = per.withColumn("times", (F.col("dealt") / F.col("copies")).cast("int")).withColumn("__ep_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")


QUERIES = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {}
