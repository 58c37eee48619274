"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct five-word shingles. Instead of independent band keys, two small
collections of ``M`` half keys (``R`` minhashes each) are made; every pair of a first and a second half
key is a table key, so ``M * M`` tables cost only ``2 * M * R`` minhashes. At similarity 0.75 the
chance that a pair shares no table is below 2 * (1 - 0.75**R)**M, about 1e-4; it falls fast above.

1. Equal sets are one class (grouped by a 128-bit fingerprint); only its smallest id goes on.
2. Half keys that no second class has are dropped before the tensor product is formed.
3. Candidates are compared on full sets in three rounds: with the smallest id any of their tables
   holds; with the first of each table; and, where a table still holds several components, with all
   classes of other components that share its first half key. The last round deals such a group out
   in blocks of about ``BLOCK`` classes, multiplies the blocks' incidence matrices inside the tasks and
   emits links only; so no cap cuts a group, and no group lands in one task.
4. Links become components by alternating large-star and small-star steps on tables in the shared
   folder. Neither links, components nor fingerprints reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import stash, table

M, R, SHINGLE, SEED = 18, 3, 5, 17
#: Classes in a block of round 3, and shingles multiplied at once.
BLOCK, COLUMNS = 512, 4096
#: Ids below this number are broadcast to pick their texts; above it the join shuffles.
FEW = 1_000_000

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 1 << 63, 2 * M * R, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, 2 * M * R, dtype=np.uint64)
_WEIGHT = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that multiplied keys have no visible structure."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles (A-Z lower-cased); see the contract.

    Fewer words: the whole sequence is the one shingle; no words: the empty set.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return _mixed((_mixed(h) * _WEIGHT[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    own = sum(_mixed(h + np.uint64(k))[k : k + n] * _WEIGHT[k] for k in range(SHINGLE))
    return np.unique(_mixed(own))


def half_keys(own: np.ndarray) -> np.ndarray:
    """``2 * M`` keys: of each collection, M keys of R minhashes."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 1024):
        np.minimum(low, (own[k : k + 1024, None] * _A + _B >> np.uint64(20)).min(0), out=low)
    parts = _mixed(low).reshape(2 * M, R)
    key = np.arange(2 * M, dtype=np.uint64)
    for r in range(R):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return key.view(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            n, prints, keys = [], [], []
            for text in batch["t"]:
                own = shingle_set(text.as_py())
                n.append(len(own))
                raw = own.tobytes()
                prints.append(f"{xxh64_intdigest(raw, 1):016x}{xxh64_intdigest(raw, 2):016x}" if len(own) else None)
                keys.append(half_keys(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "print", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, n long, print string, keys array<bigint>")


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            own = [shingle_set(t.as_py()) for t in batch["t"]]
            # The upper halves of the hashes, for round 3: equal shingles stay equal in them.
            half = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())), pa.array(half, pa.binary())], names=["id", "own", "half"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, own array<bigint>, half binary")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    common = often[column] > 1
    names, column = np.unique(column[common], return_inverse=True)
    of, both = of[common], np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(names), COLUMNS):
        here = (column >= lo) & (column < lo + COLUMNS)
        x = np.zeros((len(sets), min(COLUMNS, len(names) - lo)), np.float32)
        x[of[here], column[here] - lo] = 1
        both += x @ x.T
    return both


def _within_blocks(rows: DataFrame) -> DataFrame:
    """Likely links (a, b) among the classes of each pair of blocks: ``u, x, y, block, id, component, half``.

    Compared on 32-bit halves of the hashes at 0.74, so that a chance collision loses no link; the
    full sets decide afterwards.
    """

    def compared(key, group):
        sets = [np.frombuffer(h, np.uint32) for _, _, _, h in group]
        block, component = (np.array([r[k] for r in group]) for k in (0, 2))
        n = np.array([len(x) for x in sets])
        both = _overlaps(sets)
        near = 100 * both >= 74 * (n[:, None] + n[None, :] - both)
        near &= component[:, None] != component[None, :]
        if key[1] != key[2]:
            near &= block[:, None] != block[None, :]
        return [(group[i][1], group[j][1]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]

    def run(batches):
        key, group = None, []
        for batch in batches:
            found = []
            columns = [batch[c].to_pylist() for c in ("u", "x", "y", "block", "id", "component", "half")]
            for u, x, y, *row in zip(*columns, strict=True):
                if (u, x, y) != key:
                    if len(group) > 1:
                        found += compared(key, group)
                    key, group = (u, x, y), []
                group.append(row)
            yield found
        if len(group) > 1:
            yield compared(key, group)

    kind = rows.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def links(batches):
        for found in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], arrow), pa.array([max(p) for p in found], arrow)], names=["a", "b"])

    return rows.repartition("u", "x", "y").sortWithinPartitions("u", "x", "y").mapInArrow(links, f"a {kind.simpleString()}, b {kind.simpleString()}")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    a, b = (sets.select(F.col("id").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    both = F.size(F.array_intersect("own_a", "own_b"))
    either = F.size("own_a") + F.size("own_b") - both
    return pairs.join(a, "a").join(b, "b").where(100 * both >= 75 * either).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id reachable, for every id in ``links(a, b)``."""
    at = stash(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v > m").distinct(), "stars")
    was = None
    while True:
        both = at.union(at.select("m", "v"))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        large = both.where("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v > m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v")
        at = stash(small.select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e")).select("e.*").where("v > m").distinct(), "stars")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == was:
            return at.select(F.col("v").alias("id"), F.col("m").alias("component")).union(at.select("m", "m").distinct())
        was = now


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id)``, one row per input row.

    Null or empty texts have no shingles and are linked with nothing. A row with a null id starts no
    class; if its text equals another row's it gets that class, else its component is null. Where
    an id is repeated with different texts, each row gets the component of its own text. Ties go to the
    smallest id. Texts are read whole, their sets held one at a time. Other columns are left out, so
    none can clash; an empty table gives no rows.
    """
    signed = stash(_signatures(docs, id_col, text_col), "signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("print").agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys"))
    classes = stash(classes, "classes")

    half = classes.select("rep", F.explode("keys").alias("key"))
    shared = half.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = classes.select("rep", "print", F.posexplode("keys").alias("at", "key")).withColumn("first", F.col("at") < M)
    live = live.join(shared, "key").groupBy("rep", "print").agg(F.collect_set(F.when(F.col("first"), F.col("key"))).alias("u"), F.collect_set(F.when(~F.col("first"), F.col("key"))).alias("v"))
    tensor = live.select("rep", F.explode("u").alias("u"), "v").select("rep", "u", F.explode("v").alias("v"))
    tensor = stash(tensor.select("rep", "u", F.xxhash64("u", "v").alias("k")).distinct(), "tensor")
    heads = tensor.groupBy("k").agg(F.min("rep").alias("head"), F.count("*").alias("c")).where("c > 1").select("k", "head")
    tables = stash(tensor.join(heads, "k"), "tables")

    ids = tables.select(F.col("rep").alias("__ep_id")).distinct()
    ids = stash(ids, "ids")
    few = ids.count() <= FEW
    picked = docs.where(F.col(id_col).isNotNull()).join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("__ep_id"), "left_semi")
    sets = stash(_sets(picked, id_col, text_col), "sets")

    # Round 1: every class with the smallest id that one of its tables holds.
    pairs = tables.groupBy("rep").agg(F.min("head").alias("head")).where("head < rep").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    links = stash(_links(pairs, sets), "links")
    owner = components(links)

    def open_tables(of: DataFrame) -> DataFrame:
        own = tables.join(of.withColumnRenamed("id", "rep"), "rep", "left").select("k", "u", "rep", "head", F.coalesce("component", "rep").alias("component"))
        mixed = own.groupBy("k").agg((F.min("component") < F.max("component")).alias("mixed")).where("mixed").select("k")
        return own.join(mixed, "k")

    # Round 2: every class with the first of each table that still holds several components.
    left = stash(open_tables(owner), "open")
    heads = left.where("rep = head").select("k", F.col("component").alias("of_head"))
    pairs = left.join(heads, "k").where("component <> of_head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = stash(links.union(_links(pairs, sets)), "links")
    owner = components(links)

    # Round 3: what is still apart in a table meets all others that share its first half key.
    left = stash(open_tables(owner).select("u", F.col("rep").alias("id"), "component").distinct(), "open")
    groups = left.groupBy("u").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo < hi")
    cells = left.join(groups.select("u", "blocks"), "u").withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("u", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "component").join(sets.select("id", "half"), "id")
    pairs = _within_blocks(cells).distinct()
    links = links.union(_links(pairs, sets))
    owner = components(links)

    several = classes.select("print", "rep")
    rows = signed.select("id", "n", "print").join(several, "print", "left")
    rows = rows.join(owner.withColumnRenamed("id", "rep"), "rep", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component (its smallest id), columns as they were.

    Rows that repeat a kept id are reduced to one; rows with a null id all stay, as do documents without
    words. Long texts are read whole, an empty table gives no rows, columns of any names are carried.
    """
    found = stash(near_duplicates(docs, id_col=id_col, text_col=text_col), "components")
    gone = stash(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__ep_id")).distinct(), "gone")
    few = gone.count() <= FEW
    kept = docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("__ep_id"), "left_anti")
    again = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if again.isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = {
    "op5_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(low.low, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
"""
}
QUERIES = {"op5_minhash": op5_minhash}
