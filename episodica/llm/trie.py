"""Conversation prefix trie: digest-keyed parent edges, rolled up by pointer jumping.

A node is a distinct sequence of first turns, keyed by a digest of the whole sequence. The digests of
all prefixes of a conversation come from doubling: a turn's digest of its last 2k turns joins those of
k turns, here and k turns before, so a conversation of n turns takes about log2(n) window passes over
one sort. Rows meet in nodes by a partial count. The nodes' parent edges then double in length each
round: what a node has gathered from fewer than 2^k levels below goes to its 2^k-th ancestor, which
then has gathered from fewer than 2^(k+1). Each round is a grouped sum and two joins on the nodes,
written to the shared folder; there are about log2(depth) of them whatever the shape of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of, crc32_sql, runs_sha256, stash, table

#: Bytes of a digest that name a node; of a SHA-256.
KEY = 16


def _root() -> Column:
    return F.unhex(F.lit("00" * KEY))


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, KEY)


def prefixes(turns: DataFrame, *, conv_col: str = "conv_id", depth_col: str = "depth", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col``, ``depth_col`` (1, 2, ... in each conversation), ``node`` and ``parent``: digests of the
    sequences of all turns up to this one and up to the one before; ``bytes`` of the text."""
    by = Window.partitionBy(conv_col).orderBy(depth_col)
    role, text = F.col(role_col).cast("binary"), F.col(text_col).cast("binary")
    own = _digest(F.unhex(F.sha2(role, 256)), F.unhex(F.sha2(text, 256)))
    # Texts are read once; from here on a turn is a digest.
    out = stash(turns.select(conv_col, depth_col, own.alias("node"), F.octet_length(text_col).cast("long").alias("bytes")), "trie-turns")
    deepest = out.agg(F.max(depth_col)).first()[0] or 0
    step = 1
    while step < deepest:
        # The digest of at most 2 * step turns; shorter prefixes are whole already and stay.
        out = out.withColumn("__ep_before", F.lag("node", step).over(by))
        out = out.withColumn("node", F.when(F.col("__ep_before").isNull(), F.col("node")).otherwise(_digest("__ep_before", "node"))).drop("__ep_before")
        step *= 2
    return out.withColumn("parent", F.coalesce(F.lag("node").over(by), _root()))


def roll_up(nodes: DataFrame, values: list[str], *, id_col: str = "node", parent_col: str = "parent") -> DataFrame:
    """``nodes`` with each of ``values`` replaced by its sum over the node's subtree, the node included.

    The root's parent is null. Nulls in ``values`` count as 0; an empty table stays empty; other columns
    are carried. A node with any number of children gets their sums from a partial aggregation.
    """
    up = "__ep_up"
    now = nodes.withColumns({v: F.coalesce(v, F.lit(0)) for v in values}).withColumn(up, F.col(parent_col))
    while True:
        now = stash(now, "trie-round")
        if now.where(F.col(up).isNotNull()).isEmpty():
            return now.drop(up)
        given = now.where(F.col(up).isNotNull()).groupBy(F.col(up).alias("__ep_to")).agg(*(F.sum(v).alias(f"__ep_{v}") for v in values))
        further = now.where(F.col(up).isNotNull()).select(F.col(id_col).alias("__ep_at"), F.col(up).alias("__ep_next"))
        now = now.join(given, F.col(id_col) == F.col("__ep_to"), "left").withColumns({v: F.col(v) + F.coalesce(f"__ep_{v}", F.lit(0)) for v in values})
        # Nodes whose pointer reaches the root, or whose pointer's pointer does not exist, are done.
        now = now.join(further, F.col(up) == F.col("__ep_at"), "left").withColumn(up, F.col("__ep_next"))
        now = now.select(*nodes.columns, up)


def trie(turns: DataFrame, conversations: DataFrame, *, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """The prefix trie of ``turns`` (conv_id, depth from 1 without gaps, role, text) of ``conversations`` (ids).

    First its nodes: ``node``, ``parent`` (digests; the root's parent is null), ``depth``, ``conv_id``
    (smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``, and over the subtree, its top
    included, ``n_leaves`` and ``saved_tokens``: bytes of a node's last text that all members but one
    repeat. Second its ends: ``node`` and ``conv_id`` of each conversation's last turn.

    Conversations without turns are members of the root alone. Null roles and texts are empty; rows of a
    null id belong to no conversation; conversations with equal turns share all nodes; other columns
    are ignored; without conversations there is no node. Texts are read whole; a conversation of any
    length is sorted and passed through by one task, with spill.
    """
    ids = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id")).distinct()
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = Window.partitionBy("conv_id").orderBy("depth")
    named = prefixes(rows).select("conv_id", "depth", "node", "parent", "bytes", F.lead("depth").over(last).isNull().alias("is_end"))
    named = stash(named, "trie-named")
    found = named.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    none = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(_root().alias("node"), none.alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", none.alias("bytes"))
    nodes = stash(found.unionByName(root), "trie-nodes")

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("__ep_parent")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, F.col("node") == F.col("__ep_parent"), "left").withColumn("n_children", F.coalesce("n_children", none))
    above = nodes.select(F.col("node").alias("__ep_above"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, F.col("parent") == F.col("__ep_above"), "left").drop("__ep_parent", "__ep_above")
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    ends = named.where("is_end").select("node", "conv_id")
    silent = ids.join(named.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(_root().alias("node"), "conv_id")
    return roll_up(nodes.drop("bytes"), ["n_leaves", "saved_tokens"]), ends.unionByName(silent)


def rebuild(turns: DataFrame, *, group: int = 5, shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, role, text) and ids of the rebuilt conversations: conversation c has the first h
    turns of c - c % group, then its own behind its first h, with h = crc32(c) % shared.

    Turns come by ``turn``, nulls first, ties by role and text; null roles and texts are empty.
    """
    h = F.pmod(crc32_of(F.col("conv_id").cast("string")), F.lit(shared))
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.row_number().over(by))
    # Only the first turns of a base are dealt out, to at most ``group`` conversations.
    base = rows.where((F.col("conv_id") % group == 0) & (F.col("at") < shared)).withColumnRenamed("conv_id", "__ep_base")
    lent = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("__ep_base"), h.alias("__ep_h")).join(base, "__ep_base").where("at <= __ep_h")
    whole = rows.where(F.col("at") > h).select("conv_id", "at", "role", "text").unionByName(lent.select("conv_id", "at", "role", "text"))
    depth = F.row_number().over(Window.partitionBy("conv_id").orderBy("at")).cast("long")
    return whole.select("conv_id", depth.alias("depth"), "role", "text"), ids


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = trie(*rebuild(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    order = ends.repartition("node").sortWithinPartitions("node", "conv_id").select(F.col("node").alias("__ep_node"), F.col("conv_id").cast("string").alias("said"))
    ended = runs_sha256(order, "__ep_node", "said", ",")
    done = nodes.join(ended, F.col("node") == F.col("__ep_node"), "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return done.select(*columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


QUERIES = {"op12_trie": op12_trie}
SQL = {
    # Each node's leaf and savings go to all nodes on its smallest member's path.
    "op12_trie": f"""
    WITH placed AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id::VARCHAR")} % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
    whole AS (
        SELECT d.conv_id, p.i, p.role, p.text FROM ids d JOIN placed p ON p.conv_id = d.base AND p.i <= d.h
        UNION ALL
        SELECT d.conv_id, p.i, p.role, p.text FROM ids d JOIN placed p ON p.conv_id = d.conv_id AND p.i > d.h),
    turns AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, text,
            sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY i)) AS node
        FROM whole
        UNION ALL SELECT conv_id, 0, '', 'root' FROM ids),
    nodes AS (
        SELECT t.node, min(t.depth) AS depth, min(t.conv_id) AS conv_id, count(*) AS n_convs,
            (count(*) - 1) * min(strlen(t.text)) AS saved, min(p.node) AS parent
        FROM turns t LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.depth = t.depth - 1 GROUP BY t.node),
    children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    below AS (
        SELECT a.node, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves
        FROM nodes n JOIN turns a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN children c ON c.node = n.node
        GROUP BY a.node),
    lasts AS (
        SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members FROM (
            SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM turns) WHERE is_end GROUP BY node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
        b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
    FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node
        JOIN below b ON b.node = n.node LEFT JOIN lasts e ON e.node = n.node
    """
}
