"""Line dedup [native] by a deletion-neighbourhood join.

Lines of any length that differ in at most one character (insertion, deletion or replacement) are near
copies.

1. Equal lines are one class, known by the first place (document id, line number) that has it.
2. Within one edit, one half of a line is untouched: the first ``m / 2`` or the last ``m - m / 2``
   characters, m being the shorter length. Lines that share no half with another line are done.
3. The other half is halved again in the same way until it has at most ``PIECE`` characters; what was
   set aside on the way is one hash. So the work on a line grows with its length, not its square.
4. Of what is left a line emits its deletion neighbourhood as hashed keys: every single deletion with
   its position, which lines of equal length share that differ there only; and every single deletion
   as a text, next to the texts that lines one shorter have there.
5. A line is removed if an earlier line that stays is within one edit, and stays otherwise. Lines of an
   equal key are near each other, or near the one that is shorter, so a group never needs its pairs: in
   each round a line that is the earliest undecided one of all its keys stays, and one that has an
   earlier staying line in a key goes, after the two are compared with a bounded edit distance. Rounds
   end when all are decided; a line depends on earlier ones only, so there are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, stash, table, text_or_empty

#: Characters of which all single deletions are taken at once.
PIECE = 256
#: Line classes up to this number are broadcast to pick their texts; more are joined by shuffle.
FEW = 500_000


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``at, line`` for each line that holds more than white space; ``at`` orders null ids last."""
    text = text_or_empty(text_col)
    # The text is hashed below the generator: above it, it would be once a line.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    rows = rows.select("id", "t", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.where(F.btrim("line", F.lit(SPACES)) != "").select(F.struct(F.col("id").isNull().alias("none"), "id", "t", "no").alias("at"), "line")


def _halved(text: Column, m: Column, path: Column) -> list[Column]:
    """Both ways to set a half aside: ``path`` (hash of what is aside), ``m`` and ``rest`` of the other half."""
    first = F.floor(m / 2).cast("int")
    left = F.struct(F.xxhash64(path, F.lit("L"), m, F.left(text, first)).alias("path"), (m - first).alias("m"), F.substring(text, first + 1, F.length(text)).alias("rest"))
    right = F.struct(F.xxhash64(path, F.lit("R"), m, F.right(text, m - first)).alias("path"), first.alias("m"), F.left(text, F.length(text) - (m - first)).alias("rest"))
    return [left, right]


def _paths(line: Column, n: Column) -> Column:
    """The ``path`` of each of ``_tops``, without the rests."""
    return F.array(*[F.xxhash64(F.lit(0), F.lit(side), m, half) for m in (n, n - 1) for side, half in (("L", F.left(line, F.floor(m / 2).cast("int"))), ("R", F.right(line, m - F.floor(m / 2).cast("int"))))])


def _tops(line: Column, n: Column) -> Column:
    """Halves for partners as long or longer (m = n) and for those one shorter (m = n - 1)."""
    return F.array(*[half for m in (n, n - 1) for half in _halved(line, m, F.lit(0))])


def _neighbourhood(path: Column, m: Column, rest: Column) -> Column:
    """Keys of single deletions; ``hub`` marks those that others with the key are compared with."""
    n = F.length(rest)
    before, after = lambda i: F.left(rest, i), lambda i: F.substring(rest, i + 2, n)
    key = lambda hub, *parts: F.struct(F.xxhash64(path, *parts).alias("key"), F.lit(hub).alias("hub"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    changed = F.transform(places, lambda i: key(True, F.lit("at"), i, before(i), after(i)))
    gone = F.transform(places, lambda i: key(False, F.lit("is"), F.concat(before(i), after(i))))
    return F.when(n == m, F.concat(changed, F.array(key(True, F.lit("is"), rest)))).otherwise(gone)


def _per_key(members: DataFrame, name: str) -> DataFrame:
    """Of each key its earliest line, and its earliest one that others are compared with."""
    return members.groupBy("key").agg(F.min("at").alias(name), F.min(F.when(F.col("hub"), F.col("at"))).alias(f"{name}_hub"))


def _near_pairs(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of ``pairs`` (at, to) whose lines are within one edit."""
    both = pairs.join(lines.withColumnRenamed("line", "x"), "at").join(lines.select(F.col("at").alias("to"), F.col("line").alias("y")), "to")
    return both.where(F.levenshtein("x", "y", 1) >= 0).select("at", "to")


def _owners(members: DataFrame, lines: DataFrame) -> DataFrame:
    """``at`` and ``owner``: of the lines that go, the earliest near one that stays. ``members`` has at, key, hub."""
    undecided, staying = members, None
    while True:
        rows = undecided.join(_per_key(undecided, "lo"), "key")
        blocked = F.coalesce(F.when(F.col("hub"), F.col("lo")).otherwise(F.col("lo_hub")) < F.col("at"), F.lit(False))
        state = rows.groupBy("at").agg(F.max(blocked).alias("blocked"))
        if staying is not None:
            gone = stash(_near_pairs(_meeting(undecided, staying), lines).select("at").distinct(), "line-gone")
            state = state.join(gone.withColumn("gone", F.lit(True)), "at", "left")
        else:
            state = state.withColumn("gone", F.lit(None).cast("boolean"))
        state = stash(state.select("at", F.when(F.col("gone"), "gone").when(F.col("blocked"), "open").otherwise("stays").alias("state")), "line-states")
        stay = undecided.join(state.where("state = 'stays'").select("at"), "at", "left_semi").select(*members.columns)
        staying = stash(stay if staying is None else staying.unionByName(stay), "line-staying")
        if state.where("state = 'open'").isEmpty():
            break
        undecided = stash(undecided.join(state.where("state = 'open'").select("at"), "at", "left_semi").select(*members.columns), "line-open")
    other = members.join(staying.select("at").distinct(), "at", "left_anti")
    return _near_pairs(_meeting(other, staying), lines).groupBy("at").agg(F.min("to").alias("owner"))


def _meeting(members: DataFrame, staying: DataFrame) -> DataFrame:
    """``at, to``: lines with the earliest staying line of each of their keys that they are compared with."""
    to = F.when(F.col("hub"), F.col("k")).otherwise(F.col("k_hub"))
    rows = members.join(_per_key(staying, "k"), "key").select("at", to.alias("to"))
    return rows.where(F.col("to") < F.col("at")).distinct()


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line's place and that of the line that stays for it: ``id, t, no, of_id, of_t, of_no, near``.

    ``t`` is a hash of the document's text, ``near`` says that the staying line is not equal to this one,
    but the earliest staying one within one edit. Lines without a character that is not white space have no class. Rows equal in id and
    text are one document; rows that share an id, or have none, are told apart by their texts, null
    ids come last; equal lines of one document belong to its first. Texts and lines of any length are
    compared whole; null and empty texts have no lines, an empty table gives no rows, other columns are
    ignored.
    """
    h = [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]
    n = F.length("line")
    lines = _lines(docs, id_col, text_col)
    known = stash(lines.select(*h, "at", n.alias("n"), _paths(F.col("line"), n).alias("halves")), "lines")
    keys = [F.get("halves", k).alias(f"k{k}") for k in range(4)]
    first = known.select("h1", "h2", "at", "n", *keys).groupBy("h1", "h2").agg(F.min("at").alias("at"), *[F.any_value(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")])
    first = stash(first, "line-classes")

    half = first.select("at", "n", F.explode(F.array("k0", "k1", "k2", "k3")).alias("path"))
    shared = half.groupBy("path").agg(F.count("*").alias("c")).where("c > 1").select("path")
    live = stash(half.join(shared, "path"), "line-halves")
    places = live.groupBy("at").agg(F.max("n").alias("n"))
    few, longest = places.agg(F.count("*"), F.max("n")).first()
    places = places.select("at")
    picked = lines.join(F.broadcast(places) if few <= FEW else places, "at", "left_semi").groupBy("at").agg(F.any_value("line").alias("line"))
    picked = stash(picked, "line-texts")

    rows = picked.select("at", F.explode(_tops(F.col("line"), n)).alias("k")).select("at", "k.*")
    rows = rows.join(live.select("at", "path"), ["at", "path"], "left_semi")
    for _ in range(math.ceil(math.log2(max(1, (longest or 0) / PIECE)))):
        own = F.struct("path", "m", "rest")
        rows = rows.select("at", F.explode(F.when(F.col("m") > PIECE, F.array(*_halved(F.col("rest"), F.col("m"), F.col("path")))).otherwise(F.array(own))).alias("k")).select("at", "k.*")
    near = rows.select("at", F.explode(_neighbourhood(F.col("path"), F.col("m"), F.col("rest"))).alias("v")).select("at", "v.*")
    near = stash(near.distinct(), "line-variants")
    shared = near.groupBy("key").agg(F.count("*").alias("c"), F.max("hub").alias("any")).where("c > 1 AND any").select("key")
    owner = _owners(stash(near.join(shared, "key"), "line-members"), picked)

    classes = first.select("h1", "h2", F.col("at").alias("first")).join(owner.withColumnRenamed("at", "first"), "first", "left")
    classes = classes.select("h1", "h2", F.coalesce("owner", "first").alias("of"), "first")
    rows = known.select("h1", "h2", "at").distinct().join(classes, ["h1", "h2"])
    return rows.select("at.id", "at.t", "at.no", F.col("of.id").alias("of_id"), F.col("of.t").alias("of_t"), F.col("of.no").alias("of_no"), (F.col("of") != F.col("first")).alias("near"))


def _gone() -> Column:
    return ~(F.col("id").eqNullSafe(F.col("of_id")) & (F.col("t") == F.col("of_t")) & (F.col("no") == F.col("of_no")))


def _own(docs_id: Column, text: Column) -> Column:
    """Join condition of a document with what is known of its id and text."""
    return docs_id.eqNullSafe(F.col("__ep_id")) & (F.xxhash64(text) == F.col("__ep_t"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose texts keep only the earliest line of each class (and blank lines).

    All rows stay, null texts stay null; see ``line_classes`` for the other cases.
    """
    rows = line_classes(docs, id_col=id_col, text_col=text_col).where(_gone())
    gone = rows.groupBy(F.col("id").alias("__ep_id"), F.col("t").alias("__ep_t")).agg(F.collect_set("no").alias("__ep_gone"))
    kept = F.filter(F.split(text_col, "\n"), lambda line, k: ~F.array_contains("__ep_gone", k))
    text = F.when(F.col("__ep_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, _own(F.col(id_col), text_or_empty(text_col)), "left").withColumn(text_col, text).select(*docs.columns)


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_equal and n_near (removed), removed (line numbers)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_classes(docs).withColumn("gone", _gone())
    per = rows.groupBy(F.col("id").alias("__ep_id"), F.col("t").alias("__ep_t")).agg(
        F.count("*").alias("n"), F.count_if(F.col("gone") & ~F.col("near")).alias("e"), F.count_if(F.col("near")).alias("c"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("no")))).alias("g")
    )
    out = docs.join(per, _own(F.col("doc_id"), text_or_empty()), "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in (("n", "n_lines"), ("e", "n_equal"), ("c", "n_near"))], F.coalesce(F.array_join("g", ","), F.lit("")).alias("removed"))


SQL = {
    "op3_linededup": r"""
WITH RECURSIVE l AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS no, x[k] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x, unnest(range(1, len(x) + 1)) AS k FROM documents)),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS at, length(line) AS len FROM w GROUP BY line),
h AS (SELECT *, m, unnest([('L' || left(line, m // 2)), ('R' || right(line, m - m // 2))]) AS half FROM (SELECT *, unnest([len, len - 1]) AS m FROM f)),
q AS (SELECT DISTINCT a.at AS a, b.at AS b, a.line AS x, b.line AS y FROM h a JOIN h b ON a.half = b.half AND a.m = b.m AND a.at < b.at AND abs(a.len - b.len) <= 1),
i AS (SELECT a, b, x, y, coalesce(list_min([i for i in range(1, least(length(x), length(y)) + 1) if substring(x, i, 1) <> substring(y, i, 1)]), least(length(x), length(y)) + 1) AS i FROM q),
e AS (SELECT a, b FROM i WHERE substring(x, CASE WHEN length(x) >= length(y) THEN i + 1 ELSE i END) = substring(y, CASE WHEN length(y) >= length(x) THEN i + 1 ELSE i END)),
o AS (SELECT place, row_number() OVER (ORDER BY place) AS i FROM (SELECT a AS place FROM e UNION SELECT b FROM e)),
v AS (SELECT o.i, coalesce(list(p.i) FILTER (WHERE p.i IS NOT NULL), []) AS before FROM o LEFT JOIN e ON e.b = o.place LEFT JOIN o p ON p.place = e.a GROUP BY o.i),
g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT v.i, CASE WHEN list_has_any(v.before, g.kept) THEN g.kept ELSE list_append(g.kept, v.i) END FROM g JOIN v ON v.i = g.i + 1),
s AS (SELECT unnest(kept) AS i FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1)),
u AS (SELECT e.b AS place, min(e.a) AS owner FROM e JOIN o ON o.place = e.a JOIN s ON s.i = o.i GROUP BY e.b),
c AS (SELECT f.line, f.at, CASE WHEN s.i IS NULL THEN coalesce(u.owner, f.at) ELSE f.at END AS o FROM f LEFT JOIN o ON o.place = f.at LEFT JOIN s ON s.i = o.i LEFT JOIN u ON u.place = f.at),
r AS (SELECT w.doc_id, w.no, c.o <> c.at AS near, c.o.d <> w.doc_id OR c.o.n <> w.no AS gone FROM w JOIN c ON w.line = c.line),
p AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone AND NOT near) AS n_equal, count(*) FILTER (near) AS n_near, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (gone) AS removed FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed
FROM documents LEFT JOIN p USING (doc_id)
"""
}
QUERIES = {"op3_linededup": op3_linededup}
