"""Conversation structure repair: forward Viterbi search over four grammar states.

A conversation's role initials shall read ``(s?(ua)+)?``. The states are what has been written so far:
nothing, a system turn, a user turn that waits for its answer, and a whole exchange. For each state the
search carries the least ``(cost, audit)``, the audit naming the edits so far by their initials: Keep,
Rerole, Delete, Insert. A row's layer takes one edit of the row and is then closed by at most two
inserted turns. Of equal costs the audit that is less in ASCII order wins; as no audit of a layer
begins another one of the same cost, what is least for a layer stays least behind it.

Rows pass in order and are never gathered: edits that all surviving paths share are written out at
once, and a path goes when another one can do all it can for less. What remains in memory are the rows
on which the survivors differ (a run of rows that may be read as turns in either order stays undecided
to its end), and the audit itself, which the report returns.
"""

from __future__ import annotations

import os
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of, crc32_sql, runs_sha256, table

START, SYSTEM, USER, WHOLE = range(4)
RETAG, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States that a user turn may follow; an assistant turn follows USER only.
BEFORE_USER = (START, SYSTEM, WHOLE)
#: ``WORTH[y][x]``: whatever can follow state x can follow state y for at most so much more.
WORTH = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
EDITS = "conv_id long, n long, edit string, role string, text string"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _close(layer: list) -> list:
    """The layer after inserted turns: a user turn, an assistant turn, or both."""
    more = lambda x: x and (x[0] + INSERT, x[1] + "I")
    least = lambda options: min((x for x in options if x), default=None)
    user = least([layer[USER], *(more(layer[x]) for x in BEFORE_USER)])
    return [layer[START], layer[SYSTEM], user, least([layer[WHOLE], more(user)])]


def _step(layer: list, initial: str, fault: int) -> list:
    """The layer after one more row, closed."""
    new: list = [None] * 4

    def offer(to: int, path, cost: int, edit: str) -> None:
        if path:
            one = (path[0] + cost, path[1] + edit)
            new[to] = min(new[to], one) if new[to] else one

    for x in range(4):
        offer(x, layer[x], DELETE, "D")
    if fault not in (BLANK, DUPLICATE):
        cut = CUT if fault == TRUNCATED else 0
        if initial == "s":
            offer(SYSTEM, layer[START], cut, "K")
        for x in BEFORE_USER:
            offer(USER, layer[x], cut + (0 if initial == "u" else RETAG), "K" if initial == "u" else "R")
        offer(WHOLE, layer[USER], cut + (0 if initial == "a" else RETAG), "K" if initial == "a" else "R")
    new = _close(new)
    return [x if x and all(not y or x[0] <= y[0] + WORTH[k][j] for k, y in enumerate(new)) else None for j, x in enumerate(new)]


class _Conversation:
    """One conversation on its way: the layer, the rows that are not decided, and the counts."""

    def __init__(self):
        self.layer = _close([(0, ""), None, None, None])
        self.rows: deque = deque()
        self.state, self.n, self.audit = START, 0, []
        self.turns, self.lowest, self.turn = 0, None, None
        self.faults, self.illegal, self.initial = [0] * 4, 0, None

    def add(self, turn, role: str, text: str, fault: int) -> list[tuple]:
        if turn is not None and turn != self.turn:
            self.lowest = turn if self.lowest is None else self.lowest
            self.turn, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.faults[fault] += 1
        self.rows.append((role, text))
        self.layer = _step(self.layer, initial, fault)
        shared = os.path.commonprefix([x[1] for x in self.layer if x])
        if shared:
            self.layer = [x and (x[0], x[1][len(shared) :]) for x in self.layer]
        return self._write(shared)

    def _write(self, edits: str) -> list[tuple]:
        """Rows of the edits that are decided; what is kept or not is told by the letter alone."""
        out = []
        self.audit.append(edits)
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.rows.popleft()
            if edit in "IR":
                role = "assistant" if self.state == USER else "user"
            if edit != "D":
                self.state = SYSTEM if self.state == START and role[0] == "s" else WHOLE if self.state == USER else USER
            out.append((self.n, edit, role, text))
            self.n += 1
        return out

    def end(self) -> tuple[list[tuple], tuple]:
        cost, rest = min(x for x in (self.layer[START], self.layer[WHOLE]) if x)
        rows = self._write(rest)
        gaps = self.turn - self.lowest + 1 - self.turns if self.turns else 0
        return rows, (gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit))


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, __ep_copy, __ep_gone) plus ``__ep_fault``, each conversation's rows in
    order and in one partition. Rows that are gone only stand for their conversation."""
    bare = turns.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "__ep_copy").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(~F.col("__ep_gone"), 1)).over(same), F.lit(0)) > 0
    fault = (
        F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK)
        .when(seen, DUPLICATE)
        .when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), TRUNCATED)
        .otherwise(0)
    )
    return bare.withColumn("__ep_fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "__ep_copy")


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copy: Column | None = None, gone: Column | None = None) -> DataFrame:
    """All edits that make the conversations of ``turns`` follow the grammar for the least cost.

    One row per edit: ``conv_id``, ``n`` (from 0), ``edit`` (K, R, D, I), ``role`` and ``text`` as they stand
    after it; then one row per conversation with ``report`` (null before): gaps, the number of blank,
    duplicate and truncated rows, of illegal neighbours, cost and audit. The rows of a conversation
    stand together in one partition, in order.

    Turns come by ``turn_col``, nulls first, ties by role, text and ``copy``. Null roles and texts are one
    space; a role is known by its first character, and an empty role is never kept as it is. Rows of a
    null id form one conversation. ``gone`` marks rows that count for nothing but that their
    conversation has a report, as one without rows: zeros and an empty audit. Repeated rows are
    duplicates; other columns are ignored; an empty table gives no rows. Whole texts are read, and a
    conversation of any length passes as a stream in one task, as its order of edits asks for.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
        (copy if copy is not None else F.lit(0)).alias("__ep_copy"),
        (gone if gone is not None else F.lit(False)).alias("__ep_gone"),
    )
    names = [x.split()[0] for x in REPORT.split(", ")]
    edits = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    report = pa.struct([(x, pa.string() if x == "audit" else pa.int64()) for x in names])
    schema = edits.append(pa.field("report", report))

    def made(out: list[tuple]):
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches):
        key, talk, out = None, None, []

        def end():
            rest, told = talk.end()
            out.extend((key, *x, None) for x in rest)
            out.append((key, None, None, None, None, dict(zip(names, told, strict=True))))

        for batch in batches:
            for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if talk is None or conv != key:
                    if talk:
                        end()
                    key, talk = conv, _Conversation()
                if not gone:
                    out.extend((key, *x, None) for x in talk.add(turn, role, text, fault))
            yield made(out)
            out.clear()
        if talk:
            end()
            yield made(out)

    ordered = faults(rows).select("conv_id", "turn", "role", "text", "__ep_gone", "__ep_fault")
    return ordered.mapInArrow(run, f"{EDITS}, report struct<{REPORT.replace(' ', ':').replace(',:', ', ')}>")


def repaired(edits: DataFrame) -> DataFrame:
    """The turns that the edits leave: ``conv_id``, ``turn`` (rising, with gaps), ``role``, ``text``."""
    return edits.where("edit <> 'D'").select("conv_id", F.col("n").alias("turn"), "role", "text")


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: what was found, the cost and the audit."""
    return edits.where(F.col("report").isNotNull()).select("conv_id", "report.*")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with one row in four spoiled by a hash of its place; plus ``__ep_copy`` and ``__ep_gone``.

    A null in the place reads as one space, as do null roles and texts.
    """
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.pmod(crc32_of(place), F.lit(20))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__ep_copy"),
        (kind == 0).alias("__ep_gone"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoiled = damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    edits = repair(spoiled, copy=F.col("__ep_copy"), gone=F.col("__ep_gone"))
    # The digest follows the rows as they come; a closing row adds nothing to it but stands for its conversation.
    said = F.when(F.col("report").isNull(), F.concat("role", F.lit(":"), "text"))
    kept = edits.where("edit is null or edit <> 'D'").select("conv_id", said.alias("said"), "report")
    done = runs_sha256(kept, "conv_id", "said", "\n", carry=("report",))
    return done.select("conv_id", "report.*", F.col("sha256").alias("repaired_sha256"))


def _sql() -> str:
    add = lambda x, cost, edit, said="''": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': {x}.t || {said}}} END"
    role = lambda r: f"chr(10) || '{r}:' || r.text"
    as_is = "chr(10) || r.role || ':' || r.text"
    insert = lambda x, r: add(x, INSERT, "I", f"chr(10) || '{r}:'")
    free, cut = "r.fault NOT IN (1, 2)", "(CASE WHEN r.fault = 3 THEN 5 ELSE 0 END)"
    keep = lambda x, i: f"CASE WHEN {free} AND left(r.role, 1) = '{i}' THEN {add(x, cut, 'K', as_is)} END"
    retag = lambda x, to: f"CASE WHEN {free} THEN {add(x, cut + ' + 1', 'R', role(to))} END"
    user = [add("l.u", 2, "D"), *(f("l." + x, *y) for x in ("e", "s", "w") for f, y in ((keep, "u"), (retag, ("user",))))]
    whole = [add("l.w", 2, "D"), keep("l.u", "a"), retag("l.u", "assistant")]
    close = lambda e, s, u, w: f"least({u}, {insert(e, 'user')}, {insert(s, 'user')}, {insert(w, 'user')})"
    return f"""
    WITH RECURSIVE placed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations),
    spoiled AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM placed WHERE kind <> 0),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
        FROM spoiled),
    rows AS (
        SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM numbered),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
            count(*) FILTER (WHERE fault = 3) AS truncated, count(*) AS n,
            count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
        FROM rows GROUP BY conv_id),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    first AS (
        SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
            {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS u,
            {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS w FROM ids),
    layers AS (
        SELECT * FROM first
        UNION ALL
        SELECT conv_id, i, e, s, v AS u, least(w, {insert("v", "assistant")}) AS w FROM (
            SELECT *, {close("e", "s", "u", "w")} AS v FROM (
                SELECT l.conv_id, r.i, {add("l.e", 2, "D")} AS e, least({add("l.s", 2, "D")}, {keep("l.e", "s")}) AS s,
                    least({", ".join(user)}) AS u, least({", ".join(whole)}) AS w
                FROM layers l JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1))),
    ends AS (
        SELECT l.conv_id, least(l.e, l.w) AS best, k.* EXCLUDE (conv_id)
        FROM layers l LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM l.conv_id WHERE l.i = coalesce(k.n, 0))
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
        sha256(substr(best.t, 2)) AS repaired_sha256
    FROM ends
    """


QUERIES = {"op13_repair": op13_repair}
#: The search in SQL: one row per conversation and layer, one column per state.
SQL = {"op13_repair": _sql()}
