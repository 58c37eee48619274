"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive words of the benchmark items (an item of fewer words, but
not none, is one shorter window). All patterns of one length m form a table set with blocks of two
words: a block's shift says how far the search may jump because no pattern has that block nearer to
its end; at shift 0 the hash bucket of the block selects the test windows and a direct comparison of
the words confirms them. So most words of a clean document are never looked at.

The benchmark is a stated query set: its windows are dealt to blocks of about ``BLOCK_WINDOWS``, each
block is broadcast on its own and all documents pass it; between blocks the documents are written to
the shared folder, so memory is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

WINDOW = 10
#: Windows in one broadcast block: below about 60 MB.
BLOCK_WINDOWS = 250_000

#: Lower-cases A-Z and turns all other ASCII but digits and letters into blanks; bytes over 127 stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def windows_of(words: list[bytes], n: int = WINDOW) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class WuManber:
    """Search tables for ``{window: item ids}``; windows may have different lengths."""

    def __init__(self, windows: dict[tuple, list[str]]):
        self.tables = []
        for m in sorted({len(w) for w in windows}):
            width, shift, buckets = min(2, m), {}, {}
            for window, items in windows.items():
                if len(window) != m:
                    continue
                for end in range(width, m + 1):
                    block = window[end - width : end]
                    shift[block] = min(shift.get(block, m), m - end)
                buckets.setdefault(window[m - width :], []).append((window, items))
            self.tables.append((m, width, shift, buckets))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of all occurrences, and the items that have one."""
        spans, found, n = [], set(), len(words)
        for m, width, shift, buckets in self.tables:
            end, far, get = m, m - width + 1, shift.get
            while end <= n:
                block = tuple(words[end - width : end])
                jump = get(block, far)
                if jump:
                    end += jump
                    continue
                here = tuple(words[end - m : end])
                for window, items in buckets[block]:
                    if window == here:
                        spans.append((end - m, end))
                        found.update(items)
                end += 1
        return spans, found


def _union(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Tables:
    """A broadcast block of windows and a name for it."""

    def __init__(self, windows):
        self.windows, self.id = windows, uuid.uuid4().hex

    @property
    def value(self) -> dict:
        return self.windows.value


_built: dict[str, WuManber] = {}


def _search(tables):
    """Search of a broadcast block; a Python worker keeps the tables of its last block for its next task."""
    if tables.id not in _built:
        _built.clear()
        _built[tables.id] = WuManber(tables.value)
    return _built[tables.id].search


_ADDED = "__ep_words long, __ep_spans array<struct<a:int,b:int>>, __ep_items array<string>"


def _scan(docs: DataFrame, text_col: str, windows: dict) -> DataFrame:
    """``docs`` with the spans and items of one block of windows merged into the ``__ep_`` columns."""
    known = "__ep_spans" in docs.columns
    carried = [c for c in docs.columns if not c.startswith("__ep_")]
    tables = _Tables(docs.sparkSession.sparkContext.broadcast(windows))
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        search = _search(tables)
        for batch in batches:
            count, spans, items = [], [], []
            old = zip(batch["__ep_spans"].to_pylist(), batch["__ep_items"].to_pylist(), strict=True) if known else None
            for text in batch["__ep_text"]:
                words = words_of(text.as_py())
                hit, found = search(words)
                if old:
                    was, had = next(old)
                    hit, found = [*hit, *((x["a"], x["b"]) for x in was)], found | set(had)
                count.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in _union(hit)])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in carried), pa.array(count, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                names=[*carried, "__ep_words", "__ep_spans", "__ep_items"],
            )

    kept = docs.select("*", F.col(text_col).cast("binary").alias("__ep_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried), _ADDED])
    return kept.mapInArrow(run, schema)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` plus ``__ep_words`` (count), ``__ep_spans`` (merged hit word spans) and ``__ep_items``.

    ``__ep_items`` are the ids (as strings, sorted) of items with an occurring window. A null or empty
    document has no words and no hits; items without words have no windows; repeated items and ids
    count once; an empty benchmark hits nothing. A null item id is the string "null". Repeated
    documents are searched each, long texts whole; an empty table gives no rows; columns of ``docs``
    that begin with ``__ep_`` are dropped.
    """
    def windows(batches):
        for batch in batches:
            for item, text in zip(batch["i"].to_pylist(), batch["t"].to_pylist(), strict=True):
                own = [b" ".join(w) for w in windows_of(words_of(text))]
                for k in range(0, len(own), 10_000):
                    some = own[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.binary())], names=["i", "w"])

    listed = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text).cast("binary").alias("t"))
    listed = stash(listed.where("t is not null").mapInArrow(windows, "i string, w binary").distinct(), "windows")
    # Blocks are drawn from pairs of a window and an item, so neither a long item nor a common window fills one.
    n_blocks = max(1, math.ceil(listed.count() / BLOCK_WINDOWS))
    out = docs
    for k in range(n_blocks):
        known: dict[tuple, list[str]] = {}
        for item, window in listed.where(F.pmod(F.xxhash64("i", "w"), F.lit(n_blocks)) == k).toLocalIterator():
            known.setdefault(tuple(bytes(window).split(b" ")), []).append(item)
        out = _scan(out, text_col, known)
        if k + 1 < n_blocks:
            out = stash(out, "decontaminate")
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, columns as they were."""
    return find_benchmark(docs, benchmark).where(F.size("__ep_spans") == 0).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("__ep_spans", F.lit(0), lambda n, x: n + x["b"] - x["a"]).cast("long")
    return found.select(
        "doc_id",
        F.col("__ep_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__ep_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__ep_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, str]:
    """n_words, n_hit, comma-joined items by comparing every window at every place (for tests)."""
    words, hit, found = words_of((text or "").encode()), set(), set()
    for item, other in items:
        for window in windows_of(words_of((other or "").encode())):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontamination": f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS p, least(len(w), 10) AS m
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT m FROM p),
g AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS p
      FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, lens WHERE len(w) >= m)),
h AS (SELECT g.r, g.k, g.m, p.item_id FROM g JOIN p ON g.p = p.p AND g.m = p.m),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS j FROM (SELECT DISTINCT r, k, m FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
}
QUERIES = {"op1_decontamination": op1_decontamination}
