"""Language ID by prediction by partial matching: per-language byte context trees, frozen once learned.

A language's tree counts which bytes followed each context of up to ``ORDER`` bytes in its sample. With
T symbols of q kinds behind a context, a byte seen c times there costs ``log2((T + q) / c)`` bits; any
other byte costs the escape ``log2((T + q) / q)`` and is coded in the context that is one byte shorter;
behind no context at all, eight bits (escape method C, no exclusions). A context that the tree does not
hold costs nothing and is shortened. A text costs the sum over all its bytes, exactly, and its language
is the one in which it costs least. Each text starts behind ``ORDER`` line feeds.

The trees are kept together: for each string of a context and a byte that any language knows, the bits
it costs in all of them, escapes included. So most bytes of a text take one look-up, whatever the
number of languages; only strings that no language knows are taken down order by order.

Trees are learned by one task from a bounded sample: for each language at most ``SAMPLE_BYTES`` (and for
all of them together ``ALL_BYTES``), of texts of at most an eighth of that, in an order drawn by a hash.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unit
from .toxicity import held_out

#: Bytes of the longest context; one more must fit 64 bits.
ORDER = 4
SAMPLE_BYTES, ALL_BYTES = 1 << 20, 48 << 20
#: Languages that can be told apart; each adds one number to every string that is known.
LANGUAGES = 256
#: Bytes that are scored at once.
PIECE = 1 << 19
UNKNOWN = "und"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """Where each of some distinct 64-bit keys stands: open addressing, many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of keys that want one slot, one gets it
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``, -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


def grams(data: np.ndarray, n: int, first: int) -> np.ndarray:
    """The ``n`` bytes that end at each place from ``first`` on, packed into one number."""
    out = np.zeros(len(data) - first, np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[first - n + 1 + k : len(data) - n + 1 + k]
    return out


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * n)) - 1)


class Model:
    """``costs[k]`` and ``escapes[k]``: bits per language of the known strings of k context bytes and one more,
    and of escapes from the known contexts of k bytes."""

    def __init__(self, names: list[str], known: list[np.ndarray], costs: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray]):
        self.names, self.known, self.costs, self.contexts, self.escapes = names, known, costs, contexts, escapes
        self.where, self.at = [Index(k) for k in known], [Index(k) for k in contexts]

    def bits(self, data: np.ndarray, first: int) -> np.ndarray:
        """Bits of each byte from ``first`` (at least ``ORDER``) on, one column per language."""
        whole = grams(data, ORDER + 1, first)
        found = self.where[ORDER].find(whole)
        out = self.costs[ORDER][found]
        todo = np.flatnonzero(found < 0)
        out[todo] = 0
        for k in range(ORDER, -1, -1):
            context = self.at[k].find(_low(whole[todo] >> np.uint64(8), k))
            out[todo] += np.where(context[:, None] >= 0, self.escapes[k][context], np.float32(0))
            if k == 0:
                out[todo] += np.float32(8)
                break
            found = self.where[k - 1].find(_low(whole[todo], k))
            out[todo[found >= 0]] += self.costs[k - 1][found[found >= 0]]
            todo = todo[found < 0]
            if not len(todo):
                break
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        out = np.zeros((len(texts), len(self.names)))
        start = b"\n" * ORDER
        piece, size, runs = [], 0, []

        def flush() -> None:
            nonlocal size
            data = np.frombuffer(b"".join(piece), np.uint8)
            bits = self.bits(data, ORDER)
            lows = np.array([lo - ORDER for _, lo, _ in runs])
            # The bytes of a start behind another text's end are coded, too, but belong to none.
            edges = np.stack([lows, lows + np.array([n for _, _, n in runs])], 1).ravel()
            sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]), bits.dtype)]), edges, dtype=np.float64)[::2]
            np.add.at(out, [k for k, _, _ in runs], sums)
            piece.clear()
            runs.clear()
            size = 0

        for k, text in enumerate(texts):
            for lo in range(0, len(text), PIECE):
                part = text[lo : lo + PIECE]
                before = text[lo - ORDER : lo] if lo else start
                piece += [before, part]
                runs.append((k, size + ORDER, len(part)))
                size += ORDER + len(part)
                if size >= PIECE:
                    flush()
        if runs:
            flush()
        return out


def train(texts: dict[str, list[bytes]]) -> Model:
    """The frozen trees of the languages of ``texts``."""
    names = sorted(texts)
    start = b"\n" * ORDER
    counts: list[list] = [[] for _ in range(ORDER + 1)]
    for name in names:
        data = np.frombuffer(b"".join(x for t in texts[name] for x in (start, t)), np.uint8)
        sizes = np.array([len(t) + ORDER for t in texts[name]], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        inside = np.ones(len(data), bool)
        for k in range(ORDER):
            inside[begins + k] = False
        for k in range(ORDER + 1):
            own = grams(data, k + 1, min(ORDER, len(data)))[inside[ORDER:]] if inside.any() else np.zeros(0, np.uint64)
            counts[k].append(np.unique(own, return_counts=True))
    known, costs, contexts, escapes = [], [], [], []
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(u for u, _ in counts[k])]))
        outer = np.unique(keys >> np.uint64(8)) if k else np.zeros(1, np.uint64)
        cost, escape = np.zeros((len(keys), len(names)), np.float32), np.zeros((len(outer), len(names)), np.float32)
        of = np.searchsorted(outer, keys >> np.uint64(8) if k else keys * np.uint64(0))
        shorter = costs[k - 1][np.searchsorted(known[k - 1], _low(keys, k))] if k else np.full((len(keys), len(names)), 8, np.float32)
        for x, (own, c) in enumerate(counts[k]):
            here = np.searchsorted(keys, own)
            total, kinds = np.bincount(of[here], c, len(outer)), np.bincount(of[here], minlength=len(outer))
            held = kinds > 0
            escape[held, x] = np.log2((total[held] + kinds[held]) / kinds[held])
            cost[:, x] = escape[of, x] + shorter[:, x]
            cost[here, x] = np.log2((total + kinds)[of[here]] / c)
        known.append(keys)
        costs.append(cost)
        contexts.append(outer)
        escapes.append(escape)
    return Model(names, known, costs, contexts, escapes)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", allowed=None) -> Model:
    """Learn from a bounded sample of the rows with a language for which ``allowed`` holds.

    Null and empty texts teach nothing, equal texts of a language count once. Without rows to learn from
    the model knows no language; more than ``LANGUAGES`` are an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    rows = rows.where(allowed) if allowed is not None else rows
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.octet_length(text_col).alias("n"), unit(F.col(id_col), F.col(text_col), F.lit(11)).alias("u"))
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("all"), F.max("n").alias("longest")).limit(LANGUAGES + 1)
    sizes = {r.lang: r.all for r in sizes.collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return train({})
    most = min(SAMPLE_BYTES, ALL_BYTES // len(sizes))
    # Three times what is needed is drawn, as copies and long texts are left out.
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, 3.0 * most / n)))
    drawn = rows.where((F.col("u") < F.try_element_at(rate, F.col("lang"))) & (F.col("n") <= most // 8)).groupBy("lang", "t").agg(F.min("u").alias("u"), F.min("n").alias("n"))
    order = Window.partitionBy("lang").orderBy("u", "t").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("so_far", F.sum("n").over(order)).where(F.col("so_far") <= most)

    def learn(batches):
        texts: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["t"].to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
        model = train({lang: sorted(own) for lang, own in texts.items()})
        for at, part in enumerate((model.known, model.costs, model.contexts, model.escapes)):
            for k, x in enumerate(part):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([k]), pa.array([pickle.dumps(x)]), pa.array([model.names])], names=["at", "k", "x", "names"])

    # One task holds the sample, whose size is bounded whatever the table's.
    rows = drawn.select("lang", F.col("t").cast("binary").alias("t")).repartition(1).mapInArrow(learn, "at long, k long, x binary, names array<string>").collect()
    if not rows:
        return train({})
    parts = {(r.at, r.k): pickle.loads(bytes(r.x)) for r in rows}
    return Model(list(rows[0].names), *([parts[at, k] for k in range(ORDER + 1)] for at in range(4)))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", output: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` plus ``output``, the language in which the whole text costs fewest bits, and ``score``, its
    share of the languages' chances (two to the power of minus the bits).

    Ties go to the language that is first in code point order. A text that is null, empty or has no letter, and
    any text if no language was learned, gives ``und`` and 0. Repeated rows get equal results, an empty
    table gives no rows, long texts are read whole, and columns of the outputs' names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast((model.names, model.known, model.costs, model.contexts, model.escapes))
    carried = [c for c in docs.columns if c not in (output, score)]

    def run(batches):
        model = Model(*known.value)
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            which = np.flatnonzero(batch["__ep_letters"].to_numpy(zero_copy_only=False)) if model.names else np.zeros(0, int)
            for lo in range(0, len(which), 256):
                some = which[lo : lo + 256]
                bits = model.totals([batch["__ep_text"][int(k)].as_py() for k in some])
                best = bits.argmin(1)
                least = bits[np.arange(len(some)), best][:, None]
                scores[some] = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1)
                for k, b in zip(some, best, strict=True):
                    names[k] = model.names[b]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(names, pa.string()), pa.array(scores)], names=[*carried, output, score])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried), f"`{output}` string, `{score}` double"])
    letters = F.coalesce(F.rlike(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)).alias("__ep_letters")
    return docs.select(*carried, F.col(text_col).cast("binary").alias("__ep_text"), letters).mapInArrow(run, schema)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, allowed=~held_out())
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op11_language": op11_language}
SQL: dict[str, str] = {}
