"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character 3- to 7-grams and of the word itself
(hashed into ``BUCKETS`` rows), so a misspelling that was never seen shares most of its vectors with
the word it hides. A passage is the plain mean of its words' vectors; a softmax layer on it gives the
chance of label 1. Embeddings and layer are learned together (Adagrad). Passages of two blocks of
``HALF`` words overlap by one block, so what stands across a border is whole in one of them. A document
is as toxic as its worst passage, so a few words in a long text are not averaged away; while learning,
the worst passages stand for a toxic document, and all passages, the worst first, for a clean one.

Labels are learned from a bounded sample: in an order drawn by a hash of the id, the first ``SAMPLE``
documents of each class that together have at most ``SAMPLE_CHARS`` characters (and none of more
than a million). The sample is turned
into the model by one task, so the driver sees one number for each bucket. Buckets that fewer than
``LEAST_DOCS`` documents of the sample have stay neutral: they could only be learned by heart. So do
those that documents of both classes have about as often (within ``SIGNAL`` standard errors).
Scores cover every whole text.
"""

from __future__ import annotations

from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Documents of label 0 and 1 in the sample.
SAMPLE = (9000, 3000)
#: Characters of all documents of one class in the sample.
SAMPLE_CHARS = 24_000_000
BUCKETS, DIM, HALF = 1 << 16, 12, 8
#: Lengths of the character n-grams.
GRAMS = (3, 4, 5, 6, 7)
#: Steps of gradient descent, whatever the size of the sample.
UPDATES = 1600
LEAST_DOCS = 3
#: Standard errors by which a bucket's share of documents must differ between the classes; others stay neutral.
SIGNAL = 4.0
#: Share of the words that a step leaves out, so that no passage is learned by heart.
DROP = 0.2
#: Added to every logit, as learning sees more clean passages than toxic ones. This, ``HALF`` and ``SIGNAL`` were
#: chosen by five-fold cross-validation over the labelled rows of sf0.1 that are not held out.
SHIFT = 0.32
#: Words whose scores a task keeps; the cache starts again when it is full.
CACHE = 300_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 and c not in (35, 36, 39, 42) or c in (58, 59, 60, 61, 62, 63, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126, 127) else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z); ``# $ ' * @`` and digits stay, as misspellings use them."""
    return (text or b"").translate(_FOLD).split()


def grams(word: bytes) -> list[int]:
    """Buckets of the word itself and of its character n-grams with marked ends.

    Signs that only follow or lead a word (``word###``) are no part of it.
    """
    bare = word.strip(b"#$'*")
    word = bare if len(bare) > 2 else word
    w = f"<{word.decode('utf-8', 'replace')}>"
    return [crc32(word) % BUCKETS, *(crc32(w[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1))]


def blocks(n: int) -> np.ndarray:
    """Starts of the blocks of a text of ``n`` words; a rest below half a block joins the last one."""
    return np.arange(0, max(n - HALF // 2, 1), HALF)


def passages(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one word of the passages: two neighbouring blocks each (or the only one)."""
    starts = blocks(n)
    return starts[: max(1, len(starts) - 1)], np.append(starts[2:], n)


class Model:
    """One number per bucket, a bias, and ``prior``, the score of a text without words.

    Both layers are linear up to the softmax, so their product gives the same scores as the two.
    """

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior


def _spread(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of each run of the given length, one after the other."""
    return np.repeat(firsts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())


def train(texts: list[bytes], labels: list[int], *, updates: int = UPDATES, batch: int = 256, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.int64)
    prior = float(y.mean()) if len(y) else 0.0
    # All words of the sample as numbers, document after document; passages are runs of them.
    ids: dict[bytes, int] = {}
    tokens, begin, length, of = array("i"), [], [], []
    for k, text in enumerate(texts):
        said = [ids.setdefault(w, len(ids)) for w in words_of(text)]
        if said:
            first, last = passages(len(said))
            begin.append(first + len(tokens))
            length.append(last - first)
            of.append(np.full(len(first), k))
            tokens.extend(said)
    if len(set(labels)) < 2 or not of:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, prior)
    tokens = np.frombuffer(tokens, np.int32)
    begin, length, of = np.concatenate(begin), np.concatenate(length), np.concatenate(of)
    flat, count = array("i"), array("i")
    for word in ids:
        own = grams(word)
        flat.extend(own)
        count.append(len(own))
    del ids
    flat, count = np.frombuffer(flat, np.int32), np.frombuffer(count, np.int32)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])

    seen = np.zeros((2, BUCKETS), np.int64)
    with_words = np.bincount(y[np.unique(of)], minlength=2)
    for lo, hi in zip(*(np.searchsorted(of, np.unique(of), side) for side in ("left", "right")), strict=True):
        own = np.unique(tokens[begin[lo] : begin[hi - 1] + length[hi - 1]])
        seen[y[of[lo]], np.unique(flat[_spread(start[own], count[own])])] += 1
    share, whole = seen / np.maximum(with_words, 1)[:, None], seen.sum(0) / with_words.sum()
    error = np.sqrt(np.maximum(whole * (1 - whole), 1e-12) * (1 / np.maximum(with_words, 1)).sum())
    common = ((seen.sum(0) >= LEAST_DOCS) & (np.abs(share[1] - share[0]) >= SIGNAL * error)).astype(np.float32)

    # Neutral buckets add nothing, so only the others are looked at from here on; a word keeps its number of grams.
    lively = common[flat] > 0
    word_of = np.repeat(np.arange(len(count)), count)
    flat, some_of = flat[lively], np.bincount(word_of[lively], minlength=len(count)).astype(np.int32)
    start = np.concatenate([[0], np.cumsum(some_of)[:-1]])
    del lively, word_of

    def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of runs of ``values``, of which some may be empty."""
        out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
        if len(values):
            out[sizes > 0] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[sizes > 0])
        return out

    E = (rng.uniform(-1, 1, (BUCKETS, DIM)) * 1e-3 * common[:, None]).astype(np.float32)
    W = (rng.uniform(-1, 1, (DIM, 2)) / DIM).astype(np.float32)
    b = np.zeros(2, np.float32)
    fused = lambda: (E @ (W[:, 1] - W[:, 0]), float(b[1] - b[0]))

    def score() -> np.ndarray:
        weights, bias = fused()
        word = summed(weights[flat], some_of) / count
        so_far = np.concatenate([[0.0], np.cumsum(word[tokens], dtype=np.float64)])
        return (so_far[begin + length] - so_far[begin]) / length + bias

    g_e, g_w, g_b = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    done = 0
    while done < updates:
        now = score() + rng.normal(0, 1e-6, len(begin))
        order = np.lexsort((-now, of))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        toxic = y[of] == 1
        mine = np.flatnonzero(toxic & (rank < (8 if 4 * done < updates else 1)))
        hard = np.flatnonzero(~toxic & (rank < 2))
        rest = np.flatnonzero(~toxic & (rank >= 2))
        todo = np.concatenate([mine, hard, rng.choice(rest, min(len(rest), 2 * len(hard)), replace=False)])
        rng.shuffle(todo)
        for k in range(0, len(todo), batch):
            some = todo[k : k + batch]
            done += 1
            words = tokens[_spread(begin[some], length[some])]
            kept = rng.random(len(words)) >= DROP
            per = some_of[words]
            feat = flat[_spread(start[words], per)]
            weight = np.repeat(kept / (count[words] * np.repeat(length[some], length[some])), per).astype(np.float32)
            rows = np.add.reduceat(per, np.concatenate([[0], np.cumsum(length[some])[:-1]]))
            h = summed(E[feat] * weight[:, None], rows)
            z = h @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[of[some]]] -= 1
            p /= len(some)
            d_w, d_b, d_h = h.T @ p, p.sum(0), p @ W.T
            by = np.argsort(feat, kind="stable")
            own, first = np.unique(feat[by], return_index=True)
            d_e = summed((np.repeat(d_h, rows, axis=0) * weight[:, None])[by], np.diff(np.append(first, len(by))))
            g_e[own] += (d_e**2).mean(1)
            g_w += d_w**2
            g_b += d_b**2
            E[own] -= 0.5 * d_e / np.sqrt(g_e[own])[:, None]
            W -= 0.2 * d_w / np.sqrt(g_w)
            b -= 0.2 * d_b / np.sqrt(g_b)
    weights, bias = fused()
    return Model(weights.astype(np.float32), bias + SHIFT, prior)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", allowed: Column | None = None) -> Model:
    """Learn from a bounded sample of the labelled documents for which ``allowed`` holds.

    Ids and texts with contradicting labels and null or empty texts are left out; of the rows that repeat an
    id one text is used, and equal texts count once. Without labels of both classes the model scores
    every text with the share of label 1 (0 without labels, as for an empty table).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.where(allowed) if allowed is not None else known
    known = known.groupBy(F.col(id_col).alias("__ep_id")).agg(F.min(label_col).alias("__ep_y"), F.max(label_col).alias("__ep_z")).where("__ep_y = __ep_z")
    # More ids than needed are drawn, as some labelled ids may have no document or a very long one.
    drawn = [known.where(F.col("__ep_y") == y).orderBy(F.xxhash64("__ep_id", F.lit(5)), "__ep_id").limit(2 * SAMPLE[y]) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1]).select("__ep_id", "__ep_y")
    texts = docs.where(F.length(text_col).between(1, SAMPLE_CHARS // 24)).join(F.broadcast(ids), F.col(id_col) == F.col("__ep_id"))
    texts = texts.groupBy("__ep_id", "__ep_y").agg(F.min(text_col).alias("t"))
    order = Window.partitionBy("__ep_y").orderBy(F.xxhash64("__ep_id", F.lit(5)), "__ep_id")
    texts = texts.withColumn("__ep_chars", F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__ep_nth", F.row_number().over(order))
    texts = texts.where((F.col("__ep_chars") <= SAMPLE_CHARS) & (F.col("__ep_nth") <= F.when(F.col("__ep_y") == 1, SAMPLE[1]).otherwise(SAMPLE[0])))

    def learn(batches):
        said: dict[bytes, set] = {}
        for batch in batches:
            for text, y in zip(batch["t"].to_pylist(), batch["y"].to_pylist(), strict=True):
                said.setdefault(text, set()).add(y)
        rows = sorted((t, *ys) for t, ys in said.items() if len(ys) == 1)
        model = train([t for t, _ in rows], [y for _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.bias]), pa.array([model.prior])], names=["weights", "bias", "prior"])

    # One task holds the sample, whose size is bounded whatever the table's.
    whole = texts.select(F.col("t").cast("binary").alias("t"), F.col("__ep_y").cast("int").alias("y")).repartition(1)
    found = whole.mapInArrow(learn, "weights binary, bias double, prior double").first()
    if found is None:  # an empty sample has no task
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0)
    return Model(np.frombuffer(bytes(found.weights), "<f4"), found.bias, found.prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", output: str = "score") -> DataFrame:
    """``docs`` plus ``output``: the chance of label 1 in its worst passage, from the whole text.

    A null or empty text or one without words scores the prior of the sample; repeated rows score
    alike, long texts are read whole, an empty table gives no rows, and a column of the output's name
    is replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast((array("f", model.weights.tobytes()), model.bias, model.prior))
    carried = [c for c in docs.columns if c != output]

    def run(batches):
        weights, bias, prior = known.value

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= CACHE:
                    self.clear()
                own = grams(word)
                self[word] = value = sum(map(weights.__getitem__, own)) / len(own)
                return value

        value = Words().__getitem__
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch["__ep_text"]):
                words = words_of(text.as_py())
                if not words:
                    out[k] = prior
                    continue
                so_far = np.concatenate([[0.0], np.cumsum(np.fromiter(map(value, words), float, len(words)))])
                first, last = passages(len(words))
                worst = ((so_far[last] - so_far[first]) / (last - first)).max() + bias
                out[k] = 1 / (1 + np.exp(-np.clip(worst, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(out)], names=[*carried, output])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried), f"`{output}` double"])
    return docs.select(*carried, F.col(text_col).cast("binary").alias("__ep_text")).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents below the threshold, columns as they were; learns from rows that are not held out.

    Null and empty texts score the prior; see ``fit`` and ``score`` for the other cases.
    """
    model = fit(docs, labels, allowed=~held_out())
    return score(docs, model, output="__ep_score").where(F.col("__ep_score") < threshold).select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), allowed=~held_out())
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
