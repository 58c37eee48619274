"""Token-ID output: one wavelet matrix per shard.

Documents are put in id order by a range shuffle; each task encodes its range with a public
tokenizer, ends every document with an end id and packs at most ``SHARD_IDS`` ids (never part of a
document) into a shard file: header, document ids and lengths, and for every bit of an id a bit
plane with its rank directory, each section compressed on its own. From one such file the matrix
answers access (id at a place), rank (how often an id occurs before a place) and select (where it
occurs the k-th time) without unpacking the ids. The files' bytes are written as rows by Spark's
committer, so a lost task leaves no half-written shard.
"""

from __future__ import annotations

import os
import re
import string
import struct
import uuid
from itertools import filterfalse
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import shared_dir, table, text_or_empty

SHARD_IDS = 1 << 21
#: Encoded words that a worker keeps (about 200 bytes each); when half of it is full, it becomes the older half.
CACHE = 1_000_000
#: An empty word, or one that begins with white space, in words joined by blanks.
ODD = re.compile(r" (?:\s|$)")
#: Rows and bytes of text that are split and looked up together; a longer text is looked up alone.
ROWS, BYTES = 4096, 16 << 20
#: Marks that the pre-tokenizer parts from a letter or digit before them, and what surely is one.
MARKS, BEFORE_MARKS = string.punctuation, frozenset(string.ascii_letters + string.digits + "ÄÖÜßàâäçèéêëîïñòóôöùûü")
MAGIC, HEAD, BLOCK = b"WAVM", struct.Struct("<4sBxxxQQ"), 512


class WaveletMatrix:
    """Bit planes (most significant first) with counts of ones before every block of 512 bits."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        for level in reversed(range(bits)):
            ones = (ids & ids.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(ones))
            ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])
            zeros.append(int(len(ones) - np.count_nonzero(ones)))
            per = np.add.reduceat(np.bitwise_count(planes[-1]), np.arange(0, len(planes[-1]), BLOCK // 8), dtype=np.uint32) if len(ids) else np.zeros(0, np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(per)]).astype(np.uint32))
        return cls(len(ids), planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        plane, block = self.planes[level], i // BLOCK
        whole = plane[block * BLOCK // 8 : i // 8]
        rest = int(plane[i // 8]) >> (8 - i % 8) if i % 8 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(whole).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8]) >> (7 - i % 8) & 1
            value = value << 1 | bit
            i = self.zeros[level] + self._ones(level, i) if bit else i - self._ones(level, i)
        return value

    def _down(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` occurs before place ``i``."""
        lo, hi = self._down(value, i)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``value``; -1 if there are fewer."""
        lo, hi = self._down(value, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in reversed(range(len(self.planes))):
            one = value >> (len(self.planes) - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            a, b = 0, self.n
            while a < b:  # the place before which `want` equal bits stand, and which is one itself
                mid = (a + b) // 2
                seen = self._ones(level, mid + 1)
                if (seen if one else mid + 1 - seen) <= want:
                    a = mid + 1
                else:
                    b = mid
            i = a
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the partitions undone from the last plane to the first."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back, z = np.empty_like(out), self.zeros[level]
            back[~ones] = out[:z]
            back[ones] = out[z:] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = back
        return out


def pack(ids: np.ndarray, bits: int, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    matrix = WaveletMatrix.build(ids, bits)
    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids])
    sections = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), np.array(lengths, "<u4").tobytes()]
    for plane, rank in zip(matrix.planes, matrix.ranks, strict=True):
        sections += [plane.tobytes(), rank.astype("<u4").tobytes()]
    sections = [press(s) for s in sections]
    head = HEAD.pack(MAGIC, bits, matrix.n, len(lengths)) + np.array([*matrix.zeros, *map(len, sections)], "<u8").tobytes()
    return head + b"".join(sections)


def unpack(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and lengths of a shard file."""
    magic, bits, n, n_docs = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    table_ = np.frombuffer(data, "<u8", 3 * bits + 3, HEAD.size)
    zeros, at, parts = [int(z) for z in table_[:bits]], HEAD.size + table_.nbytes, []
    for size in table_[bits:]:
        parts.append(zstandard.decompress(data[at : at + int(size)]) if size else b"")
        at += int(size)
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n_docs)
    doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(parts[0], "<i8"), known, strict=True)]
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[4::2]]
    return WaveletMatrix(n, planes, zeros, ranks), doc_ids, np.frombuffer(parts[2], "<u4")


class Encoder:
    """Byte-level BPE through the tokenizers library, each blank-separated word encoded once.

    The pre-tokenizer starts a new piece at every blank between two words, so words can be encoded
    apart and remembered. New words are encoded together, joined by blanks: only their first tokens
    begin with the blank's symbol, which shows where each word starts. A text with an empty word,
    a word that begins with white space, or a special token's string is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.begins = np.zeros(size, bool)
        for token, k in self.whole.get_vocab().items():
            self.begins[k] = token.startswith("\u0120")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}  # ends of words
        self.before: dict[str, bytes | None] = {}  # words of the time before; those met again go back to ``words``

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            joined = " " + " ".join(some)
            # Words that cannot be encoded apart are looked for in all at once, then one by one.
            if ODD.search(joined) or any(s in joined for s in self.special):
                odd = {w for w in some if not w or w[0].isspace() or any(s in w for s in self.special)}
                self.words.update(dict.fromkeys(odd))
                some = [w for w in some if w not in odd]
            # Marks at the end of a word are pieces of their own, so its stem is learned, for all marks at once.
            stems = [w.rstrip(MARKS) for w in some]
            stems = [s if s and s[-1] in BEFORE_MARKS else w for s, w in zip(stems, some, strict=True)]
            self._learn_stems(list(dict.fromkeys(filterfalse(self.words.__contains__, stems))))
            marked = [(w, s, w[len(s) :]) for w, s in zip(some, stems, strict=True) if len(s) < len(w)]
            if len(self.marks) > CACHE // 100:
                self.marks = {}
            marks = list({m for _, _, m in marked} - self.marks.keys())
            self.marks.update(zip(marks, self._bytes(marks), strict=True))
            self.words.update((w, self.words[s] + self.marks[m]) for w, s, m in marked)

    def _learn_stems(self, words: list[str]) -> None:
        if words:
            ids = np.array(self.whole.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.kind)
            raw, at = ids.tobytes(), (np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.kind.itemsize).tolist()
            self.words.update(zip(words, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(texts, " ")
        sizes = split.value_lengths().to_numpy()
        ends, words = np.cumsum(sizes, dtype=np.int64), split.flatten()
        rest = np.ones(len(words), bool)
        rest[ends - sizes] = False
        heads = words.take(pa.array(ends - sizes))
        # Each word is looked up once, however often the texts have it.
        coded = words.filter(pa.array(rest)).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = list(filterfalse(self.words.__contains__, known))
        if len(self.words) + len(new) > CACHE // 2:
            self.words, self.before = {}, self.words
            new = known
        met = list(filter(self.before.__contains__, new))
        self.words.update(zip(met, map(self.before.__getitem__, met), strict=True))
        self._learn(list(filterfalse(self.before.__contains__, new)))
        coded = pa.array(list(map(self.words.__getitem__, known)), pa.large_binary()).take(coded.indices)
        place = np.concatenate([[0], ends - np.arange(1, len(ends) + 1)])
        at = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1)[place].tolist() if len(coded) else [0] * len(place)
        whole = np.zeros(len(texts), bool)
        if coded.null_count:  # a word that cannot be encoded apart
            whole[np.searchsorted(place, np.flatnonzero(coded.is_null()), "right") - 1] = True
        first = self._bytes(pc.if_else(pa.array(whole), texts, heads).to_pylist())
        raw = memoryview(coded.buffers()[2] or b"")
        return [f if w else f + raw[a:b] for f, w, a, b in zip(first, whole.tolist(), at[:-1], at[1:], strict=True)]


def _slices(batch: pa.RecordBatch):
    """The batch in runs of at most ``ROWS`` rows and ``BYTES`` of text, or of one row."""
    ends, lo = np.cumsum(pc.binary_length(batch["t"]).to_numpy(), dtype=np.int64), 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, BYTES + (ends[lo - 1] if lo else 0), "right"))
        hi = min(max(hi, lo + 1), lo + ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per Python worker, so that its words outlive a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write ``docs`` in ascending id order (nulls first, ties by text) as shard files under ``path``.

    Columns: part and seq (shards in order), n_ids, n_docs, file. Null texts are empty documents: the end
    id alone. Repeated rows are documents of their own, long texts are encoded whole and may fill a
    shard alone, other columns are left out, and an empty table gives no shard.
    """

    def run(batches):
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        bits = max(1, (encoder.whole.get_vocab_size() - 1).bit_length())
        width, part, seq = encoder.kind.itemsize, TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, held = [], [], [], 0

        def shard():
            data = pack(np.frombuffer(b"".join(ids), encoder.kind), bits, doc_ids, lengths)
            row = [[part], [seq], [held], [len(lengths)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_ids", "n_docs", "file"])

        for batch in batches:
            for some in _slices(batch):
                for doc_id, raw in zip(some["id"].to_pylist(), encoder.encode(some["t"]), strict=True):
                    n = len(raw) // width + 1
                    if held and held + n > shard_ids:
                        yield shard()
                        ids, doc_ids, lengths, held, seq = [], [], [], 0, seq + 1
                    ids += (raw, end)
                    doc_ids.append(doc_id)
                    lengths.append(n)
                    held += n
        if lengths:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "t")
    rows.mapInArrow(run, "part int, seq int, n_ids long, n_docs long, file binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shard files alone: id, start, n_tokens, ids_crc32, in no order."""
    shards = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["file"], strict=True):
                matrix, doc_ids, lengths = unpack(data.as_py())
                ids, starts = matrix.ids().astype("<u4"), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                crc = [crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "seq", "id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "file").mapInArrow(run, "part int, seq int, id long, inside long, n_tokens long, ids_crc32 long")
    # Ids before each task's range (one row a task), then before each shard of it.
    tasks = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before"))
    files = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("inner"))
    files = files.join(tasks, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("before"))
    return rows.join(files, ["part", "seq"]).select("id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_tokens": op8_tokens}
SQL: dict[str, str] = {}
