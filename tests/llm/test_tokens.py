from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from episodica.llm import tokens

from .cases import ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACED = ["a  b", "a   b", " a", "a ", "a \n b", "a\n\n b", "\n \n", "a   b", "a b c", "x <|endoftext|> y", "<|endoftext|>", "don't we'll  'tis", "a\t b", "a \tb"]


def expected(rows):
    own, start, out = Tokenizer.from_file(PATH), 0, {}
    for doc_id, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.setdefault(doc_id, []).append((start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return {k: sorted(v) for k, v in out.items()}


def read(found):
    out = {}
    for r in found.collect():
        out.setdefault(r[0], []).append((r.start, r.n_tokens, r.ids_crc32))
    return {k: sorted(v) for k, v in out.items()}


def test_odd_cases_and_small_shards(spark, tmp_path):
    docs = documents(spark, ODD + SPACED)
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    tokens.write_shards(docs, f"{tmp_path}/t", tokenizer=PATH, shard_ids=2000)
    assert spark.read.parquet(f"{tmp_path}/t").count() > 3
    assert read(tokens.read_documents(spark, f"{tmp_path}/t")) == expected(rows)
    tokens.write_shards(docs.limit(0), f"{tmp_path}/e", tokenizer=PATH)
    assert tokens.read_documents(spark, f"{tmp_path}/e").count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    assert read(tokens.op8_tokens(spark, d)) == expected(rows)


def test_matrix_against_brute_force():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 4), (1, 1), (7, 3), (512, 5), (5000, 9), (1025, 17)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32 if bits > 16 else np.uint16)
        data = tokens.pack(ids, bits, [3, None], [n, 0])
        matrix, doc_ids, lengths = tokens.unpack(data)
        assert doc_ids == [3, None] and list(lengths) == [n, 0]
        assert (matrix.ids() == ids).all()
        for i in rng.integers(0, n, min(n, 40)):
            v = int(ids[i])
            at = np.flatnonzero(ids == v)
            assert matrix.access(int(i)) == v
            assert matrix.rank(v, int(i)) == (at < i).sum()
            k = int(np.searchsorted(at, i))
            assert matrix.select(v, k) == i and matrix.select(v, len(at)) == -1
