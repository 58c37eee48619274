"""Remembered words: those met again outlive a full cache, and ids stay those of the whole texts."""

from episodica.llm import tokens

TEXTS = ["ab cd ab, ef", "  ab  cd ", "x <|endoftext|> ab", "a\n b \tc", "", "ab " + " ".join(f"w{k}" for k in range(40)), "cd ab ef"]


def test_words_met_again_are_kept(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "CACHE", 40)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = encoder._bytes(TEXTS)
    learned = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.extend(words), learn(words)))
    for _ in range(2):
        for text, ids in zip(TEXTS, wanted, strict=True):
            assert encoder.encode([text]) == [ids]
    assert encoder.encode(TEXTS) == wanted
    learned.clear()
    for k in range(60):  # one word is met in every text, the others fill the cache
        encoder.encode([f"t ef u{k}"])
    assert learned.count("ef") == 0


class Counting:
    """A tokenizer that counts the characters it encodes."""

    def __init__(self, whole):
        self.whole, self.seen = whole, 0

    def encode_batch_fast(self, texts, **more):
        self.seen += sum(map(len, texts))
        return self.whole.encode_batch_fast(texts, **more)


def test_stems_are_encoded_once_for_all_marks():
    import string

    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    marks = [*string.punctuation, "'s", "'s.", ".'", "...", "'", "''", "--'ll", "\n.", "….", " .", "._-", "́.", "²!"]
    stems = ["acquaintance", "öß", "x7", "7", "don't", "'s", "ª", "日本", "é", "..", "<|endoftext|>"]
    texts = [f"t {a}{m} {a}{b}{m}" for a in stems for b in ("", ".", "'t") for m in marks] + ["", " ", "  .", "t ."]
    assert encoder.encode(texts) == encoder._bytes(texts)
    encoder.whole = Counting(encoder.whole)
    encoder.encode(["t " + " ".join(f"extraordinarily{m}" for m in string.punctuation)])
    assert encoder.whole.seen < 100


def test_slices_hold_every_row_once():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 3, 40, 0, 5, 6, 0, 0, 90)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for rows, size in ((2, 10), (100, 1), (100, 45), (1, 100), (4, 1000)):
        tokens.ROWS, was_rows, tokens.BYTES, was_bytes = rows, tokens.ROWS, size, tokens.BYTES
        try:
            runs = [s["t"].to_pylist() for s in tokens._slices(batch)]
        finally:
            tokens.ROWS, tokens.BYTES = was_rows, was_bytes
        assert sum(runs, []) == texts
        assert all(0 < len(r) <= rows and (len(r) == 1 or sum(map(len, r)) <= size) for r in runs)
