import hashlib
import random

from pyspark.sql import functions as F

from episodica.llm import chat

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<<SYS>>x<</SYS>>", "<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n", "ends with <|im_end|", "<", "[", "\\", "<\\<s>", "a\n\nb\n", "\U0001f600 é <s>\U0001f600", "<|endoftext|>", "[[/INST]"]
ROLES = ["user", "assistant", "system", "", "odd\nrole", "<|im_end|>", "a b+%/ü"]


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hard_conversations(spark):
    rng, convs = random.Random(4), {}
    for c in range(120):
        convs[c] = [(rng.choice(ROLES[:3] if c % 2 else ROLES), "".join(rng.choices(TEXTS, k=rng.randint(1, 4)))) for _ in range(rng.randint(1, 7))]
    convs[500] = [("user", None), (None, "x"), ("assistant", None)]
    rows = [(c, n, r, t, "extra") for c, turns in convs.items() for n, (r, t) in enumerate(turns)]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body string"))
    read = done.select("conv_id", "formatted", "loss_mask", chat.parse(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(read) == len(convs)
    for r in read:
        source = [(a or "", b or "") for a, b in convs[r.conv_id]]
        assert [(t.role, t.text) for t in r.turns] == source
        assert r.loss == [t for role, t in source if role == "assistant"]
        for m in r.loss_mask:
            assert r.formatted[m.start : m.end].encode() == r.formatted.encode()[m.byte_start : m.byte_end]
            assert not any(c in r.formatted[m.start : m.end] for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>"))


def test_parser_refuses_what_breaks_the_grammar(spark):
    bad = ["x", "<|im_start|>user\nhi", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\nhi </s><|im_end|>\n"]
    rows = spark.createDataFrame([(b,) for b in bad], "f string").select(chat.parse(F.col("f")).alias("t")).collect()
    assert all(None in r.t for r in rows)


def test_query_matches_brute_force(spark):
    d, hard = "/root/testdata/sf0.01", "</s>[INST] ok [/INST]"
    convs = {-7: [("user", hard), ("assistant", hard)]}
    for r in spark.read.parquet(f"{d}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op7_chat(spark, d).collect()}
    assert got == {c: expected(t) for c, t in convs.items()}


def test_ties_repeats_null_ids_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)], schema)
    got = {r.conv_id: r for r in chat.format_chats(rows).select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert [x.text for x in got[1].t] == ["a", "a", "b"]
    assert [(x.role, x.text) for x in got[None].t] == [("", "")]
    assert chat.format_chats(rows.limit(0)).count() == 0
