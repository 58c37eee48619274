import hashlib
import random
import re

import duckdb

from episodica.llm import pii

from .cases import ODD, documents

P = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in P.items():
        for m in p.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def spans(row):
    return [f"{kind}:{x.s}:{x.e}" for kind in P for x in row[kind]]


HARD = [
    "a@b.c_d@e.f x.y@z a@b a@@b.c é@a.b a.b@c.d.e. %+-@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 00000300.1.1.1 1.2.3 ٣.1.1.1 1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 4111111111111111 5500 0000 0000 0004-",
    "+1 (988) 555-2485 ++49.30.123456 +1 +12345678 +123456789 +1234567890123456 +1.....2",
    "\U0001f600 mail \U0001f600 a@b.co é 10.0.0.1 \n+1 988 555 2485",
    "1" * 5000 + " " + "a." * 5000 + "@" + "b." * 5000 + "c",
]


def test_base_spans_match_brute_force(spark):
    for docs in (documents(spark, ODD + HARD), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = pii.find_pii(docs).collect()
        assert rows
        for r in rows:
            assert spans(r) == brute(r.text), r.text[:80]


def test_empty_table(spark):
    assert pii.find_pii(documents(spark, ["x"]).limit(0)).count() == 0


def test_query_digests(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in pii.op4_pii(spark, d).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))


def test_revealing_terms(spark):
    near = [f"Our treasurer Zebulon wrote from z.carter@mail{0}.example.org about matter {w} today." for w in ("oaks", "elms", "pines", "firs", "larch")]
    far = [f"The weather in {w} was mild and the harbour stayed open for everyone." for w in ("oaks", "elms", "pines", "firs", "larch", "today", "matter", "about", "wrote", "from", "our", "treasurer") for _ in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near + far + near[:1] * 3)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert {x.t for x in rows[0].term} == {"zebulon"}
    assert rows[0].text[rows[0].term[0].s : rows[0].term[0].e] == "Zebulon"
    assert not rows[7].term
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "Our treasurer  wrote from [EMAIL] about matter oaks today."
    assert clean[7] == rows[7].text


def test_copies_alone_reveal_nothing(spark):
    docs = spark.createDataFrame([(i, "Quentin may be asked at q@b.example.org any day.") for i in range(50)] + [(99, None)], "doc_id long, text string")
    assert all(not r.term for r in pii.find_pii(docs).collect())


def test_revealing_terms_are_marked_wherever_they_stand(spark):
    woods = ("oaks", "elms")
    held = [f"Zebulon met us.\n{'The weather was mild there. ' * 4}\nMail z.carter@mail0.example.org about {w} and so on, {w} being scarce.\nYours, zebulon" for w in woods]
    lone = ["Nobody saw ZEBULON at the harbour, they say."]
    far = [f"The weather in {w} was mild there, about as mild as yours, being scarce. They met and mail us and so on." for w in (*woods, "pines", "firs") for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(held + lone + far)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i in range(3):
        assert {x.t for x in rows[i].term} == {"zebulon"}
        assert [rows[i].text[x.s : x.e].lower() for x in rows[i].term] == ["zebulon"] * (2 if i < 2 else 1)
    assert not any(rows[i].term for i in range(3, len(rows)))
    assert all("zebulon" not in r.text.lower() for r in pii.sanitise(docs).collect())
    assert "text" not in pii.find_pii(docs, carry=False).columns


def test_base_columns_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    columns = ["doc_id", *(f"n_{kind}" for kind in P), "base_sha256"]
    said = sorted(duck.execute(f"SELECT {', '.join(columns)} FROM ({pii.BASE_SQL})").fetchall())
    assert sorted(tuple(r) for r in pii.op4_pii(spark, d).select(*columns).collect()) == said
    assert sum(r[1] for r in said) > 0 and sum(r[3] for r in said) > 0


def test_planted_terms_are_found_and_no_others(spark):
    """Each of ten mail domains has terms of its own in four of five documents; each document has another
    sender, words of a common and of a rare vocabulary, and may be copied."""
    rng = random.Random(5)
    common, rare = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], [f"rare{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(4000)]
    planted = {k: [f"secret{chr(97 + k)}x", f"secret{chr(97 + k)}y"] for k in range(10)}
    docs = []
    for k in range(4000):
        words = rng.choices(common, k=40) + rng.choices(rare, k=6)
        if k % 20 == 0:
            own = k // 20 % 10
            words += [w for w in planted[own] if rng.random() < 0.8]
            words.append(f"person{k}@mail{own}.example.org")
        rng.shuffle(words)
        docs += [" ".join(words)] * (4 if k % 400 == 0 else 1)
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).select("term").collect()
    marked = {x.t for r in rows for x in r.term}
    true = {w for own in planted.values() for w in own}
    assert len(marked & true) >= 0.9 * len(true)
    assert len(marked & true) >= 0.9 * len(marked)


def test_columns_of_callers_stay(spark):
    rows = [(1, "a@b.org wrote", "mine", 5, "x", None, "t", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string, ip int, card string, phone string, term string, own string")
    (clean,) = pii.sanitise(docs).collect()
    assert tuple(clean) == (1, "[EMAIL] wrote", "mine", 5, "x", None, "t", "o")
    (found,) = pii.find_pii(docs).collect()
    assert (found.own, found.email[0].m, found.ip) == ("o", "a@b.org", [])


def test_no_pairs_are_made_of_common_terms(spark, monkeypatch):
    kept, stash = {}, pii.stash
    monkeypatch.setattr(pii, "stash", lambda df, name: kept.setdefault(name, stash(df, name)))
    monkeypatch.setattr(pii, "COMMON", 1, raising=False)
    held = [f"Zebulon met us. The weather was mild there. Mail z.carter@mail0.example.org about {w} and so on. Yours, zebulon" for w in ("oaks", "elms")]
    far = [f"The weather in {w} was mild there, about as mild as yours. They met and mail us and so on." for w in ("oaks", "elms", "pines", "firs") for _ in range(20)]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(held + far)), "doc_id long, text string"), carry=False).collect()
    assert {x.t for r in rows for x in r.term} == {"zebulon"}
    assert {r.t for r in kept["pii-twice"].collect()} == {"zebulon"}


def test_no_pairs_are_made_of_terms_that_most_documents_have_elsewhere(spark, monkeypatch):
    """A term of twelve documents is far from common, but two of them are too few for an entity of two."""
    kept, stash = {}, pii.stash
    monkeypatch.setattr(pii, "stash", lambda df, name: kept.setdefault(name, stash(df, name)))
    held = [f"Zebulon met us with treacle. The weather was mild there. Mail z.carter@mail0.example.org about {w} and so on. Yours, zebulon" for w in ("oaks", "elms")]
    far = [f"The weather in {w} was mild there, about as mild as yours. They met and mail us with {'treacle' if k < 3 else 'butter'} and so on." for w in ("oaks", "elms", "pines", "firs") for k in range(20)]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(held + far)), "doc_id long, text string"), carry=False).collect()
    assert {x.t for r in rows for x in r.term} == {"zebulon"}
    assert {r.t for r in kept["pii-twice"].collect()} == {"zebulon"}
