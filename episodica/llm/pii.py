"""PII [native]: information-theoretic sanitisation.

Base finders mark emails, IP addresses, payment cards and phone numbers. What is protected are the
values found and the wider entities they belong to: a mail domain, the first two numbers of an address,
the issuer's six digits of a card, a phone number without its last seven digits. Terms t of the
documents that hold an entity c are weighed by corpus co-occurrence: with
``PMI(c, t) = log(N * n_ct / (n_c * n_t))`` and the entity's own information ``IC(c) = log(N / n_c)``,
the ratio PMI / IC tells which share of the entity's information the term gives away (1: the term
occurs only beside the entity); n counts documents. A term at or above ``DISCLOSURE`` is generalised
to a mark, at or above ``REMOVAL`` it is removed, wherever in the corpus it stands.

A ratio alone says little where counts are small: in one document any rare word has ratio 1. So a pair
is believed only if chance can hardly make it: with q = n_ct / n_t, p = n_c / N and k independent
sightings, a term that met the entity by chance would do so with a probability of at most
``exp(-k / q * KL(q || p))`` (Chernoff), and over all pairs there are, fewer than ``CHANCE`` such terms may be
expected. Copies are one sighting, in two ways. Of a value, different surroundings are counted, of a wider
entity, different values. And the entity's documents are counted by their own words, those that no
document without the entity has: who shares ``COPY`` of them with the entity's first document, or is as
similar to it in five-word shingles, is a copy of it; the others count once for each minimum of their own
words' hashes, which copies mostly share. The lesser count is k.
So a value seen in one passage, and an entity seen in one text, however often copied, reveals nothing.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stash, table, text_or_empty

DISCLOSURE, REMOVAL = 0.8, 0.95
#: Terms that may be marked by chance in a whole corpus, as expected number.
CHANCE = 0.5
#: Characters before and after an entity that tell its surroundings from those of a copy.
NEAR = 60
#: Share of its own words that makes a document a copy of its entity's first one, of at least so many words.
COPY, OWN_WORDS, SHINGLE = 0.5, 3, 5
#: Bytes of terms that are broadcast; more are joined by shuffle, in ``PARTS`` for each term.
SENT, PARTS = 16 << 20, 16
TERM = r"[\p{L}][\p{L}\p{N}'-]{2,}"
#: Prefix of the columns of the base finders while they are at work.
OWN = "__ep_"

# The contract's patterns, written so that each start is tried once: a run of address characters
# or digits is entered at its first character only (or right after the match before).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAY = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def _digits(m: Column) -> Column:
    return F.translate(m, " -().+", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def find(kind: str, text: Column) -> Column:
    """Valid matches of ``kind`` as ``array<struct<s, e, m>>``: code points, end exclusive.

    ``split`` gives what stands between the matches, so lengths add up to positions.
    """
    nothing = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(text, PATTERNS[kind]), lambda gap: F.length(gap))
        start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        every = F.aggregate(pairs, start, step, lambda acc: acc["out"])
        return F.when(F.size(found) == 0, nothing).otherwise(F.filter(every, lambda x: _valid(kind, x["m"])))

    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    possible = F.contains(text, F.lit(_MAY[kind])) if _MAY[kind] else F.lit(True)
    return F.when(possible, let(found, located)).otherwise(nothing)


def _masked(text: Column) -> Column:
    """The text with what the base finders mark (columns by kind) blanked, positions kept."""
    spans = F.sort_array(_per_kind(PATTERNS, lambda kind, x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def step(acc: Column, x: Column) -> Column:
        blank = F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], acc["at"]), F.lit(0)))
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), blank)
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), more.alias("out"))

    whole = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    blanked = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, whole)
    return F.when(F.size(spans) == 0, text).otherwise(blanked)


def _words(masked: Column) -> Column:
    return F.transform(F.regexp_extract_all(masked, F.lit(TERM), F.lit(0)), F.lower)


def _places(masked: Column, ratios: Column) -> Column:
    """Occurrences of the terms that ``ratios`` (a map) holds, as ``array<struct<s, e, t, ratio>>``."""
    nothing = F.array().cast("array<struct<s:int,e:int,t:string,ratio:double>>")

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(masked, TERM), lambda gap: F.length(gap))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            e = s + F.length(x["m"])
            t = F.lower(x["m"])
            one = F.struct(s.alias("s"), e.alias("e"), t.alias("t"), F.try_element_at(ratios, t).alias("ratio"))
            return F.struct(e.alias("at"), F.when(F.map_contains_key(ratios, t), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])

    return F.when(ratios.isNull(), nothing).otherwise(let(F.regexp_extract_all(masked, F.lit(TERM), F.lit(0)), located))


def _per_kind(kinds, each, prefix: str = OWN) -> Column:
    """One array of ``each(kind, x)`` over the spans of all ``kinds`` (columns), kind by kind."""

    def of(kind: str) -> Column:
        return F.transform(prefix + kind, lambda x: each(kind, x))

    return F.concat(*map(of, kinds))


def _listed(kinds) -> Column:
    return F.array_join(_per_kind(kinds, lambda kind, x: F.concat(F.lit(f"{kind}:"), x["s"], F.lit(":"), x["e"]), ""), ",")


def _entities(x: Column) -> Column:
    """The entities of a value found (struct of kind, m, context): itself, seen in its surroundings, and the wider
    one, seen by its values; as ``array<struct<c, sighting>>``."""
    kind, value = x["kind"], F.lower(x["m"])
    digits = _digits(x["m"])
    wide = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.left(digits, F.lit(6)))
        .otherwise(F.left(digits, F.length(digits) - 7))
    )
    exact = F.struct(F.xxhash64(kind, value).alias("c"), x["context"].alias("sighting"))
    return F.array(exact, F.struct(F.xxhash64(kind, F.lit("wide"), wide).alias("c"), F.xxhash64(value).alias("sighting")))


def _sent(wanted: DataFrame) -> bool:
    """Whether the distinct terms ``t`` of ``wanted``, and what stands beside them, may be broadcast."""
    return (wanted.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0) <= SENT


def _light(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


def _counts(words: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (stored, distinct terms ``t`` and a number ``id`` of each; other columns stay) and ``n_t``: how many
    documents have each of them. The numbers are shuffled in the terms' place."""
    rows = words.select(F.explode(F.array_distinct("__ep_words")).alias("t"))
    if _sent(asked):
        rows = rows.join(F.broadcast(asked.select("t", "id")), "t").groupBy("id").agg(F.count("*").alias("n_t"))
        return rows.join(F.broadcast(asked), "id")
    return rows.groupBy("t").agg(F.count("*").alias("n_t")).join(asked, "t")


def _occurrences(words: DataFrame, revealing: DataFrame) -> DataFrame:
    """``__ep_row``, ``t`` and ``ratio`` wherever a revealing term stands."""
    rows = words.select("__ep_row", F.explode(F.array_distinct("__ep_words")).alias("t"))
    if _sent(revealing):
        return rows.join(F.broadcast(revealing), "t")
    # A common term has many rows: they are dealt to parts, and the term to all of them.
    parted = revealing.withColumn("__ep_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("__ep_part", F.pmod(F.xxhash64("__ep_row"), F.lit(PARTS)).cast("int")).join(parted, ["t", "__ep_part"]).drop("__ep_part")


def _shingles(words: Column) -> Column:
    """Hashes of the distinct five-word runs; of fewer words, the one run they are."""
    last = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.xxhash64(F.slice(words, k, SHINGLE))))


def _said(held: DataFrame, by: DataFrame, small: bool) -> DataFrame:
    """``__ep_row``, ``c``, ``sighting``, ``t`` and the columns of ``by``: a row for each term in a document of each of its entities."""
    rows = held.select("__ep_row", "__ep_words", F.explode("x").alias("x")).select("__ep_row", "x.*", "__ep_words").join(_light(by, small), "c")
    return rows.withColumn("t", F.explode("__ep_words")).drop("__ep_words")


def _labels(held: DataFrame, entity: DataFrame, terms: DataFrame, seen: DataFrame, words: DataFrame) -> DataFrame:
    """``__ep_row``, ``c`` and ``label`` for the documents of ``seen``: equal for those that copy the entity's first."""
    seen = stash(seen.select("c", "__ep_row").distinct(), "pii-suspects")
    few = seen.count() * 32 <= SENT
    # Only terms that may be own words: all documents that have them, n_t of them, are documents of entities.
    said = _said(held, seen.select("c").distinct().join(entity.select("c", "n_c"), "c"), few)
    said = said.join(_light(terms, _sent(terms)), "t", "left").where("n_t IS NULL OR (n_t <= n_c AND n_t = h)").select("__ep_row", "c", "t")
    told = said.groupBy("c", "t").agg(F.count("*").alias("n_ct"))
    theirs = stash(said.join(_light(seen, few), ["c", "__ep_row"], "left_semi").select("c", "__ep_row", "t"), "pii-words")
    counts = _counts(words, stash(theirs.select("t").distinct().withColumn("id", F.monotonically_increasing_id()), "pii-asked"))
    alone = told.join(counts, "t").where("n_t = n_ct").select("c", "t")
    own = theirs.join(alone, ["c", "t"]).groupBy("c", "__ep_row").agg(F.collect_set(F.xxhash64("t")).alias("own"))
    texts = held.select("__ep_row", "shingles").join(_light(seen, few), "__ep_row").join(own, ["c", "__ep_row"], "left")
    texts = stash(texts.withColumn("own", F.coalesce("own", F.array().cast("array<long>"))), "pii-texts")
    first = texts.groupBy("c").agg(F.min("__ep_row").alias("__ep_row")).join(texts, ["c", "__ep_row"]).select("c", F.col("own").alias("first_own"), F.col("shingles").alias("first_shingles"))
    alike = lambda a, b, of: F.size(F.array_intersect(a, b)) >= COPY * of
    few = F.least(F.size("own"), F.size("first_own"))
    both = F.size("shingles") + F.size("first_shingles")
    near = (few >= OWN_WORDS) & alike("own", "first_own", few) | (F.size(F.array_intersect("shingles", "first_shingles")) * (1 + COPY) >= COPY * both)
    label = F.when(near, F.lit(0).cast("long")).when(F.size("own") >= OWN_WORDS, F.array_min("own"))
    return texts.join(first, "c").select("c", "__ep_row", label.alias("label"))


def _weigh(found: DataFrame, words: DataFrame, disclosure: float, chance: float) -> DataFrame:
    """``(t, ratio)`` of the revealing terms; counts cover all documents.

    ``found`` has ``__ep_row`` and ``__ep_own`` (its entities), ``words`` has ``__ep_row`` and ``__ep_words``.
    """
    n_docs = max(found.count(), 2)
    n = F.lit(float(n_docs))
    # Only documents with an entity meet their words, as arrays, one row a document; of an entity the least sighting stays.
    each = let(F.sort_array("__ep_own"), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["c"] != x["c"])))
    held = words.where(F.size("__ep_own") > 0).select("__ep_row", each.alias("x"), _shingles(F.col("__ep_words")).alias("shingles"), F.array_distinct("__ep_words").alias("__ep_words"))
    held = stash(held, "pii-held")
    own = held.select("__ep_row", F.inline("x"))
    tried = held.agg(F.sum(F.size("x").cast("double") * F.size("__ep_words"))).first()[0] or 0.0
    least = log(max(tried, 1.0) / chance)

    entity = own.groupBy("c").agg(F.count("*").alias("n_c"), F.countDistinct("sighting").alias("apart")).where("apart > 1")
    entity = entity.withColumn("ic", F.log(n / F.least(F.col("n_c"), n - 1)))
    entity = stash(entity.where(F.col("apart") * F.col("ic") >= least), "pii-entities")
    # A ratio of at least ``disclosure`` needs n_ct / n_t >= exp((disclosure - 1) * ic), and n_ct is at most n_c and at most
    # h, the documents with the term and an entity. So the terms are counted before any pair of entity and term is made.
    share = F.exp((disclosure - 1) * F.col("ic")) * (1 - 1e-9)
    bounds = entity.select("c", "n_c", F.col("apart").alias("most_apart"), "ic", share.alias("share"))
    top = entity.agg(F.max(F.col("n_c") / share)).first()[0] or 0.0
    few = entity.count() * 64 <= SENT
    rows = own.join(_light(entity.select("c"), few), "c", "left_semi").select("__ep_row").distinct()
    rows = stash(rows, "pii-weighed")
    weighed = held.join(_light(rows, rows.count() * 16 <= SENT), "__ep_row", "left_semi")
    often = weighed.select(F.explode("__ep_words").alias("t")).groupBy("t").agg(F.count("*").alias("h")).where("h > 1")
    often = stash(often.withColumn("id", F.monotonically_increasing_id()), "pii-often")
    counted = _counts(words, often.where(F.col("h") <= top))
    # Terms of more than ``top`` documents fit no entity; h says so already.
    terms = stash(counted.unionByName(often.where(F.col("h") > top).withColumn("n_t", F.col("h"))).drop("id"), "pii-counts")
    p = F.least(F.col("n_c"), n - 1) / n

    def nats(q: Column) -> Column:
        rest = F.when(q < 1, (1 - q) / q * F.log((1 - q) / (1 - p))).otherwise(0.0)
        return F.log(q / p) + rest

    # The nats of a pair grow with n_ct, so those of the most that n_ct can be are a bound.
    most = F.least("h", "n_c")
    possible = (most >= F.col("share") * F.col("n_t")) & (F.least(most, "most_apart") * nats(most / F.col("n_t")) >= least * (1 - 1e-9))
    said = _said(held, bounds, few).join(_light(terms, _sent(terms)), "t").where(possible)
    said = stash(said.select("__ep_row", "c", "sighting", "t", "n_t"), "pii-said")
    # A pair of one sighting reveals nothing.
    pairs = said.groupBy("c", "t", "n_t").agg(F.count("*").alias("n_ct"), F.countDistinct("sighting").alias("apart"))
    pairs = stash(pairs.where("apart > 1"), "pii-twice").join(entity.drop("apart"), "c")
    q = F.col("n_ct") / F.col("n_t")
    likely = pairs.select("c", "t", "apart", (F.log(q / p) / F.col("ic")).alias("ratio"), nats(q).alias("nats"))
    likely = likely.where((F.col("ratio") >= disclosure) & (F.col("nats") > 0) & (F.col("apart") * F.col("nats") >= least))
    likely = stash(likely.select("c", "t", "ratio", "nats"), "pii-likely")
    # What is left is held against the copies.
    seen = stash(said.drop("n_t").join(_light(likely, _sent(likely)), ["c", "t"]), "pii-seen")
    seen = seen.join(_labels(held, entity, terms, seen, words), ["c", "__ep_row"], "left")
    seen = seen.groupBy("c", "t", "ratio", "nats").agg(F.countDistinct("sighting").alias("apart"), F.countDistinct(F.coalesce("label", "sighting")).alias("texts"))
    return seen.where((F.least("apart", "texts") * F.col("nats")) >= least).groupBy("t").agg(F.max("ratio").alias("ratio"))


def _found(docs: DataFrame, text_col: str, disclosure: float, chance: float) -> DataFrame:
    """``docs`` plus the columns of ``find_pii``, named with the prefix ``OWN``."""
    text = text_or_empty(text_col)
    found = docs.withColumns({OWN + kind: find(kind, text) for kind in PATTERNS})

    def context(kind: str, x: Column) -> Column:
        left = F.substring(text, F.greatest(x["s"] - NEAR + 1, F.lit(1)), F.least(x["s"], F.lit(NEAR)))
        right = F.substring(text, x["e"] + 1, F.lit(NEAR))
        return F.struct(F.lit(kind).alias("kind"), x["m"].alias("m"), F.xxhash64(left, right).alias("context"))

    found = found.withColumn("__ep_own", F.flatten(F.transform(_per_kind(PATTERNS, context), _entities)))
    # Written once, so the row numbers stay what they are whatever is recomputed later.
    found = stash(found.withColumn("__ep_row", F.monotonically_increasing_id()), "pii")
    masked = _masked(text)
    words = found.select("__ep_row", "__ep_own", _words(masked).alias("__ep_words"))
    revealing = stash(_weigh(found, words, disclosure, chance), "pii-terms")
    marked = _occurrences(words, revealing).groupBy("__ep_row")
    marked = stash(marked.agg(F.map_from_entries(F.collect_list(F.struct("t", "ratio"))).alias("__ep_ratios")), "pii-marks")
    # Few marks are sent to the texts; else texts and marks meet by row.
    marks = marked.agg(F.sum(F.size("__ep_ratios") * 40 + 40)).first()[0] or 0
    marked = F.broadcast(marked) if marks <= SENT else marked
    return found.drop("__ep_own").join(marked, "__ep_row", "left").withColumn(f"{OWN}term", _places(masked, F.col("__ep_ratios"))).drop("__ep_row", "__ep_ratios")


def find_pii(docs: DataFrame, *, text_col: str = "text", disclosure: float = DISCLOSURE, chance: float = CHANCE, carry: bool = True) -> DataFrame:
    """``docs`` plus ``email``, ``ip``, ``card``, ``phone`` (arrays of s, e, m), ``term`` (array of s, e, t,
    ratio), i.e. what the base finders and the corpus statistics mark. ``carry=False`` leaves the text out.

    Null counts as an empty text; long texts are read whole; repeated rows are marked alike; terms of equal
    ratio are all marked; an empty table gives no rows; columns of ``docs`` with the outputs' names are replaced.
    """
    names = [*PATTERNS, "term"]
    kept = [c for c in docs.columns if c not in names and (carry or c != text_col)]
    found = _found(docs.select(text_col, *(c for c in docs.columns if c not in names and c != text_col)), text_col, disclosure, chance)
    return found.select(*kept, *(F.col(OWN + name).alias(name) for name in names))


def sanitise(docs: DataFrame, *, text_col: str = "text", removal: float = REMOVAL, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """``docs`` with the text's personal data replaced by its kind, revealing terms by ``[TERM]`` or nothing.

    All columns keep their names, order and, but for the text, their values; a null text stays null; the
    other cases are those of ``find_pii``.
    """
    found = _found(docs, text_col, disclosure, chance)
    base = _per_kind(PATTERNS, lambda kind, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("by")))
    terms = F.transform(f"{OWN}term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["ratio"] >= removal, "").otherwise("[TERM]").alias("by")))
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["by"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    whole = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate(F.sort_array(F.concat(base, terms)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, whole)
    return found.withColumn(text_col, F.when(text.isNotNull(), clean)).select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(_listed(PATTERNS), 256).alias("base_sha256"),
        _listed([*PATTERNS, "term"]).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def _base_sql() -> str:
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT ELSE (2 * {digits}[-i]::INT) // 10 + (2 * {digits}[-i]::INT) % 10 END))"
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {doubled} % 10 = 0 ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    found = ", ".join(f"regexp_extract_all(t, '{p}') AS {k}_m, string_split_regex(t, '{p}') AS {k}_g" for k, p in forms.items())
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {n} AS nth, m, s, s + length(m) AS e, {valid[k]} AS good FROM ("
        f"SELECT doc_id, unnest({k}_m) AS m, unnest(list_transform(range(1, len({k}_m) + 1), "
        f"lambda i: list_sum(list_transform({k}_g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({k}_m[1:i - 1], lambda x: length(x))), 0))) AS s FROM found)"
        for n, k in enumerate(forms)
    )
    return f"""
    WITH found AS (SELECT doc_id, {found} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    spans AS (SELECT * FROM ({each}) WHERE good),
    listed AS (
        SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in forms)},
            string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY nth, s) AS base FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in forms)}, sha256(coalesce(base, '')) AS base_sha256
    FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id
    """


QUERIES = {"op4_pii": op4_pii}
#: SQL for the base columns alone; the terms depend on statistics that are held against planted terms in tests.
BASE_SQL = _base_sql()
SQL: dict[str, str] = {}
