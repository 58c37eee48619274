"""Quality rules [native]: line-first cleaning, then rejection of documents that lose too much.

Every line is tested on its own: punctuation (no closing mark, too many symbols, shouting),
navigation (many separators for its words) and boilerplate (fixed phrases). Failing lines are
removed; a document is rejected if its failing lines hold more than ``MAX_LOST`` of its word
characters, or if it fails the base rules (fewer than 50 words, or more than half of the words
within repeated three-word windows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, table, text_or_empty

MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 0.5, 0.5
SYMBOLS = "#*$%&|<>"
#: Fixed phrases, matched in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "click here",
    "sign in",
    "log in",
    "subscribe to our newsletter",
    "share this",
    "skip to content",
    "back to top",
    "lorem ipsum",
)
_CLOSED = r"""[.!?…。！？:;]["'”’»)\]]*\s*$"""
_SEPARATORS = "|>»›•·"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def word_chars(text: Column) -> Column:
    return _without(text, SPACES).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - _without(text, SYMBOLS)).cast("long")


def _filled(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: _without(line, SPACES) > 0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_filled(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Window hashes are sorted with their positions; equal neighbours are repeated, and every repeated
    window adds the words that the one before it has not covered.
    """

    def within(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.sort_array(windows), repeated))

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(again, lambda x: x["p"])), covered)

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda at, k: F.least(F.lit(3), at - F.coalesce(F.get(p, k - 1), F.lit(-3))))
        return F.aggregate(new, F.lit(0), lambda n, x: n + x)

    return let(words, within).cast("long")


def line_fails(line: Column) -> Column:
    """Punctuation, navigation or boilerplate rule of one line that has a word."""
    words = F.regexp_count(line, F.lit(WORD))
    open_end = ~line.rlike(_CLOSED) & (words < 6)
    symbols = F.length(line) - _without(line, "#*$%&<>{}[]~^=\\")
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    shouting = (letters >= 12) & (10 * capitals > 7 * letters)
    separators = F.length(line) - _without(line, _SEPARATORS)
    navigation = (separators >= 3) & (5 * separators >= words)
    phrases = F.lower(line).rlike("|".join(BOILERPLATE)) & (words <= 30)
    return open_end | (10 * symbols > 3 * words + 10) | shouting | navigation | phrases


def clean_lines(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus the rule columns, ``kept`` and ``clean_text`` (the lines that pass).

    Null counts as an empty text: no words, so it fails the base rules; its ``clean_text`` is empty.
    Equal rows get equal verdicts; own columns of these names are replaced. Texts and lines of any length
    are judged whole, one row at a time; an empty table gives no rows.
    """
    text = text_or_empty(text_col)
    measured = docs.withColumns(
        {
            "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "word_chars": word_chars(text),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
            "n_repeat_words": n_repeat_words(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
            "__ep_passed": F.filter(F.split(text, "\n"), lambda line: (_without(line, SPACES) > 0) & ~line_fails(line)),
        }
    )
    left = F.aggregate("__ep_passed", F.lit(0).cast("long"), lambda n, line: n + word_chars(line))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = measured.withColumns({"lost": F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0), "base_failed": failed})
    return judged.withColumns({"kept": ~F.col("base_failed") & (F.col("lost") <= MAX_LOST), "clean_text": F.array_join("__ep_passed", "\n")}).drop("__ep_passed")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost", 6).alias("lost"))


QUERIES = {"op9_quality": op9_quality}
SQL = {
    "op9_quality": rf"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    worded AS (
        SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars
        FROM texts),
    windows AS (
        SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
        FROM worded WHERE len(w) >= 3),
    again AS (
        SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    fresh AS (
        SELECT r, least(3, p - lag(p, 1, p - 3) OVER (PARTITION BY r ORDER BY p)) AS more FROM again),
    repeats AS (
        SELECT r, sum(more) AS n_repeat_words FROM fresh GROUP BY r),
    split AS (
        SELECT r, unnest(string_split(t, chr(10))) AS l FROM texts),
    lines AS (
        SELECT r, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words,
            length(l) - length(translate(l, '#*$%&<>{{}}[]~^=\', '')) AS symbols,
            length(regexp_replace(l, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(l, '\P{{Lu}}+', '', 'g')) AS capitals,
            length(l) - length(translate(l, '{_SEPARATORS}', '')) AS separators
        FROM split),
    judged AS (
        SELECT *, (words < 6 AND NOT regexp_matches(l, '[.!?…。！？:;]["''”’»)\]]*[\x20\x09-\x0D]*$'))
            OR 10 * symbols > 3 * words + 10 OR (letters >= 12 AND 10 * capitals > 7 * letters)
            OR (separators >= 3 AND 5 * separators >= words)
            OR (words <= 30 AND regexp_matches(lower(l), '{"|".join(BOILERPLATE)}')) AS fails
        FROM lines WHERE chars > 0),
    cleaned AS (
        SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS remains
        FROM judged GROUP BY r),
    measured AS (
        SELECT doc_id, len(w) AS n_words, word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
            CASE WHEN word_chars > 0 THEN 1 - coalesce(remains, 0) / word_chars ELSE 0.0 END AS lost
        FROM worded LEFT JOIN repeats USING (r) LEFT JOIN cleaned USING (r)),
    based AS (
        SELECT *, n_words < {MIN_WORDS} OR n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM measured)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND lost <= {MAX_LOST} AS kept, round(CAST(lost AS DOUBLE), 6) AS lost
    FROM based
    """
}
