"""Chat formatting [native]: grammar round trip.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" body "<|im_end|>\\n"

Roles are URL-encoded. A body is the text itself, or the text with its control strings escaped: one
backslash more behind their first character (``</s>`` -> ``<\\/s>``, ``<\\/s>`` -> ``<\\\\/s>``), which
is undone by taking one away. The parser is deterministic and strict: it refuses bodies that hold a
control string. Every turn is rendered as it is, parsed again and compared with its source; where
they differ its control strings are escaped and the turn is tried again. The whole conversation is
parsed once more, and the job fails rather than return text that does not read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, without their first character.
_REST = r"(/?s>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"
_CONTROL = r"[<\[]" + _REST
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"))


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>``; a turn that breaks the grammar is a null element."""

    def turn(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(OPEN) + 1), F.length(block))
        role = F.substring_index(inner, "\n", 1)
        body = F.substring(inner, F.length(role) + 2, F.length(inner))
        good = F.startswith(block, F.lit(OPEN)) & F.contains(block, F.lit("\n")) & ~F.rlike(inner, F.lit(_CONTROL))
        return F.when(good, F.struct(F.try_url_decode(role).alias("role"), unescape(body).alias("text")))

    def turns(blocks: Column) -> Column:
        tail = F.get(blocks, F.size(blocks) - 1)
        bad = F.array(F.lit(None).cast("struct<role:string,text:string>"))
        return F.concat(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn), F.when(tail == "", F.slice(bad, 1, 0)).otherwise(bad))

    return let(F.split(formatted, r"<\|im_end\|>\n"), turns)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted`` and ``loss_mask``.

    ``loss_mask`` has one struct per assistant turn, in order: start and end of its body in code points
    (``start``, ``end``) and in UTF-8 bytes (``byte_start``, ``byte_end``), ends exclusive. Turns come by
    ``turn_col``, ties by role and text; repeated rows are turns of their own; null texts and roles
    are empty; rows with a null id form one conversation; other columns are ignored. Texts of any length
    are kept whole (a conversation is one string in the end); an empty table gives no rows.
    """
    rows = turns.select(F.col(conv_col), F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    as_is = F.concat(_head(F.col("role")), F.col("text"), F.lit(CLOSE))
    conflict = ~parse(as_is).eqNullSafe(source)
    rows = rows.withColumn("body", F.when(conflict, escape(F.col("text"))).otherwise(F.col("text")))
    rows = rows.withColumn("head", _head(F.col("role"))).withColumn("block", F.concat("head", "body", F.lit(CLOSE)))
    order = [F.col("n").asc_nulls_first(), F.col("role"), F.col("text")]
    by = Window.partitionBy(conv_col).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda size: F.coalesce(F.sum(size(F.col("block"))).over(before), F.lit(0)) + size(F.col("head"))
    rows = rows.select(conv_col, "role", "text", "body", "block", F.row_number().over(by).alias("n"), at(F.length).alias("start"), at(F.octet_length).alias("byte_start"))
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"), "byte_start", (F.col("byte_start") + F.octet_length("body")).alias("byte_end"))
    rows = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "block", span.alias("span")))).alias("all"))
    rows = rows.select(
        conv_col,
        F.array_join(F.transform("all", lambda x: x["block"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["role"] == "assistant"), lambda x: x["span"]).alias("loss_mask"),
        F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    checked = F.when(parse(F.col("formatted")).eqNullSafe(F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back from its formatted text")))
    return rows.select(conv_col, checked.alias("formatted"), "loss_mask")


def masked_texts(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the mask, read from the formatted text by byte spans and unescaped."""

    def cut(raw: Column) -> Column:
        return F.transform(loss_mask, lambda m: unescape(F.decode(F.substring(raw, m["byte_start"].cast("int") + 1, (m["byte_end"] - m["byte_start"]).cast("int")), "UTF-8")))

    return let(formatted.cast("binary"), cut)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    done = format_chats(turns.unionByName(own))
    read = done.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op7_chat": op7_chat}
SQL = {
    # A text with a control string, escaped or not, gets one character more for each of them.
    "op7_chat": r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
        SELECT *, len(regexp_extract_all(said, '[<\[]\\*(?:/?s>|/?INST\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)')) AS escapes
        FROM turns),
    talks AS (
        SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role, said) AS whole,
            coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, role, said) FILTER (WHERE role = 'assistant'), '') AS loss,
            sum(length('<|im_start|>') + length(url_encode(role)) + 1 + length(said) + escapes + length('<|im_end|>') + 1) AS size
        FROM sized GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
        CAST(size AS BIGINT) AS formatted_chars
    FROM talks
    """
}
