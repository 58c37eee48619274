"""Documents with odd cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, kept boolean, key string"


def documents(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), -1, -1, -1.0, None, "x") for i, t in enumerate(texts)]
    rows += rows[-1:]
    return spark.createDataFrame(rows + [(None, "no id here at all", None, None, None, None, None, None, None, None)], SCHEMA)


ODD = [None, "", " ", "\n", "word", "ä" * 3000, "a" * 20000, "x y " * 3000, "1 " * 500, "a@b.c@d.e " * 50, "line\n" * 40, "   \U0001f600 tab\tend", "# * $ % & | < >"]
