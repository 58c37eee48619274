"""What the corpus operators share: table access, scratch tables and small expression helpers.

Temporary columns that an operator adds to a caller's rows start with ``__ep_`` so that they
cannot clash with the caller's own columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII white space that separates words in several contracts: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
#: Java/RE2 pattern of a word made of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where a local session names none, as in tests, a temporary folder is made and set; on a cluster
    executors would not see it, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="episodica-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors: readers need only the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas in ``body`` use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the values of ``cols`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes; null for null."""
    return F.crc32(text.cast("binary"))


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of the ASCII string expression ``text``, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda r, b: xor(xor(r, b) >> 1, (xor(r, b) & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295)"


def runs_sha256(df: DataFrame, key: str, value: str, separator: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``sha256`` (lowercase hex digest of the strings ``value`` of each run of one key, joined) and
    ``carry`` (columns as in the run's last row). Null values add nothing.

    The rows of a key must stand together in one partition, in order. They are hashed as they pass, so
    a key of any number of rows needs the memory of one Arrow batch.
    """
    sep = separator.encode()
    kinds = {c: df.schema[c].dataType for c in (key, *carry)}
    schema = pa.schema([(key, to_arrow_type(kinds[key])), ("sha256", pa.string()), *((c, to_arrow_type(kinds[c])) for c in carry)])

    def run(batches):
        now, out = None, []

        def made():
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for k, said, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or k != now[0]:
                    if now:
                        out.append((now[0], now[1].hexdigest(), *now[3]))
                    now = [k, sha256(), False, rest]
                if said is not None:
                    now[1].update(sep + said if now[2] else said)
                    now[2] = True
                now[3] = rest
            yield made()
        if now:
            out.append((now[0], now[1].hexdigest(), *now[3]))
            yield made()

    told = ", ".join(f"`{c}` {t.simpleString()}" for c, t in [(key, kinds[key]), ("sha256", T.StringType()), *((c, kinds[c]) for c in carry)])
    return df.select(key, F.col(value).cast("binary").alias("__ep_value"), *carry).mapInArrow(run, told)
