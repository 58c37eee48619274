"""Whole files of a directory, in order of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str, limit: int | None = None) -> DataFrame:
    """``file`` (path) and ``raw`` (text) of the files in ``path`` whose names match ``pattern``.

    ``limit`` keeps the first files by path: the paths are listed without their contents, and the
    contents of later files are not read. Bytes that are no UTF-8 become replacement signs; an empty
    file has an empty text; a directory that is missing is an error; repeated names cannot be.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if limit is not None:
        last = files.select("path").orderBy("path").limit(max(limit, 1)).agg(F.max("path")).first()[0]
        # The file source skips files by this hidden column before it opens them.
        files = files.where((F.col("_metadata.file_path") <= last) & F.lit(limit > 0)) if last is not None else files
    return files.select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
