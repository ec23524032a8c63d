"""Reading the catalogue file, profiling it and naming its version."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislerank.settings import RAW_COLUMNS

# Spellings read as a missing value.
MISSING_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, encoding) of every file: UTF-8 when each of its lines is valid, otherwise Latin-1."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_size", F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy(F.col("file_path").alias("path"), F.col("file_size").alias("bytes")).agg(
        F.when(F.min("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def read_catalogue_csv(spark: SparkSession, path: str, columns: Sequence[str] = RAW_COLUMNS,
                       encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as text, missing spellings as NULL.

    Without a given encoding every file is read in its own; the driver holds the paths of the files
    that are not UTF-8.  ``multi_line=False`` lets large files be split, if no field holds a line end.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def read(paths: str | list[str], name: str) -> DataFrame:
        return spark.read.csv(paths, schema=schema, header=True, multiLine=multi_line, escape='"', encoding=name)

    if encoding is not None:
        df = read(path, encoding)
    else:
        latin = [f["path"] for f in source_files(spark, path).filter("encoding <> 'UTF-8'").select("path").collect()]
        df = read(path, "UTF-8")
        if latin:
            df = df.filter(~F.col("_metadata.file_path").isin(latin)).unionByName(
                read([unquote(f) for f in latin], "ISO-8859-1"))
    return df.select(
        *[F.when(~F.col(c).isin(*MISSING_SPELLINGS), F.col(c)).alias(c) for c in columns])


def ingestion_profile(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS, files: DataFrame | None = None) -> DataFrame:
    """One row per column: position, type, nulls, records; one pass.

    With ``files`` (as from ``source_files``) each row also names the source: files, bytes, the size in
    MB and the folder, or the file itself if it is the only one.
    """
    types = dict(df.dtypes)
    counts = df.agg(
        F.count("*").alias("records"),
        *[F.count(F.col(c)).alias(f"f_{c}") for c in columns])
    profile = counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("dtype"),
            (F.col("records") - F.col(f"f_{c}")).alias("null_count"), F.col("records"))
        for i, c in enumerate(columns)])))
    if files is None:
        return profile
    folder = F.regexp_replace("path", "/[^/]*$", "")
    source = files.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
        F.when(F.count("*") == 1, F.min("path")).otherwise(F.min(folder)).alias("source_path"))
    return profile.withColumn("s", source.select(F.struct("*")).scalar()).select(
        *profile.columns, "s.*", F.round(F.col("s.bytes") / 2**20, 3).alias("size_mb"))


def content_version(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """A 12-hex-digit version of the content that no row order or partitioning changes.

    Row digests are combined by xor, by sum and by count, so equal rows do not cancel out.
    """
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns])
    digest = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("bigint")
    return df.agg(
        F.count("*").alias("records"),
        F.coalesce(F.bit_xor(digest), F.lit(0)).alias("x"),
        F.coalesce(F.sum(digest % 2147483647), F.lit(0)).alias("s"),
    ).select(
        "records",
        F.substring(F.md5(F.concat_ws("-", "x", "s", "records")), 1, 12).alias("version"))
