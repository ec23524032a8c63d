"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislerank.session import scratch_path, ship_package

#: Fixed value: white space as the contracts count it.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate as Parquet to the shared folder and read it from there.

    It is made once, later readers fetch only the columns they need, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[list[str]] = []
_LEFT: list[str] = []


@contextmanager
def stage_scratch(spark: SparkSession) -> Iterator[None]:
    """What a stage stores, which its lazy result may read, is removed when the next stage begins.

    By then the result has been written: stages are handed tables that were read again.
    """
    while _LEFT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_LEFT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _OPEN.append([])
    try:
        yield
    finally:
        _LEFT.extend(_OPEN.pop())


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many marks after it as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and that column's name: (file, row), which names a row and is the same in every read.

    Rows of Parquet files are named by their place (the file by a 64-bit hash of its path); other tables are written first.
    """
    name = free_name(docs.columns, "row_key")
    place = "struct(xxhash64(_metadata.file_path) AS file, _metadata.row_index AS row)"
    if "_metadata" not in map(str.lower, docs.columns):
        try:
            return docs.select("*", F.expr(place).alias(name)), name
        except AnalysisException:  # not read from files
            pass
    number = F.monotonically_increasing_id()
    return store(docs.select("*", F.struct(F.shiftright(number, 33).alias("file"), number.alias("row")).alias(name)), "rows"), name


def ready(spark: SparkSession) -> None:
    """Let Python workers on any executor import this library."""
    ship_package(spark)


def word_count(text: Column) -> Column:
    """Number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(key: Column, of: int) -> Column:
    """crc32 of a key as text, modulo a number (null: 0)."""
    return F.coalesce(F.crc32(key.cast("string")) % of, F.lit(0))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A non-negative 62-bit hash for orders that look random and are the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)
