"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed: the characters between words, as a class of Java and RE2 patterns.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Most bytes of rows that meet in Python at once.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand rows to Python a few MB at a time, unless it asks for less already.

    By default a batch grows to 64 MB, and the JVM and Python each hold it, once coming and once going, in every
    running task. Results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame, column: str) -> Column:
    """The column's text; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text that isn't null, in order."""
    return let(
        F.btrim(text, F.lit(" \t\n\x0b\f\r")),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{BLANK}]+")),
    )
