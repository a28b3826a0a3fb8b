"""Words and small column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigraph.functions.arrays import let
from lexigraph.session import materialize

__all__ = ["BATCH_ROWS", "BLANKS", "WORD", "batches_of", "each", "free_name", "let", "materialize", "word_count", "words"]

# ASCII white space; every other character belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; a null or blank text gives an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return let(bare, lambda t: F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, BLANKS, -1)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores appended where the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def each(column: pa.Array) -> Iterator:
    """The values of a batch one at a time, so a batch of long texts is not held twice."""
    return (value.as_py() for value in column)


BATCH_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Texts that are written inside go to the Python workers so many at a time, which bounds what both sides hold."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)
