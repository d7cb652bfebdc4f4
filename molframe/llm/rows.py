"""Rows that models learn from (those whose crc32(id as text) mod 4 is not 2), batches of bounded size, and columns that pass through pandas unharmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of texts that a Python worker gets at once, at most.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Keeps Arrow batches of the session at BATCH_ROWS rows or fewer, since whole texts go to Python. It has no bearing on results."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def held_out(id_col: str) -> Column:
    """True for rows that no model may learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def dealt(id_col: str, seed: int) -> Column:
    """A hash of the id: an order without meaning."""
    return F.xxhash64(F.col(id_col), F.lit(seed))


def _whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def sent(df: DataFrame, name: str) -> Column:
    """The column as it goes to pandas: whole numbers as text, since pandas makes floats of those with nulls, which large ones don't survive."""
    return F.col(name).cast("string") if _whole(df, name) else F.col(name)


def sent_type(df: DataFrame, name: str) -> str:
    return "string" if _whole(df, name) else df.schema[name].dataType.simpleString()


def back(df: DataFrame, name: str, column: str) -> Column:
    """The column of df that came back as `column`, in its own type and name."""
    return F.col(column).cast(df.schema[name].dataType).alias(name)
