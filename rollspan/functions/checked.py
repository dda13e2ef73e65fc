"""Refusals inside a plan: bounded broadcasts, required values, finite results."""

from pyspark.sql import Window
from pyspark.sql import functions as F

SMALL = 100_000


def bounded(df, limit=SMALL):
    """A broadcast of a declared table that stops the job beyond `limit` rows.

    At most one row more than the limit is read to find out.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    held = df.limit(limit + 1).withColumn("_held", count)
    stop = F.raise_error(F.lit(f"a declared table has more than {limit} rows"))
    return F.broadcast(held.filter(F.when(F.col("_held") <= limit, True).otherwise(stop)).drop("_held"))


def required(column, message):
    """The column, or an error where it is null."""
    return F.coalesce(column, F.raise_error(F.lit(message)))


def finite(column, message):
    """The column, or an error where it is not a finite number; null stays null."""
    fine = column.isNull() | (F.abs(column) < F.lit(float("inf")))
    return F.when(fine, column).otherwise(F.raise_error(F.lit(message)))


def positive(column, message):
    """A finite number above zero, or an error."""
    fine = (column > 0) & (column < F.lit(float("inf")))
    return F.when(fine, column).otherwise(F.raise_error(F.lit(message)))
