"""First-N and ranking helpers that hold when one group owns most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows of every group, numbered from 1 in ``rank``.

    Works in two rounds: each group is first cut to ``n`` rows per slice of input
    partitions, then to ``n`` overall. With the filter right above the window Spark
    also cuts inside every map task, so a hot group reaches its last task as at
    most ``SALTS * n`` rows instead of all of them. The answer does not depend on
    how rows fall into slices.
    """
    slice_of = Window.partitionBy(*keys, "_slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_slice", F.spark_partition_id() % SALTS)
            .withColumn(rank, F.row_number().over(slice_of)).filter(F.col(rank) <= n).drop("_slice", rank)
            .withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n))


def with_group_size(df: DataFrame, key: str) -> DataFrame:
    """Add ``_rows``, the number of rows of the same key. Rows move to where their key belongs; null is a key like any other."""
    return df.repartition(F.col(f"`{key}`")).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(F.col(f"`{key}`"))))


def exploded(df: DataFrame, name: str, array: Column | str) -> DataFrame:
    """One row per element of the array; rows without elements drop out.

    Same as ``explode``, but the emptiness test comes after it. ``explode`` adds the
    test as a filter on the array, and Spark pushes that filter below the steps that
    build the array, so that they run twice, the first time on every raw row.
    """
    return df.withColumn(name, F.explode_outer(array)).filter(F.col(name).isNotNull())


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Number the rows of small groups, such as the topics of a hotel."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of a column with their counts; ties by value."""
    return df.groupBy(column).count().orderBy(F.desc("count"), F.asc(column)).limit(n)


def rows_of_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is among the ``n`` most frequent. The list has ``n`` rows, so it is broadcast."""
    return df.join(F.broadcast(top_values(df, column, n).select(column)), column, "left_semi")
