"""Choosing a broadcast by a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fits(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def small_side(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, most_rows) else df


def spread(df: DataFrame, *keys: str, rows: int, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` dealt by ``keys`` over partitions of about ``most_rows`` of its ``rows``; as it is, where the session's number of partitions is enough.

    What a task sorts or groups then stays the same however large the input; windows, groups and joins on these keys keep the dealing.
    """
    n = -(-rows // most_rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def kept(df: DataFrame, *keys: str, rows: int, most_rows: int = 1_000_000) -> DataFrame:
    """The distinct rows of ``df``, dealt and sorted by ``keys`` over about ``most_rows`` of its ``rows`` a partition, and held: merge joins and groups on these keys move the other side only."""
    n = max(-(-rows // most_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = df.repartition(n, *keys).distinct().sortWithinPartitions(*keys).persist()
    held.count()  # only what is held already tells a plan how it is dealt
    return held
