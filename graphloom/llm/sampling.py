"""Bounded samples that don't gather a large group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.sizes import small_side


def first_by_hash(rows: DataFrame, by: str, most: int, hashed: str = "_hash") -> DataFrame:
    """``rows`` with their rank ``_at`` by the hash column within each value of ``by``, for ranks up to ``most``.

    Hashes above a share that leaves some 2 ``most`` + 100 rows of each value are dropped first, so that only
    those are ranked; the result is the same as of ranking all, but for the chance, next to none, that a
    share of hashes that should hold twice the rows holds too few.
    """
    counts = small_side(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_of")))
    share = (F.lit(2.0 * most + 100) / F.col("_of"))
    place = F.col(hashed) / F.lit(2.0**64) + 0.5
    kept = rows.join(counts, by).where(place <= share).drop("_of")
    return kept.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(hashed))).where(F.col("_at") <= most)
