"""Semi-naive evaluation of recursive rules over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut


class NotConverged(RuntimeError):
    """The rounds ran out before the rules stopped giving new rows."""


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], max_rounds: int = 100_000) -> DataFrame:
    """All rows of ``seed``, and all that ``step`` makes of rows found, as distinct values of ``keys``.

    Each round applies the step to the last round's new rows only. Only the test for new rows crosses to
    the driver; every round is checkpointed, so that the plan stays short and lost executors cost a round.
    Rows with a null key are dropped.
    """
    keys = list(keys)
    clean = lambda df: df.select(*keys).dropna(subset=keys)
    known = delta = cut(clean(seed).distinct())
    for round_ in range(max_rounds):
        new = cut(clean(step(delta)).distinct().join(known.hint("merge"), keys, "left_anti"))  # what is known grows: never broadcast
        if new.isEmpty():
            return known
        delta = new
        known = known.unionByName(new)
        if round_ % 8 == 7:
            known = cut(known)
    raise NotConverged(f"new rows after {max_rounds} rounds")


def improve(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], value: str, largest: bool = True, max_rounds: int = 100_000) -> DataFrame:
    """The best ``value`` of each key over the seed and all that ``step`` makes of improved rows.

    What is known is rewritten every eighth round; between, the rounds' improved rows stand beside it.
    """
    keys, best = list(keys), F.max if largest else F.min
    only_best = lambda df: df.groupBy(*keys).agg(best(value).alias(value))
    known = delta = cut(only_best(seed))
    for round_ in range(max_rounds):
        offered = step(delta).groupBy(*keys).agg(best(value).alias("_offered"))
        better = (F.col("_offered") > F.col(value)) if largest else (F.col("_offered") < F.col(value))
        delta = cut(offered.join(only_best(known) if round_ % 8 else known, keys, "left").where(F.col(value).isNull() | better).select(*keys, F.col("_offered").alias(value)))
        if delta.isEmpty():
            return only_best(known) if round_ % 8 else known
        known = known.unionByName(delta)
        if round_ % 8 == 7:
            known = cut(only_best(known))
    raise NotConverged(f"values improve after {max_rounds} rounds")
