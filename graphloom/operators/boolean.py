"""Boolean path conditions: terms of a formula and their simplification; ``diagrams`` has the functions they stand for.

A formula is a set of terms, a term a set of literals: a variable's name, with ``!`` before it where negated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import NotConverged, fixpoint
from graphloom.plans.sizes import small_side


def variable(literal: Column) -> Column:
    return F.regexp_replace(literal, "^!", "")


def negated(literal: Column) -> Column:
    return F.when(F.startswith(literal, F.lit("!")), F.substring(literal, 2, 1_000_000)).otherwise(F.concat(F.lit("!"), literal))


def consistent(term: Column) -> Column:
    """Whether no variable is in the term with both signs."""
    return ~F.exists(term, lambda x: F.array_contains(term, negated(x)))


def simplified(formulas: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(formula, term) without contradictory, repeated and absorbed terms, pairs that differ in one sign made one.

    Resolvents are added until there are no new ones, then terms that hold another go. Formulas of the same terms are
    simplified once: rounds work on the different sets of terms, and a formula takes what its set gives.
    """
    clean = formulas.select("formula", F.array_sort(F.array_distinct("term")).alias("term")).where(consistent(F.col("term")))
    sets = clean.groupBy("formula").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    keyed = cut(sets.select("formula", F.sha2(F.to_json("terms"), 256).alias("_set"), "terms"))
    kinds = keyed.dropDuplicates(["_set"]).select(F.col("_set").alias("formula"), F.explode("terms").alias("term"))
    made = cut(_simplified(kinds, max_rounds).withColumnRenamed("formula", "_set"))
    return keyed.select("formula", "_set").join(small_side(made), "_set").select("formula", "term")


def _simplified(formulas: DataFrame, max_rounds: int) -> DataFrame:
    """``simplified`` of distinct, consistent terms."""
    split = lambda df: df.select("formula", F.explode("term").alias("x"), "term").select("formula", "x", F.array_remove("term", F.col("x")).alias("term"))
    step = lambda at: split(at).withColumn("x", negated(F.col("x"))).join(split(known[0]), ["formula", "x", "term"]).select("formula", "term")
    known = [cut(formulas)]
    for _ in range(max_rounds):
        new = cut(step(known[0]).distinct().join(known[0], ["formula", "term"], "left_anti"))
        if new.isEmpty():
            break
        known[0] = cut(known[0].unionByName(new))
    else:
        raise NotConverged("simplification")
    smaller = known[0].withColumnRenamed("term", "_in")
    absorbed = known[0].join(smaller, "formula").where((F.size("_in") < F.size("term")) & (F.size(F.array_except("_in", "term")) == 0)).select("formula", "term").distinct()
    return known[0].join(absorbed, ["formula", "term"], "left_anti")


def path_conditions(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(method, node, term): the conditions under which each node is reached, from acyclic edges (method, src, dst, literal).

    An edge's literal is null where it is always taken. A path that needs both signs of a variable is none.
    """
    ahead = edges.select("method", F.col("src").alias("node"), "dst", "literal")
    longer = F.when(F.col("literal").isNull(), F.col("term")).otherwise(F.array_sort(F.array_distinct(F.array_append("term", F.col("literal")))))
    step = lambda at: at.join(ahead, ["method", "node"]).select("method", F.col("dst").alias("node"), longer.alias("term")).where(consistent(F.col("term")))
    return fixpoint(roots.select("method", "node", F.array().cast("array<string>").alias("term")), step, ["method", "node", "term"])


def label(number: Column) -> Column:
    """A, B, …, Z, AA, AB, … for 0, 1, …, as long as the number needs."""
    step = lambda s: F.struct(F.call_function("div", s.left - 1, F.lit(26).cast("long")).alias("left"), F.concat(F.char(F.lit(65) + (s.left - 1) % 26), s.text).alias("text"))
    start = F.struct((number.cast("long") + 1).alias("left"), F.lit("").alias("text"))
    return F.when(number >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, lambda s, _: F.when(s.left > 0, step(s)).otherwise(s), lambda s: s.text))
