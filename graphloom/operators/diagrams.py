"""Boolean functions as reduced ordered decision diagrams, kept as tables.

A node of a diagram tests a variable and leads on by ``low`` or ``high``; T and F are where all ends. A node's id is a
digest of what it tests and leads to, so equal functions have one id, within a table and across tables, whatever
they were made from. All functions of a table share their nodes and the rounds in which these are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut

TRUE, FALSE = "T", "F"
#: Decisions of a graph, remainders of a formula, that one row may hold.
MOST = 20_000


def _digest(var: str, low: str, high: str) -> str:
    return hashlib.md5(f"{var}|{low}|{high}".encode()).hexdigest()


def _reduced(decisions: dict, made: dict) -> dict:
    """{node: (id, var, low, high, vars)} of one graph {node: (var, low, high)}, from the ends in ``made`` up."""
    for start in decisions:
        stack = [start]
        while stack:
            var, low, high = decisions[stack[-1]]
            open_ = [x for x in (low, high) if x not in made]
            if open_:
                stack += open_
                continue
            (low, *_, low_vars), (high, *_, high_vars) = made[low], made[high]
            node = stack.pop()
            one = low == high
            made[node] = (low, None, None, None, low_vars) if one else (_digest(var, low, high), var, low, high, sorted({var, *low_vars, *high_vars}))
    return made


def reduced(decisions: DataFrame, ends: DataFrame, keys: Sequence[str], most: int = MOST) -> DataFrame:
    """(keys, node, id, var, low, high, vars) of every node: var, low and high are null where both ways are one.

    ``decisions`` has (keys, node, var, low, high), low and high being nodes; along every path the variables come in
    one order. ``ends`` has (keys, node, id), id T or F. ``vars`` are the variables the function depends on, in order
    of their names. Graphs of at most ``most`` decisions, such as loops, are made one row each, others by joins; which they are
    is counted first.
    """
    keys, kind = list(keys), dict(decisions.dtypes)["node"]
    large = cut(decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"))

    @F.pandas_udf(f"array<struct<node:{kind},id:string,var:string,low:string,high:string,vars:array<string>>>")
    def solve(nodes: pd.Series, names: pd.Series, lows: pd.Series, highs: pd.Series, last: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for n, v, a, b, e, i in zip(nodes, names, lows, highs, last, ids):
            made = _reduced(dict(zip(n, zip(v, a, b))), {x: (y, None, None, None, []) for x, y in zip(e, i)})
            out.append([(x, *row) for x, row in made.items()])
        return pd.Series(out)

    listed = decisions.groupBy(*keys).agg(F.collect_list(F.struct("node", "var", "low", "high")).alias("d"))
    ended = ends.groupBy(*keys).agg(F.collect_list(F.struct("node", "id")).alias("e"))
    both = listed.join(ended, keys, "full").join(large, keys, "left_anti")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    columns = [empty(F.col(f"d.{c}"), "string" if c == "var" else kind) for c in ("node", "var", "low", "high")]
    small = both.select(*keys, F.explode(solve(*columns, empty(F.col("e.node"), kind), empty(F.col("e.id"), "string"))).alias("s")).select(*keys, "s.*")
    if large.isEmpty():
        return small
    of = lambda df: df.join(large, keys, "left_semi")
    return small.unionByName(reduced_by_rounds(of(decisions), of(ends), keys))


def reduced_by_rounds(decisions: DataFrame, ends: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As ``reduced``, for graphs of any size, by joins: a round makes the nodes whose ways are made already, of all graphs at once."""
    keys = list(keys)
    none = F.array().cast("array<string>")
    known = cut(ends.select(*keys, "node", "id", F.lit(None).cast("string").alias("var"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"), none.alias("vars")))
    todo = cut(decisions.select(*keys, "node", "var", F.col("low").alias("_low"), F.col("high").alias("_high")))
    for round_ in count():
        met = todo
        for way in ("low", "high"):
            met = met.join(known.select(*keys, F.col("node").alias(f"_{way}"), F.col("id").alias(way), F.col("vars").alias(f"{way}_vars")), [*keys, f"_{way}"])
        one = F.col("low") == F.col("high")
        same = lambda c: F.when(~one, F.col(c)).alias(c)
        vars_ = F.array_sort(F.array_union(F.array_union("low_vars", "high_vars"), F.array("var")))
        new = cut(met.select(*keys, "node", F.when(one, F.col("low")).otherwise(F.md5(F.concat_ws("|", "var", "low", "high"))).alias("id"), same("var"), same("low"), same("high"), F.when(one, F.col("low_vars")).otherwise(vars_).alias("vars")))
        if new.isEmpty():
            return known
        known = known.unionByName(new) if round_ % 8 != 7 else cut(known.unionByName(new))
        todo = cut(todo.join(new, [*keys, "node"], "left_anti"))


def shared(nodes: DataFrame) -> DataFrame:
    """(id, var, low, high): the diagrams' nodes, each once, low and high being ids."""
    return nodes.where(F.col("var").isNotNull()).select("id", "var", "low", "high").distinct()


def _bare(literal: Column) -> Column:
    return F.regexp_replace(literal, "^!", "")


def _with(terms: Column, var: Column, value: bool) -> Column:
    """The terms that are left when ``var`` has the value: those of the other sign go, its literal goes from the rest."""
    against, own = (F.concat(F.lit("!"), var), var) if value else (var, F.concat(F.lit("!"), var))
    rest = F.filter(terms, lambda t: ~F.array_contains(t, against))
    return F.array_sort(F.array_distinct(F.transform(rest, lambda t: F.array_remove(t, own))))


def _node(terms: Column) -> Column:
    ended = F.when(F.size(terms) == 0, FALSE).when(F.exists(terms, lambda t: F.size(t) == 0), TRUE)
    return F.coalesce(ended, F.md5(F.to_json(terms)))


def from_terms_by_rounds(formulas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``from_terms``, for formulas of any size: a round splits all remainders by their first variable."""
    clean = F.array_sort(F.array_distinct("term"))
    clashes = F.exists(clean, lambda x: F.array_contains(clean, F.concat(F.lit("!"), x)))
    terms = formulas.groupBy("formula").agg(F.array_sort(F.array_distinct(F.collect_list(F.when(~clashes, clean)))).alias("terms"))
    roots = cut(terms.select("formula", _node(F.col("terms")).alias("node"), "terms"))
    ended = F.col("node").isin(TRUE, FALSE)
    frontier = cut(roots.where(~ended).select("node", "terms").dropDuplicates(["node"]))
    found = None
    while not frontier.isEmpty():
        var = F.array_min(F.transform(F.flatten("terms"), _bare))
        ways = frontier.select("node", "terms", var.alias("var")).select("node", "var", _with(F.col("terms"), F.col("var"), False).alias("l"), _with(F.col("terms"), F.col("var"), True).alias("h"))
        ways = cut(ways.select("node", "var", _node(F.col("l")).alias("low"), _node(F.col("h")).alias("high"), "l", "h"))
        made = ways.select("node", "var", "low", "high")
        found = made if found is None else found.unionByName(made)
        both = ways.select(F.col("low").alias("node"), F.col("l").alias("terms")).unionByName(ways.select(F.col("high").alias("node"), F.col("h").alias("terms")))
        frontier = cut(both.where(~ended).dropDuplicates(["node"]))
    spark = formulas.sparkSession
    ends = spark.createDataFrame([(TRUE, TRUE), (FALSE, FALSE)], "node string, id string")
    if found is None:
        found = spark.createDataFrame([], "node string, var string, low string, high string")
    nodes = reduced_by_rounds(found.dropDuplicates(["node"]), ends)
    return roots.join(nodes, "node").select("formula", "id", "vars"), shared(nodes)


def _split(terms: frozenset, most: int) -> dict | None:
    """{remainder: (variable, remainder when it is false, when true)} from a set of terms on; none beyond ``most``."""
    found, todo = {}, [terms]
    while todo:
        t = todo.pop()
        if t in found or not t or frozenset() in t:
            continue
        var = min(x.removeprefix("!") for term in t for x in term)
        low, high = (frozenset(term - {own} for term in t if against not in term) for own, against in ((f"!{var}", var), (var, f"!{var}")))
        found[t] = (var, low, high)
        if len(found) > most:
            return None
        todo += [low, high]
    return found


def from_terms(formulas: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """((formula, id, vars), shared nodes) of formulas given as (formula, term): an or of terms, a term an and of literals.

    A literal is a variable's name, with ``!`` before it where negated; the variables are tested in order of their
    names. What remains of a formula under some values is a node, and equal remainders are one, so a function costs as much
    as its diagram, not as its assignments. A term with both signs of a variable is never true; a formula of such
    terms alone is false; an empty term makes it true. Formulas of more than ``most`` remainders are split by joins.
    """

    @F.pandas_udf("id string, vars array<string>, nodes array<struct<id:string,var:string,low:string,high:string>>")
    def solve(lists: pd.Series) -> pd.DataFrame:
        out = []
        for terms in lists:
            start = frozenset(t for t in map(frozenset, terms) if not any(f"!{x}" in t for x in t))
            found = _split(start, most)
            if found is None:
                out.append((None, None, None))
                continue
            ends = {x: ((TRUE if x else FALSE), None, None, None, []) for d in [(None, start, start), *found.values()] for x in d[1:] if x not in found}
            made = _reduced(found, ends)
            out.append((made[start][0], made[start][4], sorted({row[:4] for row in made.values() if row[1]})))
        return pd.DataFrame(out, columns=["id", "vars", "nodes"])

    listed = formulas.groupBy("formula").agg(F.collect_set("term").alias("terms"))
    solved = cut(listed.select("formula", solve("terms").alias("s")))
    roots = solved.where("s.id is not null").select("formula", "s.id", "s.vars")
    nodes = solved.select(F.explode("s.nodes").alias("n")).select("n.*").distinct()
    large = solved.where("s.id is null").select("formula")
    if large.isEmpty():
        return roots, nodes
    more, theirs = from_terms_by_rounds(formulas.join(large, "formula", "left_semi"))
    return roots.unionByName(more), nodes.unionByName(theirs).distinct()


def vital(formulas: DataFrame, most: int = MOST) -> DataFrame:
    """(formula, var): variables whose value changes the formula's under some value of the others, for any number of them.

    ``formulas`` is as for ``from_terms``. A reduced diagram tests just the variables its function depends on.
    """
    return from_terms(formulas, most)[0].select("formula", F.explode("vars").alias("var"))


def equal(formulas: DataFrame, most: int = MOST) -> DataFrame:
    """(formula, id): formulas that are the same function have the same id."""
    return from_terms(formulas, most)[0].select("formula", "id")
