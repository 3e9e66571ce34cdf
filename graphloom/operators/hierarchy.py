"""Trees of (node, parent): closures, lowest common ancestors, filters, name tries and prefix attachment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import fixpoint


def descent(tree: DataFrame) -> DataFrame:
    """(node, ancestor, depth): every node with itself and all above it."""
    up = tree.where(F.col("parent").isNotNull()).select(F.col("node").alias("ancestor"), F.col("parent").alias("_up"))
    step = lambda at: at.join(up, "ancestor").select("node", F.col("_up").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), step, ["node", "ancestor", "depth"])


def lifts(tree: DataFrame, keys: Sequence[str] = ()) -> list[DataFrame]:
    """[(keys, node, up)]: the ancestors 1, 2, 4, 8, … steps above each node of (keys, node, parent), a table a power."""
    found = [cut(tree.where(F.col("parent").isNotNull()).select(*keys, "node", F.col("parent").alias("up")))]
    while True:
        last = found[-1]
        far = cut(last.join(last.select(*keys, F.col("node").alias("up"), F.col("up").alias("_far")), [*keys, "up"]).select(*keys, "node", F.col("_far").alias("up")))
        if far.isEmpty():
            return found
        found.append(far)


def lowest_common(tree: DataFrame, sets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node): the lowest node at or above all of each key's nodes in ``sets`` (keys, node); none where they have no common one.

    By binary lifting: all climb to the depth of the highest, then together by falling powers of two as long as
    they don't meet. Joins are as many as the depth has digits in base two, for all keys at once.
    """
    keys, powers = list(keys), lifts(tree, keys)
    depth = sets.select(*keys, "node").distinct().withColumns({"at": F.col("node"), "depth": F.lit(0)})
    for k in range(len(powers) - 1, -1, -1):  # the depth, by climbing to the root
        depth = _climb(depth, powers[k], keys, F.lit(True), 1 << k)
    start = cut(depth.select(*keys, "node", "depth"))
    least = start.groupBy(*keys).agg(F.min("depth").alias("_least")) if keys else start.agg(F.min("depth").alias("_least"))
    now = (start.join(least, keys) if keys else start.join(F.broadcast(least))).select(*keys, F.col("node").alias("at"), (F.col("depth") - F.col("_least")).alias("over"))
    for k in range(len(powers) - 1, -1, -1):
        now = _climb(now, powers[k], keys, F.col("over") >= (1 << k), 0).withColumn("over", F.when(F.col("over") >= (1 << k), F.col("over") - (1 << k)).otherwise(F.col("over")))
    now = cut(now.select(*keys, "at").distinct())
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    for k in range(len(powers) - 1, -1, -1):
        far = now.join(powers[k].select(*keys, F.col("node").alias("at"), "up"), [*keys, "at"], "left")
        apart = (F.min("up").over(own) != F.max("up").over(own)) & (F.count("up").over(own) == F.count("at").over(own))
        now = cut(far.select(*keys, F.when(apart, F.col("up")).otherwise(F.col("at")).alias("at")).distinct())
    alone = F.count(F.lit(1)).over(own) == 1
    far = now.join(powers[0].select(*keys, F.col("node").alias("at"), "up"), [*keys, "at"], "left").withColumn("node", F.when(alone, F.col("at")).otherwise(F.col("up")))
    met = far.groupBy(*keys).agg(F.min("node").alias("node"), F.max("node").alias("_other"), F.count("node").alias("_n"), F.count(F.lit(1)).alias("_all"))
    return met.where((F.col("node") == F.col("_other")) & (F.col("_n") == F.col("_all"))).select(*keys, "node")


def _climb(rows: DataFrame, power: DataFrame, keys: list[str], where: Column, steps: int) -> DataFrame:
    """``rows`` with ``at`` moved up where the condition holds and there is that much above; depth, if there, counts the steps."""
    met = rows.join(power.select(*keys, F.col("node").alias("at"), "up"), [*keys, "at"], "left")
    moves = where & F.col("up").isNotNull()
    out = met.withColumn("depth", F.when(moves, F.col("depth") + steps).otherwise(F.col("depth"))) if "depth" in rows.columns else met
    return out.withColumn("at", F.when(moves, F.col("up")).otherwise(F.col("at"))).select(*rows.columns)


def kept(tree: DataFrame, matches: Column) -> DataFrame:
    """(node): nodes that match, and all above them."""
    hits = tree.where(matches).select("node")
    return descent(tree).join(hits, "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()


def expand(tree: DataFrame, shown: DataFrame) -> DataFrame:
    """(node): the leaves below shown nodes."""
    inner = tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    return descent(tree).join(shown.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").distinct().join(inner, "node", "left_anti")


def prefixes(name: Column, separator: str = ".") -> Column:
    """All prefixes of a separated name, the name itself last."""
    parts = F.split(name, "\\" + separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def trie(names: DataFrame, name: str = "name", separator: str = ".") -> DataFrame:
    """(node, parent, n_children, n_names): the tree of all prefixes; ``n_names`` counts the names that end there."""
    own = names.select(F.col(name).alias("name")).distinct()
    path = own.select("name", F.explode(prefixes(F.col("name"), separator)).alias("node"))
    nodes = path.groupBy("node").agg(F.count_if(F.col("name") == F.col("node")).alias("n_names"))
    nodes = nodes.withColumn("parent", F.nullif(F.regexp_replace("node", rf"(^|\{separator})[^{separator}]*$", ""), F.lit("")))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, "node", "left").select("node", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_names")


def compressed(tree: DataFrame) -> DataFrame:
    """(node, parent) of a trie without the nodes that have one child and end no name: what hangs below moves up."""
    chain = tree.where("n_children = 1 and n_names = 0").select("node")
    stays = tree.join(chain, "node", "left_anti").select("node")
    up = descent(tree.select("node", "parent")).where("depth > 0").join(stays.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    parent = up.groupBy("node").agg(F.min_by("ancestor", "depth").alias("parent"))
    return stays.join(parent, "node", "left")


def attach(names: DataFrame, known: DataFrame, name: str = "name", node: str = "node", separator: str = ".") -> DataFrame:
    """(name, node): the longest known prefix of each name, by an equi-join over its prefixes; null where none is."""
    own = names.select(F.col(name).alias("name")).distinct()
    met = own.select("name", F.explode(prefixes(F.col("name"), separator)).alias("node")).join(known.select(F.col(node).alias("node")).distinct(), "node")
    return own.join(met.groupBy("name").agg(F.max_by("node", F.length("node")).alias("node")), "name", "left")


def reclassify(classes: DataFrame, packages: list[str], name: str = "name", origin: str = "origin") -> DataFrame:
    """Origin APP becomes LIB unless the name starts with one of the packages; no packages keep all."""
    if not packages:
        return classes
    inside = F.lit(False)
    for p in packages:
        inside = inside | F.startswith(F.col(name), F.lit(p))
    return classes.withColumn(origin, F.when((F.col(origin) == "APP") & ~inside, "LIB").otherwise(F.col(origin)))


def named_like(tree: DataFrame, text: str, name: str = "name") -> DataFrame:
    """(node): nodes whose name in lower case holds the text, and all above them."""
    return kept(tree, F.contains(F.lower(F.col(name)), F.lit(text)))


def in_range(tree: DataFrame, root: Column, low: int, high: int, number: str = "number") -> DataFrame:
    """(node): nodes at or below the root whose number lies between, both ends included."""
    below = descent(tree.select("node", "parent")).where(F.col("ancestor") == root).select("node").distinct()
    return tree.where(F.col(number).between(low, high)).join(below, "node", "left_semi").select("node")
