"""Layers, orders and spanning trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.reach import Group, dealt, flipped, nodes, simple, sources
from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import NotConverged, improve


def longest_path_layers(edges: DataFrame, group: Group = (), max_rounds: int = 100_000) -> DataFrame:
    """(group, node, layer): the most edges on a path to each node of acyclic graphs; self-loops are ignored.

    Rounds take the nodes whose predecessors are all done. Raises ValueError on a cycle.
    """
    own = cut(simple(edges, group).where(F.col("src") != F.col("dst")))
    done = None
    left = own
    todo = cut(nodes(edges, group))
    for layer in range(max_rounds):
        blocked = left.select(*group, F.col("dst").alias("node")).distinct()
        now = cut(todo.join(blocked, [*group, "node"], "left_anti").withColumn("layer", F.lit(layer)))
        if now.isEmpty():
            if not todo.isEmpty():
                raise ValueError("the graph has a cycle")
            return done if done is not None else now
        done = now if done is None else done.unionByName(now)
        todo = cut(todo.join(now, [*group, "node"], "left_anti"))
        left = cut(left.join(now.select(*group, F.col("node").alias("src")), [*group, "src"], "left_anti"))
    raise NotConverged("layers")


def topological_order(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node, layer): ordering by layer, then node, is a topological order; by falling layer, a reverse one of it."""
    return longest_path_layers(edges, group)


def bfs_layers(edges: DataFrame, seeds: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node, layer): least distances, negative against the edges, 0 for seeds; the nearer side wins, then the positive."""
    both = simple(edges, group).withColumn("sign", F.lit(1)).unionByName(simple(flipped(edges), group).withColumn("sign", F.lit(-1)))
    ahead = dealt(both.withColumnRenamed("src", "node"), [*group, "sign", "node"])
    hop = lambda at: at.join(ahead, [*group, "sign", "node"]).select(*group, "sign", F.col("dst").alias("node"), (F.col("far") + 1).alias("far"))
    start = seeds.select(*group, "node", F.lit(0).alias("far"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    found = improve(start, hop, [*group, "sign", "node"], "far", largest=False)
    ahead.unpersist()
    return found.groupBy(*group, "node").agg(F.min_by(F.col("far") * F.col("sign"), F.struct("far", -F.col("sign"))).alias("layer"))


def spanning_forest(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node, parent, layer): a breadth-first forest from the sources; of several parents the least."""
    own = simple(edges, group)
    ahead = own.withColumnRenamed("src", "node")
    hop = lambda at: at.join(ahead, [*group, "node"]).select(*group, F.col("dst").alias("node"), (F.col("layer") + 1).alias("layer"))
    layers = improve(sources(edges, group).withColumn("layer", F.lit(0)), hop, [*group, "node"], "layer", largest=False)
    above = layers.select(*group, F.col("node").alias("parent"), (F.col("layer") + 1).alias("layer"))
    parents = layers.join(own.withColumnsRenamed({"src": "parent", "dst": "node"}), [*group, "node"]).join(above, [*group, "parent", "layer"]).groupBy(*group, "node").agg(F.min("parent").alias("parent"))
    return layers.join(parents, [*group, "node"], "left").select(*group, "node", "parent", "layer")


def layering_tree(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node, parent, layer) of acyclic graphs: a node hangs under a parent of the layer before; the greatest of them."""
    layers = longest_path_layers(edges, group)
    above = layers.select(*group, F.col("node").alias("parent"), (F.col("layer") + 1).alias("layer"))
    last = layers.join(simple(edges, group).withColumnsRenamed({"src": "parent", "dst": "node"}), [*group, "node"]).join(above, [*group, "parent", "layer"]).groupBy(*group, "node").agg(F.max("parent").alias("parent"))
    return layers.join(last, [*group, "node"], "left").select(*group, "node", "parent", "layer")


def vertex_order(component: str = "component", short: str = "short", full: str = "full", method: str = "method", number: str = "number") -> list:
    """The order of vertices in a list: components first, then by short and full class name, method and number; nulls last."""
    return [F.col(component).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in (short, full, method, number)]]


def layer_order(nodes: DataFrame, layer: str = "layer", degree: str = "degree", label: str = "label") -> DataFrame:
    """``nodes`` with ``place`` in their layer (from 0), by degree, then label."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy(layer).orderBy(degree, label)) - 1)
