"""Strongly connected components and what is built on them: quotients, recursion flags, pruning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.reach import Group, connected_set, dealt, degrees, flipped, nodes, on_cycles, reachable, simple, small_graphs, without
from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import NotConverged, fixpoint, improve
from graphloom.plans.sizes import kept


def trimmed(edges: DataFrame, group: Group = (), rounds: int = 2) -> DataFrame:
    """The edges less those of nodes without an edge in, or without one out, taken away so many times over."""
    own = simple(edges, group).where(F.col("src") != F.col("dst"))
    for _ in range(rounds):
        own = cut(own)
        ins, outs = own.select(*group, F.col("dst").alias("node")).distinct(), own.select(*group, F.col("src").alias("node")).distinct()
        both = ins.join(outs, [*group, "node"], "left_semi")
        for end in ("src", "dst"):
            own = own.join(both.withColumnRenamed("node", end), [*group, end], "left_semi")
    return cut(own)


def largest_by_pivot(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node, component): the component of the node with the most edges in times edges out, in each graph."""
    busy = degrees(edges, group).withColumn("_of", F.struct((F.col("n_in") * F.col("n_out")).alias("n"), F.col("node")))
    pivots = cut(busy.groupBy(*group).agg(F.max("_of").alias("_of")).select(*group, F.col("_of.node").alias("node")))
    sides = connected_set(edges, pivots, group).groupBy(*group, "node").agg(F.count_distinct("side").alias("n")).where("n = 2").select(*group, "node")
    sides = cut(sides)
    names = sides.groupBy(*group).agg(F.min("node").alias("component"))
    return cut(sides.join(names, list(group)) if group else sides.withColumn("component", F.lit(names.first().component)))


def merged(edges: DataFrame, hops: int = 8) -> DataFrame:
    """(node, component): sets of nodes that all reach each other, found within some hops of their busiest node.

    A part of what ``scc`` finds, for sharing work: what it names one component is in one, but not all of it need be
    found. Each node takes the busiest colour (node) that reaches it; those that reach it back within the colour are its set.
    """
    left = trimmed(edges)
    colour = cut(degrees(left).select("node", F.struct((F.col("n_in") * F.col("n_out")).alias("n"), F.col("node").alias("of")).alias("colour")))
    ahead = left.withColumnRenamed("src", "node")
    new = colour
    for _ in range(hops):
        offered = new.join(ahead, "node").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_offered"))
        new = cut(offered.join(colour, "node").where(F.col("_offered") > F.col("colour")).select("node", F.col("_offered").alias("colour")))
        if new.isEmpty():
            break
        colour = cut(colour.unionByName(new).groupBy("node").agg(F.max("colour").alias("colour")))
    of = colour.select("node", F.col("colour.of").alias("component"))
    ends = {end: of.withColumnsRenamed({"node": end, "component": f"_{end}"}) for end in ("src", "dst")}
    back = cut(left.join(ends["src"], "src").join(ends["dst"], "dst").where(F.col("_src") == F.col("_dst")).select(F.col("dst").alias("node"), "src", F.col("_src").alias("component")))
    found = new = cut(of.where(F.col("node") == F.col("component")))
    for _ in range(hops):
        new = cut(new.join(back, ["node", "component"]).select(F.col("src").alias("node"), "component").distinct().join(found, ["node", "component"], "left_anti"))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return cut(found)


def scc(edges: DataFrame, group: Group = (), most_edges: int = 200_000) -> DataFrame:
    """(group, node, component): each node's strongly connected component, named by its least node.

    Of a table of many graphs, those of at most ``most_edges`` edges are solved as one row each, larger ones by
    joins; which they are is counted first. A table that is one graph goes by joins.
    """
    group = list(group)
    if not group:
        return scc_by_rounds(edges)
    large = cut(simple(edges, group).groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges).drop("n"))
    if large.isEmpty():
        return scc_small(edges, group)
    return scc_small(edges.join(large, group, "left_anti"), group).unionByName(scc_by_rounds(edges.join(large, group, "left_semi"), group))


def scc_by_rounds(edges: DataFrame, group: Group = (), max_rounds: int = 100_000) -> DataFrame:
    """(group, node, component) as ``scc``, for graphs of any size, by joins alone.

    First the component of each graph's best connected node, most often the giant one, by walking both ways
    from it. Then colouring: every node takes the least colour (node) that reaches it; the nodes that reach a
    colour's own node within the colour are its component. What remains, less the ends of its paths, goes round
    again, many components and all groups at a time. Self-loops play no part.
    """
    keys = [*group, "node"]
    all_nodes = cut(nodes(edges, group))
    left = trimmed(edges, group)
    found = None
    if not left.isEmpty():
        found = largest_by_pivot(left, group)
        left = trimmed(without(left, found.select(*keys), group), group)
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        ahead = left.withColumnRenamed("src", "node")
        start = nodes(left, group).withColumn("colour", F.col("node"))
        hop = lambda at: at.join(ahead, keys).select(*group, F.col("dst").alias("node"), "colour")  # noqa: B023, E731
        colour = improve(start, hop, keys, "colour", largest=False)
        ends = {end: colour.withColumnsRenamed({"node": end, "colour": f"_{end}"}) for end in ("src", "dst")}
        inner = cut(left.join(ends["src"], [*group, "src"]).join(ends["dst"], [*group, "dst"]).where(F.col("_src") == F.col("_dst")).select(*group, "src", "dst", F.col("_src").alias("component")))
        roots = colour.where(F.col("node") == F.col("colour")).select(*group, F.col("colour").alias("component"), "node")
        back = flipped(inner).withColumnRenamed("src", "node")
        step = lambda at: at.join(back, [*group, "component", "node"]).select(*group, "component", F.col("dst").alias("node"))  # noqa: B023, E731
        part = fixpoint(roots, step, [*group, "component", "node"])
        found = part if found is None else found.unionByName(part)
        left = trimmed(without(left, part.select(*keys), group), group)
    else:
        raise NotConverged("components")
    alone = all_nodes.withColumn("component", F.col("node"))
    if found is None:
        return alone
    return cut(found.select(*keys, "component").unionByName(alone.join(found, keys, "left_anti")))


def _tarjan(pairs: list[tuple]) -> dict:
    """Each node's component in one small graph, named by its least node; the stack is explicit."""
    ahead: dict = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number, low, held, stack, out = {}, {}, set(), [], {}
    for root in ahead:
        work = [] if root in number else [(root, iter(ahead[root]))]
        if work:
            number[root] = low[root] = len(number)
            stack.append(root), held.add(root)
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in number:
                    number[x] = low[x] = len(number)
                    stack.append(x), held.add(x)
                    work.append((x, iter(ahead[x])))
                    break
                if x in held:
                    low[node] = min(low[node], number[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    held.difference_update(part)
                    out.update(dict.fromkeys(part, min(part)))
    return out


def scc_small(edges: DataFrame, group: Group) -> DataFrame:
    """``scc`` for graphs of which one fits a task many times over: one pass over each."""
    kind = dict(edges.dtypes)["src"]

    @F.pandas_udf(f"node array<{kind}>, component array<{kind}>")
    def solve(srcs: pd.Series, dsts: pd.Series) -> pd.DataFrame:
        found = [_tarjan(list(zip(a, b))) for a, b in zip(srcs, dsts)]
        return pd.DataFrame({"node": [list(f) for f in found], "component": [list(f.values()) for f in found]})

    solved = small_graphs(edges, group).select(*group, solve("srcs", "dsts").alias("s"))
    return solved.select(*group, F.explode(F.arrays_zip("s.node", "s.component")).alias("r")).select(*group, "r.node", "r.component")


def quotient(edges: DataFrame, mapping: DataFrame, group: Group = (), keep_self_loops: bool = True) -> tuple[DataFrame, DataFrame]:
    """(outer, inner) of the graph whose nodes (group, node) are mapped to (group, node, component).

    outer: distinct (group, src, dst) of different components, and with ``keep_self_loops`` of components
    in which a node has an edge to itself. inner: (group, component, src, dst), the edges inside one.
    """
    own = simple(edges, group)
    for end in ("src", "dst"):
        own = own.join(mapping.select(*group, F.col("node").alias(end), F.col("component").alias(f"_{end}")), [*group, end])
    across = F.col("_src") != F.col("_dst")
    outer = own.where(across | (F.col("src") == F.col("dst")) if keep_self_loops else across)
    return outer.select(*group, F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), own.where(~across).select(*group, F.col("_src").alias("component"), "src", "dst")


def recursion_edges(edges: DataFrame, component: DataFrame, group: Group = ()) -> DataFrame:
    """(group, src, dst, is_recursion): whether an edge lies on a cycle: within a component, or a self-loop."""
    own = simple(edges, group)
    for end in ("src", "dst"):
        own = own.join(component.select(*group, F.col("node").alias(end), F.col("component").alias(f"_{end}")), [*group, end])
    return own.select(*group, "src", "dst", (F.col("_src") == F.col("_dst")).alias("is_recursion"))


def prune(edges: DataFrame, wanted: DataFrame, component: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node): nodes from which a wanted node or a cycle is reached, those nodes included."""
    seeds = wanted.select(*group, "node").unionByName(on_cycles(edges, component, group)).distinct()
    return reachable(edges, seeds, group, include_seed=True, reverse=True)


def peel(edges: DataFrame, removable: DataFrame, component: DataFrame, direction: str = "leaf", group: Group = ()) -> DataFrame:
    """(group, node): the nodes left when removable leaves (or roots) are taken away for as long as there are any.

    Those are the nodes that reach (or are reached from) a node that isn't removable or is on a cycle.
    """
    if direction not in ("leaf", "root"):
        raise ValueError("direction is leaf or root")
    firm = nodes(edges, group).join(removable.select(*group, "node"), [*group, "node"], "left_anti").unionByName(on_cycles(edges, component, group)).distinct()
    return reachable(edges, firm, group, include_seed=True, reverse=direction == "leaf")


def peeled(edges: DataFrame, removable: DataFrame, direction: str = "leaf", group: Group = (), max_rounds: int = 100_000) -> DataFrame:
    """(group, src, dst): the edges of the nodes that ``peel`` leaves, from distinct edges without null ends; needs no components.

    Roots ask for edges that are ``kept`` by src; for leaves they are dealt by dst where a leaf can go.
    The edges that hold a node (lead to it, for roots) are counted once. A removable node that none holds goes and
    takes its own edges off what they hold: all rounds together move each edge once at most. A cycle holds itself.
    """
    if direction not in ("leaf", "root"):
        raise ValueError("direction is leaf or root")
    near, far = ("src", "dst") if direction == "root" else ("dst", "src")
    keys, end = [*group, "node"], lambda name: F.col(name).alias("node")
    held = edges.groupBy(*group, end(far)).agg(F.count(F.lit(1)).alias("n"))
    gone = cut(edges.select(*group, end(near)).distinct().join(held.hint("merge"), keys, "left_anti").join(removable.select(*keys).hint("merge"), keys, "left_semi"))
    if gone.isEmpty():
        return edges
    own = edges if direction == "root" else kept(edges, *group, near, rows=edges.count())
    held, out, freed = dealt(held.join(removable.select(*keys).hint("merge"), keys, "left_semi"), keys), gone, None
    for round_ in range(max_rounds):
        now = own.join(gone.withColumnRenamed("node", near).hint("merge"), [*group, near], "left_semi").groupBy(*group, end(far)).agg(F.count(F.lit(1)).alias("n_freed"))
        now = cut(now.join(held.hint("merge"), keys, "left_semi"))
        freed = now if freed is None else freed.unionByName(now)
        total = freed.join(now.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("n_freed").alias("n_freed"))
        gone = cut(total.join(held.hint("merge"), keys).where("n_freed = n").select(*keys))
        if gone.isEmpty():
            held.unpersist()
            return own.join(cut(out).withColumnRenamed("node", near).hint("merge"), [*group, near], "left_anti").select(*edges.columns)
        out = out.unionByName(gone)
        if round_ % 8 == 7:
            out, freed = cut(out), cut(freed.groupBy(*keys).agg(F.sum("n_freed").alias("n_freed")))
    raise NotConverged("peeling")
