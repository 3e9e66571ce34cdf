"""Dominators, natural loops, the loop nesting forest and the loop graph."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.records import dense_ids
from graphloom.operators.reach import dealt, large_graphs, reachable, simple, small_graphs
from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import NotConverged, fixpoint
from graphloom.plans.sizes import kept, small_side


def _immediate(roots: list, pairs: list[tuple]) -> dict:
    """Immediate dominators of one small graph: of each node reached, in post-order numbers, by meeting paths."""
    ahead: dict = {}
    back: dict = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    ahead[None] = roots  # a common root above
    for r in roots:
        back.setdefault(r, []).append(None)
    order, seen, stack = [], {None}, [(None, iter(ahead[None]))]
    while stack:
        node, rest = stack[-1]
        new = next((x for x in rest if x not in seen), stack)
        if new is stack:
            order.append(node)
            stack.pop()
        else:
            seen.add(new)
            stack.append((new, iter(ahead.get(new, ()))))
    number = {n: i for i, n in enumerate(order)}
    above = {None: None}
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            meet = stack
            for p in back[n]:
                if p in above:
                    if meet is stack:
                        meet = p
                    x = p
                    while meet != x:
                        while number[meet] < number[x]:
                            meet = above[meet]
                        while number[x] < number[meet]:
                            x = above[x]
            if n not in above or above[n] != meet:
                above[n], changed = meet, True
    return {n: d for n, d in above.items() if n is not None}


def _dominator_sets(edges: DataFrame, roots: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, node, idom, doms) by one pass over each graph; a graph travels as one row of arrays."""
    kind = dict(edges.dtypes)["src"]

    @F.pandas_udf(f"node array<{kind}>, idom array<{kind}>, doms array<array<{kind}>>")
    def solve(srcs: pd.Series, dsts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for src, dst, start in zip(srcs, dsts, starts):  # each at most as large as the caller counted
            above = _immediate(sorted(start), sorted(zip(src, dst)))
            chains = []
            for n in above:
                chain = []
                while n is not None:
                    chain.append(n)
                    n = above[n]
                chains.append(chain)
            out.append((list(above), list(above.values()), chains))
        return pd.DataFrame(out, columns=["node", "idom", "doms"])

    solved = small_graphs(edges, group, roots).select(*group, solve("srcs", "dsts", "starts").alias("s"))
    return solved.select(*group, F.explode(F.arrays_zip("s.node", "s.idom", "s.doms")).alias("r")).select(*group, "r.node", "r.idom", "r.doms")


def dominators_by_rounds(edges: DataFrame, roots: DataFrame, group: Sequence[str] = (), max_rounds: int = 100_000) -> DataFrame:
    """(group, node, dom) as ``dominators``, for graphs of any size, by joins alone.

    A node's dominators are among the nodes of any path to it, so those of one shortest path are where they
    begin. A candidate stays while every edge into the node comes from a node that has it, too; what goes takes
    along, in the next round, what rested on it. Rounds are as many as the longest way such news travel.
    Edges and candidates are dealt once and held; a round moves only what it found.
    """
    keys, pair, at = [*group, "node"], [*group, "node", "dom"], [*group, "src"]
    own = kept(edges.select(*group, "src", "dst").dropna().where(F.col("src") != F.col("dst")), *at, rows=edges.count())
    entry = cut(roots.select(*keys).dropna().distinct())
    tree = new = cut(entry.withColumn("up", F.lit(None).cast(dict(entry.dtypes)["node"])))
    for round_ in range(max_rounds):  # breadth first: each new node has its least parent above it
        ends = own.join(new.select(*group, F.col("node").alias("src")).hint("merge"), at).groupBy(*group, F.col("dst").alias("node")).agg(F.min("src").alias("up"))
        new = cut(ends.join(tree.hint("merge"), keys, "left_anti"))
        if new.isEmpty():
            break
        tree = cut(tree.unionByName(new)) if round_ % 8 == 7 else tree.unionByName(new)
    tree = cut(tree)
    known, jump = cut(tree.select(*keys, F.col("node").alias("dom"))), cut(tree.dropna(subset=["up"]))
    while not jump.isEmpty():  # all nodes above, twice as far each round
        further = jump.join(known.withColumnRenamed("node", "up").hint("merge"), [*group, "up"]).select(*pair)
        known = cut(known.unionByName(further))
        jump = cut(jump.join(jump.select(*group, F.col("node").alias("up"), F.col("up").alias("_up")).hint("merge"), [*group, "up"]).select(*keys, F.col("_up").alias("up")))
    known = dealt(known, pair)
    live = tree.select(*group, F.col("node").alias("src"))
    into = own.join(live.hint("merge"), at, "left_semi").join(small_side(entry.withColumnRenamed("node", "dst")), [*group, "dst"], "left_anti").persist()
    into.count(), own.unpersist()
    # How many edges into a node lack a candidate: counted once, then brought up to date by what went.
    n_in = into.groupBy(*group, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    having = into.join(known.withColumnRenamed("node", "src").hint("merge"), at).groupBy(*group, F.col("dst").alias("node"), "dom").agg(F.count(F.lit(1)).alias("n_have"))
    gone = cut(known.where("node != dom").join(n_in.hint("merge"), keys).join(having.hint("merge"), pair, "left").where(F.coalesce("n_have", F.lit(0)) < F.col("n_in")).select(*pair))
    out = gone
    for round_ in range(max_rounds):
        if gone.isEmpty():
            left = cut(known.join(out.hint("merge"), pair, "left_anti"))
            known.unpersist(), into.unpersist()
            return left
        news = into.join(gone.withColumnRenamed("node", "src").hint("merge"), at).select(*group, F.col("dst").alias("node"), "dom").where("node != dom").distinct()
        gone = cut(news.join(known.hint("merge"), pair, "left_semi").join(out.hint("merge"), pair, "left_anti"))
        out = cut(out.unionByName(gone)) if round_ % 8 == 7 else out.unionByName(gone)
    raise NotConverged("dominators")


def dominators(edges: DataFrame, roots: DataFrame, group: Sequence[str] = (), most_edges: int = 200_000) -> DataFrame:
    """(group, node, dom): all dominators of every node reached from its graph's roots (group, node), the node itself included.

    Graphs of at most ``most_edges`` edges, such as the flow graphs of methods, are solved as one row each; larger
    ones by joins. Which they are is counted first.
    """
    group = list(group)
    large = large_graphs(edges, group, most_edges)
    if large.isEmpty():
        return _dominator_sets(edges, roots, group).select(*group, "node", F.explode("doms").alias("dom"))
    if not group:
        return dominators_by_rounds(edges, roots)
    of = lambda df, how: df.join(large, group, how)
    small = _dominator_sets(of(edges, "left_anti"), of(roots, "left_anti"), group).select(*group, "node", F.explode("doms").alias("dom"))
    return small.unionByName(dominators_by_rounds(of(edges, "left_semi"), of(roots, "left_semi"), group))


def immediate_dominators(edges: DataFrame, roots: DataFrame, group: Sequence[str] = (), most_edges: int = 200_000) -> DataFrame:
    """(group, node, idom) of every node reached: of its other dominators the one with the most; null for what no node dominates."""
    dom = cut(dominators(edges, roots, group, most_edges))
    depth = dom.groupBy(*group, "node").agg(F.count(F.lit(1)).alias("depth"))
    above = dom.where(F.col("node") != F.col("dom")).join(depth.withColumnRenamed("node", "dom"), [*group, "dom"])
    nearest = above.groupBy(*group, "node").agg(F.max_by("dom", "depth").alias("idom"))
    return depth.select(*group, "node").join(nearest, [*group, "node"], "left")


def back_edges(edges: DataFrame, dom: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, head, latch): edges to a dominator of their source."""
    return simple(edges, group).withColumnsRenamed({"src": "latch", "dst": "head"}).join(dom.withColumnsRenamed({"node": "latch", "dom": "head"}), [*group, "latch", "head"], "left_semi").select(*group, "head", "latch")


def _retreating(srcs: list, dsts: list, starts: list) -> list[tuple]:
    """(head, latch) of one small graph."""
    pairs = sorted(zip(srcs, dsts))
    above, out = _immediate(sorted(starts), pairs), []
    for latch, head in pairs:
        node = latch if latch in above else None
        while node is not None and node != head:
            node = above[node]
        if node is not None:
            out.append((head, latch))
    return out


def loop_edges(edges: DataFrame, roots: DataFrame, group: Sequence[str], most_edges: int = 200_000) -> DataFrame:
    """(group, head, latch): ``back_edges`` from the roots (group, node), without a table of all dominators where graphs are small.

    In whatever order nodes stand, a cycle has an edge that doesn't ascend; a graph without one is not looked at.
    """
    group, kind = list(group), dict(edges.dtypes)["src"]
    large = large_graphs(edges, group, most_edges)

    @F.pandas_udf(f"head array<{kind}>, latch array<{kind}>")
    def solve(srcs: pd.Series, dsts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        found = [_retreating(src.tolist(), dst.tolist(), start.tolist()) for src, dst, start in zip(srcs, dsts, starts)]
        return pd.DataFrame({"head": [[h for h, _ in pairs] for pairs in found], "latch": [[t for _, t in pairs] for pairs in found]})

    small, some = (edges, roots) if large.isEmpty() else (df.join(large, group, "left_anti") for df in (edges, roots))
    cyclic = small_graphs(small, group, some, rows=edges.count()).where(F.exists(F.arrays_zip("srcs", "dsts"), lambda e: e["dsts"] <= e["srcs"]))
    solved = cyclic.select(*group, solve("srcs", "dsts", "starts").alias("s"))
    found = solved.select(*group, F.explode(F.arrays_zip("s.head", "s.latch")).alias("r")).select(*group, "r.head", "r.latch")
    if large.isEmpty():
        return found
    of = lambda df: df.join(large, group, "left_semi")
    return found.unionByName(back_edges(of(edges), dominators_by_rounds(of(edges), of(roots), group), group))


def _bodies(srcs: list, dsts: list, heads: list, latches: list) -> list[tuple]:
    """(head, member) of the loops of one small graph."""
    before: dict = {}
    for a, b in zip(srcs, dsts):
        before.setdefault(b, []).append(a)
    own: dict = {}
    for head, latch in zip(heads, latches):
        members, todo = own.setdefault(head, {head}), [latch]
        while todo:
            node = todo.pop()
            if node not in members:
                members.add(node)
                todo += before.get(node, ())
    return [(head, m) for head, members in own.items() for m in members]


def natural_loops_by_rounds(edges: DataFrame, back: DataFrame, group: Sequence[str]) -> DataFrame:
    """As ``natural_loops``, for graphs of any size, a round a step."""
    before = dealt(simple(edges, group).withColumnsRenamed({"dst": "member", "src": "_before"}), [*group, "member"])
    open_ = lambda at: at.where(F.col("head") != F.col("member"))
    step = lambda at: open_(at).join(before, [*group, "member"]).select(*group, "head", F.col("_before").alias("member"))
    start = back.select(*group, "head", F.col("latch").alias("member")).unionByName(back.select(*group, "head", F.col("head").alias("member")))
    found = fixpoint(start, step, [*group, "head", "member"])
    before.unpersist()
    return found


def natural_loops(edges: DataFrame, back: DataFrame, group: Sequence[str], most_edges: int = 200_000) -> DataFrame:
    """(group, head, member): each head's loop: it, and all that reach its latches without passing it.

    Graphs of at most ``most_edges`` edges are solved as one row each, larger ones by joins; which they are is counted first.
    """
    group, kind = list(group), dict(edges.dtypes)["src"]
    if not group:
        return natural_loops_by_rounds(edges, back, group)
    with_loops = edges.select(*group, "src", "dst").join(back.select(*group).distinct(), group, "left_semi")
    large = large_graphs(with_loops, group, most_edges)

    @F.pandas_udf(f"array<struct<head:{kind},member:{kind}>>")
    def solve(srcs: pd.Series, dsts: pd.Series, heads: pd.Series, latches: pd.Series) -> pd.Series:
        return pd.Series([_bodies(*row) for row in zip(srcs, dsts, heads, latches)])

    ends = back.groupBy(*group).agg(F.collect_list("head").alias("heads"), F.collect_list("latch").alias("latches"))
    small = small_graphs(with_loops.join(large, group, "left_anti"), group).join(ends, group)
    found = cut(small.select(*group, F.explode(solve("srcs", "dsts", "heads", "latches")).alias("r")).select(*group, "r.head", "r.member"))
    if large.isEmpty():
        return found
    of = lambda df: df.join(large, group, "left_semi")
    return found.unionByName(natural_loops_by_rounds(of(edges), of(back), group))


def loop_forest(bodies: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, head, parent, depth, n_members): loops nest where one holds another's head; the smallest such is the parent."""
    sizes = bodies.groupBy(*group, "head").agg(F.count(F.lit(1)).alias("n_members"))
    holds = bodies.where(F.col("head") != F.col("member")).withColumnsRenamed({"head": "_outer", "member": "head"}).join(sizes.withColumnsRenamed({"head": "_outer", "n_members": "_n"}), [*group, "_outer"])
    nested = holds.join(sizes, [*group, "head"]).where(F.col("_n") > F.col("n_members"))
    parents = nested.groupBy(*group, "head").agg(F.min_by("_outer", F.struct("_n", "_outer")).alias("parent"), F.count(F.lit(1)).alias("_depth"))
    return sizes.join(parents, [*group, "head"], "left").select(*group, "head", "parent", F.coalesce("_depth", F.lit(0)).alias("depth"), "n_members")


def innermost_loop(bodies: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, member, head): the smallest loop that holds each node."""
    sizes = bodies.groupBy(*group, "head").agg(F.count(F.lit(1)).alias("n"))
    return bodies.join(sizes, [*group, "head"]).groupBy(*group, "member").agg(F.min_by("head", F.struct("n", "head")).alias("head"))


def loop_exits(edges: DataFrame, bodies: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, head, src, dst): edges from a loop's member to a node outside it."""
    leaving = simple(edges, group).join(bodies.withColumnRenamed("member", "src"), [*group, "src"])
    return leaving.join(bodies.withColumnRenamed("member", "dst"), [*group, "head", "dst"], "left_anti").select(*group, "head", "src", "dst")


def loop_kinds(edges: DataFrame, bodies: DataFrame, back: DataFrame, handlers: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, head, kind): exception where (group, node) of ``handlers`` is the head; infinite without an exit;
    pre-condition if the head itself leaves and no latch does, else post-condition."""
    exits = loop_exits(edges, bodies, group)
    latches = back.join(exits.select(*group, "head", F.col("src").alias("latch")).distinct(), [*group, "head", "latch"], "left_semi").select(*group, "head").distinct().withColumn("_late", F.lit(True))
    caught = handlers.select(*group, F.col("node").alias("head")).distinct().withColumn("_caught", F.lit(True))
    any_exit = exits.select(*group, "head").distinct().withColumn("_exit", F.lit(True))
    out = bodies.select(*group, "head").distinct()
    for side in (latches, caught, any_exit):
        out = out.join(side, [*group, "head"], "left")
    kind = F.when(F.col("_caught"), "exception").when(F.col("_exit").isNull(), "infinite").when(F.col("_late"), "post-condition").otherwise("pre-condition")
    return out.select(*group, "head", kind.alias("kind"))


def loop_conditions(edges: DataFrame, bodies: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, head, node): the members on a path within the loop from its head to an edge that leaves it.

    Backward from the exits to the head, not through it; forward from the head is the same set within a
    natural loop, where every member is reached from the head.
    """
    exits = loop_exits(edges, bodies, group).select(*group, "head", F.col("src").alias("node"))
    inside = simple(edges, group).withColumnsRenamed({"dst": "node", "src": "_before"})
    kept = bodies.withColumnRenamed("member", "node")
    step = lambda at: at.where(F.col("node") != F.col("head")).join(inside, [*group, "node"]).select(*group, "head", F.col("_before").alias("node")).join(kept, [*group, "head", "node"], "left_semi")
    return fixpoint(exits, step, [*group, "head", "node"])


def loop_conditions_forward(edges: DataFrame, bodies: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, head, node) as ``loop_conditions``, from the head on: members from which a walk within the loop, not back
    to the head, meets an edge that leaves it."""
    keys = [*group, "head", "node"]
    exits = loop_exits(edges, bodies, group).select(*group, "head", F.col("src").alias("_end")).distinct()
    inside = simple(edges, group).join(bodies.withColumnRenamed("member", "src"), [*group, "src"]).join(bodies.withColumnRenamed("member", "dst"), [*group, "head", "dst"], "left_semi").where(F.col("dst") != F.col("head"))
    inside = cut(inside.select(*group, "head", "src", "dst"))
    start = bodies.select(*group, "head", F.col("member").alias("node"), F.col("member").alias("_end"))
    step = lambda at: at.withColumnRenamed("_end", "src").join(inside, [*group, "head", "src"]).select(*keys, F.col("dst").alias("_end"))
    walks = fixpoint(start, step, [*keys, "_end"])
    return walks.join(exits, [*group, "head", "_end"], "left_semi").select(*keys).distinct()


def conditions_checked(edges: DataFrame, bodies: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, head, node, side): both, or the one method (backward, forward) that finds the condition."""
    side = lambda df, name: df.withColumn(name, F.lit(True))
    met = side(loop_conditions(edges, bodies, group), "_b").join(side(loop_conditions_forward(edges, bodies, group), "_f"), [*group, "head", "node"], "full")
    return met.select(*group, "head", "node", F.when(F.col("_b") & F.col("_f"), "both").when(F.col("_b"), "backward").otherwise("forward").alias("side"))


def numbered_graph(graph: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, id), (src, dst) by ids) of a graph of names, ids from 0 without gaps; edges into ``roots`` (node) are left out."""
    ids = dense_ids(graph.select(F.col("src").alias("node")).unionByName(graph.select(F.col("dst").alias("node"))).distinct(), "node", start=0)
    kept = graph.join(roots.select(F.col("node").alias("dst")), "dst", "left_anti")
    for end in ("src", "dst"):
        kept = kept.join(ids.select(F.col("node").alias(end), F.col("id").alias(f"_{end}")), end)
    return ids, kept.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def loop_graph(calls: DataFrame, bodies: DataFrame, forest: DataFrame, main: DataFrame) -> DataFrame:
    """(src, dst) among loops and methods, as structs (method, head), the head null for a method.

    A method leads to its outermost loops, a loop to those nested in it, and the innermost loop that holds
    a call (method, stmt, callee), else its method, to the callee; only what is reached from ``main`` (method).
    """
    method = lambda m: F.struct(m.alias("method"), F.lit(None).cast("string").alias("head"))
    loop = lambda m, h: F.struct(m.alias("method"), h.cast("string").alias("head"))
    m, h = F.col("method"), F.col("head")
    nest = forest.select(F.when(F.col("parent").isNull(), method(m)).otherwise(loop(m, F.col("parent"))).alias("src"), loop(m, h).alias("dst"))
    inner = innermost_loop(bodies, ["method"]).withColumnRenamed("member", "stmt")
    called = calls.join(inner, ["method", "stmt"], "left").select(F.when(h.isNull(), method(m)).otherwise(loop(m, h)).alias("src"), method(F.col("callee")).alias("dst"))
    edges = nest.unionByName(called).distinct()
    keyed = edges.select(F.to_json("src").alias("src"), F.to_json("dst").alias("dst"))
    live = reachable(keyed, main.select(F.to_json(method(F.col("method"))).alias("node")), include_seed=True)
    return edges.withColumn("node", F.to_json("src")).join(live, "node", "left_semi").select("src", "dst")
