"""Reachability: closures, ancestors and descendants, vertex cuts.

Edges are tables with columns src and dst, and with the columns of ``group`` where one table holds many
graphs. Edges with a null end are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import NotConverged, fixpoint
from graphloom.plans.sizes import spread

Group = Sequence[str]


def flipped(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst")


def onward(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, dst, _next): edges named so as to go on from another edge's dst."""
    return edges.select(*group, F.col("src").alias("dst"), F.col("dst").alias("_next"))


def simple(edges: DataFrame, group: Group = ()) -> DataFrame:
    """Distinct edges without null ends."""
    return edges.select(*group, "src", "dst").dropna().distinct()


def dealt(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` kept, dealt by the keys that every round joins on, so that only the rounds' new rows are shuffled."""
    return table.repartition(*keys).persist()


def nodes(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node): all ends of edges."""
    return edges.select(*group, F.col("src").alias("node")).unionByName(edges.select(*group, F.col("dst").alias("node"))).dropna().distinct()


def small_graphs(edges: DataFrame, group: Group, roots: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """(group, srcs, dsts, starts): each graph's edges and roots (group, node) as arrays of one row.

    Graphs are dealt over at least as many partitions as there are cores, as the work on them is Python's, and over as
    many as ``rows``, the number of edges where it is known, asks for.
    """
    spark = edges.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1_000_000))
    marked = edges.select(*group, "src", "dst").dropna().withColumn("_root", F.lit(None).cast(dict(edges.dtypes)["src"]))
    if roots is not None:
        none = F.lit(None).cast(dict(edges.dtypes)["src"])
        marked = marked.unionByName(roots.dropna().select(*group, none.alias("src"), none.alias("dst"), F.col("node").alias("_root")))
    dealt = marked.repartition(n, *group).distinct()  # each graph being small, its edges meet once only
    return dealt.groupBy(*group).agg(F.collect_list("src").alias("srcs"), F.collect_list("dst").alias("dsts"), F.collect_set("_root").alias("starts"))


def large_graphs(edges: DataFrame, group: Group, most_edges: int) -> DataFrame:
    """(group): the graphs of more than ``most_edges`` edges; equal ones are told apart only where there are so many with them."""
    over = lambda df: cut(df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges).drop("n"))
    maybe = over(edges)
    if maybe.isEmpty():
        return maybe
    return over(simple(edges.join(maybe, list(group), "left_semi") if group else edges, group))


def reachable(edges: DataFrame, seeds: DataFrame, group: Group = (), include_seed: bool = False, reverse: bool = False, through: DataFrame | None = None) -> DataFrame:
    """(group, node): nodes on a path of at least one edge from a seed (group, node).

    A seed is among them only if a path leads to it, or with ``include_seed``. With ``reverse`` edges are
    walked backwards. With ``through`` (group, node) only those nodes are walked through.
    """
    own = dealt(simple(flipped(edges) if reverse else edges, group), [*group, "src"])
    keys = [*group, "node"]
    hop = lambda at: at.withColumnRenamed("node", "src").join(own, [*group, "src"]).select(*group, F.col("dst").alias("node"))
    step = hop if through is None else lambda at: hop(at.join(through.select(*keys), keys, "left_semi"))
    start = seeds.select(*keys)
    found = fixpoint(hop(start.distinct()), step, keys)
    own.unpersist()
    return found.unionByName(start).distinct() if include_seed else found


def _reached(ahead: dict) -> Iterator[tuple]:
    """(node, what it reaches) for each node of one small graph that has edges out."""
    for start, todo in ahead.items():
        seen, todo = set(), list(todo)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead.get(x, ())
        yield start, list(seen)


def pairs_small(edges: DataFrame, group: Group, rows: int, most: int = 200_000) -> DataFrame:
    """``reachable_pairs`` for graphs of which one fits a task many times over: one pass over each, handed on by about ``most`` pairs at a time."""
    fields, kinds = [*group, "src"], dict(edges.dtypes)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            srcs, dsts = batch.column("srcs"), batch.column("dsts")
            kind, n, of, found = srcs.type.value_type, 0, [], []

            def told() -> pa.RecordBatch:
                at = pa.array(of, pa.int64())  # noqa: B023
                ends = [pa.array([f[k] for f in found], t) for k, t in ((0, kind), (1, pa.list_(kind)))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*[batch.column(g).take(at) for g in group], *ends], [*fields, "dsts"])  # noqa: B023

            for i in range(batch.num_rows):
                ahead: dict = {}
                for a, b in zip(srcs[i].as_py(), dsts[i].as_py()):
                    ahead.setdefault(a, []).append(b)
                for pair in _reached(ahead):
                    of.append(i), found.append(pair)
                    n += len(pair[1])
                    if n >= most:
                        yield told()
                        n, of, found = 0, [], []
            yield told()

    listed = small_graphs(edges, group, rows=rows).select(*group, "srcs", "dsts")
    out = listed.mapInArrow(solve, ", ".join([*[f"`{c}` {kinds[c]}" for c in fields], f"dsts array<{kinds['src']}>"]))
    return out.select(*fields, F.explode("dsts").alias("dst"))


def reachable_pairs(edges: DataFrame, group: Group = (), seeds: DataFrame | None = None, max_rounds: int = 60, most_edges: int = 1_000) -> DataFrame:
    """(group, src, dst): for each source, or each seed (group, node), the nodes reached by at least one edge.

    Of a table of many graphs, those of at most ``most_edges`` edges are solved as one row each, without rounds that keep their pairs;
    which they are is counted first. For others without seeds the paths double each round: the last round's new pairs are joined
    with all pairs found, on either side, so that the rounds are the logarithm of the longest path. The result is by nature all
    pairs; for large graphs give seeds.
    """
    keys = [*group, "src", "dst"]
    if seeds is not None:
        own = dealt(simple(edges, group), [*group, "src"])
        ahead = onward(own, group)
        step = lambda at: at.join(ahead, [*group, "dst"]).select(*group, "src", F.col("_next").alias("dst"))
        found = fixpoint(own.join(seeds.withColumnRenamed("node", "src"), [*group, "src"], "left_semi"), step, keys)
        own.unpersist()
        return found
    if group and most_edges:
        large = large_graphs(edges, group, most_edges)
        if large.isEmpty():
            return pairs_small(edges, group, edges.count())
        small, others = (edges.join(large, list(group), how) for how in ("left_anti", "left_semi"))
        return pairs_small(small, group, small.count()).unionByName(reachable_pairs(others, group, max_rounds=max_rounds, most_edges=0))
    known = new = cut(simple(edges, group))
    for _ in range(max_rounds):
        n = known.count()
        chain = lambda x, y: spread(x, *group, "dst", rows=n).join(onward(y, group).hint("merge"), [*group, "dst"]).select(*group, "src", F.col("_next").alias("dst"))  # noqa: B023, E731
        longer = spread(chain(new, known).unionByName(chain(known, new)), *keys, rows=4 * n)
        new = cut(longer.distinct().join(known.hint("merge"), keys, "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
    raise NotConverged(f"new pairs after {max_rounds} rounds")


def connected_set(edges: DataFrame, seeds: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node, side): the seeds' ancestors and descendants, seeds included in both. Both sides share their rounds."""
    side = lambda df, name: df.withColumn("side", F.lit(name))
    both = side(edges, "descendant").unionByName(side(flipped(edges).select(*edges.columns), "ancestor"))
    starts = side(seeds, "descendant").unionByName(side(seeds, "ancestor"))
    return reachable(both, starts, [*group, "side"], include_seed=True).select(*group, "node", "side")


def unrelated(edges: DataFrame, seeds: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node): nodes that are neither ancestors nor descendants of a seed, nor seeds."""
    return nodes(edges, group).join(connected_set(edges, seeds, group).select(*group, "node"), [*group, "node"], "left_anti")


def without(edges: DataFrame, cut: DataFrame, group: Group = ()) -> DataFrame:
    """The edges left when nodes are removed."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(cut.select(*group, F.col("node").alias(end)), [*group, end], "left_anti")
    return out.select(*edges.columns)


def induced(edges: DataFrame, kept: DataFrame, group: Group = ()) -> DataFrame:
    """The edges between kept nodes."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(kept.select(*group, F.col("node").alias(end)), [*group, end], "left_semi")
    return out.select(*edges.columns)


def degrees(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node, n_in, n_out) over distinct edges."""
    own = simple(edges, group)
    ends = own.select(*group, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(own.select(*group, F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy(*group, "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def sources(edges: DataFrame, group: Group = (), fallback: bool = True) -> DataFrame:
    """(group, node): nodes entered by no other node; where a graph has none, its least node with ``fallback``."""
    entered = simple(edges, group).where(F.col("src") != F.col("dst")).select(*group, F.col("dst").alias("node"))
    all_nodes = nodes(edges, group)
    strict = all_nodes.join(entered, [*group, "node"], "left_anti")
    if not fallback:
        return strict
    least = all_nodes.groupBy(*group).agg(F.min("node").alias("node"))
    return strict.unionByName(least.join(strict, list(group), "left_anti") if group else least.where(F.lit(strict.isEmpty())))


def on_cycles(edges: DataFrame, component: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node): nodes on a cycle, given ``scc``'s components: in one of several nodes, or with an edge to itself."""
    big = component.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    loops = edges.where(F.col("src") == F.col("dst")).select(*group, F.col("src").alias("node"))
    return component.join(big, [*group, "component"], "left_semi").select(*group, "node").unionByName(loops).distinct()


def self_recursive(edges: DataFrame, group: Group = ()) -> DataFrame:
    """(group, node): nodes with an edge to themselves."""
    return edges.where(F.col("src") == F.col("dst")).select(*group, F.col("src").alias("node")).distinct()


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def attached_roots(edges: DataFrame, main: Column, group: Group = ()) -> DataFrame:
    """The edges with one more from ``main`` to each node entered by no other."""
    roots = sources(edges, group, fallback=False).where(F.col("node") != main)
    return edges.select(*group, "src", "dst").unionByName(roots.select(*group, main.alias("src"), F.col("node").alias("dst")))
