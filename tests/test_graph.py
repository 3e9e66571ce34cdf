"""Graph operators on small graphs with answers worked out by hand, and against plain Python on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cycles, layers, loops, program, project, reach
from graphloom.plans.fixpoint import NotConverged, fixpoint, improve

#: r→a, a→b, b→a, b→c, c→d, d→d, x→c
M1 = [("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), ("x", "c")]


def edges(spark, pairs, g=1):
    return spark.createDataFrame([(g, a, b) for a, b in pairs], "g int, src string, dst string")


def node(spark, names, g=1):
    return spark.createDataFrame([(g, n) for n in names], "g int, node string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


G = ["g"]


def test_reachable(spark):
    e = edges(spark, M1)
    assert rows(reach.reachable(e, node(spark, ["r"]), G), "node") == [("a",), ("b",), ("c",), ("d",)]
    assert ("a",) in rows(reach.reachable(e, node(spark, ["a"]), G), "node")
    assert rows(reach.reachable(e, node(spark, ["c"]), G, include_seed=True, reverse=True), "node") == [("a",), ("b",), ("c",), ("r",), ("x",)]
    assert rows(reach.reachable(e, node(spark, ["r"]), G, through=node(spark, ["a"])), "node") == [("a",), ("b",)]
    assert rows(reach.unrelated(e, node(spark, ["x"]), G), "node") == [("a",), ("b",), ("r",)]


def test_empty_null_and_several_groups(spark):
    none = spark.createDataFrame([], "g int, src string, dst string")
    assert rows(reach.reachable(none, node(spark, ["r"]), G), "node") == []
    assert rows(cycles.scc(none, G), "node") == []
    assert rows(layers.longest_path_layers(none, G), "node") == []
    e = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (1, None, "z"), (2, "c", None)], "g int, src string, dst string")
    assert rows(reach.reachable(e, node(spark, ["a"], 1).unionByName(node(spark, ["a"], 2)), G), "g", "node") == [(1, "b"), (2, "c")]


def test_dominators_and_loops(spark):
    e = edges(spark, M1)
    idom = loops.immediate_dominators(e, node(spark, ["r"]), G)
    assert {r.node: r.idom for r in idom.collect()} == {"r": None, "a": "r", "b": "a", "c": "b", "d": "c"}
    dom = loops.dominators(e, node(spark, ["r"]), G)
    assert rows(dom.where("node = 'c'"), "dom") == [("a",), ("b",), ("c",), ("r",)]
    back = loops.back_edges(e, dom, G)
    assert rows(back, "head", "latch") == [("a", "b"), ("d", "d")]
    bodies = loops.natural_loops(e, back, G)
    assert sorted(bodies.collect()) == sorted(loops.natural_loops(e, back, G, most_edges=2).select(bodies.columns).collect())
    assert rows(bodies, "head", "member") == [("a", "a"), ("a", "b"), ("d", "d")]
    assert rows(loops.loop_exits(e, bodies, G), "head", "src", "dst") == [("a", "b", "c")]
    kinds = loops.loop_kinds(e, bodies, back, node(spark, []), G)
    assert rows(kinds, "head", "kind") == [("a", "post-condition"), ("d", "infinite")]


def plain_dominators(pairs, roots):
    """x dominates n if n isn't reached without x."""
    def reached(without):
        seen = {r for r in roots if r != without}
        todo = list(seen)
        while todo:
            a = todo.pop()
            for x, y in pairs:
                if x == a and y != without and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen
    every = reached(None)
    return sorted((n, x) for x in every for n in every - (reached(x) - {x}))


@pytest.mark.parametrize("seed", range(4))
def test_dominators_by_rounds_and_by_rows(spark, seed):
    rng = random.Random(seed)
    n = 24
    pairs = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(rng.choice([26, 34, 50]))]
    e, roots = edges(spark, pairs), ["n00", "n01"][: 1 + seed % 2]
    want = plain_dominators(set(pairs), roots)
    assert rows(loops.dominators(e, node(spark, roots), G), "node", "dom") == want
    assert rows(loops.dominators(e, node(spark, roots), G, most_edges=0), "node", "dom") == want
    one = loops.dominators_by_rounds(e.select("src", "dst"), node(spark, roots).select("node"))
    assert rows(one, "node", "dom") == want
    some = loops.immediate_dominators(e.unionByName(edges(spark, [("n00", "z")], 2)), node(spark, roots).unionByName(node(spark, ["n00"], 2)), G, most_edges=5)
    depth = {x: sum(a == x for a, _ in want) for x, _ in want}
    nearest = {x: max((d for a, d in want if a == x and d != x), key=depth.get, default=None) for x, _ in want}
    assert {(r.g, r.node): r.idom for r in some.collect()} == {**{(1, k): v for k, v in nearest.items()}, (2, "n00"): None, (2, "z"): "n00"}


def test_nested_loops(spark):
    e = edges(spark, [("r", "h"), ("h", "i"), ("i", "j"), ("j", "i"), ("i", "h"), ("h", "z")])
    dom = loops.dominators(e, node(spark, ["r"]), G)
    bodies = loops.natural_loops(e, loops.back_edges(e, dom, G), G)
    assert rows(loops.loop_forest(bodies, G), "head", "depth", "n_members") == [("h", 0, 3), ("i", 1, 2)]
    assert rows(loops.innermost_loop(bodies, G), "member", "head") == [("h", "h"), ("i", "i"), ("j", "i")]


def test_components_and_quotient(spark):
    e = edges(spark, M1)
    comp = cycles.scc(e, G)
    assert rows(comp, "node", "component") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("r", "r"), ("x", "x")]
    outer, inner = cycles.quotient(e, comp, G)
    assert rows(outer, "src", "dst") == [("a", "c"), ("c", "d"), ("d", "d"), ("r", "a"), ("x", "c")]
    assert rows(inner, "component", "src", "dst") == [("a", "a", "b"), ("a", "b", "a"), ("d", "d", "d")]
    assert rows(cycles.recursion_edges(e, comp, G).where("is_recursion"), "src", "dst") == [("a", "b"), ("b", "a"), ("d", "d")]
    assert rows(reach.sources(e, G), "node") == [("r",), ("x",)]
    assert rows(reach.sources(edges(spark, [("p", "q"), ("q", "p")]), G), "node") == [("p",)]


def test_projection_and_peeling(spark):
    e = edges(spark, M1)
    assert rows(project.project_visible(e, node(spark, ["r", "b", "d"]), G), "src", "dst") == [("b", "b"), ("b", "d"), ("d", "d"), ("r", "b")]
    all_ = reach.nodes(e, G)
    assert rows(project.project_visible(e, all_, G), "src", "dst") == sorted(M1)
    comp = cycles.scc(e, G)
    assert rows(cycles.peel(e, all_, comp, "leaf", G), "node") == [(n,) for n in "abcdrx"]
    open_ = edges(spark, [p for p in M1 if p != ("d", "d")])
    assert rows(cycles.peel(open_, reach.nodes(open_, G), cycles.scc(open_, G), "leaf", G), "node") == [("a",), ("b",), ("r",)]
    assert rows(cycles.prune(open_, node(spark, []), cycles.scc(open_, G), G), "node") == [("a",), ("b",), ("r",)]


def test_layers(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "c")])
    assert rows(layers.longest_path_layers(e, G), "node", "layer") == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        layers.longest_path_layers(edges(spark, [("a", "b"), ("b", "a")]), G)
    found = layers.bfs_layers(edges(spark, M1), node(spark, ["b"]), G)
    assert rows(found, "node", "layer") == [("a", 1), ("b", 0), ("c", 1), ("d", 2), ("r", -2)]
    assert rows(layers.layering_tree(e, G), "node", "layer") == [("a", 0), ("b", 1), ("c", 2)]


def test_rounds_run_out(spark):
    seed = spark.createDataFrame([(0,)], "n int")
    with pytest.raises(NotConverged):
        fixpoint(seed, lambda at: at.selectExpr("n + 1 as n"), ["n"], max_rounds=3)
    with pytest.raises(NotConverged):
        improve(seed.selectExpr("n", "n as v"), lambda at: at.selectExpr("n", "v + 1 as v"), ["n"], "v", max_rounds=3)


def closure(pairs):
    known = set(pairs)
    while True:
        new = {(a, d) for a, b in known for c, d in pairs if b == c} - known
        if not new:
            return known
        known |= new


def test_random_graphs(spark):
    rng = random.Random(5)
    graphs = {g: sorted({(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(rng.randint(1, 12))}) for g in range(12)}
    e = spark.createDataFrame([(g, a, b) for g, ps in graphs.items() for a, b in ps], "g int, src string, dst string")
    comp, pairs = set(), set()
    for g, ps in graphs.items():
        c = closure(ps)
        pairs |= {(g, a, b) for a, b in c}
        for n in {x for p in ps for x in p}:
            comp.add((g, n, min([n, *(m for m in "abcdefg" if (n, m) in c and (m, n) in c)])))
    assert set(rows(reach.reachable_pairs(e, G), "g", "src", "dst")) == pairs
    assert set(rows(cycles.scc(e, G), "g", "node", "component")) == comp
    assert set(rows(cycles.scc(e, G, most_edges=3), "g", "node", "component")) == comp
    assert set(rows(cycles.scc_by_rounds(e, G), "g", "node", "component")) == comp
    roots = spark.createDataFrame([(g, ps[0][0]) for g, ps in graphs.items()], "g int, node string")
    expected = set()
    for g, ps in graphs.items():
        r = ps[0][0]
        live = {r} | {b for a, b in closure(ps) if a == r}
        for n in live:
            for x in live:
                rest = [p for p in ps if x not in p]
                if n == x or r == x or n not in {r} | {b for a, b in closure(rest) if a == r}:
                    expected.add((g, n, x))
    dom = loops.dominators(e, roots, G)
    assert set(rows(dom, "g", "node", "dom")) == expected


def test_hidden_nodes_that_reach_each_other_are_walked_as_one(spark, monkeypatch):
    """A random graph, a third of it hidden: the edges of plain walks, by a few walked pairs a source."""
    rng, walked = random.Random(12), []
    pairs = [(a, rng.randrange(60)) for a in range(200) for _ in range(6)] + [(300, 303), (303, 306), (306, 300), (306, 301)]
    through = project.fixpoint
    monkeypatch.setattr(project, "fixpoint", lambda *args: walked.append(through(*args)) or walked[-1])
    e = spark.createDataFrame(pairs, "src long, dst long")
    shown = spark.createDataFrame([(i,) for i in range(400) if i % 3], "node long")
    ahead, want = {}, set()
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    for a in ahead:
        if a % 3:
            seen, at = set(), list(ahead[a])
            while at:
                b = at.pop()
                if b not in seen:
                    seen.add(b)
                    at += [] if b % 3 else ahead.get(b, ())
            want |= {(a, b) for b in seen if b % 3}
    assert {(r.src, r.dst) for r in project.project_visible(e, shown).collect()} == want
    assert walked[0].count() < 3 * 200  # 20 hidden nodes, which nearly all sources reach


@pytest.mark.parametrize("most", [1_000, 2])
def test_sources_of_the_same_hidden_nodes_are_walked_once(spark, monkeypatch, most):
    """Many sources lead to few sets of hidden nodes: rows are told of each, but walked for one of them; nothing is found twice."""
    rng, walked = random.Random(5), []
    through = project.fixpoint
    monkeypatch.setattr(project, "fixpoint", lambda *args: walked.append(through(*args)) or walked[-1])
    pairs = [(a, b) for a in range(400, 1300) if a % 3 for b in ((3, 6), (9,), (6, 12, 15))[a % 7 % 3]] + [(a, rng.randrange(60)) for a in range(60) for _ in range(2)]
    found = [tuple(r) for r in project.project_visible(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i,) for i in range(1300) if i % 3], "node long"), most=most).collect()]
    ahead, want = {}, set()
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    for a in ahead:
        seen, at = set(), list(ahead[a]) if a % 3 else []
        while at:
            b = at.pop()
            if b not in seen:
                seen.add(b)
                at += [] if b % 3 else ahead.get(b, ())
        want |= {(a, b) for b in seen if b % 3}
    assert set(found) == want and len(found) == len(want)
    assert most == 2 or walked[0].count() < 600  # 600 sources lead to hidden nodes


def test_projection_of_groups_like_groups_of_the_projection(spark, monkeypatch):
    """Random graphs, and nodes that come back to themselves by hidden ones of several components: equal to the quotient, without walks from nodes where a group has one."""
    rng = random.Random(8)
    for extra in ([], [(1, 300), (300, 303), (303, 1)], [(2, 306), (306, 2), (5, 300), (300, 309), (309, 312), (312, 5), (7, 7)]):
        pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(rng.choice([60, 260]))] + extra
        e = spark.createDataFrame(pairs, "src long, dst long")
        shown = spark.createDataFrame([(i,) for i in range(400) if i % 3], "node long")
        of = spark.createDataFrame([(i, i % 11) for i in range(400) if i % 13], "node long, component long")
        got = rows(project.project_grouped(e, shown, of), "src", "dst")
        want = rows(cycles.quotient(project.project_visible(e, shown), of)[0], "src", "dst")
        assert got == want and want
    walked, through = [], project.fixpoint
    monkeypatch.setattr(project, "fixpoint", lambda *args: walked.append(through(*args)) or walked[-1])
    many = spark.createDataFrame([(a, 3) for a in range(1000) if a % 3] + [(3, a) for a in range(1000) if a % 3], "src long, dst long")
    nodes_ = spark.createDataFrame([(i,) for i in range(1000) if i % 3], "node long")
    assert project.project_grouped(many, nodes_, nodes_.selectExpr("node", "node % 5 AS component")).count() == 25
    assert sum(w.count() for w in walked) == 5


@pytest.mark.parametrize("most_edges", [1_000, 3, 0])
def test_pairs_of_small_graphs_keep_no_rounds(spark, monkeypatch, most_edges):
    """Graphs in rows and by rounds give the same pairs; those in rows leave nothing but their count in the checkpoints."""
    rng, cuts, plain = random.Random(6), [], reach.cut
    graphs = {2**60 + g: {(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(1 + g % 9)} for g in range(30)} | {5: {(f"c{k}", f"c{k + 1}") for k in range(50)}, 6: {("a", "a")}}
    e = spark.createDataFrame([(g, a, b) for g, ps in graphs.items() for a, b in ps] + [(6, "a", "a"), (6, "b", None), (None, "a", "b")], "g long, src string, dst string")
    monkeypatch.setattr(reach, "cut", lambda df: cuts.append(1) or plain(df))
    got = [tuple(r) for r in reach.reachable_pairs(e, G, most_edges=most_edges).select("g", "src", "dst").collect()]
    assert set(got) == {(g, a, b) for g, ps in graphs.items() for a, b in closure(ps)} and len(got) == len(set(got))
    assert len(cuts) == 1 or most_edges < 1_000


def test_growing_sides_are_never_broadcast(spark):
    """Climbing a hierarchy sends none of it to the driver, however small Spark takes it to be."""
    above = spark.range(2, 200).select(F.col("id").alias("class"), F.floor(F.col("id") / 2).alias("super"))
    methods = spark.range(1, 200).select(F.col("id").alias("class"), (F.col("id") % 3).cast("string").alias("subsig"))
    chain = program.override_chain(methods, above)
    assert "Broadcast" not in chain._jdf.queryExecution().executedPlan().toString()
    want = {(c, str(c % 3), c >> d, d) for c in range(1, 200) for d in range(9) if c >> d and (c >> d) % 3 == c % 3}
    assert {tuple(r) for r in chain.collect()} == want
    nearest = {(c, s, min((x for x in want if x[0] == c and x[3]), key=lambda x: x[3])[2]) for c, s, _, d in want if d}
    assert {tuple(r) for r in program.nearest_override(methods, above).collect()} == nearest


@pytest.mark.parametrize("most_edges", [200_000, 3, 0])
def test_loop_edges_are_edges_to_dominators(spark, most_edges):
    rng = random.Random(12)
    pairs = [(g, f"n{rng.randrange(8)}", f"n{rng.randrange(8)}") for g in range(12) for _ in range(1 + g)] + [(50, "a", "b"), (50, "b", "c"), (51, "a", "a"), (51, "b", "b")]
    e = spark.createDataFrame([*pairs, *pairs[:5], (1, "n1", None)], "g int, src string, dst string")
    starts = spark.createDataFrame([(g, n) for g in range(12) for n in ("n0", "n1")] + [(50, "a"), (51, "a")], "g int, node string")
    got = rows(loops.loop_edges(e, starts, G, most_edges), "g", "head", "latch")
    assert got == rows(loops.back_edges(e, loops.dominators(e, starts, G), G), "g", "head", "latch") and (51, "a", "a") in got and (51, "b", "b") not in got


def test_dominators_by_rounds_moves_only_what_it_finds(spark):
    """A chain with a side entry, a ring and parts that no root reaches; candidates come by doubling instead of in every round."""
    rng, context = random.Random(3), spark.sparkContext
    pairs = [(k, k + 1) for k in range(24)] + [(3, 9), (9, 4), (30, 31), (31, 30), (24, 24), (5, 0)] + [(rng.randrange(40, 400), rng.randrange(40, 400)) for _ in range(900)]
    one = spark.createDataFrame(pairs, "src long, dst long")
    context.setJobGroup("doms", "doms")
    got = rows(loops.dominators_by_rounds(one, spark.range(1).toDF("node")), "node", "dom")
    n_jobs = len(context.statusTracker().getJobIdsForGroup("doms"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_dominators(set(pairs), [0])
    assert (9, 4) not in got and (9, 3) in got and (24, 3) in got
    assert n_jobs < 220  # 263 with candidates joined in every round
