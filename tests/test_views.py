"""Views of the taint graph and small helpers."""

import random

from pyspark.sql import functions as F

from graphloom.operators import absint, hierarchy, project, reach, subtrees, taint


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_cleaned_graph(spark):
    """Library roots go, then library leaves, then chains close up."""
    e = edges(spark, ("lib1", "lib2"), ("lib2", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("e", "lib3"), ("x", "a"))
    got = taint.cleaned(e, nodes(spark, "lib1", "lib2", "lib3"))
    assert rows(got, "src", "dst") == [("c", "d"), ("c", "e"), ("x", "c")]


def test_view_of_a_selection(spark):
    e = edges(spark, ("p", "i"), ("i", "s"), ("s", "r"), ("other", "far"))
    kinds = spark.createDataFrame([("p", "parameter"), ("i", "inner"), ("s", "stmt"), ("r", "return"), ("other", "stmt"), ("far", "stmt")], "node string, kind string")
    groups = spark.createDataFrame([("p", "m"), ("s", "m"), ("r", "r")], "node string, component string")
    outer, inner = taint.view(e, nodes(spark, "s"), kinds, groups)
    assert rows(outer, "src", "dst") == [("m", "r")] and rows(inner, "src", "dst") == [("p", "s")]


def test_names_and_kinds(spark):
    df = spark.createDataFrame([("instance_field:C:f",), ("parameter:m:0",), ("return:m",), ("local:m:x",), ("new:m:3",)], "node string")
    assert [r[0] for r in df.select(taint.display_kind(F.col("node"))).collect()] == ["field", "input", "output", "local", "allocation"]
    found = taint.find_named(df, spark.createDataFrame([("m",)], "name string"), F.regexp_extract("node", "^[^:]*:([^:]*)", 1))
    assert found.count() == 4


def test_cuts_and_mappings(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    assert rows(reach.without(e, nodes(spark, "b")), "src", "dst") == [("a", "c")]
    assert rows(reach.induced(e, nodes(spark, "a", "b")), "src", "dst") == [("a", "b")]
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "node string, onto string")
    two = spark.createDataFrame([("x", "z")], "node string, onto string")
    assert rows(project.composed(one, two), "node", "onto") == [("a", "z"), ("b", "y")]
    assert rows(project.contract_chains(edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))), "src", "dst") == [("a", "d")]


def test_types_of_values(spark):
    values = spark.createDataFrame([("v", "o1", "Dog"), ("v", "o2", "Car"), ("v", "any", None)], "addr string, value string, class string")
    wanted = spark.createDataFrame([("v", "Animal")], "addr string, wanted string")
    subtype = spark.createDataFrame([("Dog", "Animal"), ("Dog", "Dog"), ("Car", "Car")], "class string, super string")
    assert rows(absint.of_type(values, wanted, subtype), "value") == [("any",), ("o1",)]


def test_stored_tables_can_be_cleared(spark):
    import os

    from graphloom.plans import checkpoint

    kept = checkpoint.stored(spark.range(3), "three")
    assert kept.count() == 3 and os.path.isdir(checkpoint.own_dir(spark).removeprefix("file:"))
    assert checkpoint.clear(spark) and not os.path.isdir(checkpoint.own_dir(spark).removeprefix("file:"))
    assert checkpoint.stored(spark.range(2), "two").count() == 2


def plain_above(parents, node):
    line = [node]
    while parents.get(line[-1]) is not None:
        line.append(parents[line[-1]])
    return line


def test_subtrees_of_random_forests(spark):
    rng = random.Random(6)
    parents = {k: rng.choice([None, *range(max(0, k - 4), k)]) if k else None for k in range(120)}
    tree = spark.createDataFrame([*parents.items(), (500, 501), (501, 500), (600, 999)], "node int, parent int")
    values = [(rng.randrange(120), float(rng.randint(0, 9))) for _ in range(200)]
    want, names_ = {}, set()
    for n, v in values:
        for a in plain_above(parents, n):
            want.setdefault(a, []).append(v)
            names_.add((a, f"n{v}"))
    leaves = spark.createDataFrame(values, "node int, v double")
    found = {r.node: (r.n_leaves, r.total, r.least, r.greatest) for r in subtrees.roll_up(tree, leaves, "v").collect()}
    assert found == {a: (len(v), sum(v), min(v), max(v)) for a, v in want.items()}
    named = leaves.select("node", F.concat(F.lit("n"), F.col("v")).alias("name"))
    assert {tuple(r) for r in subtrees.unions(tree, named, "name").collect()} == names_
    ranges = {r.node: r for r in subtrees.numbered(tree).collect()}
    assert set(ranges) == {*parents, 600} and all(len({b for b in parents if a in plain_above(parents, b)}) == ranges[a].last - ranges[a].first for a in parents)


def test_subtrees_of_a_long_chain(spark):
    n = 20_000
    tree = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = subtrees.roll_up(tree, tree.select("node", F.lit(1).alias("one")), "one")
    assert found.count() == n and found.where(F.col("n_leaves") != n - F.col("node")).isEmpty()


def test_lowest_common_ancestors(spark):
    rng = random.Random(8)
    rows_, sets, want = [], [], {}
    for g in range(12):
        parents = {k: rng.choice([None, k - 1, rng.randrange(k), rng.randrange(k)]) if k else None for k in range(40)}
        rows_ += [(g, *x) for x in parents.items()]
        own = rng.sample(range(40), rng.randint(1, 4))
        sets += [(g, n) for n in own]
        lines = [plain_above(parents, n) for n in own]
        common = [n for n in lines[0] if all(n in line for line in lines)]
        if common:
            want[g] = common[0]
    found = hierarchy.lowest_common(spark.createDataFrame(rows_, "g int, node int, parent int"), spark.createDataFrame(sets, "g int, node int"), ["g"])
    assert {r.g: r.node for r in found.collect()} == want


def test_subtrees_are_numbered_alike_by_every_way(spark):
    rng = random.Random(16)
    bushy = {k: rng.choice([None, (k - 1) // 2, 0, k - 1]) if k else None for k in range(300)}
    for most_nodes, extra in ((0, []), (5, []), (1_000, []), (5, [(k, k - 1) for k in range(1_001, 1_100)])):  # by rounds, in part, in one task, with a chain
        parents = {**bushy, **dict(extra)}
        rows_ = spark.createDataFrame([*parents.items(), (2_000, 2_001), (2_001, 2_000), (2_002, 2_001), (3_000, 9_999)], "node int, parent int")
        ranges = {r.node: r for r in subtrees.numbered(rows_, most_nodes).collect()}
        lines = {n: [a for a in plain_above(parents, n) if a in parents] for n in parents}
        assert set(ranges) == {*parents, 3_000}
        below = {}
        for n, line in lines.items():
            for a in line:
                below.setdefault(a, set()).add(n)
            assert ranges[n].root == line[-1]
        for a, inside in below.items():
            assert {n for n in parents if ranges[n].root == ranges[a].root and ranges[a].first <= ranges[n].first < ranges[a].last} == inside
            assert ranges[a].last - ranges[a].first == len(inside)


def test_earlier_siblings_in_blocks(spark):
    leaves = spark.range(50).select(F.col("id").alias("node"), (F.col("id") % 2).alias("parent"), (F.col("id") + 1).alias("own"))
    for most_rows in (3, 100):
        got = sorted((r.parent, r["_before"], r.own) for r in subtrees._before(leaves, 25, most_rows).collect())
        for parent in (0, 1):
            own = [x for x in got if x[0] == parent]
            assert len(own) == 25 and own[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))


def plain_cleaned(pairs, library):
    """What ``cleaned`` gives, node by node."""
    now = set(pairs)
    for near, far in ((0, 1), (1, 0)):
        while gone := {p for p in now if p[near] in library and p[near] not in {q[far] for q in now}}:
            now -= gone
    of = lambda n, i: [p for p in now if p[i] == n]
    thin = {n for p in now for n in p if len(of(n, 0)) == len(of(n, 1)) == 1}
    out = set()
    for a, b in now:
        while a not in thin and b in thin:
            b = of(b, 0)[0][1]
        out |= set() if a in thin else {(a, b)}
    return sorted(out)


def test_cleaned_as_node_by_node(spark):
    """Rings, self-loops, parallel ways; ways that share their ends."""
    for seed in range(6):
        rng = random.Random(seed)
        pairs = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range((20, 30, 45)[seed % 3])]
        pairs += [("k0", "k1"), ("k1", "k2"), ("k2", "k0"), ("s", "s"), ("t", "u"), ("u", "v"), ("t", "v"), ("t", "t"), ("v", "v"), *pairs[:3]]
        library = [n for n in sorted({n for p in pairs for n in p}) if rng.random() < 0.8 or n == "k1"]
        got = taint.cleaned(edges(spark, *pairs, ("n00", None)), nodes(spark, *library))
        assert rows(got, "src", "dst") == plain_cleaned(pairs, set(library)), seed


def test_cleaned_takes_few_jobs_for_long_chains(spark):
    """A chain closes in as many rounds as the logarithm of its length; it took one for each of its nodes."""
    n, context = 40, spark.sparkContext
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    context.setJobGroup("chain", "chain")
    assert rows(taint.cleaned(e, spark.range(1000, 1001).toDF("node")), "src", "dst") == [(0, n)]
    assert len(context.statusTracker().getJobIdsForGroup("chain")) < 100
    context.setLocalProperty("spark.jobGroup.id", None)
