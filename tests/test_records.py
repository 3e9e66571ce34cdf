"""Record, hierarchy and program operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import hierarchy, history, program, records


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_missing_returns(spark):
    states = spark.createDataFrame([("m", 0, "f", "k", "call"), ("m", 1, "f", "k", "other"), ("m", 3, "f", "k", "call"), ("m", 3, "g", "k", "call"), ("m", 4, "g", "k", "other")], "method string, idx int, fp string, kont string, kind string")
    assert rows(records.missing_successor(states, ["method", "fp", "kont"], "idx", F.col("kind") == "call"), "idx", "fp") == [(3, "f")]


def test_integrity(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 9), (3, 8, 9)], "id int, src int, dst int")
    nodes = spark.createDataFrame([(1, "s", 5), (2, "s", 3), (3, "s", 4)], "id int, kind string, seq int")
    assert rows(records.hanging_edges(edges, nodes), "id") == [(2,), (3,)]
    assert rows(records.missing_refs(edges, nodes), "node", "refs") == [(8, 1), (9, 2)]
    assert rows(records.add_missing(edges, nodes), "id", "kind")[-2:] == [(8, "missing"), (9, "missing")]
    assert rows(records.drop_missing(edges, nodes), "id") == [(1,)]
    assert records.info(edges, nodes).first().asDict() == {"n_nodes": 3, "first_node": 2, "n_edges": 3, "n_missing": 2, "n_references": 3, "n_hanging": 2}


def test_coverage(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    found = records.coverage(a, b, ["k"])
    assert rows(found, "k", "side") == [("x", "left"), ("y", "both"), ("z", "right")]
    assert records.coverage_summary(found).first().left_share == 0.5


def test_dense_ids_and_order(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "k string")
    assert rows(records.dense_ids(df, "k"), "k", "id") == [("a", 1), ("b", 2), ("c", 3)]
    dup = spark.createDataFrame([("n", 1, "old"), ("n", 2, "new")], "name string, seq int, data string")
    assert rows(records.last_wins(dup, ["name"], ["seq"]), "name", "data") == [("n", "new")]


def test_trie(spark):
    names = spark.createDataFrame([("a.b.C",), ("a.b.D",), ("x.y.Z",)], "name string")
    t = hierarchy.trie(names)
    assert rows(t, "node", "n_children", "n_names") == [("a", 1, 0), ("a.b", 2, 0), ("a.b.C", 0, 1), ("a.b.D", 0, 1), ("x", 1, 0), ("x.y", 1, 0), ("x.y.Z", 0, 1)]
    assert {r.node: r.parent for r in hierarchy.compressed(t).collect()} == {"a.b": None, "a.b.C": "a.b", "a.b.D": "a.b", "x.y.Z": None}
    assert {r.name: r.node for r in hierarchy.attach(names, spark.createDataFrame([("a",), ("a.b",)], "node string")).collect()} == {"a.b.C": "a.b", "a.b.D": "a.b", "x.y.Z": None}


def test_flow_and_dispatch(spark):
    stmts = spark.createDataFrame([("m", 0, "assign", None, None), ("m", 1, "if", [4], None), ("m", 2, "switch", [0, 3], 4), ("m", 3, "goto", [1], None), ("m", 4, "return", None, None)], "method string, idx int, kind string, targets array<int>, default_target int")
    flow = program.flow_edges(stmts)
    assert rows(flow, "src", "dst") == [(0, 1), (1, 2), (1, 4), (2, 0), (2, 3), (2, 4), (3, 1)]
    above = spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "A")], "class string, super string")
    sub = program.subtypes(above)
    methods = spark.createDataFrame([("A", "f"), ("C", "f"), ("D", "f"), ("B", "g")], "class string, subsig string")
    calls = spark.createDataFrame([("s1", "A", "f", "virtual"), ("s2", "B", "f", "virtual"), ("s3", "A", "f", "special")], "site string, class string, subsig string, kind string")
    assert rows(program.cha_targets(calls, methods, sub), "site", "target") == [("s1", "A"), ("s1", "C"), ("s1", "D"), ("s2", "C"), ("s3", "A")]
    assert rows(program.nearest_override(methods, above), "class", "target") == [("C", "A"), ("D", "A")]
    targets = spark.createDataFrame([("m", 0, "n")], "method string, idx int, callee string")
    more = stmts.unionByName(spark.createDataFrame([("n", 0, "return_void", None, None)], stmts.schema))
    got = {(r.src.method, r.src.idx, r.dst.method, r.dst.idx, r.kind) for r in program.supergraph(flow, targets, more).collect()}
    assert ("m", 0, "n", 0, "call") in got and ("n", 0, "m", 1, "return") in got and ("m", 0, "m", 1, "flow") in got


def test_handlers_unwind(spark):
    sub = program.subtypes(spark.createDataFrame([("Npe", "Rt"), ("Rt", "Ex")], "class string, super string"))
    stmts = spark.createDataFrame([("m", 1, "Npe"), ("m", 5, "Npe"), ("m", 1, "Ex")], "method string, idx int, thrown string")
    traps = spark.createDataFrame([("m", 1, 0, 3, 8, "Ex"), ("m", 0, 0, 2, 7, "Rt")], "method string, ord int, begin_idx int, end_idx int, handler_idx int, exception string")
    found = program.handlers(stmts, traps, sub)
    assert {(r.idx, r.thrown): r.handler_idx for r in found.collect()} == {(1, "Npe"): 7, (5, "Npe"): None, (1, "Ex"): 8}
    calls = spark.createDataFrame([("main", 3, "m")], "method string, idx int, callee string")
    arrived = {(r.method, r.idx, r.thrown): r.handler_idx for r in program.unwound(stmts, calls, traps, sub).collect()}
    assert arrived == {("m", 1, "Ex"): 8, ("m", 1, "Npe"): 7, ("m", 5, "Npe"): None, ("main", 3, "Npe"): None}


def test_unwinding_like_plain_rounds(spark, monkeypatch):
    """Random calls, and a chain of 40: what plain Python finds, in fewer rounds than the chain has calls."""
    rng = random.Random(4)
    above = {"Npe": ["Npe", "Ex"], "Io": ["Io", "Ex"], "Ex": ["Ex"]}
    calls = [(f"c{k + 1}", 2, f"c{k}") for k in range(40)] + [(f"m{rng.randrange(20)}", rng.randrange(6), f"m{rng.randrange(20)}") for _ in range(60)]
    thrown = [("c0", 1, "Npe"), ("c0", 1, "Io")] + [(f"m{rng.randrange(20)}", rng.randrange(6), rng.choice(list(above))) for _ in range(12)]
    traps = [("c20", 0, 5, "Io", 0, 9)] + [(f"m{rng.randrange(20)}", b, b + rng.randint(1, 3), rng.choice(list(above)), o, 10 + o) for o, b in enumerate(rng.randrange(5) for _ in range(25))]
    first = lambda m, i, t: next((h for n, b, e, x, o, h in sorted(traps, key=lambda r: r[4]) if n == m and b <= i < e and x in above[t]), None)
    want, todo = {}, list(thrown)
    while todo:
        m, i, t = todo.pop()
        if (m, i, t) not in want:
            want[m, i, t] = first(m, i, t)
            todo += [] if want[m, i, t] is not None else [(n, j, t) for n, j, callee in calls if callee == m]
    rounds, plain = [], program.fixpoint
    monkeypatch.setattr(program, "fixpoint", lambda seed, step, keys: plain(seed, lambda at: rounds.append(1) or step(at), keys))
    frame = spark.createDataFrame
    found = program.unwound(
        frame(thrown, "method string, idx int, thrown string"), frame(calls, "method string, idx int, callee string"),
        frame(traps, "method string, begin_idx int, end_idx int, exception string, ord int, handler_idx int"), frame([(c, s) for c, ss in above.items() for s in ss], "class string, super string"),
    )
    got = found.collect()
    assert {(r.method, r.idx, r.thrown): r.handler_idx for r in got} == want and len(got) == len(want)
    assert want["c40", 2, "Npe"] is None and want["c20", 2, "Io"] == 9 and ("c21", 2, "Io") not in want
    assert len(rounds) < 30


def test_ranges_by_pieces_like_comparisons(spark):
    rng = random.Random(5)
    ranges = [(rng.choice("ab"), o, b, b + rng.choice([0, 1, 2, 3, 50, 1000, 10**12]), o * 7) for o, b in enumerate(rng.choice([-(10**12), rng.randint(-40, 40)]) for _ in range(60))]
    points = [(k, rng.choice("abc"), rng.choice([rng.randint(-60, 120), -(10**12) + 5, 10**12, None])) for k in range(300)]
    df = spark.createDataFrame(points, "id int, k string, at long")
    found = records.range_first(df, spark.createDataFrame(ranges, "k string, ord int, b long, e long, h int"), ["k"], "at", "b", "e", "ord", ["h"])
    plain = lambda k, at: next((h for g, _, b, e, h in ranges if g == k and at is not None and b <= at < e), None)
    assert {r.id: r.h for r in found.collect()} == {i: plain(k, at) for i, k, at in points}


def test_text_hash_wraps(spark):
    def plain(text):
        h, units = 98764321261, text.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[k : k + 2], "big")) % 2**64
        return h - 2**64 if h >= 2**63 else h

    texts = ["", "a", "java.lang.Object", "é𐀀\n" * 9, "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.text_hash(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: plain(t) for t in texts}


def test_rules(spark):
    rows_ = spark.createDataFrame([("a.B",), ("a.C",), ("x",)], "name string")
    rules = spark.createDataFrame([(2, False, "^a"), (1, True, "B$")], "ord int, include boolean, pattern string")
    assert {r.name: r.included for r in records.first_match(rows_, rules, "name").collect()} == {"a.B": True, "a.C": False, "x": True}
    many = spark.createDataFrame([(k, k % 2 == 0, f"^n{k}$") for k in range(1200)] + [(2000, False, "^a")], "ord int, include boolean, pattern string")
    named = rows_.unionByName(spark.createDataFrame([("n7",), ("n8",)], "name string"))
    assert {r.name: r.included for r in records.first_match(named, many, "name").collect()} == {"a.B": False, "a.C": False, "x": True, "n7": False, "n8": True}


@pytest.mark.parametrize("version,hidden", [(1, [("a",)]), (2, [("a",), ("b",)]), (3, [("b",)])])
def test_history(spark, version, hidden):
    log = spark.createDataFrame([(1, "hide", "a"), (2, "hide", "b"), (3, "show", "a")], "version int, op string, id string")
    assert rows(records.visible_at(log, version), "id") == hidden


def test_undo_and_redo_like_versions(spark):
    rng = random.Random(4)
    log, want = [], set()
    for user in range(8):
        versions, now = [frozenset()], 0
        for seq in range(150):
            op, key = rng.choice(["hide", "hide", "show", "undo", "undo", "redo", "clear" if seq % 20 == 0 else "redo"]), rng.randrange(5)
            log.append((user, seq, op, key))
            if op == "undo":
                now = max(0, now - 1)
            elif op == "redo":
                now = min(len(versions) - 1, now + 1)
            else:
                new = {"hide": versions[now] | {key}, "show": versions[now] - {key}, "clear": frozenset()}[op]
                if new != versions[now]:
                    versions = [*versions[: now + 1], new]
                    now += 1
            want |= {(user, seq, i) for i in versions[now]}
    df = spark.createDataFrame([*log, (None, 1, "hide", 1), (3, 7, "other", 1)], "user int, seq long, op string, id int")
    assert {tuple(r) for r in history.states_at(df, df.dropna()).collect()} == want
    assert history.periods(df.limit(0)).count() == 0


def test_states_are_read_with_the_log(spark):
    """A point is dealt once, not once a level of pieces, and stands after all changes of its place."""
    big = 2**60 + 1
    log = spark.createDataFrame([("u", 1, "hide", big), ("u", 3, "hide", 2), ("u", 3, "undo", None), ("u", 5, "clear", None), ("v", 1, "hide", 9)], "user string, seq long, op string, id long")
    points = spark.createDataFrame([("u", 0), ("u", 2), ("u", 2), ("u", 3), ("u", 9), ("w", 1), ("v", 1)], "user string, seq long")
    found = history.states_at(log, points)
    assert sorted((r.user, r.seq, r.id) for r in found.where("user = 'v'").collect()) == [("v", 1, 9)]
    assert sorted((r.user, r.seq) for r in found.where("user <> 'v'").collect()) == [("u", 2), ("u", 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    many = spark.range(3).select(F.lit("u").alias("user"), F.col("id").alias("seq"), F.lit("hide").alias("op"), (F.col("id") + big).alias("id"))
    assert max(r.id for r in history.states_at(many, many).collect()) == big + 2
