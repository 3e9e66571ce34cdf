"""Decision diagrams and loop slices against truth tables and walks."""

import itertools
import random

import pytest

from graphloom import tools
from graphloom.operators import diagrams, slices

STMT = "method string, idx int, kind string, targets array<int>"
EDGE = "node string, var string, low string, high string"


def table(terms, names):
    """The truth table of an or of ands."""
    rows = []
    for values in itertools.product((False, True), repeat=len(names)):
        own = dict(zip(names, values))
        rows.append(any(all(own[x.lstrip("!")] != x.startswith("!") for x in t) for t in terms))
    return rows


def depends(terms, names):
    out = set()
    for n in names:
        k = names.index(n)
        rows = table(terms, names)
        step = 1 << (len(names) - 1 - k)
        if any(rows[i] != rows[i ^ step] for i in range(len(rows))):
            out.add(n)
    return out


@pytest.mark.parametrize("most", [10_000, 3])
def test_diagrams_of_random_formulas(spark, most):
    rng = random.Random(7)
    names = list("abcde")
    formulas = {k: [[rng.choice(["", "!"]) + rng.choice(names) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))] for k in range(60)}
    formulas |= {60: [["a"], ["!a"]], 61: [["a", "!a"]], 62: [[]], 63: [["a", "b"], ["a", "!b"]], 64: [["a"]]}
    df = spark.createDataFrame([(k, t) for k, ts in formulas.items() for t in ts], "formula int, term array<string>")
    vital = {}
    for r in diagrams.vital(df, most).collect():
        vital.setdefault(r.formula, set()).add(r["var"])
    assert {k: vital.get(k, set()) for k in formulas} == {k: depends(ts, names) for k, ts in formulas.items()}
    by_id, by_table = {}, {}
    for r in diagrams.equal(df, most).collect():
        by_id.setdefault(r.id, set()).add(r.formula)
        by_table.setdefault(tuple(table(formulas[r.formula], names)), set()).add(r.formula)
    assert sorted(map(sorted, by_id.values())) == sorted(map(sorted, by_table.values()))
    assert {60, 62} <= by_id["T"] and 61 in by_id["F"]


def test_formulas_of_sixty_variables(spark):
    names = [f"v{k:02}" for k in range(60)]
    pairs = [names[k : k + 2] for k in range(0, 60, 2)]
    rows = [("or of ands", p) for p in pairs] + [("absorbed", names[:1])] + [("absorbed", [names[0], *p]) for p in pairs]
    found = diagrams.vital(spark.createDataFrame(rows, "formula string, term array<string>")).collect()
    assert sorted(r["var"] for r in found if r.formula == "or of ands") == names
    assert [r["var"] for r in found if r.formula == "absorbed"] == names[:1]


def diamonds(n):
    """if k to the then part, else falling through to a goto behind it; the last if leaves."""
    rows, at = [], 0
    for _ in range(n):
        rows += [("m", at, "if", [at + 2]), ("m", at + 1, "goto", [at + 3]), ("m", at + 2, "assign", None)]
        at += 3
    return [*rows, ("m", at, "if", [at + 2]), ("m", at + 1, "goto", [0]), ("m", at + 2, "return", None)]


def test_forty_diamonds_in_a_row(spark):
    stmts = spark.createDataFrame(diamonds(40), STMT)
    back = spark.createDataFrame([("m", 0, 121)], "method string, head int, latch int")
    found = slices.vital_branches(stmts, back).collect()
    assert [(r.idx, r.label) for r in found] == [(120, "AO")]


def walked(rows, head, end):
    """(labels by idx, the ifs that matter) of a loop by walking it under every choice."""
    at = {i: (kind, t[0] if t else None) for i, kind, t in rows}
    ifs = [i for i in range(head, end + 1) if at[i][0] == "if"]

    def nexts(i):
        kind, target = at[i]
        if kind == "if":
            return [(False, i + 1 if i + 1 in at else None), (True, target)]
        if kind == "goto":
            return [(None, target)]
        return [] if kind == "return" else [(None, i + 1 if i + 1 in at else None)]

    def follow(i, source):
        """Where an edge from ``source`` to ``i`` leads, gotos skipped; none if it goes back."""
        while True:
            if i is None or i <= source:
                return None, None
            if head <= i <= end and at[i][0] == "goto":
                if at[i][1] <= i:
                    return None, i
                i, source = at[i][1], i
            else:
                return i, None

    edges = {}
    for i in range(head, end + 1):
        if at[i][0] != "goto" or i == head:
            edges[i] = {b: follow(j, i) for b, j in nexts(i)}
    leaves = any(to == end + 1 for e in edges.values() for to, _ in e.values())
    exit_ = end + 1 if leaves else end

    def out(values):
        i = head
        while i is not None:
            if i == exit_ and i != head:
                return True
            if i not in edges:
                return False
            e = edges[i]
            to, closing = e.get(values.get(i)) if at[i][0] == "if" else e.get(None, (None, None))
            i = to if to is not None else (closing if not leaves and closing == end else None)
        return False

    matter = []
    for i in ifs:
        others = [j for j in ifs if j != i]
        if any(out({**dict(zip(others, v)), i: True}) != out({**dict(zip(others, v)), i: False}) for v in itertools.product((False, True), repeat=len(others))):
            matter.append(i)
    return matter


def test_vital_branches_like_walks(spark):
    rng = random.Random(9)
    rows, loops_, want = [], [], set()
    for m in range(150):
        n = rng.randint(3, 9)
        own = []
        for i in range(n):
            kind = rng.choice(["assign", "if", "if", "goto", "return"]) if i < n - 1 else rng.choice(["goto", "if", "return"])
            own.append((i, kind, [rng.randrange(n)] if kind in ("if", "goto") else None))
        head = rng.randrange(n)
        end = rng.randrange(head, n)
        rows += [(f"m{m}", *r) for r in own]
        loops_.append((f"m{m}", head, end))
        want |= {(f"m{m}", i) for i in walked(own, head, end)}
    found = slices.vital_branches(spark.createDataFrame(rows, STMT), spark.createDataFrame(loops_, "method string, head int, latch int"))
    assert {(r.method, r.idx) for r in found.collect()} == want and want


def test_graphs_by_rounds_like_graphs_in_rows(spark):
    rng = random.Random(3)
    rows = [(g, k, f"v{k:02}", rng.randint(k + 1, 12), rng.randint(k + 1, 12)) for g in range(20) for k in range(8)]
    decisions = spark.createDataFrame(rows, "g int, node int, var string, low int, high int")
    ends = spark.createDataFrame([(g, k, "T" if k % 3 else "F") for g in range(20) for k in range(8, 13)], "g int, node int, id string")
    both = [sorted(map(str, diagrams.reduced(decisions, ends, ["g"], most).collect())) for most in (100, 5)]
    assert both[0] == both[1] and len(both[0]) == 20 * 13


def test_slices_of_nothing(spark):
    stmts, back = spark.createDataFrame([], STMT), spark.createDataFrame([], "method string, head int, latch int")
    assert slices.vital_branches(stmts, back).count() == 0
    assert diagrams.vital(spark.createDataFrame([], "formula int, term array<string>")).count() == 0


def test_chains_end(spark):
    steps = [("a", k, k + 1) for k in range(1000)] + [("b", 5, 9)]
    found = slices.chased(spark.createDataFrame(steps, "g string, src int, dst int"), ["g"]).collect()
    assert {(r.g, r.src): r.dst for r in found} == {**{("a", k): 1000 for k in range(1000)}, ("b", 5): 9}


def test_loops_identified_from_statements(spark):
    rows = [
        ("up", 0, "assign", None, "i = 0"), ("up", 1, "if", [4], "i >= 9"), ("up", 2, "assign", None, "i = i + 1"), ("up", 3, "goto", [1], None), ("up", 4, "return", None, None),
        ("tests", 0, "if", [3], "a == b"), ("tests", 1, "if", [3], "c == d"), ("tests", 2, "goto", [0], None), ("tests", 3, "return", None, None),
        ("ever", 10, "assign", None, "a = b"), ("ever", 20, "goto", [10], None), ("ever", 30, "return", None, None),
        ("late", 0, "assign", None, "i = 0"), ("late", 7, "assign", None, "i = i + 1"), ("late", 9, "if", [7], "i < n"), ("late", 12, "return", None, None),
    ]
    stmts = spark.createDataFrame(rows, STMT + ", text string").selectExpr("*", "CAST(NULL AS int) AS default_target")
    found = {(r.method, r.head): r for r in tools.identified_loops(stmts).collect()}
    assert {k: r.loop_kind for k, r in found.items()} == {("up", 1): "count_up", ("tests", 0): "branches", ("ever", 10): "unidentified", ("late", 7): "do_while"}
    assert found["tests", 0].branches == [0, 1] and found["up", 1].bindings["bound"] == "9" and found["up", 1].branches is None


def test_conditions_by_sweep_and_ancestor(spark):
    # two tests leave; a diamond stands between them
    rows = [("m", 0, "if", [7]), ("m", 1, "if", [3]), ("m", 2, "assign", None), ("m", 3, "assign", None), ("m", 4, "if", [7]), ("m", 5, "assign", None), ("m", 6, "goto", [0]), ("m", 7, "return", None)]
    cut_out = slices.loop_slices(spark.createDataFrame(rows, STMT), spark.createDataFrame([("m", 0, 6)], "method string, head int, latch int"))
    assert sorted(r.node for r in slices.choke_conditions(cut_out).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.node for r in slices.ancestor_conditions(cut_out).collect()) == [1, 2, 3, 4, 5]
