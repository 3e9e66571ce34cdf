"""Taint rules, formulas, patterns, the store, names."""

import itertools

from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import absint, boolean, diagrams, patterns, taint


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_taint_rules(spark):
    stmts = spark.createDataFrame([("m", 0, "assign"), ("m", 1, "assign"), ("m", 2, "return"), ("m", 3, "throw")], "method string, idx int, kind string")
    e = [
        ("m", 0, 0, None, None, "lhs", "local", "x", None, None, None),
        ("m", 0, 1, None, None, "rhs", "invoke", "y.f(z)", None, "C.f", None),
        ("m", 0, 2, 1, -1, "rhs", "local", "y", None, None, None),
        ("m", 0, 3, 1, 0, "rhs", "local", "z", None, None, None),
        ("m", 1, 0, None, None, "lhs", "instance_field", "x.g", None, None, "C:g"),
        ("m", 1, 1, 0, 0, "lhs", "local", "x", None, None, None),
        ("m", 1, 2, None, None, "rhs", "new_array", "new int[n]", "int", None, None),
        ("m", 1, 3, 2, 0, "rhs", "local", "n", None, None, None),
        ("m", 2, 0, None, None, "op", "local", "x", None, None, None),
    ]
    exprs = spark.createDataFrame(e, "method string, idx int, expr_id int, parent_id int, pos int, side string, kind string, text string, type string, callee string, field string")
    over = spark.createDataFrame([("D.f", "C.f", 1)], "method string, super_method string, n_params int")
    got = set(rows(taint.taint_edges(stmts, exprs, over), "src", "dst", "rel"))
    for edge in [
        ("stmt:m:0", "value:m:x", "Lhs"), ("value:m:x", "local:m:x", "Ref"), ("return:C.f", "stmt:m:0", "Result"), ("value:m:y", "stmt:m:0", "InvokeBase"),
        ("value:m:z", "parameter:C.f:0", "Argument"), ("value:m:z", "stmt:m:0", "ParametersDependency"), ("value:m:x", "value:m:x.g", "InstanceFieldBase"),
        ("value:m:x.g", "instance_field:C:g", "InstanceFieldRef"), ("value:m:n", "new_array:m:1", "NewArraySize"), ("new_array:m:1", "stmt:m:1", "NewArray"),
        ("value:m:x", "stmt:m:2", "Stmt"), ("stmt:m:2", "return:m", "Return"), ("stmt:m:3", "throws:m", "Throws"), ("return:D.f", "return:C.f", "MethodOverridden"),
        ("parameter:C.f:0", "parameter:D.f:0", "ParameterSubtypePolymorphism"),
    ]:
        assert edge in got, edge
    assert not any(rel == "Definition" for _, _, rel in got)
    assert ("stmt:m:2", "return:m", "Return") not in set(rows(taint.taint_edges(stmts, exprs, strict=True), "src", "dst", "rel"))


def test_dealt_facts_are_moved_only_for_edges_between_statements(spark):
    """Facts dealt by idx and method: what stands at a statement isn't moved again, and equal edges are told apart in one exchange; repeated facts give each edge once."""
    deal = lambda df: df.repartition(3, "idx", "method")
    stmts = spark.createDataFrame([(m, i, "throw" if i % 5 == 0 else "assign") for m in "ab" for i in range(20)] * 2, "method string, idx int, kind string")
    each = lambda m, i: [(m, i, 0, None, None, "lhs", "local", "x", None, None, None), (m, i, 1, None, None, "rhs", "invoke", f"c{i}", None, "f", None), (m, i, 2, 1, -1, "rhs", "local", "w", None, None, None), (m, i, 3, 1, 0, "rhs", "local", "w", None, None, None), (m, i, 4, 1, 1, "rhs", "local", "w", None, None, None)]
    facts = [row for m in "ab" for i in range(20) for row in each(m, i)]
    exprs = spark.createDataFrame(facts * 2, "method string, idx int, expr_id int, parent_id int, pos int, side string, kind string, text string, type string, callee string, field string")
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = taint.taint_edges(deal(stmts), deal(exprs))
        assert df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 1
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    want = set()
    for m in "ab":
        for i in range(20):
            s_, x, w = f"stmt:{m}:{i}", f"value:{m}:x", f"value:{m}:w"
            want |= {(s_, x, "Lhs", None), (x, f"local:{m}:x", "Ref", None), ("return:f", s_, "Result", None), (f"local:{m}:w", w, "Ref", None), (w, s_, "InvokeBase", None), (w, s_, "ParametersDependency", None), (w, "parameter:f:0", "Argument", 0), (w, "parameter:f:1", "Argument", 1)}
            want |= {(s_, f"throws:{m}", "Throws", None)} if i % 5 == 0 else set()
    assert set(got) == want and len(got) == len(want)


def test_taint_edges_are_compiled(spark):
    """No function over arrays, which Spark interprets row by row, stands between facts and edges; edges of lambdas and arrays."""
    stmts = spark.createDataFrame([("m", 0, "assign"), ("m", 1, "assign")], "method string, idx int, kind string")
    e = [
        ("m", 0, 0, None, None, "lhs", "array_ref", "a[i]", "int", None, None), ("m", 0, 1, 0, 0, "lhs", "local", "a", None, None, None), ("m", 0, 2, 0, 1, "lhs", "local", "i", None, None, None),
        ("m", 0, 3, None, None, "rhs", "lambda", "l", None, "L", "I"), ("m", 0, 4, 3, -1, "rhs", "this", "this", None, None, None), ("m", 0, 5, 3, 0, "rhs", "local", "b", None, None, None),
        ("m", 1, 0, None, None, "rhs", "new_multi_array", "n", "int", None, None), ("m", 1, 1, 0, 1, "rhs", "parameter", "p", None, None, None), ("m", 9, 0, None, None, "rhs", "new", "no statement", None, None, None),
    ]
    exprs = spark.createDataFrame(e, "method string, idx int, expr_id int, parent_id int, pos int, side string, kind string, text string, type string, callee string, field string")
    df = taint.taint_edges(stmts, exprs)
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    v, at = "value:m:", "stmt:m:0"
    assert {tuple(r) for r in df.collect()} == {
        (at, v + "a[i]", "Lhs", None), (v + "a[i]", "array_ref:int", "ArrayRef", None), (v + "a", v + "a[i]", "ArrayBase", None), (v + "i", v + "a[i]", "ArrayIndex", None),
        ("local:m:a", v + "a", "Ref", None), ("local:m:i", v + "i", "Ref", None), ("local:m:b", v + "b", "Ref", None), ("this:m", v + "this", "Ref", None), ("parameter:m:1", v + "p", "Ref", None),
        ("lambda:m:0", at, "LambdaClosure", None), ("return:L", "return:I", "LambdaReturn", None), (v + "this", "parameter:L:0", "LambdaCaptureThis", None), (v + "b", "parameter:L:0", "LambdaCapture", 0),
        (v + "this", at, "LambdaCaptureDependency", None), (v + "b", at, "LambdaCaptureDependency", None), ("new_array:m:1", "stmt:m:1", "NewMultiArray", None), (v + "p", "new_array:m:1", "NewMultiArraySize", 1),
    }


def holds(terms, value):
    return any(all(value[x.lstrip("!")] != x.startswith("!") for x in t) for t in terms)


def test_vital_and_simplified(spark):
    formulas = {
        "1": [["A", "B"]], "2": [["A"], ["A", "B"]], "3": [["A", "!A"]], "4": [["A", "B"], ["!A", "C"]], "5": [["A", "B"], ["A", "!B"]], "6": [["A", "B", "C"], ["!A", "B", "C"], ["D"]],
    }
    df = spark.createDataFrame([(k, t) for k, ts in formulas.items() for t in ts], "formula string, term array<string>")
    expected, same = set(), {}
    for k, ts in formulas.items():
        vs = sorted({x.lstrip("!") for t in ts for x in t})
        table = {a: holds(ts, dict(zip(vs, a))) for a in itertools.product((False, True), repeat=len(vs))}
        same[k] = (vs, table)
        expected |= {(k, v) for i, v in enumerate(vs) if any(table[a] != table[a[:i] + (not a[i],) + a[i + 1 :]] for a in table)}
    assert set(rows(diagrams.vital(df), "formula", "var")) == expected
    short = {}
    for r in boolean.simplified(df).collect():
        short.setdefault(r.formula, []).append(list(r.term))
    assert sorted(short["5"]) == [["A"]] and sorted(short["2"]) == [["A"]] and "3" not in short and sorted(short["6"]) == [["B", "C"], ["D"]]
    for k, (vs, table) in same.items():
        assert all(holds(short.get(k, []), dict(zip(vs, a))) == y for a, y in table.items())


def test_path_conditions_and_labels(spark):
    e = spark.createDataFrame([("m", 0, 1, "A"), ("m", 0, 2, "!A"), ("m", 1, 3, None), ("m", 2, 3, "B")], "method string, src int, dst int, literal string")
    roots = spark.createDataFrame([("m", 0)], "method string, node int")
    got = {(r.node, tuple(r.term)) for r in boolean.path_conditions(e, roots).collect()}
    assert got == {(0, ()), (1, ("A",)), (2, ("!A",)), (3, ("A",)), (3, ("!A", "B"))}
    made = [r[0] for r in spark.range(704).select(boolean.label(F.col("id"))).collect()]
    assert made[:2] == ["A", "B"] and made[25:28] == ["Z", "AA", "AB"] and made[701:704] == ["ZZ", "AAA", "AAB"]


LOOPS = {
    "iterator": ["it = list.iterator();head:;t = it.hasNext();if t == 0 goto out;x = it.next();y = x + 1;goto head;"],
    "array_for_each": ["n = length a;i = 0;head:;if i >= n goto out;v = a[i];s = s + v;i = i + 1;goto head;", "i = 0;n = length a;head:;if i >= n goto out;v = a[i];i = i + 1;goto head;"],
    "array_for": ["i = 0;head:;n = length a;if i >= n goto out;s = 1;v = a[i];i = i + 1;goto head;"],
    "count_up": ["i = 0;head:;if i >= 45 goto out;x = x + i;i = i + 2;goto head;", "i = a;head:;if i > n goto out;if x < 3 goto other;i = i + k;goto head;"],
    "count_down": ["i = 45;head:;if i <= 0 goto out;i = i - 1;goto head;", "x = 1;i = 45;head:;if i < 0 goto out;i = i + -1;goto head;"],
    "count_up_sized": ["i = 0;head:;n = list.size();if i >= n goto out;i = i + 1;goto head;", "i = 5;head:;n = s.length();if i >= n goto out;if x < 3 goto out;i = i + 1;goto head;"],
    "count_up_sized_offset": ["i = 0;head:;n = list.size();m = n - 1;if i >= m goto out;i = i + 1;goto head;"],
    "character": ["c = 97;head:;if c > 122 goto out;x = f(c);t = c + 1;c = (char) t;goto head;"],
    "simple_while": ["x = 9;y = 1;head:;if x == 0 goto out;y = y + x;x = x - y;z = 1;goto head;", "i = 0;head:;if i >= 45 goto out;if x > 1 goto out;i = i + 2;goto head;"],
    "count_up_var": ["i = a;head:;m = n;if i >= m goto out;i = i + 1;goto head;"],
    "count_down_var": ["i = a;head:;m = 0;if i <= m goto out;x = 1;i = i - 1;goto head;"],
    "randomized_while": ["head:;i = i + 1;n = 10;if i < n goto head;r = random();t = cmpg(r, 5);if t >= 0 goto head;"],
    "do_while": ["x = 1;head:;y = f(x);x = x + 2;if x < 10 goto head;"],
    "unidentified": [
        "i = 0;head:;if i >= 45 goto out;j = i + 2;foo = bar;", "head:;if x == 0 goto out;x = f(x);goto head;", "x = 1;head:;if x == 0 goto out;x = f(x);goto head;",
        "i = 1;head:;n = length a;if i >= n goto out;s = 1;i = i + 1;goto out2;", "i = a;head:;m = n;if i >= m goto out;goto out;i = i + 1;goto head;", "head:;x = f(x);if x < 10 goto head;",
    ],
}


def test_loop_patterns(spark):
    df = spark.createDataFrame([(k, i, t) for k, v in LOOPS.items() for i, t in enumerate(v)], "want string, no int, text string")
    got = {(r.want, r.no): r for r in patterns.classify_loops(df).collect()}
    assert {k: r.loop_kind for k, r in got.items()} == {(k, i): k for k, v in LOOPS.items() for i in range(len(v))}
    one = got["count_up", 0]
    assert (one.bindings["i"], one.bindings["bound"], one.bindings["by"], one.n_matches) == ("i", "45", "2", 2)
    assert got["count_up_sized_offset", 0].bindings["offset"] == "1" and got["array_for_each", 1].bindings["over"] == "a"
    # A second variable may not stand in for the first.
    other = spark.createDataFrame([("i = 0;head:;if j >= 45 goto out;i = i + 2;goto head;",)], "text string")
    assert patterns.classify_loops(other).first().loop_kind == "unidentified"
    stmts = spark.createDataFrame([("m", 1, "b"), ("m", 0, "a")], "method string, idx int, text string")
    assert patterns.written(stmts, ["method"], ["idx"], "text").first().text == "a;b;"


def test_store_grows_through_calls(spark):
    """main: a = new A; b = new B; a.f = b; c = a.g(b). A.g(p): r = this.f; return r."""
    d = spark.createDataFrame
    facts = absint.Facts(
        alloc=d([("main/a", "oA", "A"), ("main/b", "oB", "B"), ("dead/x", "oX", "X")], "var string, object string, class string"),
        copies=d([("main/a", "main/a2")], "src string, dst string"),
        loads=d([("A.g/r", "A.g/this", "f")], "var string, base string, field string"),
        stores=d([("main/a2", "f", "main/b")], "base string, field string, var string"),
        calls=d([("c1", "main", "main/a", "g", ["main/b"], "main/c", "virtual", None), ("c2", "main", None, "lib", [], "main/t", "static", "Lib.make")], "site string, method string, base string, subsig string, args array<string>, result string, kind string, callee string"),
        methods=d([("A.g", "A", "g", ["A.g/p"], "A.g/this", ["A.g/r"]), ("main", "M", "main", [], None, [])], "method string, class string, subsig string, params array<string>, this string, returns array<string>"),
        dispatch=d([("A", "g", "A.g")], "class string, subsig string, method string"),
        models=d([("Lib.make", "object", "L")], "method string, kind string, class string"),
    )
    store, calls = absint.run(facts, d([("main",)], "method string"))
    got = set(rows(store, "addr", "value"))
    assert {("main/c", "oB"), ("A.g/p", "oB"), ("A.g/this", "oA"), ("oA.f", "oB"), ("A.g/r", "oB"), ("main/a2", "oA"), ("main/t", "L@c2")} <= got
    assert not any(a.startswith("dead") for a, _ in got)
    assert ("c1", "A.g") in rows(calls, "site", "method")


def test_names(spark):
    df = spark.createDataFrame([("[[I", 0x0019, "a/b/C.class"), ("Ljava/lang/String;", 0x0402, "x")], "d string, f int, n string")
    got = df.select(names.type_name(F.col("d")), names.access_words(F.col("f")), names.dotted(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("int[][]", "static final public", "a.b.C"), ("java.lang.String", "private abstract", "x")]
    assert spark.range(1).select(names.duration(F.lit(3723)), names.percent(F.lit(1), F.lit(3))).first()[:] == ("1h 02m 03s", "33.33")
    toks = spark.range(1).select(names.tokens(F.lit('int x = f("a;b"); // end'))).first()[0]
    assert [(t.token, t.kind) for t in toks][:3] == [("int", "keyword"), ("x", "other"), ("f", "other")] and toks[-1].kind == "comment"


def test_formulas_of_the_same_terms_are_simplified_once(spark, monkeypatch):
    given, plain = [], boolean._simplified
    monkeypatch.setattr(boolean, "_simplified", lambda f, n: given.append(f) or plain(f, n))
    terms = ([["A", "B"], ["!B", "A"], ["C", "!C"]], [["A", "B"], ["B"], ["A", "B"]])
    df = spark.createDataFrame([(i, t) for i in range(300) for t in terms[i % 2]] + [(900, ["D", "!D"]), (901, [])], "formula long, term array<string>")
    assert sorted((r.formula, r.term) for r in boolean.simplified(df).collect()) == [(i, [["A"], ["B"]][i % 2]) for i in range(300)] + [(901, [])]
    assert given[0].count() == 5
