"""The tools by name."""

import pytest

from graphloom import tools
from graphloom.plans import sizes
from graphloom.sources import packets
from tests.test_sources import facts, jar  # noqa: F401

STATE = "id long, kind string, method string, stmt_index int, stmt_kind string, stmt_text string, fp string, kont string, seq long"


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("set"))
    states = [(1, "state", "m", 0, "invoke", "f()", "p", "k", 1), (2, "state", "m", 3, "other", "x", "p", "k", 2)]
    packets.write({"state": spark.createDataFrame(states, STATE), "state_edge": spark.createDataFrame([(1, 1, 2), (2, 2, 7)], "id long, src long, dst long"), "node_tag": spark.createDataFrame([(1, 2, "t", "x")], "id long, node long, tag string, type string")}, path)
    return path


def test_record_tools(spark, records, tmp_path):
    assert tools.info(spark, records).first().asDict() == {"n_nodes": 2, "first_node": 1, "n_edges": 2, "n_hanging": 1, "n_missing": 1, "n_references": 1}
    assert sorted(r.line.split()[0] for r in tools.show(spark, records).collect()) == ["edge-1", "edge-2", "node-1", "node-2", "tag-1"]
    assert [r.line.split()[0] for r in tools.show(spark, records, 2).collect()] == ["node-2"]
    assert [r.id for r in tools.missing_returns(spark, records).collect()] == [1]
    tools.validate(spark, records, str(tmp_path / "a"), add_missing=True)
    assert tools.info(spark, str(tmp_path / "a")).first().n_missing == 0 and packets.read(spark, str(tmp_path / "a"))["node_tag"].count() == 1
    tools.validate(spark, records, str(tmp_path / "b"), remove_missing=True)
    assert packets.read(spark, str(tmp_path / "b"))["state_edge"].count() == 1
    tools.cat(spark, [records, str(tmp_path / "b")], str(tmp_path / "c"))
    assert packets.read(spark, str(tmp_path / "c"))["state"].count() == 4
    methods = spark.createDataFrame([("m",), ("n",)], "method_id string")
    assert tools.coverage(spark, records, methods)[1].first().right_share == 0.5


def test_program_tools(spark, facts, jar):  # noqa: F811
    _, f = facts
    lines = [r.line for r in tools.listed(f).collect()]
    assert "synchronized public class demo.Main" in lines and "  static int total" in [x.replace("   ", "  ") for x in lines]
    assert [r[0] for r in tools.find_main(f).collect()] == ["demo.Main"]
    callees = {r.callee.split("(")[0] for r in tools.call_graph(f).where("method like 'demo.Main.main%'").collect()}
    assert {"demo.Main$Box.area", "demo.Main$Dot.area", "demo.Main.sum", "demo.Main.pick", "demo.Main.fact"} <= callees
    graph = {(r.src.method.split("(")[0], r.dst.method.split("(")[0]) for r in tools.loop_graph(f).collect()}
    assert ("demo.Main.fact", "demo.Main.fact") in graph and ("demo.Main.main", "demo.Main.pick") in graph
    short = lambda df: {(r.src.method.split("(")[0], r.src.head is not None, r.dst.method.split("(")[0], r.dst.head is not None) for r in df.collect()}
    whole, pruned, shrunk = (short(tools.loop_graph(f, *how)) for how in ((), (True,), (True, True)))
    assert pruned < whole and ("demo.Main.fact", False, "demo.Main.fact", False) in pruned & shrunk
    assert all(h or m == "demo.Main.fact" for a, x, b, y in shrunk for m, h in ((a, x), (b, y)))
    checked = tools.loop_conditions(f, check=True).collect()
    assert checked and {r.side for r in checked} == {"both"} and {(r.method, r.head, r.node) for r in checked} == {tuple(r) for r in tools.loop_conditions(f).select("method", "head", "node").collect()}
    tests = tools.vital_branches(f).collect()
    heads = {(r.method, r.head) for r in checked}
    assert tests and {(r.method, r.head) for r in tests} <= heads and all(r.label for r in tests)
    methods = tools.condition_methods(f).collect()
    assert methods and all(r.sweep or r.ancestor for r in methods) and any(r.sweep and r.ancestor for r in methods)
    made = tools.app(spark, "demo", jar)
    assert made["app"].first().main_class == "demo.Main"


def test_loop_tools(spark):
    texts = spark.createDataFrame([(1, "i = 0;head:;if i >= 45 goto out;i = i + 2;goto head;"), (2, "nothing;")], "id int, text string")
    assert {r.loop_kind: r.percent for r in tools.loop_statistics(texts).collect()} == {"count_up": 50.0, "unidentified": 50.0}
    assert {(r.name, r.value) for r in tools.loop_operands(texts, ["id"]).collect()} == {("i", "i"), ("from", "0"), ("bound", "45"), ("by", "2")}
    assert tools.system_properties(spark).where("key = 'java.version'").count() == 1


def test_taint_graph_has_all_members(spark):
    stmts = spark.createDataFrame([("m", 0, "return_void")], "method string, idx int, kind string")
    exprs = spark.createDataFrame([], "method string, idx int, expr_id int, parent_id int, pos int, side string, kind string, text string, type string, callee string, field string")
    fields = spark.createDataFrame([("C:f", True)], "field string, static boolean")
    nodes, edges = tools.taint_graph(stmts, exprs, fields, spark.createDataFrame([("m", 1)], "method string, n_params int"))
    assert {r.node for r in nodes.collect()} == {"stmt:m:0", "return:m", "static_field:C:f", "throws:m", "parameter:m:0"} and edges.count() == 1


def test_spread_follows_the_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "a")
    wide = sizes.spread(df, "a", rows=100, most_rows=10)
    assert wide.rdd.getNumPartitions() == 10 and wide.count() == 100
    assert sizes.spread(df, "a", rows=100) is df


def test_subtypes_of_some_classes_are_those_of_the_closure(spark):
    from graphloom.operators import program

    above = spark.createDataFrame([(k, k // 2) for k in range(2, 60)] + [(60, 61), (61, 60), (7, 4)], "class long, super long")
    wanted = spark.createDataFrame([(k,) for k in (1, 4, 30, 60, 99)], "super long")
    got = [tuple(r) for r in program.subtypes_of(above, wanted).collect()]
    closed = {tuple(r) for r in program.subtypes(above).collect()}
    assert sorted(got) == sorted({(c, s) for c, s in closed if s in (1, 4, 30, 60)} | {(99, 99)})
