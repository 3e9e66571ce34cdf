"""The tools by name, over record sets and archives; each returns tables or writes a record set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import cycles, loops, program, project, reach, records, slices, taint
from graphloom.operators.patterns import classify_loops, operands
from graphloom.plans.checkpoint import cut
from graphloom.sources import classfiles, packets

CALL_KINDS = ("invoke", "assign_invoke")


def app(spark: SparkSession, name: str, app_path: str, lib_path: str | None = None, main_class: str | None = None) -> dict[str, DataFrame]:
    """Tables app and path_element of an application's archives and, with origin LIB, its libraries'."""
    found = classfiles.entries(classfiles.scan(spark, app_path))
    mains = classfiles.main_classes(found)
    if lib_path:
        found = found.unionByName(classfiles.entries(classfiles.scan(spark, lib_path, "LIB")))
    return {"app": classfiles.app(mains, name, main_class), "path_element": found}


def cat(spark: SparkSession, paths: list[str], out: str) -> None:
    """Record sets after each other."""
    packets.write(packets.read(spark, *paths), out)


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row about the states and edges of a record set."""
    tables = packets.read(spark, path)
    return records.info(tables["state_edge"], tables["state"])


def show(spark: SparkSession, path: str, state: int | None = None) -> DataFrame:
    """(line) of a record set's states, edges and tags, or of one state."""
    tables = packets.read(spark, path)
    if state is not None:
        tables = {"state": tables["state"].where(F.col("id") == state)}
    return packets.lines(tables)


def validate(spark: SparkSession, path: str, out: str, add_missing: bool = False, remove_missing: bool = False) -> None:
    """Writes a record set whose edges' states are all there: placeholders added, or hanging edges removed. Other tables pass."""
    if add_missing and remove_missing:
        raise ValueError("states are added or edges removed, not both")
    tables = packets.read(spark, path)
    if add_missing:
        whole = records.add_missing(tables["state_edge"], tables["state"])
        tables["state"] = whole.select(*tables["state"].columns)
    if remove_missing:
        tables["state_edge"] = records.drop_missing(tables["state_edge"], tables["state"])
    packets.write(tables, out)


def missing_returns(spark: SparkSession, path: str) -> DataFrame:
    """Call states without the state after the call."""
    states = packets.read(spark, path)["state"].where("kind = 'state'")
    return records.missing_successor(states, ["method", "fp", "kont"], "stmt_index", F.col("stmt_kind").isin(*CALL_KINDS))


def coverage(spark: SparkSession, path: str, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(method, side) of a record set's methods (left) and an archive's (right), and a row of shares."""
    seen = packets.read(spark, path)["state"].select("method").distinct()
    compared = records.coverage(seen, methods.select(F.col("method_id").alias("method")), ["method"])
    return compared, records.coverage_summary(compared)


def listed(facts: dict[str, DataFrame]) -> DataFrame:
    """(line): an archive's classes with their fields and methods, in order."""
    cls = facts["class"].select(F.col("name").alias("class"), F.lit(0).alias("rank"), F.concat_ws(" ", names.access_words(F.col("access")), F.lit("class"), "name").alias("line"))
    fields = facts["field"].select("class", F.lit(1).alias("rank"), F.concat_ws(" ", F.lit(" "), names.access_words(F.col("access")), names.type_name(F.col("descriptor")), "name").alias("line"))
    methods = facts["method"].select("class", F.lit(2).alias("rank"), F.concat_ws(" ", F.lit(" "), names.access_words(F.col("access")), "subsig").alias("line"))
    return cls.unionByName(fields).unionByName(methods).orderBy("class", "rank", "line").select("line")


def find_main(facts: dict[str, DataFrame], lenient: bool = False) -> DataFrame:
    """Classes with a main method."""
    return classfiles.mains(facts["method"], lenient).select("class").distinct()


def call_graph(facts: dict[str, DataFrame]) -> DataFrame:
    """(method, stmt, callee): what calls may reach by class hierarchy analysis, and what lambdas stand for where they are made."""
    subtype = program.subtypes(program.supers(facts["class"]))
    reached = program.cha_targets(facts["call"].select("method", "idx", "class", "subsig", "kind"), facts["method"].select("class", "subsig"), subtype)
    made = facts["lambda"].select("method", F.col("idx").alias("stmt"), F.col("impl").alias("callee"))
    return reached.select("method", F.col("idx").alias("stmt"), F.concat("target", F.lit("."), "subsig").alias("callee")).unionByName(made).distinct()


def loop_tables(facts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(bodies, forest) of all methods with a body."""
    flow = program.flow_edges(facts["stmt"])
    roots = facts["stmt"].groupBy("method").agg(F.min("idx").alias("node"))
    bodies = loops.natural_loops(flow, loops.back_edges(flow, loops.dominators(flow, roots, ["method"]), ["method"]), ["method"])
    return bodies, loops.loop_forest(bodies, ["method"])


def loop_graph(facts: dict[str, DataFrame], prune: bool = False, shrink: bool = False) -> DataFrame:
    """(src, dst) of the loops and methods reached from the main methods.

    With ``prune`` only what leads to a loop or a recursion stays, with ``shrink`` only loops and methods in
    recursion, each joined to the nearest below it.
    """
    bodies, forest = loop_tables(facts)
    main = classfiles.mains(facts["method"]).select(F.col("method_id").alias("method"))
    graph = loops.loop_graph(call_graph(facts), bodies, forest.withColumn("parent", F.col("parent").cast("string")), main)
    if not (prune or shrink):
        return graph
    kind = graph.schema["src"].dataType
    edges = cut(graph.select(F.to_json("src").alias("src"), F.to_json("dst").alias("dst")))
    wanted = reach.nodes(edges).where(F.get_json_object("node", "$.head").isNotNull())
    component = cut(cycles.scc(edges))
    if prune:
        edges = cut(reach.induced(edges, cycles.prune(edges, wanted, component)))
    if shrink:
        edges = project.shrink(edges, wanted, reach.on_cycles(edges, component))
    return edges.select(F.from_json("src", kind).alias("src"), F.from_json("dst", kind).alias("dst"))


def loop_conditions(facts: dict[str, DataFrame], check: bool = False) -> DataFrame:
    """(method, head, node): the statements that decide on leaving each loop; with ``check`` also ``side``, which of the two methods find it."""
    bodies, _ = loop_tables(facts)
    find = loops.conditions_checked if check else loops.loop_conditions
    return find(program.flow_edges(facts["stmt"]), cut(bodies), ["method"])


def _back_edges(stmts: DataFrame) -> DataFrame:
    flow = cut(program.flow_edges(stmts))
    roots = stmts.groupBy("method").agg(F.min("idx").alias("node"))
    return cut(loops.back_edges(flow, loops.dominators(flow, roots, ["method"]), ["method"]))


def vital_branches(facts: dict[str, DataFrame]) -> DataFrame:
    """(method, head, idx, label): the tests on which leaving each loop depends."""
    return slices.vital_branches(facts["stmt"], _back_edges(facts["stmt"]))


def condition_methods(facts: dict[str, DataFrame]) -> DataFrame:
    """(method, head, node, sweep, ancestor): the statements that decide on leaving each loop, and which of two methods finds them:
    the sweep to the first choke point, and what lies behind the latest common statement."""
    cut_ = cut(slices.loop_slices(facts["stmt"], _back_edges(facts["stmt"])))
    keys, side = ["method", "head", "node"], lambda df, name: df.withColumn(name, F.lit(True))
    met = side(slices.choke_conditions(cut_), "sweep").join(side(slices.ancestor_conditions(cut_), "ancestor"), keys, "full")
    return met.select(*keys, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("sweep", "ancestor")])


def identified_loops(stmts: DataFrame) -> DataFrame:
    """(method, head, loop_kind, bindings, branches) of the loops of statements (method, idx, kind, targets, default_target, text)."""
    return slices.identified_loops(stmts, _back_edges(stmts))


def call_coverage(spark: SparkSession, path: str, facts: dict[str, DataFrame]) -> DataFrame:
    """One row: a record set's methods against an archive's, and against those its main methods call."""
    seen = packets.read(spark, path)["state"].select("method").distinct()
    main = classfiles.mains(facts["method"]).select(F.col("method_id").alias("node"))
    calls = call_graph(facts).select(F.col("method").alias("src"), F.col("callee").alias("dst"))
    called = reach.reachable(calls, main, include_seed=True).withColumnRenamed("node", "method")
    return records.method_coverage(seen, facts["method"].select(F.col("method_id").alias("method")), called)


def taint_graph(stmts: DataFrame, exprs: DataFrame, fields: DataFrame, methods: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (node), edges) of the taint graph: the ends of its edges, and the addresses of all fields and methods."""
    edges = cut(taint.taint_edges(stmts, exprs, overrides))
    return reach.nodes(edges).unionByName(taint.member_nodes(fields, methods).select("node")).distinct(), edges


def loop_statistics(texts: DataFrame) -> DataFrame:
    """(loop_kind, n, percent) of loops written as texts."""
    return records.kind_counts(classify_loops(texts), "loop_kind")


def loop_operands(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, value) of what the loops' patterns bind."""
    return operands(classify_loops(texts), key)


def system_properties(spark: SparkSession) -> DataFrame:
    """(key, value) of the driver's Java properties, in order; they are few."""
    found = spark.sparkContext._jvm.java.lang.System.getProperties()
    return spark.createDataFrame(sorted((str(k), str(v)) for k, v in dict(found).items()), "key string, value string").orderBy("key")
