"""Taint edges from statement and expression facts, and the views of the taint graph.

Facts: stmts (method, idx, kind); exprs (method, idx, expr_id, parent_id, pos, side, kind, text, type, callee,
field), side lhs, rhs or op, children of an expression numbered by pos with a receiver at -1; overrides
(method, super_method, n_params). Addresses are strings of kind and payload. Every pass reads the facts once
and gives each row the edges of all rules that apply to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import cycles, project, reach
from graphloom.plans.checkpoint import cut
from graphloom.plans.sizes import kept

NEW = {"new": "New", "new_array": "NewArray", "new_multi_array": "NewMultiArray"}
#: (parent's kind, child's position) and the relationship of the child's value to the parent's.
OPERANDS = {("instance_field", 0): "InstanceFieldBase", ("array_ref", 0): "ArrayBase", ("array_ref", 1): "ArrayIndex", ("unop", 0): "UnOp", ("binop", 0): "BinOp1", ("binop", 1): "BinOp2", ("instanceof", 0): "InstanceOf", ("cast", 0): "Cast"}
STORES = {"local": "Ref", "parameter": "ParameterRef", "static_field": "StaticFieldRef", "this": "ThisRef", "instance_field": "InstanceFieldRef", "array_ref": "ArrayRef"}
LOADS = {"local": "Ref", "parameter": "Ref", "static_field": "Ref", "this": "Ref", "instance_field": "InstanceFieldValue", "array_ref": "ArrayValue"}
STATEMENT = ("idx", "method")
OPERAND_STMTS = ("if", "switch", "return", "enter_monitor", "exit_monitor", "throw")


def _address(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def _edge(when: Column, src: Column, dst: Column, rel: Column | str, idx: Column | None = None) -> Column:
    rel = F.lit(rel) if isinstance(rel, str) else rel
    return F.when(when, F.struct(src.alias("src"), dst.alias("dst"), rel.alias("rel"), (F.lit(None) if idx is None else idx).cast("int").alias("rel_idx")))


def _emit(df: DataFrame, *edges: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The edges that are there of each row, with its columns ``keep``. A function over arrays (``array_compact``) would have all of them interpreted."""
    return df.select(*keep, F.explode(F.array(*edges)).alias("e")).where("e IS NOT NULL").select(*keep, "e.*")


def _named(kind: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[kind]


def _of(prefix: str = "") -> tuple[Column, Column, Column]:
    """The addresses of an expression's value, its statement, and the place it names."""
    c = lambda n: F.col(prefix + n)
    place = (
        F.when(c("kind") == "local", _address("local", c("method"), c("text"))).when(c("kind") == "parameter", _address("parameter", c("method"), c("pos")))
        .when(c("kind") == "this", _address("this", c("method"))).when(c("kind") == "static_field", _address("static_field", c("field")))
        .when(c("kind") == "instance_field", _address("instance_field", c("field"))).when(c("kind") == "array_ref", _address("array_ref", c("type")))
    )
    return _address("value", c("method"), c("text")), _address("stmt", c("method"), c("idx")), place


def taint_edges(stmts: DataFrame, exprs: DataFrame, overrides: DataFrame | None = None, strict: bool = False, distinct: bool = True) -> DataFrame:
    """(src, dst, rel, rel_idx): all edges; with ``strict`` a returned value doesn't flow to the method's return.

    A parameter expression's ``pos`` is its number where it stands alone. Parallel edges stay without ``distinct``.

    All joins are by (idx, method): facts that come dealt by these are not moved. Edges at a statement's own address are equal
    only to edges of the same idx and method, so only the others are moved to tell equal ones apart.
    """
    top, kind, side = F.col("parent_id").isNull(), F.col("kind"), F.col("side")
    lhs, rhs = top & (side == "lhs"), top & (side == "rhs")
    call, closure = kind.isin("invoke", "static_invoke"), kind == "lambda"
    # Addresses are columns of their own, each built once a row; joins sort by idx first, as methods repeat more.
    named = lambda df, **of: df.select("*", *[a.alias(n) for n, a in zip(("_value", "_stmt", "_place"), _of())], *[a.alias(n) for n, a in of.items()])
    value, stmt, place = (F.col(n) for n in ("_value", "_stmt", "_place"))
    made = F.when(kind == "new", _address("new", F.col("method"), F.col("idx"))).when(kind.isin(*NEW), _address("new_array", F.col("method"), F.col("idx")))
    back_of = lambda to, when: F.when(when, _address("return", F.col(to)))
    own = named(
        exprs.join(stmts.select("method", "idx", F.col("kind").alias("stmt_kind")), [*STATEMENT]),
        _made=F.when(rhs, made), _called=back_of("callee", call | closure), _lambda=F.when(closure, _address("lambda", F.col("method"), F.col("idx"))), _onto=back_of("field", closure & F.col("field").isNotNull()),
        _stores=_named(kind, STORES), _loads=_named(kind, LOADS), _new=_named(kind, NEW),
    )
    at_stmt = [
        _edge(lhs, stmt, value, "Lhs"),
        _edge(F.col("_made").isNotNull(), F.col("_made"), stmt, F.col("_new")),
        _edge(rhs & ~kind.isin(*NEW) & ~call & ~closure, value, stmt, "Definition"),
        _edge(call, F.col("_called"), stmt, "Result"),
        _edge(closure, F.col("_lambda"), stmt, "LambdaClosure"),
        _edge(top & (side == "op") & F.col("stmt_kind").isin(*OPERAND_STMTS), value, stmt, "Stmt"),
    ]
    single, single_far = _emit(own, *at_stmt, keep=STATEMENT), _emit(
        own,
        _edge(lhs & place.isNotNull(), value, place, F.col("_stores")),
        _edge(F.col("_onto").isNotNull(), F.col("_called"), F.col("_onto"), "LambdaReturn"),
        _edge(~lhs & place.isNotNull(), place, value, F.col("_loads")),
    )
    p = exprs.select("method", "idx", F.col("expr_id").cast("long").alias("_id"), *[F.col(c).alias(f"p_{c}") for c in ("kind", "text", "callee", "type")])
    pk, pos = F.col("p_kind"), F.col("pos")
    called = pk.isin("invoke", "static_invoke")
    number = F.when(pos >= 0, pos).when(pk == "lambda", F.lit(0))
    operand = F.create_map(*[F.lit(x) for (k, i), rel in OPERANDS.items() for x in (f"{k}:{i}", rel)])[F.concat_ws(":", pk, pos.cast("string"))]
    # The difference keeps the parent from being a key of the join, by which all would be dealt again.
    pair = named(
        exprs.where(~top).join(p, [*STATEMENT]).where(F.col("parent_id").cast("long") - F.col("_id") == 0), _operand=operand, _above=_address("value", F.col("method"), F.col("p_text")),
        _array=F.when(pk.isin("new_array", "new_multi_array"), _address("new_array", F.col("method"), F.col("idx"))), _param=F.when((called | (pk == "lambda")) & number.isNotNull(), _address("parameter", F.col("p_callee"), number)),
    )
    above, array, param = F.col("_above"), F.col("_array"), F.col("_param")
    nested_at_stmt = [
        _edge(pk == "new_array", value, array, "NewArraySize"),
        _edge(pk == "new_multi_array", value, array, "NewMultiArraySize", pos),
        _edge(called & (pos == -1), value, stmt, "InvokeBase"),
        _edge(called & (pos >= 0), value, stmt, "ParametersDependency"),
        _edge(pk == "lambda", value, stmt, "LambdaCaptureDependency"),
    ]
    nested, nested_far = _emit(pair, *nested_at_stmt, keep=STATEMENT), _emit(
        pair,
        _edge(F.col("_operand").isNotNull(), value, above, F.col("_operand")),
        _edge(called & (pos >= 0), value, param, "Argument", pos),
        _edge((pk == "lambda") & (pos == -1), value, param, "LambdaCaptureThis"),
        _edge((pk == "lambda") & (pos >= 0), value, param, "LambdaCapture", pos),
    )
    at, back = _address("stmt", F.col("method"), F.col("idx")), _address("return", F.col("method"))
    ends = _emit(stmts, _edge(kind == "return_void" if strict else kind.isin("return", "return_void"), at, back, "Return"), _edge(kind == "throw", at, _address("throws", F.col("method")), "Throws"), keep=STATEMENT)
    out = single_far.unionByName(nested_far)
    if overrides is not None:
        out = out.unionByName(_emit(overrides, _edge(F.lit(True), back, _address("return", F.col("super_method")), "MethodOverridden")))
        each = overrides.where("n_params > 0").select("method", "super_method", F.explode(F.sequence(F.lit(0), F.col("n_params") - 1)).alias("i"))
        out = out.unionByName(_emit(each, _edge(F.lit(True), _address("parameter", F.col("super_method"), F.col("i")), _address("parameter", F.col("method"), F.col("i")), "ParameterSubtypePolymorphism")))
    told = lambda df: (df.distinct() if distinct else df).select(*out.columns)
    return told(out).unionByName(told(single)).unionByName(told(nested)).unionByName(told(ends))


def kind_of(address: Column) -> Column:
    return F.substring_index(address, ":", 1)


def display_kind(address: Column) -> Column:
    """The kind by which an address is shown."""
    k = kind_of(address)
    return F.when(k.isin("static_field", "instance_field"), "field").when(k.isin("new", "new_array"), "allocation").when(k.isin("return", "throws"), "output").when(k == "parameter", "input").otherwise(k)


def find_named(nodes: DataFrame, names: DataFrame, of: Column) -> DataFrame:
    """Nodes whose name (an expression) is one of (name)."""
    return nodes.withColumn("name", of).join(names.select("name").distinct(), "name", "left_semi").drop("name")


def method_groups(nodes: DataFrame) -> DataFrame:
    """(node, component, role) from (node, method, kind): groups are methods, addresses without one their own; parameters
    are inputs, returns outputs, all else inner."""
    role = F.when(F.col("kind") == "parameter", "input").when(F.col("kind") == "return", "output").otherwise("inner")
    return nodes.select("node", F.coalesce("method", "node").alias("component"), role.alias("role"))


def cleaned(edges: DataFrame, library: DataFrame) -> DataFrame:
    """The graph without library roots, then library leaves, again and again, then without nodes in simple chains.

    The edges are dealt once, by their src, and stay so: what goes or is contracted comes to them.
    """
    library = cut(library.select("node").distinct())
    own = kept(edges.select("src", "dst").dropna(), "src", rows=edges.count())
    rooted = cycles.peeled(own, library, "root").persist()
    rooted.count(), own.unpersist()
    out = cut(project.contract_chains(cycles.peeled(rooted, library, "leaf")))
    rooted.unpersist()
    return out


def view(edges: DataFrame, selected: DataFrame, kinds: DataFrame, groups: DataFrame, inner: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The graph around a selection: ancestors and descendants, inner addresses hidden, grouped: (outer, inner).

    The outer graph is found without the projection, whose pairs only the ``inner`` one needs.
    """
    around = reach.connected_set(edges, selected).select("node").distinct()
    own = cut(reach.induced(reach.simple(edges), around))
    outer = project.project_grouped(own, kinds.where(F.col("kind") != "inner"), groups)
    return outer, cycles.quotient(project.hide_kind(own, kinds, "inner"), groups)[1] if inner else None


def split_merge(up: DataFrame, down: DataFrame, mapping: DataFrame) -> DataFrame:
    """(src, dst): the ancestors' graph with the descendants' grafted on, their nodes renamed by (node, onto)."""
    out = down.select("src", "dst")
    for end in ("src", "dst"):
        out = out.join(mapping.select(F.col("node").alias(end), F.col("onto").alias("_onto")), end, "left").withColumn(end, F.coalesce("_onto", end)).drop("_onto")
    return up.select("src", "dst").unionByName(out.select("src", "dst")).distinct()


def match_operands(operands: DataFrame, values: DataFrame) -> DataFrame:
    """(operand, addr): an operand's first value: equal, else equivalent, else a local of the same name in the same method.

    Three equi-joins in place of one join over alternatives; operands (operand, text, method, name) and values
    (addr, text, canonical, method, name); the best rank and least address win.
    """
    o = operands.select("operand", F.col("text").alias("o_text"), F.col("method").alias("o_method"), F.col("name").alias("o_name"))
    one = o.join(values, F.col("o_text") == F.col("text")).select("operand", "addr", F.lit(0).alias("rank"))
    two = o.join(values, F.col("o_text") == F.col("canonical")).select("operand", "addr", F.lit(1).alias("rank"))
    three = o.join(values, (F.col("o_method") == F.col("method")) & (F.col("o_name") == F.col("name"))).select("operand", "addr", F.lit(2).alias("rank"))
    return one.unionByName(two).unionByName(three).groupBy("operand").agg(F.min_by("addr", F.struct("rank", "addr")).alias("addr"))


def member_nodes(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(node, kind): an address for each field (field, static), and for each method (method, n_params) its throws and parameters."""
    kind = F.when(F.col("static"), "static_field").otherwise("instance_field")
    own = fields.select(F.concat_ws(":", kind, "field").alias("node"), kind.alias("kind"))
    thrown = methods.select(_address("throws", F.col("method")).alias("node"), F.lit("throws").alias("kind"))
    each = methods.where("n_params > 0").select("method", F.explode(F.sequence(F.lit(0), F.col("n_params") - 1)).alias("i"))
    return own.unionByName(thrown).unionByName(each.select(_address("parameter", F.col("method"), F.col("i")).alias("node"), F.lit("parameter").alias("kind")))


def library_nodes(nodes: DataFrame, with_code: DataFrame) -> DataFrame:
    """``nodes`` (node, class, …) with ``library``: of a class that is none of those with code (class); array elements never are."""
    known = with_code.select("class").distinct().withColumn("_code", F.lit(True))
    outside = F.col("class").isNotNull() & F.col("_code").isNull() & (kind_of(F.col("node")) != "array_ref")
    return nodes.join(known, "class", "left").select(*nodes.columns, F.coalesce(outside, F.lit(False)).alias("library"))
