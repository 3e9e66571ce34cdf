"""Calls across origins, supergraphs, taint views, formulas and abstract stores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import absint, boolean, cycles, hierarchy, program, project, reach, records, taint
from graphloom.plans.checkpoint import cut
from graphloom.plans.sizes import spread
from graphloom.queries.flows import CLOSURE, FLOW, customer_flow, customer_roots, table
from graphloom.queries.graph import G, R
from graphloom.queries.program import STMTS, _stmts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Parts as classes, by size of origin APP or LIB; items as calls from a part to the supplier's number.
ORIGINS = "cls AS (SELECT p_partkey AS name, CASE WHEN p_size > 20 THEN 'APP' ELSE 'LIB' END AS origin FROM part WHERE p_size > 5), c AS (SELECT l_partkey AS src_class, l_suppkey AS dst_class FROM lineitem)"


def _origins(spark, sf_dir):
    classes = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") > 20, "APP").otherwise("LIB").alias("origin"))
    return classes, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src_class"), F.col("l_suppkey").alias("dst_class"))


@query(f"WITH {ORIGINS} SELECT c.* FROM c JOIN cls a ON a.name = src_class AND a.origin = 'APP' JOIN cls b ON b.name = dst_class AND b.origin = 'APP'")
def app_calls(spark, sf_dir):
    classes, calls = _origins(spark, sf_dir)
    return program.app_calls(calls, classes)


@query(f"WITH {ORIGINS} SELECT a.origin AS src_origin, b.origin AS dst_origin, count(*) AS n FROM c LEFT JOIN cls a ON a.name = src_class LEFT JOIN cls b ON b.name = dst_class GROUP BY 1, 2")
def call_origins(spark, sf_dir):
    classes, calls = _origins(spark, sf_dir)
    return program.call_origins(calls, classes)


@query(f"WITH {ORIGINS}, e AS (SELECT DISTINCT src_class AS src, dst_class AS dst FROM c), lib AS (SELECT name FROM cls WHERE origin = 'LIB'), one AS (SELECT * FROM e WHERE src IN (SELECT name FROM lib)), two AS (SELECT one.src, e.dst FROM one JOIN e ON e.src = one.dst WHERE one.dst IN (SELECT name FROM lib)) SELECT * FROM one WHERE dst NOT IN (SELECT name FROM lib) UNION SELECT * FROM two WHERE dst NOT IN (SELECT name FROM lib)")
def app_through_library(spark, sf_dir):
    """What library classes reach outside the library in at most two calls."""
    classes, calls = _origins(spark, sf_dir)
    edges = calls.select(F.col("src_class").alias("caller"), F.col("dst_class").alias("callee"))
    return program.app_through_library(edges, classes.where("origin = 'LIB'").select(F.col("name").alias("node")))


#: Orders as methods that call the order of the number of each assigned part.
CALLS = "targets AS (SELECT method, idx, l_partkey AS callee FROM stmts WHERE kind = 'assign')"
CFG = "s AS (SELECT *, lead(idx) OVER (PARTITION BY method ORDER BY idx) AS after FROM stmts), cfg AS (SELECT method, idx AS src, target AS dst FROM s WHERE kind IN ('if', 'goto', 'switch') UNION SELECT method, idx, 0 FROM s WHERE kind = 'switch' UNION SELECT method, idx, after FROM s WHERE kind IN ('assign', 'if') AND after IS NOT NULL)"


@query(f"WITH {STMTS}, {CFG}, {CALLS}, e AS (SELECT method AS sm, src AS si, method AS dm, dst AS di, 'flow' AS kind FROM cfg UNION SELECT t.method, t.idx, t.callee, f.i, 'call' FROM targets t JOIN (SELECT method, min(idx) AS i FROM stmts GROUP BY 1) f ON f.method = t.callee UNION SELECT t.callee, r.idx, t.method, c.dst, 'return' FROM targets t JOIN stmts r ON r.method = t.callee AND r.kind = 'return' JOIN cfg c ON c.method = t.method AND c.src = t.idx) SELECT * FROM e")
def supergraph(spark, sf_dir):
    stmts = cut(_stmts(spark, sf_dir))
    stmts = spread(stmts, "method", rows=stmts.count())
    targets = stmts.where("kind = 'assign'").select("method", "idx", F.col("l_partkey").alias("callee"))
    found = program.supergraph(program.flow_edges(stmts), targets, stmts)
    return found.select(F.col("src.method").alias("sm"), F.col("src.idx").alias("si"), F.col("dst.method").alias("dm"), F.col("dst.idx").alias("di"), "kind")


@query("SELECT o_custkey AS operand, min(o_orderkey) FILTER (o_orderstatus = 'O') AS o, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'O'), min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS addr FROM orders GROUP BY 1")
def operand_values(spark, sf_dir):
    """Each customer's order by preference: the first open, else the first done, else the first, as operands by rank of match."""
    orders = table(spark, sf_dir, "orders")
    key = lambda s: F.concat_ws("|", F.col("o_custkey").cast("string"), F.lit(s))
    own = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus")
    values = orders.select(F.col("o_orderkey").alias("addr"), F.when(F.col("o_orderstatus") == "O", own).alias("text"), F.when(F.col("o_orderstatus") == "F", F.concat_ws("|", F.col("o_custkey").cast("string"), F.lit("O"))).alias("canonical"), F.col("o_custkey").alias("method"), F.lit("n").alias("name"))
    wanted = orders.select(F.col("o_custkey").alias("operand"), key("O").alias("text"), F.col("o_custkey").alias("method"), F.lit("n").alias("name")).distinct()
    open_ = orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("operand")).agg(F.min("o_orderkey").alias("o"))
    return taint.match_operands(wanted, values).join(open_, "operand", "left").select("operand", "o", "addr")


@query("SELECT node, component, role FROM (SELECT 'n' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS node, CASE WHEN l_suppkey > 5 THEN 's' || l_suppkey ELSE 'n' || l_orderkey || '-' || l_linenumber || '-' || l_partkey END AS component, CASE l_returnflag WHEN 'A' THEN 'input' WHEN 'R' THEN 'output' ELSE 'inner' END AS role FROM lineitem)")
def method_roles(spark, sf_dir):
    """Items as addresses, grouped by supplier as method; the first suppliers' have none."""
    text = lambda *c: F.concat(F.lit("n"), F.concat_ws("-", *[F.col(x).cast("string") for x in c]))
    kind = F.when(F.col("l_returnflag") == "A", "parameter").when(F.col("l_returnflag") == "R", "return").otherwise("value")
    method = F.when(F.col("l_suppkey") > 5, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    return taint.method_groups(table(spark, sf_dir, "lineitem").select(text("l_orderkey", "l_linenumber", "l_partkey").alias("node"), method.alias("method"), kind.alias("kind")))


@query(
    f"{R}{FLOW}, {CLOSURE}, keep AS (SELECT o_custkey, node FROM cyclic UNION SELECT o_custkey, node FROM verts WHERE node NOT LIKE 'F%' UNION SELECT k.o_custkey, f.dst FROM keep k JOIN flow f ON f.o_custkey = k.o_custkey AND f.src = k.node), "
    "rest AS (SELECT f.* FROM flow f JOIN keep a ON a.o_custkey = f.o_custkey AND a.node = f.src JOIN keep b ON b.o_custkey = f.o_custkey AND b.node = f.dst) SELECT * FROM rest"
)
def without_library_roots(spark, sf_dir):
    """The flow without roots F, as the first step of cleaning a taint graph."""
    flow = cut(customer_flow(spark, sf_dir))
    kept = cycles.peel(flow, reach.nodes(flow, G).where("node like 'F%'"), cycles.scc_small(flow, G), "root", G)
    return reach.induced(flow, kept, G)


@query(f"WITH {FLOW}, m AS (SELECT 'F1' AS node, 'P1' AS onto), u AS (SELECT DISTINCT src, dst FROM flow WHERE src < dst), d AS (SELECT DISTINCT src, dst FROM flow WHERE src > dst) SELECT src, dst FROM u UNION SELECT coalesce(a.onto, d.src), coalesce(b.onto, d.dst) FROM d LEFT JOIN m a ON a.node = d.src LEFT JOIN m b ON b.node = d.dst")
def split_merge(spark, sf_dir):
    flow = cut(customer_flow(spark, sf_dir).select("src", "dst").distinct())
    return taint.split_merge(flow.where("src < dst"), flow.where("src > dst"), spark.createDataFrame([("F1", "P1")], "node string, onto string"))


@query("SELECT n_nationkey AS node, coalesce('zone ' || (r_regionkey % 2), r_name) AS onto FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 3 UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey >= 3")
def composed_mapping(spark, sf_dir):
    """Nations to regions to zones; regions without a zone stay."""
    regions = table(spark, sf_dir, "region")
    first = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("onto"))
    zones = regions.where("r_regionkey < 3").select(F.col("r_name").alias("node"), F.concat(F.lit("zone "), (F.col("r_regionkey") % 2).cast("string")).alias("onto"))
    return project.composed(first, zones)


@query(f"{R}{FLOW}, walk AS (SELECT o_custkey, node, []::VARCHAR[] AS term FROM roots UNION SELECT w.o_custkey, f.dst, list_sort(list_distinct(list_append(w.term, CASE WHEN f.dst < 'O' THEN substr(f.dst, 2, 1) ELSE '!' || substr(f.dst, 2, 1) END))) FROM walk w JOIN flow f ON f.o_custkey = w.o_custkey AND f.src = w.node AND f.src < f.dst WHERE NOT list_contains(w.term, CASE WHEN f.dst < 'O' THEN '!' || substr(f.dst, 2, 1) ELSE substr(f.dst, 2, 1) END)) SELECT o_custkey AS method, node, array_to_string(term, '&') AS term FROM walk")
def path_conditions(spark, sf_dir):
    """Conditions along a customer's steps to later letters; the priority is the variable, its sign by status."""
    flow = customer_flow(spark, sf_dir).where("src < dst")
    letter = F.substring("dst", 2, 1)
    edges = flow.select(F.col("o_custkey").alias("method"), "src", "dst", F.when(F.col("dst") < "O", letter).otherwise(F.concat(F.lit("!"), letter)).alias("literal"))
    found = boolean.path_conditions(edges, customer_roots(spark, sf_dir).withColumnRenamed("o_custkey", "method"))
    return found.withColumn("term", F.array_join("term", "&"))


@query("SELECT n AS number, CASE WHEN n < 26 THEN chr((65 + n)::INT) ELSE chr((64 + n // 26)::INT) || chr((65 + n % 26)::INT) END AS label FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part)")
def branch_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("number")).distinct().select("number", boolean.label(F.col("number")).alias("label"))


#: Customers' balances as a store: nations hold their customers' segments.
STORE = "s AS (SELECT DISTINCT c_nationkey AS addr, c_mktsegment AS value FROM customer WHERE c_acctbal > 9000)"


@query(f"WITH {STORE}, u AS (SELECT DISTINCT s_nationkey AS addr, 'supplier' AS value FROM supplier WHERE s_acctbal > 8000) SELECT * FROM s WHERE addr NOT IN (SELECT addr FROM u) UNION ALL SELECT * FROM u")
def strong_update(spark, sf_dir):
    store = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("addr"), F.col("c_mktsegment").alias("value")).distinct()
    return absint.overwritten(store, table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("addr"), F.lit("supplier").alias("value")))


@query(f"WITH {STORE.replace('9000', '9900')} SELECT n_name AS state, n_nationkey AS addr FROM nation WHERE n_nationkey NOT IN (SELECT addr FROM s)")
def undefined_addresses(spark, sf_dir):
    store = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("addr"), F.col("c_mktsegment").alias("value")).distinct()
    return absint.undefined(table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"), F.col("n_nationkey").alias("addr")), store)


#: Points-to: an order's customer is a variable with an object of its segment; items copy from the order to the part and supplier.
@query(
    "WITH RECURSIVE copies AS (SELECT DISTINCT 'o/' || l_orderkey AS src, 'p/' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT 'p/' || l_partkey, 's/' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'), "
    "pts AS (SELECT 'o/' || o_orderkey AS addr, c_mktsegment AS value FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT c.dst, p.value FROM pts p JOIN copies c ON c.src = p.addr) SELECT * FROM pts"
)
def points_to(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    copies = items.where("l_returnflag = 'A'").select(key("o/", "l_orderkey").alias("src"), key("p/", "l_partkey").alias("dst")).unionByName(items.where("l_returnflag = 'R'").select(key("p/", "l_partkey").alias("src"), key("s/", "l_suppkey").alias("dst"))).distinct()
    alloc = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(key("o/", "o_orderkey").alias("var"), F.col("c_mktsegment").alias("object"), F.lit("C").alias("class"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    facts = absint.Facts(
        alloc, copies, none("var string, base string, field string"), none("base string, field string, var string"),
        none("site string, method string, base string, subsig string, args array<string>, result string, kind string, callee string"),
        none("method string, class string, subsig string, params array<string>, this string, returns array<string>"), none("class string, subsig string, method string"),
    )
    return absint.run(facts, spark.createDataFrame([("o",), ("p",), ("s",)], "method string"))[0]


@query("WITH t AS (SELECT node, parent FROM (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)) SELECT s.node FROM t s JOIN t n ON n.node = s.parent WHERE s.node LIKE 's%' AND n.parent = 'r1' UNION SELECT n.node FROM t n WHERE n.parent = 'r1' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.parent = n.node)")
def expand_group(spark, sf_dir):
    """The leaves below region 1."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    tree = tree.unionByName(table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent")))
    tree = tree.unionByName(table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent")))
    return hierarchy.expand(tree, spark.createDataFrame([("r1",)], "node string"))


@query("WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem), n AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F') SELECT * FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)")
def rejected_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return records.resolve_ends(edges, table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")))[1]


@query(r"""SELECT p_partkey, '  "' || p_brand || '" -> "' || p_name || '" [label="' || p_type || '"];' AS line FROM part""")
def dot_lines(spark, sf_dir):
    from graphloom.sources.packets import dot

    parts = table(spark, sf_dir, "part")
    lines = dot(parts.withColumn("src", F.col("p_brand")).withColumn("dst", F.col("p_name")), label="p_type")
    keyed = parts.select("p_partkey", F.concat(F.lit('  "'), names.dot_text(F.col("p_brand")), F.lit('" -> "'), names.dot_text(F.col("p_name")), F.lit('" [label="'), names.dot_text(F.col("p_type")), F.lit('"];')).alias("line"))
    return keyed.join(lines.distinct(), "line", "left_semi").select("p_partkey", "line")
