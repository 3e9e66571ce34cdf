"""Hierarchies, dispatch, taint, patterns, formulas and stores over facts made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import absint, diagrams, hierarchy, patterns, program, subtrees, taint
from graphloom.plans.checkpoint import cut
from graphloom.plans.sizes import spread
from graphloom.queries.flows import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


R = "WITH RECURSIVE "
#: Parts as classes: part n's superclass is n div 2; it declares its brand as a method if its size is even.
CLASSES = """
above AS (SELECT p_partkey AS class, p_partkey // 2 AS super FROM part WHERE p_partkey > 0
), subtype AS (
  SELECT p_partkey AS class, p_partkey AS super FROM part UNION SELECT s.class, a.super FROM subtype s JOIN above a ON a.class = s.super
), declared AS (SELECT p_partkey AS class, p_brand AS subsig FROM part WHERE p_size % 2 = 0
), calls AS (
  SELECT l_orderkey AS method, l_linenumber AS stmt, l_partkey AS class, p_brand AS subsig, CASE WHEN l_returnflag = 'N' THEN 'static' ELSE 'virtual' END AS kind
  FROM lineitem JOIN part ON p_partkey = l_suppkey)"""


def _above(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("class"), F.floor(F.col("p_partkey") / 2).alias("super"))


def _declared(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("class"), F.col("p_brand").alias("subsig"))


def _calls(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "N", "static").otherwise("virtual")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_suppkey"), F.col("p_brand").alias("subsig"))
    return table(spark, sf_dir, "lineitem").join(part, "l_suppkey").select(F.col("l_orderkey").alias("method"), F.col("l_linenumber").alias("stmt"), F.col("l_partkey").alias("class"), "subsig", kind.alias("kind"))


@query(f"{R}{CLASSES} SELECT * FROM subtype")
def subtype_closure(spark, sf_dir):
    return program.subtypes(_above(spark, sf_dir))


@query(f"{R}{CLASSES} SELECT DISTINCT super AS node FROM subtype WHERE class IN (SELECT class FROM declared WHERE subsig = 'Brand#1')")
def class_closure(spark, sf_dir):
    """Classes at or above those that declare Brand#1."""
    return program.class_closure(_above(spark, sf_dir), _declared(spark, sf_dir).where("subsig = 'Brand#1'").select(F.col("class").alias("node")))


@query(f"{R}{CLASSES} SELECT c.*, d.class AS target FROM calls c JOIN subtype s ON s.super = c.class JOIN declared d ON d.class = s.class AND d.subsig = c.subsig WHERE c.kind = 'virtual' UNION ALL SELECT c.*, d.class FROM calls c JOIN declared d ON d.class = c.class AND d.subsig = c.subsig WHERE c.kind = 'static'")
def cha_dispatch(spark, sf_dir):
    """Targets of every item taken as a call: receiver its part, method its supplier's brand."""
    return program.cha_targets(_calls(spark, sf_dir), _declared(spark, sf_dir), cut(program.subtypes(_above(spark, sf_dir))))


@query(f"{R}{CLASSES}, climb AS (SELECT d.class, d.subsig, a.super AS target FROM declared d JOIN above a ON a.class = d.class UNION SELECT c.class, c.subsig, a.super FROM climb c JOIN above a ON a.class = c.target WHERE NOT EXISTS (SELECT 1 FROM declared x WHERE x.class = c.target AND x.subsig = c.subsig)) SELECT c.* FROM climb c JOIN declared x ON x.class = c.target AND x.subsig = c.subsig")
def nearest_override(spark, sf_dir):
    return program.nearest_override(_declared(spark, sf_dir), _above(spark, sf_dir))


@query(f"{R}{CLASSES}, line AS (SELECT DISTINCT class, class AS target, 0 AS depth FROM declared UNION SELECT l.class, a.super, l.depth + 1 FROM line l JOIN above a ON a.class = l.target) SELECT d.class, d.subsig, l.target, l.depth FROM declared d JOIN line l ON l.class = d.class JOIN declared x ON x.class = l.target AND x.subsig = d.subsig")
def override_chain(spark, sf_dir):
    return program.override_chain(_declared(spark, sf_dir), _above(spark, sf_dir))


#: Items as statements: numbered within the order, their kind by flag and discount.
STMTS = """
stmts AS (
  SELECT l_orderkey AS method, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INT AS idx,
    CASE WHEN l_discount >= 0.09 THEN 'return' WHEN l_returnflag = 'A' THEN 'assign' WHEN l_returnflag = 'R' THEN 'if' WHEN l_linestatus = 'F' THEN 'goto' ELSE 'switch' END AS kind,
    (l_partkey % 7)::INT AS target, l_partkey, l_suppkey FROM lineitem)"""


def _stmts(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kind = F.when(F.col("l_discount") >= 0.09, "return").when(F.col("l_returnflag") == "A", "assign").when(F.col("l_returnflag") == "R", "if").when(F.col("l_linestatus") == "F", "goto").otherwise("switch")
    items = table(spark, sf_dir, "lineitem")
    items = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    rows = spread(items, "l_orderkey", rows=items.count()).select(F.col("l_orderkey").alias("method"), (F.row_number().over(own) - 1).alias("idx"), kind.alias("kind"), (F.col("l_partkey") % 7).cast("int").alias("target"), "l_partkey", "l_suppkey")
    jumps = F.when(F.col("kind").isin("if", "goto", "switch"), F.array("target"))
    return rows.withColumns({"targets": jumps, "default_target": F.when(F.col("kind") == "switch", F.lit(0))})


@query(f"WITH {STMTS}, s AS (SELECT *, lead(idx) OVER (PARTITION BY method ORDER BY idx) AS after FROM stmts) SELECT method, idx AS src, target AS dst FROM s WHERE kind IN ('if', 'goto', 'switch') UNION SELECT method, idx, 0 FROM s WHERE kind = 'switch' UNION SELECT method, idx, after FROM s WHERE kind IN ('assign', 'if') AND after IS NOT NULL")
def cfg_edges(spark, sf_dir):
    """Flow edges of orders taken as methods."""
    return program.flow_edges(_stmts(spark, sf_dir))


#: One assignment x_p = y_s for each assign, an operand for each if and return.
EXPRS = """
exprs AS (
  SELECT method, idx, kind AS stmt_kind, 'p' || (l_partkey % 10) AS lhs, 'f' || (l_suppkey % 10) AS rhs FROM stmts)"""


def _exprs(spark, sf_dir):
    s = _stmts(spark, sf_dir)
    row = lambda i, side, kind, text, field: F.struct(F.lit(i).alias("expr_id"), F.lit(side).alias("side"), F.lit(kind).alias("kind"), text.alias("text"), field.cast("string").alias("field"))
    lhs, rhs = F.concat(F.lit("p"), F.col("l_partkey") % 10), F.concat(F.lit("f"), F.col("l_suppkey") % 10)
    rows = F.when(F.col("kind") == "assign", F.array(row(0, "lhs", "local", lhs, F.lit(None)), row(1, "rhs", "static_field", rhs, rhs))).when(F.col("kind").isin("if", "return"), F.array(row(0, "op", "local", lhs, F.lit(None))))
    each = s.select("method", "idx", F.explode(rows).alias("e")).select("method", "idx", "e.*")
    none = F.lit(None)
    return each.withColumns({"parent_id": none.cast("int"), "pos": none.cast("int"), "type": none.cast("string"), "callee": none.cast("string")})


@query(
    f"WITH {STMTS}, {EXPRS}, e AS ("
    "SELECT 'stmt:' || method || ':' || idx AS src, 'value:' || method || ':' || lhs AS dst, 'Lhs' AS rel FROM exprs WHERE stmt_kind = 'assign' UNION "
    "SELECT 'value:' || method || ':' || lhs, 'local:' || method || ':' || lhs, 'Ref' FROM exprs WHERE stmt_kind = 'assign' UNION "
    "SELECT 'value:' || method || ':' || rhs, 'stmt:' || method || ':' || idx, 'Definition' FROM exprs WHERE stmt_kind = 'assign' UNION "
    "SELECT 'static_field:' || rhs, 'value:' || method || ':' || rhs, 'Ref' FROM exprs WHERE stmt_kind = 'assign' UNION "
    "SELECT 'local:' || method || ':' || lhs, 'value:' || method || ':' || lhs, 'Ref' FROM exprs WHERE stmt_kind IN ('if', 'return') UNION "
    "SELECT 'value:' || method || ':' || lhs, 'stmt:' || method || ':' || idx, 'Stmt' FROM exprs WHERE stmt_kind IN ('if', 'return') UNION "
    "SELECT 'stmt:' || method || ':' || idx, 'return:' || method, 'Return' FROM exprs WHERE stmt_kind = 'return') SELECT src, dst, rel, NULL::INT AS rel_idx FROM e"
)
def taint_edges(spark, sf_dir):
    """Taint edges of items taken as assignments of fields to locals, tests and returns."""
    return taint.taint_edges(_stmts(spark, sf_dir), _exprs(spark, sf_dir))


@query("SELECT region AS node, count(*) AS n_leaves, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS least, max(c_acctbal) AS greatest FROM (SELECT 'r' || n_regionkey AS region, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'n' || c_nationkey, c_acctbal FROM customer UNION ALL SELECT 'c' || c_custkey, c_acctbal FROM customer) GROUP BY 1")
def tree_roll_up(spark, sf_dir):
    """Balances of customers, rolled up to nations and regions."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"))
    customers = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"), "c_acctbal")
    tree = regions.unionByName(nations).unionByName(customers.select("node", "parent"))
    return subtrees.roll_up(tree, customers, "c_acctbal").withColumn("total", F.round("total", 2))


@query("WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey AS top FROM part UNION ALL SELECT node, top // 2 FROM up WHERE top > 1) SELECT DISTINCT u.top AS node, p.p_brand AS name FROM up u JOIN part p ON p.p_partkey = u.node WHERE u.top IN (SELECT p_partkey FROM part)")
def name_unions(spark, sf_dir):
    """The brands of each part and of all parts below it, part n hanging below n div 2."""
    part = table(spark, sf_dir, "part")
    above = F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2))
    return subtrees.unions(part.select(F.col("p_partkey").alias("node"), above.alias("parent")), part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("name")), "name")


@query("WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier), kept AS (SELECT node, parent FROM tree WHERE contains(name, '7') UNION SELECT t.node, t.parent FROM kept k JOIN tree t ON t.node = k.parent) SELECT DISTINCT node FROM kept")
def tree_filter(spark, sf_dir):
    """Suppliers with a 7 in the name, and the nations and regions above them."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("region", "r", "r_regionkey", None, None, "r_name"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "s_name")]
    tree = None
    for name, p, c, q, d, label in parts:
        part = table(spark, sf_dir, name).select(key(p, c).alias("node"), (key(q, d) if q else F.lit(None).cast("string")).alias("parent"), F.col(label).alias("name"))
        tree = part if tree is None else tree.unionByName(part)
    return hierarchy.kept(tree, F.contains("name", F.lit("7")))


HOSTS = "hosts AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS name FROM pages), split AS (SELECT name, string_split(name, '.') AS p FROM hosts), paths AS (SELECT name, array_to_string(p[1:n], '.') AS node FROM (SELECT name, p, unnest(range(1, len(p) + 1)) AS n FROM split))"


def _hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("name")).distinct()


@query(f"WITH {HOSTS}, nodes AS (SELECT node, count(*) FILTER (name = node) AS n_names, nullif(regexp_replace(node, '(^|[.])[^.]*$', ''), '') AS parent FROM paths GROUP BY node) SELECT n.node, n.parent, (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children, n.n_names FROM nodes n")
def package_trie(spark, sf_dir):
    return hierarchy.trie(_hosts(spark, sf_dir))


@query(f"{R}{HOSTS}, nodes AS (SELECT node, count(*) FILTER (name = node) AS n_names, nullif(regexp_replace(node, '(^|[.])[^.]*$', ''), '') AS parent FROM paths GROUP BY node), stays AS (SELECT node FROM nodes n WHERE NOT (n_names = 0 AND (SELECT count(*) FROM nodes c WHERE c.parent = n.node) = 1)), up AS (SELECT node, parent AS a, 1 AS d FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT u.node, n.parent, u.d + 1 FROM up u JOIN nodes n ON n.node = u.a WHERE n.parent IS NOT NULL) SELECT s.node, (SELECT min_by(u.a, u.d) FROM up u WHERE u.node = s.node AND u.a IN (SELECT node FROM stays)) AS parent FROM stays s")
def trie_compressed(spark, sf_dir):
    return hierarchy.compressed(hierarchy.trie(_hosts(spark, sf_dir)))


@query(f"WITH {HOSTS}, known AS (SELECT DISTINCT node FROM paths WHERE length(node) % 2 = 0 AND node NOT IN (SELECT name FROM hosts)) SELECT h.name, (SELECT max_by(p.node, length(p.node)) FROM paths p JOIN known k ON k.node = p.node WHERE p.name = h.name) AS node FROM hosts h")
def prefix_attach(spark, sf_dir):
    """Hosts under the longest known prefix, those of even length that are no host."""
    hosts = _hosts(spark, sf_dir)
    known = hierarchy.trie(hosts).where("length(node) % 2 = 0 and n_names = 0")
    return hierarchy.attach(hosts, known)


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 10 AND NOT (p_name LIKE 'red%' OR p_name LIKE 'blue%') THEN 'LIB' WHEN p_size > 10 THEN 'APP' ELSE 'JVM' END AS origin FROM part")
def prefix_reclass(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, "APP").otherwise("JVM").alias("origin"))
    return hierarchy.reclassify(parts, ["red", "blue"], "p_name")


TEXTS = "texts AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS text FROM events GROUP BY 1)"


@query(f"WITH {TEXTS} SELECT user_id, regexp_matches(text, 's[ce]*p') AS direct, regexp_matches(text, '(vc){{2,}}e') AS pairs, len(regexp_extract_all(text, 'e+p')) AS n_late FROM texts")
def pattern_match(spark, sf_dir):
    """Patterns over a user's events, one letter an event."""
    texts = patterns.encoded(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.substring("event_type", 1, 1))
    t = F.col("text")
    return texts.select("user_id", t.rlike("s[ce]*p").alias("direct"), t.rlike("(vc){2,}e").alias("pairs"), F.regexp_count(t, F.lit("e+p")).cast("long").alias("n_late"))


@query("WITH b AS (SELECT b FROM range(16) t(b)), f AS (SELECT p_partkey AS formula, p_size % 2 AS s1, p_size // 2 % 2 AS s2, p_size // 4 % 2 AS s3, p_size // 8 % 2 AS s4 FROM part), v AS (SELECT formula, b, ((b & 1) = s1 AND (b >> 1 & 1) = s2) OR ((b & 1) = s3 AND (b >> 2 & 1) = s4) OR ((b >> 1 & 1) = s2 AND (b >> 3 & 1) = s4 AND (b & 1) = s1) AS y FROM f, b), d AS (SELECT DISTINCT x.formula, i FROM v x JOIN (SELECT unnest(range(4)) AS i) ON true JOIN v y ON y.formula = x.formula AND y.b = xor(x.b, 1 << i) WHERE x.y <> y.y) SELECT formula, substr('ABCD', i + 1, 1) AS var FROM d")
def vital_branches(spark, sf_dir):
    """Vital variables of (A∧B) ∨ (A∧C) ∨ (A∧B∧D), with signs from the parts' sizes; the last term is absorbed."""
    size = F.col("p_size")
    sign = lambda name, k: F.when(F.floor(size / (1 << k)) % 2 == 1, name).otherwise(f"!{name}")
    terms = F.array(F.array(sign("A", 0), sign("B", 1)), F.array(sign("A", 2), sign("C", 3)), F.array(sign("A", 0), sign("B", 1), sign("D", 3)))
    return diagrams.vital(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("formula"), F.explode(terms).alias("term")))


@query("WITH s AS (SELECT DISTINCT user_id AS addr, event_type AS value FROM events WHERE value < 5), d AS (SELECT DISTINCT user_id AS addr, event_type AS value FROM events WHERE value >= 5) SELECT * FROM s UNION SELECT * FROM d")
def store_join(spark, sf_dir):
    return _stores(spark, sf_dir)[0]


def _stores(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    side = lambda c: events.where(c).select(F.col("user_id").alias("addr"), F.col("event_type").alias("value")).distinct()
    return absint.joined(side("value < 5"), side("value >= 5"))


@query("WITH s AS (SELECT DISTINCT user_id AS addr, event_type AS value FROM events WHERE value < 5), d AS (SELECT DISTINCT user_id AS addr, event_type AS value FROM events WHERE value >= 5 EXCEPT SELECT * FROM s) SELECT DISTINCT o_orderkey AS state FROM orders WHERE o_custkey IN (SELECT addr FROM d)")
def delta_readers(spark, sf_dir):
    """Orders of customers whose number is a user's with news."""
    reads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("state"), F.col("o_custkey").alias("addr"))
    return absint.readers(_stores(spark, sf_dir)[1], reads)


@query("SELECT DISTINCT p_size AS flags, trim(CASE WHEN p_size & 2 <> 0 THEN 'private ' ELSE '' END || CASE WHEN p_size & 4 <> 0 THEN 'protected ' ELSE '' END || CASE WHEN p_size & 8 <> 0 THEN 'static ' ELSE '' END || CASE WHEN p_size & 16 <> 0 THEN 'final ' ELSE '' END || CASE WHEN p_size & 32 <> 0 THEN 'synchronized ' ELSE '' END || CASE WHEN p_size & 1 <> 0 THEN 'public ' ELSE '' END) AS words FROM part")
def access_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("flags")).distinct().select("flags", names.access_words(F.col("flags")).alias("words"))


@query("SELECT p_partkey, p_brand || ' ' || p_type || ' ' || p_name || '(' || array_to_string(string_split(p_name, ' '), ',') || ')' AS method_key FROM part")
def method_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.method_key(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.split("p_name", " ")).alias("method_key"))


@query("SELECT p_partkey, (h - CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END)::BIGINT AS hash FROM (SELECT p_partkey, list_reduce(list_prepend(98764321261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616::HUGEINT) AS h FROM part)")
def java_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.text_hash(F.col("p_name")).alias("hash"))


@query("SELECT p_partkey, repeat('[', (p_size % 4)::INT) || CASE WHEN p_size % 3 = 0 THEN 'I' ELSE 'Ljava/' || p_type || ';' END AS descriptor, CASE WHEN p_size % 3 = 0 THEN 'int' ELSE 'java.' || p_type END || repeat('[]', (p_size % 4)::INT) AS name, (p_size % 4)::INT AS depth FROM part")
def descriptor_parse(spark, sf_dir):
    size = F.col("p_size")
    text = F.concat(F.repeat(F.lit("["), size % 4), F.when(size % 3 == 0, "I").otherwise(F.concat(F.lit("Ljava/"), F.col("p_type"), F.lit(";"))))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("descriptor")).select("p_partkey", "descriptor", names.type_name(F.col("descriptor")).alias("name"), names.array_depth(F.col("descriptor")).alias("depth"))
