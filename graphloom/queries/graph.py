"""Graph operators over customers' order states and over parts that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cycles, layers, loops, project, reach
from graphloom.plans.checkpoint import cut
from graphloom.queries.flows import CLOSURE, DOMINATE, FLOW, PARTS, customer_flow, customer_roots, part_flow, table, user_flow, user_roots

G = ["o_custkey"]
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(customer_flow(spark, sf_dir))


def _dominated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    flow = _flow(spark, sf_dir)
    roots_ = customer_roots(spark, sf_dir)
    return flow, loops.immediate_dominators(flow, roots_, G), loops.dominators(flow, roots_, G)


def _bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    flow = _flow(spark, sf_dir)
    back = cut(loops.loop_edges(flow, customer_roots(spark, sf_dir), G))
    return flow, back, loops.natural_loops(flow, back, G)


def _first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_flow(spark, sf_dir).agg(F.min("src").alias("node"))


R = "WITH RECURSIVE "


@query(f"{R}{PARTS}, r AS (SELECT dst AS node FROM part_edges WHERE src = (SELECT min(src) FROM part_edges) UNION SELECT e.dst FROM r JOIN part_edges e ON e.src = r.node) SELECT node FROM r")
def reachable(spark, sf_dir):
    """Parts reached from the least part."""
    return reach.reachable(part_flow(spark, sf_dir), _first_part(spark, sf_dir))


@query(f"{R}{PARTS}, r AS (SELECT min(src) AS node FROM part_edges UNION SELECT e.src FROM r JOIN part_edges e ON e.dst = r.node) SELECT node FROM r")
def ancestors(spark, sf_dir):
    """Parts from which the least part is reached, itself included."""
    return reach.reachable(part_flow(spark, sf_dir), _first_part(spark, sf_dir), include_seed=True, reverse=True)


@query(f"{R}{FLOW}, up AS (SELECT * FROM roots UNION SELECT u.o_custkey, f.src FROM up u JOIN flow f ON f.o_custkey = u.o_custkey AND f.dst = u.node), down AS (SELECT * FROM roots UNION SELECT u.o_custkey, f.dst FROM down u JOIN flow f ON f.o_custkey = u.o_custkey AND f.src = u.node) SELECT o_custkey, node, 'ancestor' AS side FROM up UNION ALL SELECT o_custkey, node, 'descendant' FROM down")
def connected_set(spark, sf_dir):
    """Ancestors and descendants of each customer's first state."""
    return reach.connected_set(_flow(spark, sf_dir), customer_roots(spark, sf_dir), G)


@query(f"{R}{FLOW}, {CLOSURE} SELECT o_custkey, src, dst FROM closure")
def closure_pairs(spark, sf_dir):
    """All pairs of states joined by a path."""
    return reach.reachable_pairs(_flow(spark, sf_dir), G)


@query(f"WITH {PARTS} SELECT n.node, count(DISTINCT i.src) AS n_in, count(DISTINCT o.dst) AS n_out FROM part_nodes n LEFT JOIN part_edges i ON i.dst = n.node LEFT JOIN part_edges o ON o.src = n.node GROUP BY n.node")
def degree(spark, sf_dir):
    """Edges in and out of each part."""
    return reach.degrees(part_flow(spark, sf_dir))


@query(f"WITH {FLOW}, strict AS (SELECT o_custkey, node FROM verts EXCEPT SELECT o_custkey, dst FROM flow WHERE src <> dst) SELECT * FROM strict UNION ALL SELECT o_custkey, min(node) FROM verts WHERE o_custkey NOT IN (SELECT o_custkey FROM strict) GROUP BY 1")
def graph_sources(spark, sf_dir):
    """States entered by no other, or the least state."""
    return reach.sources(_flow(spark, sf_dir), G)


@query(f"WITH {PARTS} SELECT DISTINCT src AS node FROM part_edges WHERE src = dst")
def self_recursion(spark, sf_dir):
    """Parts that follow themselves."""
    return reach.self_recursive(part_flow(spark, sf_dir))


@query(f"WITH {FLOW} SELECT f.* FROM flow f WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE r.o_custkey = f.o_custkey AND r.node IN (f.src, f.dst))")
def vertex_cut(spark, sf_dir):
    """The flow without each customer's first state."""
    return reach.without(_flow(spark, sf_dir), customer_roots(spark, sf_dir), G)


@query(f"{R}{FLOW}, {DOMINATE} SELECT * FROM dom")
def dominators(spark, sf_dir):
    return _dominated(spark, sf_dir)[2]


@query(f"{R}{FLOW}, {DOMINATE}, size AS (SELECT o_custkey, node, count(*) AS n FROM dom GROUP BY ALL) SELECT r.o_custkey, r.node, max(CASE WHEN s.n = t.n - 1 THEN d.dom END) AS idom FROM reach r JOIN dom d USING (o_custkey, node) JOIN size t USING (o_custkey, node) JOIN size s ON s.o_custkey = r.o_custkey AND s.node = d.dom GROUP BY r.o_custkey, r.node")
def idom(spark, sf_dir):
    return _dominated(spark, sf_dir)[1]


@query(f"{R}{FLOW}, {DOMINATE} SELECT * FROM back")
def back_edges(spark, sf_dir):
    return _bodies(spark, sf_dir)[1]


@query(f"{R}{FLOW}, {DOMINATE} SELECT o_custkey, head, count(*) AS n_latches FROM back GROUP BY ALL")
def loop_heads(spark, sf_dir):
    return _bodies(spark, sf_dir)[1].groupBy("o_custkey", "head").agg(F.count(F.lit(1)).alias("n_latches"))


@query(f"{R}{FLOW}, {DOMINATE} SELECT * FROM bodies")
def loop_bodies(spark, sf_dir):
    return _bodies(spark, sf_dir)[2]


FOREST = """
size AS (SELECT o_custkey, head, count(*) AS n_members FROM bodies GROUP BY ALL
), nested AS (
  SELECT i.o_custkey, i.head, o.head AS outer_head, o.n_members AS n FROM size i JOIN bodies b ON b.o_custkey = i.o_custkey AND b.member = i.head AND b.head <> i.head
  JOIN size o ON o.o_custkey = b.o_custkey AND o.head = b.head WHERE o.n_members > i.n_members
)"""


@query(f"{R}{FLOW}, {DOMINATE}, {FOREST} SELECT s.o_custkey, s.head, min_by(outer_head, (n, outer_head)) AS parent, count(n)::INT AS depth, s.n_members FROM size s LEFT JOIN nested n ON n.o_custkey = s.o_custkey AND n.head = s.head GROUP BY s.o_custkey, s.head, s.n_members")
def loop_forest(spark, sf_dir):
    found = loops.loop_forest(_bodies(spark, sf_dir)[2], G)
    return found.withColumn("depth", F.col("depth").cast("int"))


@query(f"{R}{FLOW}, {DOMINATE}, {FOREST} SELECT b.o_custkey, b.member, min_by(b.head, (s.n_members, b.head)) AS head FROM bodies b JOIN size s ON s.o_custkey = b.o_custkey AND s.head = b.head GROUP BY ALL")
def innermost_loop(spark, sf_dir):
    return loops.innermost_loop(_bodies(spark, sf_dir)[2], G)


EXITS = "exits AS (SELECT b.o_custkey, b.head, f.src, f.dst FROM bodies b JOIN flow f ON f.o_custkey = b.o_custkey AND f.src = b.member WHERE NOT EXISTS (SELECT 1 FROM bodies x WHERE x.o_custkey = b.o_custkey AND x.head = b.head AND x.member = f.dst))"


@query(f"{R}{FLOW}, {DOMINATE}, {EXITS} SELECT * FROM exits")
def loop_exits(spark, sf_dir):
    flow, _, bodies = _bodies(spark, sf_dir)
    return loops.loop_exits(flow, bodies, G)


@query(f"{R}{FLOW}, {DOMINATE}, {EXITS} SELECT DISTINCT b.o_custkey, b.head, CASE WHEN b.head LIKE 'O1' THEN 'exception' WHEN NOT EXISTS (SELECT 1 FROM exits e WHERE e.o_custkey = b.o_custkey AND e.head = b.head) THEN 'infinite' WHEN EXISTS (SELECT 1 FROM exits e JOIN back k ON k.o_custkey = e.o_custkey AND k.head = e.head AND k.latch = e.src WHERE e.o_custkey = b.o_custkey AND e.head = b.head) THEN 'post-condition' ELSE 'pre-condition' END AS kind FROM bodies b")
def loop_kinds(spark, sf_dir):
    """Loops by where they are left; the state O1 stands for a caught exception."""
    flow, back, bodies = _bodies(spark, sf_dir)
    return loops.loop_kinds(flow, bodies, back, reach.nodes(flow, G).where("node = 'O1'"), G)


@query(f"{R}{FLOW}, {DOMINATE}, {EXITS}, cond AS (SELECT o_custkey, head, src AS node FROM exits UNION SELECT c.o_custkey, c.head, f.src FROM cond c JOIN flow f ON f.o_custkey = c.o_custkey AND f.dst = c.node JOIN bodies b ON b.o_custkey = c.o_custkey AND b.head = c.head AND b.member = f.src WHERE c.node <> c.head) SELECT * FROM cond")
def loop_conditions(spark, sf_dir):
    flow, _, bodies = _bodies(spark, sf_dir)
    return loops.loop_conditions(flow, bodies, G)


@query(f"{R}{FLOW}, {CLOSURE} SELECT * FROM component")
def scc(spark, sf_dir):
    return cycles.scc(_flow(spark, sf_dir), G)


@query(f"{R}{FLOW}, {CLOSURE} SELECT * FROM component")
def scc_by_graph(spark, sf_dir):
    """The same, one pass over each customer's small graph."""
    return cycles.scc_small(_flow(spark, sf_dir), G)


@query(f"{R}{FLOW}, {CLOSURE} SELECT DISTINCT f.o_custkey, a.component AS src, b.component AS dst FROM flow f JOIN component a ON a.o_custkey = f.o_custkey AND a.node = f.src JOIN component b ON b.o_custkey = f.o_custkey AND b.node = f.dst WHERE a.component <> b.component OR f.src = f.dst")
def scc_quotient(spark, sf_dir):
    """The condensation, with the explicit self-loops."""
    flow = _flow(spark, sf_dir)
    return cycles.quotient(flow, cycles.scc_small(flow, G), G)[0]


@query(f"{R}{FLOW}, {CLOSURE} SELECT f.o_custkey, a.component, f.src, f.dst FROM flow f JOIN component a ON a.o_custkey = f.o_custkey AND a.node = f.src JOIN component b ON b.o_custkey = f.o_custkey AND b.node = f.dst WHERE a.component = b.component")
def scc_inner_edges(spark, sf_dir):
    flow = _flow(spark, sf_dir)
    return cycles.quotient(flow, cycles.scc_small(flow, G), G)[1]


@query(f"{R}{FLOW}, {CLOSURE} SELECT f.o_custkey, f.src, f.dst, a.component = b.component AS is_recursion FROM flow f JOIN component a ON a.o_custkey = f.o_custkey AND a.node = f.src JOIN component b ON b.o_custkey = f.o_custkey AND b.node = f.dst")
def recursion_edges(spark, sf_dir):
    flow = _flow(spark, sf_dir)
    return cycles.recursion_edges(flow, cycles.scc_small(flow, G), G)


@query(f"WITH {PARTS} SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM part_edges e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE a.p_brand <> b.p_brand OR e.src = e.dst")
def class_quotient(spark, sf_dir):
    """Parts grouped by brand, as addresses by class."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("component"))
    return cycles.quotient(part_flow(spark, sf_dir), brands)[0]


@query(f"{R}{FLOW}, {CLOSURE}, keep AS (SELECT o_custkey, node FROM cyclic UNION SELECT o_custkey, node FROM verts WHERE node LIKE 'P%' UNION SELECT k.o_custkey, f.src FROM keep k JOIN flow f ON f.o_custkey = k.o_custkey AND f.dst = k.node) SELECT * FROM keep")
def prune_to_loops(spark, sf_dir):
    """States from which a state P or a cycle is reached."""
    flow = _flow(spark, sf_dir)
    return cycles.prune(flow, reach.nodes(flow, G).where("node like 'P%'"), cycles.scc_small(flow, G), G)


def _peel_sql(src: str, dst: str) -> str:
    return f"{R}{FLOW}, {CLOSURE}, keep AS (SELECT o_custkey, node FROM cyclic UNION SELECT o_custkey, node FROM verts WHERE node NOT LIKE 'F%' UNION SELECT k.o_custkey, f.{src} FROM keep k JOIN flow f ON f.o_custkey = k.o_custkey AND f.{dst} = k.node) SELECT * FROM keep"


@query(_peel_sql("src", "dst"))
def peel_leaves(spark, sf_dir):
    """What is left when leaves F are taken away again and again."""
    flow = _flow(spark, sf_dir)
    return cycles.peel(flow, reach.nodes(flow, G).where("node like 'F%'"), cycles.scc_small(flow, G), "leaf", G)


@query(_peel_sql("dst", "src"))
def peel_roots(spark, sf_dir):
    flow = _flow(spark, sf_dir)
    return cycles.peel(flow, reach.nodes(flow, G).where("node like 'F%'"), cycles.scc_small(flow, G), "root", G)


def _project_sql(visible: str, before: str = "") -> str:
    return f"{R}{FLOW}{before}, seen AS ({visible}), walk AS (SELECT f.* FROM flow f JOIN seen s ON s.o_custkey = f.o_custkey AND s.node = f.src UNION SELECT w.o_custkey, w.src, f.dst FROM walk w JOIN flow f ON f.o_custkey = w.o_custkey AND f.src = w.dst WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.o_custkey = w.o_custkey AND s.node = w.dst)) SELECT w.* FROM walk w JOIN seen s ON s.o_custkey = w.o_custkey AND s.node = w.dst"


@query(_project_sql("SELECT * FROM verts WHERE node NOT LIKE 'O%'"))
def visible_projection(spark, sf_dir):
    """The flow as seen with the states O hidden."""
    flow = _flow(spark, sf_dir)
    return project.project_visible(flow, reach.nodes(flow, G).where("node not like 'O%'"), G)


@query(_project_sql("SELECT v.* FROM verts v WHERE (SELECT count(*) FROM flow f WHERE f.o_custkey = v.o_custkey AND f.dst = v.node) <> 1 OR (SELECT count(*) FROM flow f WHERE f.o_custkey = v.o_custkey AND f.src = v.node) <> 1"))
def contract_degree2(spark, sf_dir):
    return project.contract_chains(_flow(spark, sf_dir), G)


@query(_project_sql("SELECT * FROM cyclic UNION SELECT * FROM roots WHERE EXISTS (SELECT 1 FROM verts v WHERE v.o_custkey = roots.o_custkey AND v.node = roots.node)", f", {CLOSURE}"))
def shrink(spark, sf_dir):
    """The first states and those in recursion, joined to the nearest such below."""
    flow = _flow(spark, sf_dir)
    return project.shrink(flow, customer_roots(spark, sf_dir), reach.on_cycles(flow, cycles.scc_small(flow, G), G), G)


DAG = "dag AS (SELECT * FROM flow WHERE src < dst), dag_verts AS (SELECT o_custkey, src AS node FROM dag UNION SELECT o_custkey, dst FROM dag)"


def _dag(spark, sf_dir):
    return cut(customer_flow(spark, sf_dir).where("src < dst"))


@query(f"{R}{FLOW}, {DAG}, seed AS (SELECT * FROM roots), up AS (SELECT * FROM seed UNION SELECT u.o_custkey, f.src FROM up u JOIN dag f ON f.o_custkey = u.o_custkey AND f.dst = u.node), down AS (SELECT * FROM seed UNION SELECT u.o_custkey, f.dst FROM down u JOIN dag f ON f.o_custkey = u.o_custkey AND f.src = u.node) SELECT o_custkey, node FROM dag_verts EXCEPT (SELECT * FROM up UNION SELECT * FROM down)")
def unrelated_nodes(spark, sf_dir):
    """States neither above nor below each customer's first state, over steps to a later letter."""
    return reach.unrelated(_dag(spark, sf_dir), customer_roots(spark, sf_dir), G)


@query(f"WITH {FLOW}, {DAG} SELECT * FROM dag_verts EXCEPT SELECT o_custkey, dst FROM dag")
def roots(spark, sf_dir):
    """States that follow none, over steps to a later letter."""
    dag = _dag(spark, sf_dir)
    return reach.sources(dag, G, fallback=False)


@query(f"{R}{FLOW}, {DAG}, far AS (SELECT o_custkey, node, 0 AS layer FROM dag_verts UNION SELECT p.o_custkey, d.dst, p.layer + 1 FROM far p JOIN dag d ON d.o_custkey = p.o_custkey AND d.src = p.node) SELECT o_custkey, node, max(layer) AS layer FROM far GROUP BY ALL")
def longest_path_layer(spark, sf_dir):
    return layers.longest_path_layers(_dag(spark, sf_dir), G)


@query(f"{R}{FLOW}, {DAG}, far AS (SELECT o_custkey, node, 0 AS layer FROM dag_verts UNION SELECT p.o_custkey, d.dst, p.layer + 1 FROM far p JOIN dag d ON d.o_custkey = p.o_custkey AND d.src = p.node), deep AS (SELECT o_custkey, node, max(layer) AS layer FROM far GROUP BY ALL) SELECT n.o_custkey, n.node, max(p.node) AS parent, n.layer FROM deep n LEFT JOIN (SELECT d.o_custkey, d.dst, p.node, p.layer FROM dag d JOIN deep p ON p.o_custkey = d.o_custkey AND p.node = d.src) p ON p.o_custkey = n.o_custkey AND p.dst = n.node AND p.layer = n.layer - 1 GROUP BY n.o_custkey, n.node, n.layer")
def layering_tree(spark, sf_dir):
    return layers.layering_tree(_dag(spark, sf_dir), G)


@query(f"{R}{FLOW}, f AS (SELECT o_custkey, node, 0 AS far FROM roots UNION SELECT p.o_custkey, d.dst, p.far + 1 FROM f p JOIN flow d ON d.o_custkey = p.o_custkey AND d.src = p.node WHERE p.far < 20), b AS (SELECT o_custkey, node, 0 AS far FROM roots UNION SELECT p.o_custkey, d.src, p.far + 1 FROM b p JOIN flow d ON d.o_custkey = p.o_custkey AND d.dst = p.node WHERE p.far < 20), s AS (SELECT o_custkey, node, min(far) AS far, 1 AS sign FROM f GROUP BY ALL UNION ALL SELECT o_custkey, node, min(far), -1 FROM b GROUP BY ALL) SELECT o_custkey, node, min_by(far * sign, (far, -sign)) AS layer FROM s GROUP BY ALL")
def bfs_layers(spark, sf_dir):
    return layers.bfs_layers(_flow(spark, sf_dir), customer_roots(spark, sf_dir), G)


@query(f"{R}{FLOW}, strict AS (SELECT o_custkey, node FROM verts EXCEPT SELECT o_custkey, dst FROM flow WHERE src <> dst), start AS (SELECT * FROM strict UNION ALL SELECT o_custkey, min(node) FROM verts WHERE o_custkey NOT IN (SELECT o_custkey FROM strict) GROUP BY 1), f AS (SELECT o_custkey, node, 0 AS far FROM start UNION SELECT p.o_custkey, d.dst, p.far + 1 FROM f p JOIN flow d ON d.o_custkey = p.o_custkey AND d.src = p.node WHERE p.far < 20), l AS (SELECT o_custkey, node, min(far) AS layer FROM f GROUP BY ALL) SELECT l.o_custkey, l.node, min(p.node) AS parent, l.layer FROM l LEFT JOIN (SELECT d.o_custkey, d.dst, p.node, p.layer FROM flow d JOIN l p ON p.o_custkey = d.o_custkey AND p.node = d.src) p ON p.o_custkey = l.o_custkey AND p.dst = l.node AND p.layer = l.layer - 1 GROUP BY ALL")
def spanning_forest(spark, sf_dir):
    return layers.spanning_forest(_flow(spark, sf_dir), G)


@query("""WITH f AS (SELECT DISTINCT user_id, src, dst FROM (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL) SELECT user_id, src, dst FROM f""")
def user_flow_edges(spark, sf_dir):
    """Event types that follow each other, by user."""
    return user_flow(spark, sf_dir)


@query("WITH first AS (SELECT user_id, min_by(event_type, (ts, event_id)) AS node FROM events GROUP BY 1) SELECT user_id, node FROM first")
def user_first_type(spark, sf_dir):
    return user_roots(spark, sf_dir)
