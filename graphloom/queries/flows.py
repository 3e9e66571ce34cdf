"""Graphs made of the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _steps(rows: DataFrame, group: str, state: str, order: list[str]) -> DataFrame:
    follow = F.lead(state).over(Window.partitionBy(group).orderBy(*order))
    return rows.select(group, F.col(state).alias("src"), follow.alias("dst")).where(F.col("dst").isNotNull()).distinct()


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a state: status and first letter of the priority. A customer's orders are like a method's statements."""
    return table(spark, sf_dir, "orders").withColumn("state", F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)))


def customer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, src, dst): states of a customer's orders that follow each other."""
    return _steps(states(spark, sf_dir), "o_custkey", "state", ["o_orderdate", "o_orderkey"])


def customer_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, node): the state of each customer's first order."""
    return states(spark, sf_dir).groupBy("o_custkey").agg(F.min_by("state", F.struct("o_orderdate", "o_orderkey")).alias("node"))


def user_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, src, dst): types of a user's events that follow each other."""
    return _steps(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def user_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("node"))


def part_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts that follow each other within an order."""
    return _steps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("src", "dst").distinct()


FLOW = """
flow_rows AS (
  SELECT o_custkey, o_orderstatus || substr(o_orderpriority, 1, 1) AS state,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders
), flow AS (
  SELECT DISTINCT o_custkey, src, dst FROM (
    SELECT o_custkey, state AS src, lead(state) OVER (PARTITION BY o_custkey ORDER BY n) AS dst FROM flow_rows) WHERE dst IS NOT NULL
), roots AS (
  SELECT o_custkey, state AS node FROM flow_rows WHERE n = 1
), verts AS (
  SELECT o_custkey, src AS node FROM flow UNION SELECT o_custkey, dst FROM flow
)"""
#: Pairs joined by a path of at least one edge, and components by mutual reachability.
CLOSURE = """
closure AS (
  SELECT o_custkey, src, dst FROM flow UNION
  SELECT c.o_custkey, c.src, f.dst FROM closure c JOIN flow f ON c.o_custkey = f.o_custkey AND c.dst = f.src
), component AS (
  SELECT v.o_custkey, v.node, least(v.node, coalesce(min(a.dst), v.node)) AS component
  FROM verts v LEFT JOIN (SELECT a.o_custkey, a.src, a.dst FROM closure a JOIN closure b ON a.o_custkey = b.o_custkey AND a.src = b.dst AND a.dst = b.src) a
    ON a.o_custkey = v.o_custkey AND a.src = v.node
  GROUP BY v.o_custkey, v.node
), cyclic AS (
  SELECT DISTINCT o_custkey, src AS node FROM closure WHERE src = dst
)"""
#: x dominates n if n isn't reached from the root without x.
DOMINATE = """
reach AS (
  SELECT o_custkey, node FROM roots UNION SELECT r.o_custkey, f.dst FROM reach r JOIN flow f ON r.o_custkey = f.o_custkey AND r.node = f.src
), avoid AS (
  SELECT x.o_custkey, x.node AS x, r.node FROM reach x JOIN roots r ON x.o_custkey = r.o_custkey WHERE x.node <> r.node UNION
  SELECT a.o_custkey, a.x, f.dst FROM avoid a JOIN flow f ON a.o_custkey = f.o_custkey AND a.node = f.src WHERE f.dst <> a.x
), dom AS (
  SELECT n.o_custkey, n.node, x.node AS dom FROM reach n JOIN reach x ON n.o_custkey = x.o_custkey
  WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.o_custkey = n.o_custkey AND a.x = x.node AND a.node = n.node)
), back AS (
  SELECT f.o_custkey, f.dst AS head, f.src AS latch FROM flow f JOIN dom d ON d.o_custkey = f.o_custkey AND d.node = f.src AND d.dom = f.dst
), bodies AS (
  SELECT o_custkey, head, head AS member FROM back UNION SELECT o_custkey, head, latch FROM back UNION
  SELECT b.o_custkey, b.head, f.src FROM bodies b JOIN flow f ON f.o_custkey = b.o_custkey AND f.dst = b.member WHERE b.member <> b.head
)"""
PARTS = """
part_edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem)
  WHERE dst IS NOT NULL
), part_nodes AS (
  SELECT src AS node FROM part_edges UNION SELECT dst FROM part_edges
)"""
