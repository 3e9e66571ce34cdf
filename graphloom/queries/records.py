"""Record tools over conversations, orders, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import records
from graphloom.queries.flows import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn, role FROM conversations s WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = s.conv_id AND t.turn = s.turn + 1)")
def missing_returns(spark, sf_dir):
    """User turns that no turn follows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return records.missing_successor(turns, ["conv_id"], "turn", F.col("role") == "user")


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def _nodes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("day")).withColumn("seq", F.struct("day", "id")).drop("day")


EDGES = "edges AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem), nodes AS (SELECT o_orderkey AS id, 'order' AS kind, o_orderdate FROM orders WHERE o_orderstatus <> 'F')"
REFS = "refs AS (SELECT node, count(*) AS refs FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) WHERE node NOT IN (SELECT id FROM nodes) GROUP BY node)"


@query(f"WITH {EDGES} SELECT * FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)")
def hanging_edges(spark, sf_dir):
    """Items whose order or part number is no open order's."""
    return records.hanging_edges(_edges(spark, sf_dir), _nodes(spark, sf_dir))


@query(f"WITH {EDGES}, {REFS} SELECT * FROM refs")
def missing_refs(spark, sf_dir):
    return records.missing_refs(_edges(spark, sf_dir), _nodes(spark, sf_dir))


@query(f"WITH {EDGES}, {REFS} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM refs) AS n_missing, (SELECT sum(refs)::BIGINT FROM refs) AS n_references, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)) AS n_hanging, (SELECT min_by(id, (o_orderdate, id)) FROM nodes) AS first_node")
def info_summary(spark, sf_dir):
    return records.info(_edges(spark, sf_dir), _nodes(spark, sf_dir)).select("n_nodes", "n_edges", "n_missing", "n_references", "n_hanging", "first_node")


@query(f"WITH {EDGES}, {REFS} SELECT id, kind FROM nodes UNION ALL SELECT node, 'missing' FROM refs")
def add_missing_nodes(spark, sf_dir):
    return records.add_missing(_edges(spark, sf_dir), _nodes(spark, sf_dir).drop("seq"))


@query(f"WITH {EDGES} SELECT * FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def drop_missing_edges(spark, sf_dir):
    return records.resolve_ends(_edges(spark, sf_dir), _nodes(spark, sf_dir))[0]


@query("SELECT 0 AS stream, event_id AS seq, event_type AS kind FROM events UNION ALL SELECT 1, o_orderkey, o_orderstatus FROM orders")
def concat_tables(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("kind"))
    return records.concat(events, orders)


COVER = "sides AS (SELECT coalesce(a.k, b.k) AS p_partkey, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 10) b ON a.k = b.k)"


def _covered(spark, sf_dir):
    ordered = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return records.coverage(ordered, table(spark, sf_dir, "part").where("p_size > 10"), ["p_partkey"])


@query(f"WITH {COVER} SELECT * FROM sides")
def coverage_full_outer(spark, sf_dir):
    """Parts ordered in bulk against parts above a size, as seen methods against the jar's."""
    return _covered(spark, sf_dir)


@query(f"WITH {COVER}, n AS (SELECT count(*) FILTER (side = 'both') AS b, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r FROM sides) SELECT b AS n_both, l AS n_left, r AS n_right, round(b / (b + l), 4) AS left_share, round(b / (b + r), 4) AS right_share FROM n")
def coverage_ratio(spark, sf_dir):
    return records.coverage_summary(_covered(spark, sf_dir))


@query("WITH a AS (SELECT coalesce(s.k, p.k, c.k) AS k, s.k AS s, p.k AS a, c.k AS c FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) s FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 10) p ON s.k = p.k FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.05) c ON c.k = coalesce(s.k, p.k)) SELECT count(*) FILTER (s IS NOT NULL AND a IS NOT NULL) AS seen_app, count(*) FILTER (s IS NOT NULL AND a IS NULL) AS seen_only, count(*) FILTER (a IS NOT NULL AND s IS NULL) AS app_only, count(*) FILTER (c IS NOT NULL AND s IS NULL) AS called_unseen, round(100.0::DOUBLE * count(*) FILTER (s IS NOT NULL AND a IS NOT NULL) / count(*) FILTER (a IS NOT NULL AND c IS NOT NULL), 2) AS percent FROM a")
def method_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("method", F.col("l_partkey"))
    return records.method_coverage(items.where("l_quantity > 45"), table(spark, sf_dir, "part").where("p_size > 10").withColumn("method", F.col("p_partkey")), items.where("l_discount > 0.05"))


@query("WITH o AS (SELECT DISTINCT l_orderkey AS method, l_linenumber AS idx FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS method, l_linenumber AS idx FROM lineitem WHERE l_returnflag = 'A') SELECT o.method, min(o.idx) AS first, max(o.idx) AS last, count(*) AS n FROM o WHERE o.method IN (SELECT method FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.method = o.method AND c.idx = o.idx) GROUP BY 1")
def uncovered_statements(spark, sf_dir):
    """Lines of orders with a returned line that aren't returned themselves."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("method"), F.col("l_linenumber").alias("idx"), "l_returnflag")
    return records.uncovered_statements(lines.select("method", "idx").distinct(), lines.where("l_returnflag = 'A'"))


@query("SELECT event_type AS kind, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM events GROUP BY 1")
def loop_stats_percent(spark, sf_dir):
    """Events by type, as loops by kind."""
    return records.kind_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")), "kind")


@query("SELECT event_id, user_id, (row_number() OVER w - 1)::INT AS number, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def next_prev_stmt(spark, sf_dir):
    """Each event's number among its user's, and the types before and after it."""
    found = records.neighbours(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.select("event_id", "user_id", "number", "previous", "next")


@query("SELECT event_type, min_by(event_id, (ts, event_id)) AS event_id, min_by(user_id, (ts, event_id)) AS user_id FROM events GROUP BY 1")
def first_state(spark, sf_dir):
    return records.first_of_kind(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "user_id")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def upsert_last_wins(spark, sf_dir):
    return records.last_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT p_name, row_number() OVER (ORDER BY p_name) AS id FROM (SELECT DISTINCT p_name FROM part)")
def dense_ids(spark, sf_dir):
    return records.dense_ids(table(spark, sf_dir, "part"), "p_name")


@query("SELECT conv_id, turn AS src, coalesce(lead(turn) OVER w, first_value(turn) OVER w) AS dst FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def cycle_pairs(spark, sf_dir):
    return records.cycle_pairs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn")


@query("WITH p AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) SELECT o_custkey, o_orderpriority FROM p GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM p q WHERE q.o_custkey = p.o_custkey)")
def nodes_on_all_paths(spark, sf_dir):
    """Priorities that occur with every status that a customer's orders have."""
    return records.in_all_paths(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority")


@query("WITH l AS (SELECT user_id AS id, max_by(event_type, event_id) AS op FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) SELECT id FROM l WHERE op = 'view'")
def hidden_set(spark, sf_dir):
    """Users hidden after the whole log of views (hide) and clicks (show)."""
    events = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    log = events.select(F.col("event_id").alias("version"), F.when(F.col("event_type") == "view", "hide").otherwise("show").alias("op"), F.col("user_id").alias("id"))
    return records.visible_at(log, 1 << 60)


@query("SELECT page_id, CASE WHEN regexp_matches(url, 'casino|pills') THEN false WHEN regexp_matches(url, 'example[.]org/') THEN true WHEN regexp_matches(url, '/(de|fr)/') THEN false ELSE true END AS included FROM pages")
def rule_first_match(spark, sf_dir):
    rules = spark.createDataFrame([(1, False, "casino|pills"), (2, True, "example[.]org/"), (3, False, "/(de|fr)/")], "ord int, include boolean, pattern string")
    return records.first_match(table(spark, sf_dir, "pages"), rules, "url").select("page_id", "included")


@query("WITH r(status, ord, b, e, h) AS (VALUES ('F', 1, DATE '1992-01-01', DATE '1995-01-01', 10), ('F', 2, DATE '1994-01-01', DATE '1999-01-01', 20), ('O', 1, DATE '1996-06-01', DATE '1998-01-01', 30)) SELECT o_orderkey, o_orderstatus AS status, min_by(h, ord) AS h FROM orders LEFT JOIN r ON r.status = o_orderstatus AND o_orderdate >= b AND o_orderdate < e GROUP BY 1, 2")
def range_handler(spark, sf_dir):
    """The first interval of an order's status that covers its date, as traps cover statements."""
    rows = [("F", 1, "1992-01-01", "1995-01-01", 10), ("F", 2, "1994-01-01", "1999-01-01", 20), ("O", 1, "1996-06-01", "1998-01-01", 30)]
    day = lambda c: F.unix_date(F.to_date(c))
    ranges = spark.createDataFrame(rows, "status string, ord int, b string, e string, h int").withColumns({c: day(F.col(c)) for c in "be"})
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), day(F.col("o_orderdate")).alias("at"))
    return records.range_first(orders, ranges, ["status"], "at", "b", "e", "ord", ["h"]).select("o_orderkey", "status", "h")


@query("WITH z AS (SELECT p_partkey, unnest(list_zip(string_split(p_name, ' '), string_split(p_type || ' ' || p_brand, ' '))) AS z, generate_subscripts(list_zip(string_split(p_name, ' '), string_split(p_type || ' ' || p_brand, ' ')), 1) - 1 AS pos FROM part) SELECT p_partkey, pos::INT AS pos, z[1] AS args, z[2] AS params FROM z WHERE z[1] IS NOT NULL AND z[2] IS NOT NULL")
def arg_zip(spark, sf_dir):
    """Words of a part's name with those of its type and brand, by position."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("args"), F.split(F.concat_ws(" ", "p_type", "p_brand"), " ").alias("params"))
    return records.zip_positions(parts, ["p_partkey"], "args", "params")
