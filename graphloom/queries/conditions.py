"""Loops of orders taken as methods: their slices, the conditions for leaving them, where conditions end; handlers of what is thrown; sets with undo."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import history, loops, program, slices
from graphloom.plans.checkpoint import cut
from graphloom.queries.flows import table
from graphloom.queries.program import STMTS, _stmts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


R = "WITH RECURSIVE "
M = ["method"]
#: Back edges by reachability that avoids a node, slices by their definition, and every assignment of a slice's tests walked.
BACK = f"""{STMTS}, placed AS (SELECT *, lead(idx) OVER (PARTITION BY method ORDER BY idx) AS after FROM stmts
), flow AS (
  SELECT method, idx AS src, target AS dst FROM placed WHERE kind IN ('if', 'goto', 'switch') UNION SELECT method, idx, 0 FROM placed WHERE kind = 'switch'
  UNION SELECT method, idx, after FROM placed WHERE kind IN ('assign', 'if') AND after IS NOT NULL
), reach AS (
  SELECT method, 0 AS node FROM stmts WHERE idx = 0 UNION SELECT r.method, f.dst FROM reach r JOIN flow f ON f.method = r.method AND f.src = r.node
), avoid AS (
  SELECT method, node AS cut, 0 AS node FROM reach WHERE node <> 0 UNION SELECT a.method, a.cut, f.dst FROM avoid a JOIN flow f ON f.method = a.method AND f.src = a.node WHERE f.dst <> a.cut
), back AS (
  SELECT f.method, f.dst AS head, f.src AS latch FROM flow f JOIN reach r ON r.method = f.method AND r.node = f.src
  WHERE f.src = f.dst OR NOT EXISTS (SELECT 1 FROM avoid a WHERE a.method = f.method AND a.cut = f.dst AND a.node = f.src)
), ends AS (
  SELECT method, head, max(latch) AS stop FROM back GROUP BY ALL HAVING max(latch) >= head
)"""
SLICES = f"""{BACK}, inside AS (
  SELECT p.method, e.head, e.stop, idx, kind, target, after, CASE WHEN kind = 'if' THEN chr(64 + (count(*) FILTER (kind = 'if') OVER (PARTITION BY p.method, e.head ORDER BY idx))::INT) END AS label
  FROM placed p JOIN ends e ON e.method = p.method AND idx BETWEEN e.head AND e.stop
), chain AS (
  SELECT method, head, idx AS src, target AS dst FROM inside WHERE kind = 'goto' AND target > idx
  UNION SELECT c.method, c.head, c.src, i.target FROM chain c JOIN inside i ON i.method = c.method AND i.head = c.head AND i.idx = c.dst AND i.kind = 'goto' AND i.target > i.idx
), chased AS (
  SELECT method, head, src, max(dst) AS dst FROM chain GROUP BY ALL
), each AS (
  SELECT method, head, stop, idx AS src, label, target AS dst, true AS taken FROM inside WHERE kind = 'if' AND target > idx
  UNION ALL SELECT method, head, stop, idx, label, target, NULL FROM inside WHERE kind = 'goto' AND idx = head AND target > idx
  UNION ALL SELECT method, head, stop, idx, label, after, CASE WHEN kind = 'if' THEN false END FROM inside WHERE kind NOT IN ('return', 'goto') AND after IS NOT NULL
), led AS (
  SELECT e.method, e.head, e.stop, e.src, e.label, e.taken, coalesce(c.dst, e.dst) AS dst, coalesce(g.target <= g.idx, false) AS goes_back
  FROM each e LEFT JOIN chased c ON c.method = e.method AND c.head = e.head AND c.src = e.dst
  LEFT JOIN inside g ON g.method = e.method AND g.head = e.head AND g.idx = coalesce(c.dst, e.dst) AND g.kind = 'goto'
), lefts AS (
  SELECT method, head FROM led WHERE dst = stop + 1 GROUP BY ALL
), slices AS (
  SELECT l.method, l.head, src, dst, label, taken, dst = CASE WHEN x.head IS NULL THEN stop ELSE stop + 1 END AS exits
  FROM led l LEFT JOIN lefts x ON x.method = l.method AND x.head = l.head WHERE NOT goes_back OR (x.head IS NULL AND dst = stop)
)"""
WALKS = f"""{SLICES}, tests AS (
  SELECT DISTINCT method, head, src AS idx, label, ascii(label) - 65 AS bit FROM slices WHERE label IS NOT NULL
), begins AS (
  SELECT DISTINCT method, head, head AS node FROM slices
), masks AS (
  SELECT b.method, b.head, b.node, unnest(range((SELECT coalesce(1 << (max(bit) + 1)::INT, 1) FROM tests t WHERE t.method = b.method AND t.head = b.head))) AS mask FROM begins b
), leaves AS (
  SELECT DISTINCT method, head, dst AS node FROM slices WHERE exits
), walk AS (
  SELECT method, head, mask, node FROM masks
  UNION ALL
  SELECT w.method, w.head, w.mask, s.dst FROM walk w JOIN slices s ON s.method = w.method AND s.head = w.head AND s.src = w.node AND (s.label IS NULL OR s.taken = ((w.mask >> (ascii(s.label) - 65)) & 1 = 1))
  WHERE NOT EXISTS (SELECT 1 FROM leaves l WHERE l.method = w.method AND l.head = w.head AND l.node = w.node)
), leaving AS (
  SELECT w.method, w.head, w.mask, bool_or(l.node IS NOT NULL) AS y FROM walk w LEFT JOIN leaves l ON l.method = w.method AND l.head = w.head AND l.node = w.node GROUP BY ALL
)"""


def _back(spark, sf_dir):
    stmts = _stmts(spark, sf_dir)
    flow = cut(program.flow_edges(stmts))
    roots = stmts.groupBy("method").agg(F.min("idx").alias("node"))
    return stmts, flow, cut(loops.loop_edges(flow, roots, M))


@query(f"{R}{SLICES} SELECT DISTINCT * FROM slices")
def loop_slices(spark, sf_dir):
    """The loops of all orders cut out as graphs of tests."""
    stmts, _, back = _back(spark, sf_dir)
    return slices.loop_slices(stmts, back)


@query(f"{R}{WALKS} SELECT DISTINCT t.method, t.head, t.idx, t.label FROM tests t JOIN leaving a ON a.method = t.method AND a.head = t.head JOIN leaving b ON b.method = a.method AND b.head = a.head AND b.mask = xor(a.mask, 1 << t.bit::INT) WHERE a.y <> b.y")
def loop_vital_branches(spark, sf_dir):
    """The tests on which leaving each loop of all orders depends."""
    stmts, _, back = _back(spark, sf_dir)
    return slices.vital_branches(stmts, back)


@query(
    f"{R}{WALKS}, wide AS (SELECT method, head, string_agg(CASE WHEN y THEN '1' ELSE '0' END, '' ORDER BY m) AS y FROM (SELECT l.method, l.head, m.m, l.y FROM (SELECT unnest(range(128)) AS m) m JOIN (SELECT *, max(mask) OVER (PARTITION BY method, head) AS top FROM leaving) l ON l.mask = (m.m & l.top)) GROUP BY ALL) "
    "SELECT min(method) AS method, min_by(head, (method, head)) AS head, count(*) AS n_loops FROM wide GROUP BY y"
)
def equal_conditions(spark, sf_dir):
    """Loops of all orders that are left under the same condition: the first of each kind, and how many there are."""
    stmts, _, back = _back(spark, sf_dir)
    found = slices.exit_conditions(slices.loop_slices(stmts, back))
    return found.groupBy("id").agg(F.min(F.struct("method", "head")).alias("first"), F.count(F.lit(1)).alias("n_loops")).select("first.method", "first.head", "n_loops")


#: Sweeps by running maxima; the latest common statement by reachability that avoids each candidate.
METHODS = f"""{SLICES}, cuts AS (SELECT DISTINCT * FROM slices), lasts AS (
  SELECT method, head, max(dst) FILTER (exits) AS last FROM cuts GROUP BY ALL
), inner_edges AS (
  SELECT DISTINCT method, head, src, dst FROM cuts JOIN lasts USING (method, head) WHERE NOT exits AND dst < last
), jumpers AS (
  SELECT DISTINCT method, head, src AS node FROM cuts WHERE exits
), nodes AS (
  SELECT method, head, src AS node FROM cuts UNION SELECT method, head, dst FROM inner_edges
), swept AS (
  SELECT n.method, n.head, n.node, j.node IS NOT NULL AS jumps, (SELECT max(dst) FROM inner_edges e WHERE e.method = n.method AND e.head = n.head AND e.src < n.node) AS far,
    (SELECT max(node) FROM jumpers x WHERE x.method = n.method AND x.head = n.head) AS last_jump
  FROM nodes n LEFT JOIN jumpers j ON j.method = n.method AND j.head = n.head AND j.node = n.node
), chokes AS (
  SELECT method, head, min(node) AS choke FROM swept WHERE coalesce(far, -1) <= node AND node >= last_jump GROUP BY ALL
), by_sweep AS (
  SELECT method, head, node FROM swept JOIN chokes USING (method, head) WHERE node < choke OR node = choke AND jumps
), seen AS (
  SELECT method, head, head AS node FROM lasts UNION SELECT s.method, s.head, e.dst FROM seen s JOIN inner_edges e ON e.method = s.method AND e.head = s.head AND e.src = s.node
), around AS (
  SELECT method, head, node AS without, head AS node FROM seen WHERE node <> head
  UNION SELECT a.method, a.head, a.without, e.dst FROM around a JOIN inner_edges e ON e.method = a.method AND e.head = a.head AND e.src = a.node WHERE e.dst <> a.without
), common AS (
  SELECT s.method, s.head, max(s.node) AS node FROM seen s WHERE EXISTS (SELECT 1 FROM jumpers j JOIN seen x USING (method, head, node) WHERE j.method = s.method AND j.head = s.head)
    AND NOT EXISTS (SELECT 1 FROM jumpers j JOIN seen x USING (method, head, node) JOIN around a ON a.method = s.method AND a.head = s.head AND a.without = s.node AND a.node = j.node WHERE j.method = s.method AND j.head = s.head)
  GROUP BY s.method, s.head
), behind AS (
  SELECT method, head, node FROM common UNION SELECT b.method, b.head, e.dst FROM behind b JOIN inner_edges e ON e.method = b.method AND e.head = b.head AND e.src = b.node
), by_ancestor AS (
  SELECT * FROM behind WHERE node <> head
)"""


@query(f"{R}{METHODS} SELECT method, head, node, CASE WHEN s.n IS NULL THEN 'ancestor' WHEN a.n IS NULL THEN 'sweep' ELSE 'both' END AS side FROM (SELECT *, 1 AS n FROM by_sweep) s FULL JOIN (SELECT *, 1 AS n FROM by_ancestor) a USING (method, head, node)")
def choke_and_ancestor(spark, sf_dir):
    """The conditions of all orders' loops by a sweep to the choke point and by the latest common statement."""
    stmts, _, back = _back(spark, sf_dir)
    cut_ = cut(slices.loop_slices(stmts, back))
    side = lambda df, name: df.withColumn(name, F.lit(True))
    met = side(slices.choke_conditions(cut_), "_s").join(side(slices.ancestor_conditions(cut_), "_a"), ["method", "head", "node"], "full")
    return met.select("method", "head", "node", F.when(F.col("_s") & F.col("_a"), "both").when(F.col("_s"), "sweep").otherwise("ancestor").alias("side"))


#: The shapes that these statements can have, said of statements instead of their text: what stands before and after the head.
KINDS = f"""{WALKS}, said AS (
  SELECT i.*, CASE WHEN kind <> 'assign' THEN '' WHEN l_suppkey % 3 = 0 THEN 'zero' WHEN l_suppkey % 3 = 1 THEN 'next' ELSE 'other' END AS word
  FROM (SELECT p.method, e.head, e.stop, p.idx, p.kind, p.target, p.l_suppkey FROM placed p JOIN ends e ON e.method = p.method AND p.idx <= e.stop) i
), told AS (
  SELECT method, head,
    bool_or(idx = head - 1 AND word = 'zero') AS just_before, bool_or(idx < head AND word = 'zero') AS before, bool_or(idx = head AND kind = 'if' AND target > stop) AS tests_first,
    bool_or(idx > head AND idx = stop - 1 AND word = 'next') AS next_last, bool_or(idx > head AND idx < stop AND word = 'next') AS next_inside, bool_or(idx >= head AND idx < stop AND word = 'next') AS next_any,
    bool_or(idx = stop AND kind = 'goto' AND target = head AND stop > head) AS closes, bool_or(idx = stop AND kind = 'if' AND target = head) AS tests_last,
    bool_or(idx > head AND idx < stop - 1 AND kind IN ('if', 'goto') AND target > stop) AS leaves_inside
  FROM said GROUP BY ALL
), tested AS (
  SELECT DISTINCT t.method, t.head FROM tests t JOIN leaving a ON a.method = t.method AND a.head = t.head JOIN leaving b ON b.method = a.method AND b.head = a.head AND b.mask = xor(a.mask, 1 << t.bit::INT) WHERE a.y <> b.y
), kinds AS (
  SELECT t.method, t.head, CASE WHEN just_before AND tests_first AND next_last AND closes AND NOT leaves_inside THEN 'count_up' WHEN before AND tests_first AND next_inside AND closes THEN 'simple_while'
    WHEN before AND next_any AND tests_last THEN 'do_while' WHEN x.head IS NOT NULL THEN 'branches' ELSE 'unidentified' END AS loop_kind
  FROM told t LEFT JOIN tested x ON x.method = t.method AND x.head = t.head
)"""


@query(f"{R}{KINDS} SELECT * FROM kinds")
def loop_kinds_of_statements(spark, sf_dir):
    """The kinds of the loops of all orders, items being i = 0, i = i + 1, another assignment, or a test of i."""
    stmts, _, back = _back(spark, sf_dir)
    s = F.col("l_suppkey") % 3
    text = F.when(F.col("kind") == "if", F.concat(F.lit("i >= "), (F.col("l_partkey") % 10).cast("string"))).when(F.col("kind") == "assign", F.when(s == 0, "i = 0").when(s == 1, "i = i + 1").otherwise("a = b"))
    return slices.identified_loops(stmts.withColumn("text", text), back).select("method", "head", "loop_kind")


#: Every item of an order is a trap: over a few statements, for a class of exceptions; parts are the classes, as in ``program``.
TRAPS = f"""{STMTS}, subtype AS (
  SELECT p_partkey AS class, p_partkey AS super FROM part UNION SELECT class, super // 2 FROM subtype WHERE super > 1
), traps AS (
  SELECT method, idx AS ord, l_suppkey % 4 AS begin_idx, l_suppkey % 4 + 1 + l_partkey % 3 AS end_idx, 1 + l_suppkey % 8 AS exception, target AS handler_idx FROM stmts
)"""
CAUGHT = "EXISTS (SELECT 1 FROM traps t JOIN subtype s ON s.super = t.exception WHERE t.method = {0}.method AND {0}.idx >= t.begin_idx AND {0}.idx < t.end_idx AND s.class = {0}.thrown)"


def _trapped(spark, sf_dir):
    """(statements with their part, traps, pairs of class and superclass, classes)."""
    stmts = cut(_stmts(spark, sf_dir))
    begin = F.col("l_suppkey") % 4
    traps = stmts.select("method", F.col("idx").alias("ord"), begin.alias("begin_idx"), (begin + 1 + F.col("l_partkey") % 3).alias("end_idx"), (1 + F.col("l_suppkey") % 8).alias("exception"), F.col("target").alias("handler_idx"))
    above = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("class"), F.floor(F.col("p_partkey") / 2).alias("super"))
    return stmts, traps, above, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("class"))


@query(f"{R}{TRAPS} SELECT x.method, x.idx, x.l_partkey AS thrown, min_by(t.handler_idx, t.ord) FILTER (s.class IS NOT NULL) AS handler_idx FROM stmts x LEFT JOIN traps t ON t.method = x.method AND x.idx >= t.begin_idx AND x.idx < t.end_idx LEFT JOIN subtype s ON s.class = x.l_partkey AND s.super = t.exception GROUP BY ALL")
def exception_handlers(spark, sf_dir):
    """What takes an exception of its part's class at each item."""
    stmts, traps, above, known = _trapped(spark, sf_dir)
    # Only what traps name can take anything: pairs under other classes are not built.
    named = traps.select(F.col("exception").alias("super")).distinct()
    subtype = cut(program.subtypes_of(above, named).join(known.hint("merge"), "class", "left_semi"))
    return program.handlers(stmts.withColumn("thrown", F.col("l_partkey")), traps, subtype)


@query(
    f"{R}{TRAPS}, calls AS (SELECT method, idx, l_partkey AS callee FROM stmts WHERE kind = 'assign'), arrive AS ("
    f"SELECT method, idx, 1 + l_partkey % 50 AS thrown FROM stmts WHERE kind = 'return' UNION SELECT c.method, c.idx, a.thrown FROM arrive a JOIN calls c ON c.callee = a.method WHERE NOT {CAUGHT.format('a')}"
    ") SELECT a.method, a.idx, a.thrown, min_by(t.handler_idx, t.ord) FILTER (s.class IS NOT NULL) AS handler_idx FROM arrive a LEFT JOIN traps t ON t.method = a.method AND a.idx >= t.begin_idx AND a.idx < t.end_idx LEFT JOIN subtype s ON s.class = a.thrown AND s.super = t.exception GROUP BY ALL"
)
def unwound_exceptions(spark, sf_dir):
    """Where exceptions thrown at returns arrive, items being calls of the order with their part's number."""
    stmts, traps, above, known = _trapped(spark, sf_dir)
    thrown = stmts.where("kind = 'return'").select("method", "idx", (1 + F.col("l_partkey") % 50).alias("thrown"))
    calls = stmts.where("kind = 'assign'").select("method", "idx", F.col("l_partkey").alias("callee"))
    # The classes above what is thrown are all that can take it.
    subtype = program.supers_of(above, known.join(thrown.select(F.col("thrown").alias("class")).distinct(), "class", "left_semi"))
    return program.unwound(thrown, calls, traps, subtype)


@query("SELECT l_partkey AS dst_class, count(DISTINCT l_suppkey) AS n_callers, count(*) AS n_calls FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def unknown_targets(spark, sf_dir):
    """Items as calls of their supplier to their part, of which those above size 25 are known classes."""
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src_class"), F.col("l_partkey").alias("dst_class"))
    return program.unknown_targets(calls, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("name")))


@query("WITH RECURSIVE met AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT l.l_partkey FROM met m JOIN lineitem l ON l.l_orderkey = m.node) SELECT node FROM met")
def call_closure(spark, sf_dir):
    """Orders reached from the urgent ones, an item calling the order with its part's number."""
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"))
    main = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("node"))
    return program.call_closure(calls, main)


@query(
    "WITH RECURSIVE log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'click' THEN 'redo' WHEN 'purchase' THEN 'show' ELSE 'hide' END AS op, floor(value)::BIGINT % 7 AS id FROM events"
    "), walk AS (SELECT DISTINCT user_id, 0::BIGINT AS seq, []::STRUCT(op VARCHAR, id BIGINT)[] AS stack, 0 AS depth, []::BIGINT[] AS own FROM log UNION ALL SELECT * FROM ("
    "SELECT w.user_id, l.seq, CASE WHEN change THEN list_append(w.stack[1:w.depth], {'op': l.op, 'id': l.id}) ELSE w.stack END, CASE WHEN change OR forth THEN w.depth + 1 WHEN back THEN w.depth - 1 ELSE w.depth END, "
    "CASE WHEN change THEN CASE l.op WHEN 'hide' THEN list_append(w.own, l.id) ELSE list_filter(w.own, lambda x: x <> l.id) END "
    "WHEN forth THEN CASE w.stack[w.depth + 1].op WHEN 'hide' THEN list_append(w.own, w.stack[w.depth + 1].id) ELSE list_filter(w.own, lambda x: x <> w.stack[w.depth + 1].id) END "
    "WHEN back THEN CASE w.stack[w.depth].op WHEN 'show' THEN list_append(w.own, w.stack[w.depth].id) ELSE list_filter(w.own, lambda x: x <> w.stack[w.depth].id) END ELSE w.own END "
    "FROM (SELECT w.*, l.op AS next_op, (l.op IN ('hide', 'show') AND (l.op = 'hide') <> list_contains(w.own, l.id)) AS change, l.op = 'redo' AND w.depth < len(w.stack) AS forth, l.op = 'undo' AND w.depth > 0 AS back FROM walk w JOIN log l ON l.user_id = w.user_id AND l.seq = w.seq + 1) w JOIN log l ON l.user_id = w.user_id AND l.seq = w.seq + 1)"
    ") SELECT user_id, seq, unnest(own) AS id FROM walk"
)
def undo_history(spark, sf_dir):
    """What is hidden at each of a user's events: errors undo, clicks redo, purchases show, others hide."""
    events = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "click", "redo").when(F.col("event_type") == "purchase", "show").otherwise("hide")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    log = cut(events.select(F.col("user_id").alias("user"), seq.alias("seq"), op.alias("op"), (F.floor("value") % 7).alias("id")))
    return history.states_at(log, log).withColumnRenamed("user", "user_id")
