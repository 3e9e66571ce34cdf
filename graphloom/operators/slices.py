"""Loops cut out of their methods as acyclic graphs of tests, and the condition under which a pass leaves them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.boolean import label
from graphloom.operators.diagrams import FALSE, TRUE, reduced
from graphloom.operators.hierarchy import lowest_common
from graphloom.operators.loops import immediate_dominators
from graphloom.operators.patterns import classify_loops, written
from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import fixpoint
from graphloom.plans.sizes import spread

LOOP = ["method", "head"]


def chased(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, src, dst): where the chain from each ``src`` ends, from (keys, src, dst) with one step a src and no cycle.

    Pointer jumping: every round doubles how far each step leads.
    """
    keys = list(keys)
    now = cut(steps.select(*keys, "src", "dst"))
    while True:
        ahead = now.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("_far"))
        met = now.join(ahead, [*keys, "dst"], "left")
        moved = cut(met.select(*keys, "src", F.coalesce("_far", "dst").alias("dst"), F.col("_far").isNotNull().alias("_moved")))
        now = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return now


def loop_slices(stmts: DataFrame, back: DataFrame) -> DataFrame:
    """(method, head, src, dst, label, taken, exits): the forward edges of each loop's statements, gotos aside.

    ``stmts`` has (method, idx, kind, targets), ``back`` the back edges (method, head, latch). A loop's statements are
    those from its head to its last latch; one whose latches all come before the head has none. Ifs have
    labels A, B, … in order; ``taken`` tells their true edge, and is null for other statements. A goto is no node, but as the
    head: edges into it lead where its chain ends. Edges back are left out, also those through gotos. Only ifs branch: a switch
    falls through; a return or throw ends. ``exits`` marks edges to the statement after the loop or, where
    there is none, to its last statement, a goto then standing for itself.
    """
    ends = back.groupBy(*LOOP).agg(F.max("latch").alias("end")).where(F.col("end") >= F.col("head"))
    after = F.lead("idx").over(Window.partitionBy("method").orderBy("idx"))
    own = stmts.select("method", "idx", "kind", "targets", after.alias("after"))
    inside = own.join(ends.hint("merge"), "method").where(F.col("idx").between(F.col("head"), F.col("end")))
    ordered = Window.partitionBy(*LOOP).orderBy("idx")
    stop = F.max(F.when(F.col("idx") == F.col("end"), F.coalesce("after", F.col("end") + 1))).over(Window.partitionBy(*LOOP))
    is_if = F.col("kind") == "if"
    inside = cut(inside.withColumn("stop", stop).withColumn("label", F.when(is_if, label(F.sum(F.when(is_if, 1).otherwise(0)).over(ordered) - 1))))
    n = 2 * inside.count()  # of edges, switches and ifs of several targets aside
    forward = F.col("targets")[0] > F.col("idx")
    gotos = inside.where("kind = 'goto'").select(*LOOP, "end", "idx", forward.alias("on"), F.col("targets")[0].alias("dst"))
    chains = chased(gotos.where("on").select(*LOOP, F.col("idx").alias("src"), "dst"), LOOP)
    chains = chains.select(*LOOP, F.col("dst").alias("_last"), F.col("src").alias("dst"))
    closing = gotos.where("not on").select(*LOOP, F.col("idx").alias("dst"), F.lit(True).alias("_back"))
    enters = F.when((F.col("kind") == "goto") & (F.col("idx") == F.col("head")), F.struct(F.col("targets")[0].alias("dst"), F.lit(None).cast("boolean").alias("taken")))
    falls = F.when(~F.col("kind").isin("return", "return_void", "throw", "goto"), F.struct(F.col("after").alias("dst"), F.when(is_if, F.lit(False)).alias("taken")))
    falls = F.coalesce(enters, falls)
    jumps = F.when(is_if, F.transform("targets", lambda t: F.struct(t.alias("dst"), F.lit(True).alias("taken"))))
    each = inside.select(*LOOP, "end", "stop", F.col("idx").alias("src"), "label", F.explode(F.array_append(F.coalesce(jumps, F.array().cast("array<struct<dst:int,taken:boolean>>")), falls)).alias("e"))
    each = each.select(*LOOP, "end", "stop", "src", "label", "e.*").where(F.col("dst") > F.col("src"))
    led = spread(each, *LOOP, "dst", rows=n).join(chains.hint("merge"), [*LOOP, "dst"], "left").withColumn("dst", F.coalesce("_last", "dst")).drop("_last")
    led = cut(spread(led, *LOOP, "dst", rows=n).join(closing.hint("merge"), [*LOOP, "dst"], "left"))
    left = led.where(F.col("dst") == F.col("stop")).select(*LOOP).distinct().withColumn("_left", F.lit(True))
    found = spread(led, *LOOP, rows=n).join(left.hint("merge"), LOOP, "left")
    exit_ = F.when(F.col("_left"), F.col("stop")).otherwise(F.col("end"))
    kept = found.where(F.col("_back").isNull() | (F.col("_left").isNull() & (F.col("dst") == F.col("end"))))
    return kept.select(*LOOP, "src", "dst", "label", "taken", (F.col("dst") == exit_).alias("exits")).distinct()


def exit_conditions(slices: DataFrame) -> DataFrame:
    """(method, head, id, vars): the function of the tests under which a pass from the head meets the loop's exit, and the labels it depends on.

    Since the tests come in the order of their labels along every path, the slice itself is the decision diagram,
    read from the exit up; statements that don't test are skipped by pointer jumping. A way that ends elsewhere, or goes back to
    the head, is false.
    """
    slices = cut(slices)
    tests = slices.where(F.col("label").isNotNull())
    exits = slices.where("exits").select(*LOOP, F.col("dst").alias("node")).distinct().withColumn("_exit", F.lit(True))
    plain = slices.where(F.col("label").isNull()).join(exits.select(*LOOP, F.col("node").alias("src")), [*LOOP, "src"], "left_anti")
    runs = cut(chased(plain.select(*LOOP, "src", "dst"), LOOP))
    over = runs.select(*LOOP, F.col("src").alias("_at"), F.col("dst").alias("_to"))
    led = tests.join(over, (tests.method == over.method) & (tests["head"] == over["head"]) & (tests.dst == over["_at"]), "left").select(*[tests[c] for c in LOOP], tests.src, tests.label, tests.taken, F.coalesce("_to", tests.dst).alias("to"))
    way = lambda taken: F.max(F.when(F.col("taken") == F.lit(taken), F.col("to")))
    none = F.lit(-1)
    decisions = cut(led.groupBy(*LOOP, F.col("src").alias("node")).agg(F.first("label").alias("var"), F.coalesce(way(False), none).alias("low"), F.coalesce(way(True), none).alias("high")))
    # An exit that is itself a test (of a loop with no statement after it) ends the pass.
    decisions = decisions.join(exits.drop("_exit"), [*LOOP, "node"], "left_anti")
    heads = slices.select(*LOOP).distinct()
    roots = heads.join(over.where(F.col("_at") == F.col("head")).select(*LOOP, F.col("_to").alias("node")), LOOP, "left").select(*LOOP, F.coalesce("node", "head").alias("node"))
    met = decisions.select(*LOOP, F.explode(F.array("low", "high")).alias("node")).unionByName(roots).distinct()
    ends = met.join(decisions, [*LOOP, "node"], "left_anti").join(exits, [*LOOP, "node"], "left").select(*LOOP, "node", F.when(F.col("_exit"), TRUE).otherwise(FALSE).alias("id"))
    return roots.join(reduced(decisions, ends, LOOP), [*LOOP, "node"]).select(*LOOP, "id", "vars")


def vital_branches(stmts: DataFrame, back: DataFrame) -> DataFrame:
    """(method, head, idx, label): the ifs of each loop on which leaving it depends."""
    slices = cut(loop_slices(stmts, back))
    labels = slices.where(F.col("label").isNotNull()).select(*LOOP, F.col("src").alias("idx"), "label").distinct()
    vital = exit_conditions(slices).select(*LOOP, F.explode("vars").alias("label"))
    return vital.join(labels, [*LOOP, "label"]).select(*LOOP, "idx", "label")


def inner_edges(slices: DataFrame) -> DataFrame:
    """(method, head, src, dst): a slice's edges between the loop's own statements, which all stand before its exit; none without an exit."""
    exit_ = slices.where("exits").select(*LOOP, F.col("dst").alias("_exit")).distinct()
    return slices.where(~F.col("exits")).join(exit_, LOOP).where(F.col("dst") < F.col("_exit")).select(*LOOP, "src", "dst").distinct()


def jumpers(slices: DataFrame) -> DataFrame:
    """(method, head, node): the statements from which a slice's exit is met."""
    return slices.where("exits").select(*LOOP, F.col("src").alias("node")).distinct()


def choke_conditions(slices: DataFrame) -> DataFrame:
    """(method, head, node): the condition as what is visited up to the first choke point behind all jumps to the exit.

    Statements are swept in order, in which all edges of a slice go forward. The farthest place that the ones swept so far
    lead to is a running maximum; where it is no farther than the next statement, no jump is open and that statement is
    a choke point. It belongs to the condition only if it jumps to the exit itself. A choke point is always met, the last
    statement being one.
    """
    inner, out = inner_edges(slices), jumpers(slices)
    nodes = slices.select(*LOOP, F.col("src").alias("node")).unionByName(inner.select(*LOOP, F.col("dst").alias("node"))).distinct()
    far = inner.groupBy(*LOOP, F.col("src").alias("node")).agg(F.max("dst").alias("_far"))
    swept = nodes.join(far, [*LOOP, "node"], "left").join(out.withColumn("_jumps", F.lit(True)), [*LOOP, "node"], "left")
    own = Window.partitionBy(*LOOP).orderBy("node")
    before = F.max("_far").over(own.rowsBetween(Window.unboundedPreceding, -1))
    last_jump = F.max(F.when(F.col("_jumps"), F.col("node"))).over(Window.partitionBy(*LOOP))
    swept = swept.withColumns({"_open": F.coalesce(before, F.lit(-1)) > F.col("node"), "_last": last_jump})
    choke = F.min(F.when(~F.col("_open") & (F.col("node") >= F.col("_last")), F.col("node"))).over(Window.partitionBy(*LOOP))
    swept = swept.withColumn("_choke", choke)
    return swept.where((F.col("node") < F.col("_choke")) | ((F.col("node") == F.col("_choke")) & F.col("_jumps"))).select(*LOOP, "node")


def ancestor_conditions(slices: DataFrame) -> DataFrame:
    """(method, head, node): the condition as the latest statement on all ways to the jumps to the exit, and all behind it but the head.

    That statement is the lowest common ancestor of the jumping ones in the dominator tree. Jumps that no way
    from the head meets play no part.
    """
    inner = cut(inner_edges(slices))
    roots = slices.select(*LOOP, F.col("head").alias("node")).distinct()
    alone = roots.join(inner.select(*LOOP).distinct(), LOOP, "left_anti").select(*LOOP, "node", F.lit(None).cast("int").alias("parent"))
    tree = cut(immediate_dominators(inner, roots, LOOP).select(*LOOP, "node", F.col("idom").alias("parent")).unionByName(alone).dropDuplicates([*LOOP, "node"]))
    met = jumpers(slices).join(tree, [*LOOP, "node"], "left_semi")
    first = lowest_common(tree, met, LOOP)
    ahead = inner.select(*LOOP, F.col("src").alias("node"), F.col("dst").alias("_next"))
    step = lambda at: at.join(ahead, [*LOOP, "node"]).select(*LOOP, F.col("_next").alias("node"))
    return fixpoint(first, step, [*LOOP, "node"]).where(F.col("node") != F.col("head"))


def loop_texts(stmts: DataFrame, back: DataFrame) -> DataFrame:
    """(method, head, text): each loop as the text that ``patterns`` match, what stands before it in the method included.

    ``stmts`` has (method, idx, kind, targets, text), the text being an assignment or call as written and an if's
    condition. ``head:`` stands before the loop's first statement; a jump behind its last one goes ``out``, one to the
    first to ``head``, any other to the statement's number. A text is as long as its method.
    """
    ends = back.groupBy(*LOOP).agg(F.max("latch").alias("end")).where(F.col("end") >= F.col("head"))
    own = stmts.select("method", "idx", "kind", F.get("targets", F.lit(0)).alias("to"), F.coalesce("text", F.lit("")).alias("text"))
    at = own.join(ends, "method").where(F.col("idx") <= F.col("end"))
    goal = F.when(F.col("to") > F.col("end"), "out").when(F.col("to") == F.col("head"), "head").otherwise(F.concat(F.lit("L"), F.col("to").cast("string")))
    said = F.when(F.col("kind") == "if", F.concat(F.lit("if "), F.col("text"), F.lit(" goto "), goal)).when(F.col("kind") == "goto", F.concat(F.lit("goto "), goal)).when(F.col("text") == "", F.col("kind")).otherwise(F.col("text"))
    line = F.concat(F.when(F.col("idx") == F.col("head"), "head:;").otherwise(""), said)
    return written(at.withColumn("_line", line), LOOP, ["idx"], "_line")


def identified_loops(stmts: DataFrame, back: DataFrame) -> DataFrame:
    """(method, head, loop_kind, bindings, branches): each loop's kind by its shape or, where no shape fits, by its tests.

    A loop of no known shape is ``branches`` if leaving it depends on tests, whose statements are listed, and
    ``unidentified`` if on none.
    """
    kinds = classify_loops(loop_texts(stmts, back)).select(*LOOP, "loop_kind", "bindings")
    tests = vital_branches(stmts, back).groupBy(*LOOP).agg(F.array_sort(F.collect_list("idx")).alias("_tests"))
    met = kinds.join(tests, LOOP, "left")
    open_ = F.col("loop_kind") == "unidentified"
    kind = F.when(open_ & F.col("_tests").isNotNull(), "branches").otherwise(F.col("loop_kind"))
    return met.select(*LOOP, kind.alias("loop_kind"), "bindings", F.when(open_, F.col("_tests")).alias("branches"))
