"""Program facts: class hierarchies, dispatch, flow graphs and call graphs.

Tables: classes (name, super_name, interfaces, origin), methods (class, subsig, …), stmts (method, idx, kind,
targets, default_target), calls (method, stmt, class, subsig, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.reach import dealt, nodes, reachable, reachable_pairs
from graphloom.operators.records import covering, in_own_pieces
from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import fixpoint
from graphloom.plans.sizes import fits, small_side, spread


def supers(classes: DataFrame) -> DataFrame:
    """(class, super): each class with its superclass and interfaces."""
    above = F.explode(F.array_union(F.array("super_name"), F.coalesce("interfaces", F.array().cast("array<string>"))))
    return classes.select(F.col("name").alias("class"), above.alias("super")).where(F.col("super").isNotNull())


def subtypes(above: DataFrame) -> DataFrame:
    """(class, super): every class with itself and all above it, from (class, super)."""
    edges = above.select(F.col("class").alias("src"), F.col("super").alias("dst"))
    closed = reachable_pairs(edges).select(F.col("src").alias("class"), F.col("dst").alias("super"))
    # No class is above itself but on a cycle, so only what the closure lacks is added.
    own = nodes(edges).select(F.col("node").alias("class"), F.col("node").alias("super"))
    return closed.unionByName(own.join(closed.where("class = super").hint("merge"), ["class", "super"], "left_anti"))


def subtypes_of(above: DataFrame, supers: DataFrame) -> DataFrame:
    """(class, super) as ``subtypes``, but only the pairs under the classes ``supers`` (super), with themselves; a round a level below them."""
    wanted = cut(supers.select(F.col("super").alias("class"), "super").dropna().distinct())
    down = dealt(above.select("class", "super").dropna().distinct().select(F.col("super").alias("class"), F.col("class").alias("_below")), ["class"])
    step = lambda at: at.join(down.hint("merge"), "class").select(F.col("_below").alias("class"), "super")
    found = fixpoint(wanted, step, ["class", "super"])
    down.unpersist()
    return found


def supers_of(above: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, super) as ``subtypes``, but only of the classes (class), with themselves; a round a level above them."""
    up = above.select(F.col("class").alias("super"), F.col("super").alias("_up")).dropna().distinct()
    up = cut(up).hint("merge")  # not sent to the driver in every round
    step = lambda at: at.join(up, "super").select("class", F.col("_up").alias("super"))
    return fixpoint(classes.select("class", F.col("class").alias("super")), step, ["class", "super"])


def class_closure(above: DataFrame, start: DataFrame) -> DataFrame:
    """(node): the start classes (node) and all above them."""
    return reachable(above.select(F.col("class").alias("src"), F.col("super").alias("dst")), start, include_seed=True)


def cha_targets(calls: DataFrame, methods: DataFrame, subtype: DataFrame) -> DataFrame:
    """``calls`` with ``target``: the class of each method that a call may reach by class hierarchy analysis.

    A virtual call reaches the declarations of its subsignature in all subtypes of the receiver's class; a
    call of kind static or special that of the class itself.
    """
    exact = F.col("kind").isin("static", "special")
    declared = methods.select(F.col("class").alias("target"), "subsig").distinct()
    down = subtype.select(F.col("super").alias("class"), F.col("class").alias("target"))
    n = calls.count()
    # Only classes that declare a call's subsignature are met: subtypes are joined with declarations first.
    below = declared.join(spread(down, "target", rows=n).hint("merge"), "target")
    virtual = spread(calls.where(~exact), "class", "subsig", rows=n).join(below.hint("merge"), ["class", "subsig"])
    direct = calls.where(exact).join(declared.withColumn("class", F.col("target")), ["class", "subsig"])
    return virtual.select(*calls.columns, "target").unionByName(direct.select(*calls.columns, "target"))


def nearest_override(methods: DataFrame, above: DataFrame) -> DataFrame:
    """(class, subsig, target): for each method the nearest declarations above it; each path up stops at its first."""
    declared = methods.select("class", "subsig").distinct()
    here = declared.withColumnsRenamed({"class": "target"}).withColumn("_hit", F.lit(True))
    up = above.select(F.col("class").alias("target"), F.col("super").alias("_up"))
    up, here = cut(up).hint("merge"), cut(here).hint("merge")  # neither is sent to the driver in every round
    climb = lambda at: at.join(up, "target").select("class", "subsig", F.col("_up").alias("target"))
    step = lambda at: climb(at.join(here, ["target", "subsig"], "left_anti"))
    walked = fixpoint(climb(declared.withColumn("target", F.col("class"))), step, ["class", "subsig", "target"])
    return walked.join(here, ["target", "subsig"], "left_semi").select("class", "subsig", "target")


def override_chain(methods: DataFrame, above: DataFrame) -> DataFrame:
    """(class, subsig, target, depth): the declarations of a method in the superclasses, the class itself first."""
    up = cut(above.select(F.col("class").alias("target"), F.col("super").alias("_up"))).hint("merge")
    step = lambda at: at.join(up, "target").select("class", F.col("_up").alias("target"), (F.col("depth") + 1).alias("depth"))
    start = methods.select("class").distinct().select("class", F.col("class").alias("target"), F.lit(0).alias("depth"))
    line = fixpoint(start, step, ["class", "target", "depth"])
    declared = methods.select("class", "subsig").distinct()
    theirs = declared.withColumnRenamed("class", "target").hint("merge")
    return line.join(declared.hint("merge"), "class").join(theirs, ["target", "subsig"], "left_semi").select("class", "subsig", "target", "depth")


def flow_edges(stmts: DataFrame) -> DataFrame:
    """(method, src, dst): successors by kind. None for return and throw; the target for goto; default and targets
    for switch; fall-through and targets for if; else fall-through."""
    stmts = stmts.withColumn("_after", F.lead("idx").over(Window.partitionBy("method").orderBy("idx")))
    falls = ~F.col("kind").isin("return", "return_void", "throw", "goto", "switch")
    ends = F.concat(F.coalesce("targets", F.array().cast("array<int>")), F.array(F.col("default_target")), F.array(F.when(falls, F.col("_after"))))
    return stmts.select("method", F.col("idx").alias("src"), F.explode(ends).alias("dst")).where(F.col("dst").isNotNull()).distinct()


def app_calls(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """Calls (src_class, dst_class, …) between classes of origin APP."""
    app = classes.where("origin = 'APP'").select(F.col("name").alias("_c"))
    out = calls
    for end in ("src_class", "dst_class"):
        out = out.join(app.withColumnRenamed("_c", end), end, "left_semi")
    return out.select(*calls.columns)


def unknown_targets(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """(dst_class, n_callers, n_calls): the classes that calls (src_class, dst_class) name and ``classes`` (name) lacks, with how many classes call them."""
    missing = calls.join(classes.select(F.col("name").alias("dst_class")), "dst_class", "left_anti")
    per = missing.groupBy("dst_class", "src_class").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("dst_class").agg(F.count(F.lit(1)).alias("n_callers"), F.sum("n").alias("n_calls"))


def call_origins(calls: DataFrame, classes: DataFrame) -> DataFrame:
    """(src_origin, dst_origin, n) of calls; origin null for unknown classes."""
    named = classes.select(F.col("name").alias("_c"), F.col("origin").alias("_o"))
    out = calls
    for end in ("src", "dst"):
        out = out.join(named.withColumnsRenamed({"_c": f"{end}_class", "_o": f"{end}_origin"}), f"{end}_class", "left")
    return out.groupBy("src_origin", "dst_origin").agg(F.count(F.lit(1)).alias("n"))


def call_closure(calls: DataFrame, main: DataFrame) -> DataFrame:
    """(node): methods reached from main methods over (caller, callee)."""
    return reachable(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), main, include_seed=True)


def app_through_library(calls: DataFrame, library: DataFrame, level: int = 1) -> DataFrame:
    """(src, dst): app methods reached from each library method over at most ``level`` + 1 calls, the inner ones of the library."""
    own = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    lib = library.select(F.col("node").alias("dst")).distinct()
    at = own.join(lib.withColumnRenamed("dst", "src"), "src", "left_semi")
    found = at.join(lib, "dst", "left_anti").select("src", "dst")
    for _ in range(level):
        inner = at.join(lib, "dst", "left_semi")
        at = inner.select("src", F.col("dst").alias("_m")).join(own.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct()
        found = found.unionByName(at.join(lib, "dst", "left_anti").select("src", "dst"))
    return found.distinct()


def supergraph(flow: DataFrame, targets: DataFrame, stmts: DataFrame) -> DataFrame:
    """(src, dst, kind) over statements (method, idx): flow within methods, calls to entries, returns after calls.

    ``targets`` is (method, idx, callee). Falling through a call stays, as the flow graph has it.
    """
    at = lambda m, i: F.struct(F.col(m).alias("method"), F.col(i).alias("idx"))
    n = stmts.count()
    targets = spread(targets, "callee", rows=n)
    within = flow.select(at("method", "src").alias("src"), at("method", "dst").alias("dst"), F.lit("flow").alias("kind"))
    entry = stmts.groupBy(F.col("method").alias("callee")).agg(F.min("idx").alias("_first"))
    call = targets.join(entry.hint("merge"), "callee").select(at("method", "idx").alias("src"), at("callee", "_first").alias("dst"), F.lit("call").alias("kind"))
    leaves = stmts.where(F.col("kind").isin("return", "return_void")).select(F.col("method").alias("callee"), F.col("idx").alias("_last"))
    after = spread(flow.select("method", F.col("src").alias("idx"), F.col("dst").alias("_next")), "method", "idx", rows=n)
    back = targets.join(leaves.hint("merge"), "callee").join(after.hint("merge"), ["method", "idx"]).select(at("callee", "_last").alias("src"), at("method", "_next").alias("dst"), F.lit("return").alias("kind"))
    return spread(within.unionByName(call).unionByName(back), "src", "dst", "kind", rows=3 * n).distinct()


TRAP = ("method", "begin_idx", "end_idx", "exception", "ord", "handler_idx")


def handlers(stmts: DataFrame, traps: DataFrame, subtype: DataFrame) -> DataFrame:
    """(method, idx, thrown, handler_idx): the first trap in table order that covers the statement and takes the type.

    ``stmts`` has a column thrown; where no trap does, the handler is null and the caller unwinds.
    """
    thrown = stmts.select("method", "idx", "thrown")
    covered = covering(thrown, traps if "_piece" in traps.columns else traps.select(*TRAP), ["method"], "idx", "begin_idx", "end_idx")
    fits = subtype.select(F.col("class").alias("thrown"), F.col("super").alias("exception"))
    met = thrown.distinct().join(covered.hint("merge"), ["method", "idx"]).join(fits.hint("merge"), ["thrown", "exception"])
    first = met.groupBy("method", "idx", "thrown").agg(F.min_by("handler_idx", "ord").alias("handler_idx"))
    return thrown.join(first, ["method", "idx", "thrown"], "left")


def _longer_ways(calls: DataFrame, doublings: int = 2, most: int = 8) -> DataFrame:
    """(callee, method, _taken): ``calls`` and, as long as they are ``most`` times as many at the most, ways over two, then up to four calls, with what is taken on the way."""
    ways = cut(calls.distinct())
    n = most * ways.count()
    for _ in range(doublings):
        on = ways.select(F.col("callee").alias("method"), F.col("method").alias("_on"), F.col("_taken").alias("_more"))
        longer = ways.join(on.hint("merge"), "method").select("callee", F.col("_on").alias("method"), F.array_sort(F.array_union("_taken", "_more")).alias("_taken"))
        if not fits(longer, n):
            break
        ways = cut(ways.unionByName(longer).distinct())
    return ways


def unwound(thrown: DataFrame, calls: DataFrame, traps: DataFrame, subtype: DataFrame) -> DataFrame:
    """(method, idx, thrown, handler_idx): where exceptions arrive, and the handler that takes them there.

    They arrive at their statement (method, idx, thrown) and, where no trap takes them, at the statements (method,
    idx, callee) that call the method; each statement once for a type, so recursion ends. A null handler at a
    statement of a method that nothing calls is an error of the program.

    What the traps over a statement take is found once, before the rounds; these only tell which types leave which
    called methods, and go up to four calls at a time. The handlers where the types arrive come at the end, all at once.
    """
    start = cut(thrown.select("method", "idx", "thrown").dropna().distinct())
    calls = cut(calls.select("method", "idx", "callee").dropna().distinct())
    traps = in_own_pieces(traps.select(*TRAP), "begin_idx", "end_idx")
    # Types only travel: what is above those thrown at the start is all that the rounds ask for.
    types = small_side(cut(start.select(F.col("thrown").alias("class")).distinct()))
    subtype = cut(subtype.select("class", "super").join(types, "class", "left_semi"))
    above = small_side(cut(subtype.groupBy(F.col("class").alias("thrown")).agg(F.collect_set("super").alias("_above"))))
    sites = start.select("method", "idx").unionByName(calls.select("method", "idx")).distinct()
    taken = cut(covering(sites, traps, ["method"], "idx", "begin_idx", "end_idx").groupBy("method", "idx").agg(F.array_sort(F.collect_set("exception")).alias("_taken")))
    at = lambda df: df.join(taken.hint("merge"), ["method", "idx"], "left").withColumn("_taken", F.coalesce("_taken", F.array().cast(dict(taken.dtypes)["_taken"])))
    free = lambda df: df.join(above, "thrown", "left").where(~F.coalesce(F.arrays_overlap("_taken", "_above"), F.lit(False)))
    # What leaves a method matters only where something calls it.
    called = calls.select(F.col("callee").alias("method")).distinct().hint("merge")
    ways = _longer_ways(at(calls.join(called, "method", "left_semi")).select("callee", "method", "_taken"))
    callers = dealt(ways.select(F.col("callee").alias("_m"), F.col("method").alias("_caller"), "_taken"), ["_m"])
    step = lambda gone: free(gone.withColumnRenamed("method", "_m").join(callers.hint("merge"), "_m")).select(F.col("_caller").alias("method"), "thrown")
    left = fixpoint(free(at(start.join(called, "method", "left_semi"))), step, ["method", "thrown"])
    met = calls.join(left.withColumnRenamed("method", "callee").hint("merge"), "callee").select("method", "idx", "thrown")
    out = handlers(cut(start.unionByName(met).distinct()), traps, subtype)
    callers.unpersist()
    return out


def registry(class_files: DataFrame) -> DataFrame:
    """Class files with the last of each name."""
    from graphloom.operators.records import last_wins

    return last_wins(class_files, ["name"], ["seq"])


def return_sites(returning: DataFrame, calls: DataFrame, library: Column) -> DataFrame:
    """(method, caller, site): where each method (method) returns to: its explicit calls (caller, site, callee, explicit) by callers that ``library`` doesn't hold of."""
    made = calls.where(F.col("explicit") & ~library).select("caller", "site", F.col("callee").alias("method"))
    return made.join(returning.select("method").distinct(), "method", "left_semi").select("method", "caller", "site")


def units_of(classes: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with the code of their unit (class, code), units of no known class)."""
    return classes.join(units.select("class", "code"), "class"), units.join(classes, "class", "left_anti")


def overrides_of(methods: DataFrame, above: DataFrame) -> DataFrame:
    """(class, subsig, target, depth): what each method overrides, nearest first: no static or private methods, no constructors,
    and package-private ones only within their package. ``methods`` has (class, package, subsig, static, access)."""
    able = methods.where(~F.col("static") & (F.col("access") != "private") & ~F.startswith("subsig", F.lit("<")))
    own = able.select("class", "subsig", F.col("package").alias("_own"))
    chain = override_chain(able, above).where("depth > 0").join(own.hint("merge"), ["class", "subsig"])
    theirs = able.select(F.col("class").alias("target"), "subsig", "package", "access")
    open_ = (F.col("access") != "package") | (F.col("package") == F.col("_own"))
    return chain.join(theirs.hint("merge"), ["target", "subsig"]).where(open_).select("class", "subsig", "target", "depth")


def counts(classes: DataFrame, methods: DataFrame, stmts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: the numbers of classes, methods, statements and call targets."""
    each = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k, df in (("classes", classes), ("methods", methods), ("statements", stmts), ("targets", targets))]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return rows.agg(*[F.max(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in ("classes", "methods", "statements", "targets")])


def assignees(stmts: DataFrame) -> DataFrame:
    """(method, lhs): the different places that a method's assignments write."""
    return stmts.where("kind = 'assign'").select("method", "lhs").dropna().distinct()
