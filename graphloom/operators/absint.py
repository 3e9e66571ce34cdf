"""Abstract interpretation as rules: a store of (addr, value) pairs that grows to a fixpoint.

The powersets of the abstract domain are unnested, so joining is a union and the delta what an anti-join leaves.
Addresses are variables ``method/name``; values are abstract objects (class and allocation site). Facts:

alloc (var, object, class), copies (src, dst), loads (var, base, field): var = base.field,
stores (base, field, var): base.field = var, calls (site, method, base, subsig, args, result, kind, callee),
methods (method, class, subsig, params, this, returns), models (method, kind, class): library methods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut
from graphloom.plans.fixpoint import NotConverged
from graphloom.plans.sizes import spread

TOP = "any"


@dataclass
class Facts:
    alloc: DataFrame
    copies: DataFrame
    loads: DataFrame
    stores: DataFrame
    calls: DataFrame
    methods: DataFrame
    dispatch: DataFrame  # (class, subsig, method): the method that an object of the class runs
    models: DataFrame | None = None


def _field(obj: str, field: str):
    return F.concat_ws(".", F.col(obj), F.col(field))


def modelled(facts: Facts) -> DataFrame:
    """(addr, value) from library models: the result of a modelled call is any value, an object or an array of a class."""
    if facts.models is None:
        return facts.alloc.select(F.col("var").alias("addr"), F.col("object").alias("value")).limit(0)
    met = facts.calls.join(facts.models, facts.calls.callee == facts.models.method).where(F.col("result").isNotNull())
    made = F.when(F.col("kind_") == "top", TOP).when(F.col("kind_") == "object", F.concat_ws("@", "class", "site")).when(F.col("kind_") == "array", F.concat_ws("@", F.concat("class", F.lit("[]")), "site"))
    return met.select("result", facts.models["kind"].alias("kind_"), facts.models["class"].alias("class"), "site").select(F.col("result").alias("addr"), made.alias("value")).where("value is not null")


def run(facts: Facts, entries: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(store, call_edges): (addr, value), and (site, method) of the calls that can be made from the entry methods.

    Each round carries the new pairs along the flows, and the pairs of both ends along new flows. Flows come
    from copies of reached methods, from loads and stores at objects that the base may newly be, and from calls
    to the methods that those objects run; static calls flow at once. Raises if the rounds run out.
    """
    methods = facts.methods
    all_classes = facts.alloc.select(F.col("object").alias("value"), "class").distinct()
    if facts.models is not None:
        made = modelled(facts).select("value", F.regexp_replace("value", "@.*$", "").alias("class"))
        all_classes = all_classes.unionByName(made).distinct()
    all_classes = cut(all_classes)
    owner = lambda var: F.substring_index(F.col(var), "/", 1)

    def bind(calls: DataFrame) -> DataFrame:
        """(src, dst) flows of argument to parameter and return to result, of (site, method) calls."""
        made = calls.join(facts.calls.drop("method"), "site").join(methods, "method")
        args = made.select(F.explode(F.arrays_zip("args", "params")).alias("p")).select(F.col("p.args").alias("src"), F.col("p.params").alias("dst"))
        back = made.where(F.col("result").isNotNull()).select(F.explode("returns").alias("src"), F.col("result").alias("dst"))
        return args.unionByName(back).dropna()

    known_methods = cut(entries.select("method").distinct())
    new_methods = known_methods
    store = flows = edges = None
    delta = None
    size = facts.copies.count() + facts.alloc.count()  # what rounds are dealt by: pairs and flows known so far
    for _ in range(max_rounds):
        in_new = lambda df, var: df.join(new_methods.select(F.col("method").alias("_m")), owner(var) == F.col("_m"), "left_semi")  # noqa: B023, E731
        seeds = in_new(facts.alloc.select(F.col("var").alias("addr"), F.col("object").alias("value")).unionByName(modelled(facts)), "addr")
        found = in_new(facts.copies.select("src", "dst"), "dst")
        static = in_new(facts.calls.where(F.col("kind") == "static").select("site", F.col("callee").alias("to"), F.col("method").alias("at")).withColumn("_var", F.concat(F.col("at"), F.lit("/"))), "_var").select("site", F.col("to").alias("method"))
        if store is not None:
            at = delta  # loads, stores and calls don't wait for their method, so the bases' new values are enough
            found = found.unionByName(facts.loads.join(at.withColumnRenamed("addr", "base"), "base").select(_field("value", "field").alias("src"), F.col("var").alias("dst")))
            found = found.unionByName(facts.stores.join(at.withColumnRenamed("addr", "base"), "base").select(F.col("var").alias("src"), _field("value", "field").alias("dst")))
            virtual = facts.calls.where(F.col("kind") != "static").withColumnRenamed("method", "at").join(at.withColumnRenamed("addr", "base"), "base").join(all_classes, "value").join(facts.dispatch, ["class", "subsig"])
            run_ = virtual.select("site", "method").distinct()
            this = virtual.join(methods.select("method", "this"), "method").where(F.col("this").isNotNull()).select(F.col("this").alias("addr"), "value")
            static, seeds = static.unionByName(run_), seeds.unionByName(this)
        new_edges = static.dropna().distinct()
        new_edges = cut(new_edges if edges is None else new_edges.join(edges, ["site", "method"], "left_anti"))
        edges = new_edges if edges is None else cut(edges.unionByName(new_edges))
        found = spread(found.unionByName(bind(new_edges)).dropna(), "src", "dst", rows=size).distinct()
        new_flows = cut(found if flows is None else found.join(flows, ["src", "dst"], "left_anti"))
        flows = new_flows if flows is None else cut(flows.unionByName(new_flows))
        moved = seeds
        if store is not None:
            moved = moved.unionByName(spread(store, "addr", rows=size).join(new_flows, store.addr == new_flows.src).select(F.col("dst").alias("addr"), "value"))
            moved = moved.unionByName(spread(delta, "addr", rows=size).join(flows, delta.addr == flows.src).select(F.col("dst").alias("addr"), "value"))
        moved = spread(moved.dropna(), "addr", "value", rows=size).distinct()
        delta = cut(moved if store is None else moved.join(store, ["addr", "value"], "left_anti"))
        store = delta if store is None else cut(store.unionByName(delta))
        size = store.count() + flows.count()
        new_methods = cut(new_edges.select("method").distinct().join(known_methods, "method", "left_anti"))
        known_methods = cut(known_methods.unionByName(new_methods))
        if delta.isEmpty() and new_methods.isEmpty() and new_flows.isEmpty():
            return store, edges
    raise NotConverged(f"the store still grows after {max_rounds} rounds")


def joined(store: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, news): the union of two tables of (addr, value), and what of the second is new."""
    news = delta.distinct().join(store, ["addr", "value"], "left_anti")
    return store.unionByName(news), news


def readers(news: DataFrame, reads: DataFrame) -> DataFrame:
    """(state): states to evaluate again: those that read (state, addr) an address with news."""
    return reads.join(news.select("addr").distinct(), "addr", "left_semi").select("state").distinct()


def overwritten(store: DataFrame, strong: DataFrame) -> DataFrame:
    """The store with all values of the updated addresses replaced (strong update)."""
    return store.join(strong.select("addr").distinct(), "addr", "left_anti").unionByName(strong.select("addr", "value").distinct())


def undefined(states_reads: DataFrame, store: DataFrame) -> DataFrame:
    """(state, addr) of reads at addresses without a value."""
    return states_reads.join(store.select("addr").distinct(), "addr", "left_anti").select("state", "addr")


def of_type(values: DataFrame, wanted: DataFrame, subtype: DataFrame) -> DataFrame:
    """(addr, value) whose class is a subtype of the address's wanted one, and all that may be anything."""
    atomic = values.where(F.col("value") == TOP)
    fits = wanted.join(subtype.select(F.col("super").alias("wanted"), "class"), "wanted").select("addr", "class")
    return atomic.select("addr", "value").unionByName(values.join(fits, ["addr", "class"], "left_semi").select("addr", "value"))
