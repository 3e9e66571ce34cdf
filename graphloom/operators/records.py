"""Record tools: integrity checks, summaries, coverage, and positional columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut


def missing_successor(states: DataFrame, key: Sequence[str], index: str, is_call: Column) -> DataFrame:
    """Call states that no state follows: none at the same key with the next index."""
    next_ = states.select(*key, (F.col(index) - 1).alias(index)).distinct()
    return states.where(is_call).join(next_, [*key, index], "left_anti").select(*states.columns)


def _known_ends(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """``edges`` with _known: whether both ends are nodes."""
    known = nodes.select(F.col(node).alias("_id")).distinct()
    out = edges
    for end in ("src", "dst"):
        out = out.join(known.select(F.col("_id").alias(f"_{end}_id")), F.col(end) == F.col(f"_{end}_id"), "left")
    return out.withColumn("_known", F.col("_src_id").isNotNull() & F.col("_dst_id").isNotNull()).select(*edges.columns, "_known")


def hanging_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges with an end that is no node."""
    return _known_ends(edges, nodes, node).where(~F.col("_known")).select(*edges.columns)


def missing_refs(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """(node, refs): ids that edges name but that are no node, and how often; both ends count."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.join(nodes.select(F.col(node).alias("node")), "node", "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("refs"))


def add_missing(edges: DataFrame, nodes: DataFrame, node: str = "id", kind: str = "kind") -> DataFrame:
    """Nodes with a placeholder of kind ``missing`` for each id that edges name without one."""
    extra = missing_refs(edges, nodes, node).select(F.col("node").alias(node), F.lit("missing").alias(kind))
    return nodes.unionByName(extra, allowMissingColumns=True)


def drop_missing(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Edges with both ends among the nodes."""
    return _known_ends(edges, nodes, node).where("_known").select(*edges.columns)


def info(edges: DataFrame, nodes: DataFrame, node: str = "id", seq: str = "seq") -> DataFrame:
    """One row: distinct nodes, edges, missing ids, their references, hanging edges and the first node in the stream."""
    refs = missing_refs(edges, nodes, node).agg(F.count(F.lit(1)).alias("n_missing"), F.coalesce(F.sum("refs"), F.lit(0)).alias("n_references"))
    ends = _known_ends(edges, nodes, node).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(~F.col("_known")).alias("n_hanging"))
    first = nodes.agg(F.countDistinct(node).alias("n_nodes"), F.min_by(node, seq).alias("first_node"))
    parts = [first, ends, refs]
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.unionByName(part, allowMissingColumns=True)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])


def concat(*streams: DataFrame, seq: str = "seq") -> DataFrame:
    """The streams after each other: rows keep their order, as (stream, seq)."""
    out = None
    for i, stream in enumerate(streams):
        part = stream.withColumn("stream", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def resolve_ends(edges: DataFrame, nodes: DataFrame, node: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): edges with both ends known, and the others."""
    return drop_missing(edges, nodes, node), hanging_edges(edges, nodes, node)


def coverage(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, side): both, left or right, for every key of either table."""
    a = left.select(*key).distinct().withColumn("_left", F.lit(True))
    b = right.select(*key).distinct().withColumn("_right", F.lit(True))
    side = F.when(F.col("_left") & F.col("_right"), "both").when(F.col("_left"), "left").otherwise("right")
    return a.join(b, list(key), "full_outer").select(*key, side.alias("side"))


def coverage_summary(compared: DataFrame) -> DataFrame:
    """One row: keys on both sides and on one, and the shares of either side that both have."""
    n = lambda s: F.count_if(F.col("side") == s)
    share = lambda s: F.when(n("both") + n(s) > 0, F.round(n("both") / (n("both") + n(s)), 4)).otherwise(F.lit(0.0))
    return compared.agg(n("both").alias("n_both"), n("left").alias("n_left"), n("right").alias("n_right"), share("left").alias("left_share"), share("right").alias("right_share"))


def kind_counts(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n, percent) with the percentage to two places."""
    counted = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def neighbours(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column], of: str) -> DataFrame:
    """``rows`` with number (from 0), previous and next ``of`` in order within the key."""
    own = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({"number": F.row_number().over(own) - 1, "previous": F.lag(of).over(own), "next": F.lead(of).over(own)})


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; only the winner leaves a partition."""
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def first_of_kind(rows: DataFrame, kind: str, order: Sequence[str]) -> DataFrame:
    """The first row of each kind."""
    values = [c for c in rows.columns if c != kind]
    return rows.groupBy(kind).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_row")).select(kind, "_row.*").select(*rows.columns)


def dense_ids(rows: DataFrame, key: str, name: str = "id", start: int = 1) -> DataFrame:
    """(key, name): ids without gaps in order of the key, by a sort over ranges and the ranges' sizes."""
    spread = rows.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    # Kept once: the ranges' bounds are sampled, and both uses below must see the same.
    inside = cut(spread.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(key))))
    sizes = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return inside.join(before, "_part").select(key, (F.col("_before") + F.col("_at") - 1 + start).cast("long").alias(name))


def cycle_pairs(paths: DataFrame, key: Sequence[str], order: Sequence[str], node: str) -> DataFrame:
    """(key, src, dst): each node with the next on its path, the last with the first."""
    own = Window.partitionBy(*key).orderBy(*order)
    first = F.first(node).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return paths.select(*key, F.col(node).alias("src"), F.coalesce(F.lead(node).over(own), first).alias("dst"))


def in_all_paths(paths: DataFrame, key: Sequence[str], path: str, node: str) -> DataFrame:
    """(key, node): nodes on every path of a key (relational division)."""
    wanted = paths.groupBy(*key).agg(F.countDistinct(path).alias("_all"))
    return paths.groupBy(*key, node).agg(F.countDistinct(path).alias("_n")).join(wanted, list(key)).where(F.col("_n") == F.col("_all")).select(*key, node)


def method_coverage(seen: DataFrame, app: DataFrame, called: DataFrame, key: str = "method") -> DataFrame:
    """One row: methods seen and in the app, seen only, app only, called but unseen, and seen of those called in percent."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    all_ = mark(seen, "s").join(mark(app, "a"), key, "full_outer").join(mark(called, "c"), key, "full_outer")
    s, a, c = (F.col(x).isNotNull() for x in "sac")
    both, wanted = F.count_if(s & a), F.count_if(a & c)
    return all_.agg(both.alias("seen_app"), F.count_if(s & ~a).alias("seen_only"), F.count_if(a & ~s).alias("app_only"), F.count_if(c & ~s).alias("called_unseen"), F.when(wanted > 0, F.round(100.0 * both / wanted, 2)).otherwise(F.lit(0.0)).alias("percent"))


def uncovered_statements(statements: DataFrame, covered: DataFrame, method: str = "method", index: str = "idx") -> DataFrame:
    """(method, first, last, n): the statements of methods seen at all that no state covers."""
    known = covered.select(method).distinct()
    left = statements.join(known, method, "left_semi").join(covered.select(method, index).distinct(), [method, index], "left_anti")
    return left.groupBy(method).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"))


def visible_at(log: DataFrame, version: int, key: str = "id") -> DataFrame:
    """(key): what is hidden at a version of an append-only log of (version, op, key), op hide or show; later entries win."""
    now = log.where(F.col("version") <= version).groupBy(key).agg(F.max_by("op", "version").alias("op"))
    return now.where("op = 'hide'").select(key)


def first_match(rows: DataFrame, rules: DataFrame, text: str, default: bool = True) -> DataFrame:
    """``rows`` with ``included``: the include flag of the first rule (ord, include, pattern) whose pattern the text matches.

    The rules are a list that a user wrote. Up to a thousand patterns and flags become one conditional expression;
    longer lists are one array, whose first match counts.
    """
    listed = rules.orderBy("ord").collect()
    if len(listed) > 1000:
        texts = F.from_json(F.lit(json.dumps([[r["pattern"], str(r["include"]).lower()] for r in listed])), "array<array<string>>")
        first = F.get(F.filter(texts, lambda r: F.regexp_like(F.col(text), r[0])), F.lit(0))
        return rows.withColumn("included", F.coalesce(first[1].cast("boolean"), F.lit(default)))
    out = F.lit(default)
    for rule in reversed(listed):
        out = F.when(F.col(text).rlike(rule["pattern"]), F.lit(rule["include"])).otherwise(out)
    return rows.withColumn("included", out)


def pieces(begin: Column, end: Column) -> Column:
    """The array of (level, piece) that make up begin <= n < end: 2 ** level numbers from piece * 2 ** level on, two a level at most."""
    low = lambda k: -F.call_function("shiftright", -begin.cast("long"), k)
    high = lambda k: F.call_function("shiftright", end.cast("long"), k)
    odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1
    piece = lambda k, at, where: F.when(where & (low(k) < high(k)), F.struct(k.alias("level"), at.alias("piece")))
    # No piece is longer than the range, so a short one asks for few levels.
    top = F.least(F.coalesce(F.length(F.bin(F.try_subtract(end.cast("long"), begin.cast("long")))) - 1, F.lit(62)), F.lit(62))
    each = F.transform(F.sequence(F.lit(0), top), lambda k: F.array(piece(k, low(k), odd(low(k))), piece(k, high(k) - 1, odd(high(k)))))
    return F.filter(F.flatten(each), lambda p: p.isNotNull())


def in_pieces(points: DataFrame, at: str, cut_: DataFrame) -> DataFrame:
    """``points`` with _level and _piece: the piece that holds the place, at each level that ``cut_`` has."""
    used = sorted(r["_level"] for r in cut_.select("_level").distinct().collect())  # 63 at most
    dealt = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>")))
    return dealt.withColumn("_piece", F.call_function("shiftright", F.col(at).cast("long"), F.col("_level")))


def in_own_pieces(ranges: DataFrame, begin: str, end: str) -> DataFrame:
    """``ranges`` with _level and _piece, a row for each of their pieces, kept for several uses by ``covering``."""
    return cut(ranges.withColumn("_p", F.explode(pieces(F.col(begin), F.col(end)))).select(*ranges.columns, F.col("_p.level").alias("_level"), F.col("_p.piece").alias("_piece")))


def covering(points: DataFrame, ranges: DataFrame, key: Sequence[str], at: str, begin: str, end: str) -> DataFrame:
    """(key, at, the other columns of ``ranges``): each place of ``points``, once, with every range of its key that has begin <= at < end.

    at, begin and end are whole numbers. A place is in one piece of each level, a range is made of pieces of its own,
    so both meet by equality of key, level and piece, and a key with very many places and ranges is as many join keys as
    they have pieces. ``ranges`` may come from ``in_own_pieces``.
    """
    cut_ = ranges if "_piece" in ranges.columns else in_own_pieces(ranges, begin, end)
    spots = points.select(*key, at).distinct().dropna()
    return in_pieces(spots, at, cut_).join(cut_, [*key, "_level", "_piece"]).drop("_level", "_piece")


def range_first(points: DataFrame, ranges: DataFrame, key: Sequence[str], at: str, begin: str, end: str, order: str, keep: Sequence[str]) -> DataFrame:
    """``points`` with the columns ``keep`` of the first range (by ``order``) of the same key with begin <= at < end, if any."""
    best = covering(points, ranges, key, at, begin, end).groupBy(*key, at).agg(F.min_by(F.struct(*keep), order).alias("_hit"))
    return points.join(best, [*key, at], "left").select(*points.columns, *[F.col(f"_hit.{k}").alias(k) for k in keep])


def zip_positions(rows: DataFrame, key: Sequence[str], left: str, right: str) -> DataFrame:
    """(key, pos, left, right): the elements of two arrays by position, as long as both have one."""
    return rows.select(*key, F.posexplode(F.arrays_zip(left, right)).alias("pos", "_pair"), F.least(F.size(left), F.size(right)).alias("_n")).where(F.col("pos") < F.col("_n")).select(*key, "pos", F.col(f"_pair.{left}").alias(left), F.col(f"_pair.{right}").alias(right))
