"""A Merkle manifest of a table: a hash tree a source, one over the sources, and every row's proof. Spark functions only.

Nodes have coordinates (part, level, idx); at each level ``FAN`` consecutive ones are a run and become one node above.
A node's siblings follow from its index and its level's size alone, and are looked up in the stored node table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, part: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the place within the part in ``order`` from 0, and ``n``, the part's rows.

    Sorted once over all tasks and stored; the runs of a part that tasks hold are counted and added up, so a
    part of any size is spread over as many tasks as its rows take.
    """
    sorted_ = stored(rows.repartitionByRange(part, *order).sortWithinPartitions(part, *order).withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    task = F.shiftright("_at", 33)
    runs = sorted_.groupBy(part, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(part)
    runs = runs.select(part, "_task", "_first", (F.sum("_rows").over(own.orderBy("_task")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(own).alias("n"))
    placed = sorted_.withColumn("_task", task).join(small_side(runs), [part, "_task"])
    return stored(placed.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_first", "_before"), f"{name}-numbered")


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda x: F.lower(F.hex(x))), "")


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The node table from (part, idx, n, digest) up: one stored table of the same columns a level.

    A part ends at the level where one node is left; that node is its root.
    """
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = found[-1].where("n > 1").groupBy("part", "n", F.expr(f"idx div {FAN}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("at"), "digest"))).alias("run"))  # 16 at most
        above = runs.select("part", "idx", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.unhex(F.sha2(_joined(F.col("run.digest")), 256)).alias("digest"))
        found.append(stored(above, f"{name}-level"))
        most = -(-most // FAN)
    return found


def roots(tables: list[DataFrame]) -> DataFrame:
    """(part, digest) of each part's root."""
    tops = [t.where("n = 1").select("part", "digest") for t in tables]
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionAll(t)
    return whole


def siblings(nodes: DataFrame, more: list[str]) -> DataFrame:
    """(part, over, idx, left, right, *more): the digests of each node's run before and after it, for parts of several nodes.

    Every node explodes the coordinates of its run and looks them up among the level's nodes, its own row for
    the columns in ``more``; a node is asked for by sixteen at most. ``over`` is the run's node above, by which
    the rows are dealt, so that what lies above a run can be joined without dealing them anew.
    """
    begin = F.expr(f"idx div {FAN} * {FAN}")
    asked = nodes.where("n > 1").select("part", F.col("idx").alias("owner"), F.explode(F.sequence(begin, F.least(begin + FAN - 1, F.col("n") - 1))).alias("idx"))
    own = F.col("idx") == F.col("owner")
    met = asked.join(nodes.select("part", "idx", "digest", *more), ["part", "idx"])
    met = met.select("part", F.expr(f"idx div {FAN}").alias("over"), "owner", F.when(~own, F.struct("idx", "digest")).alias("sibling"), *[F.when(own, F.col(c)).alias(c) for c in more])
    both = met.repartition("part", "over").groupBy("part", "over", "owner").agg(F.sort_array(F.collect_list("sibling")).alias("run"), *[F.max(c).alias(c) for c in more])
    side = lambda keep: _joined(F.transform(F.filter("run", lambda x: keep(x.idx)), lambda x: x.digest))
    return both.select("part", "over", F.col("owner").alias("idx"), side(lambda i: i < F.col("owner")).alias("left"), side(lambda i: i > F.col("owner")).alias("right"), *more)


def paths(tables: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The lowest level's columns but n, ``path``, and ``above``'s other columns: the siblings from a node to its part's root.

    ``path`` has a struct of left and right a level. ``above`` is (part, path, ...): where each part's root goes on.
    What lies above a run is joined once for the run, from the top down.
    """
    more = [c for c in above.columns if c not in ("part", "path")]
    known = None
    for level in range(len(tables) - 1, -1, -1):
        kept = [c for c in tables[level].columns if c not in ("part", "idx", "n")] if level == 0 else []
        tops = tables[level].where("n = 1").select("part", "idx", *kept).join(above, "part").select("part", "idx", *kept, "path", *more)
        if known is not None:
            upper = known.select("part", F.col("idx").alias("over"), F.col("path").alias("rest"), *more)
            inner = siblings(tables[level], kept).join(upper.hint("merge"), ["part", "over"])  # paths compress well: their files tell too little for a broadcast
            tops = tops.unionAll(inner.select("part", "idx", *kept, F.concat(F.array(F.struct("left", "right")), F.col("rest")).alias("path"), *more))
        known = stored(tops, f"{name}-paths") if level else tops
    return known


@dataclass
class Manifest:
    """``tables``: the nodes of the sources' trees by level, the rows first; ``over``: those of the tree over sources."""

    tables: list[DataFrame]
    over: list[DataFrame]

    def root(self) -> DataFrame:
        """(root): one row, or none for an empty table."""
        return roots(self.over).select(F.lower(F.hex("digest")).alias("root"))

    def proofs(self) -> DataFrame:
        """The rows with digest, path, subroot and root."""
        top = roots(self.over).select("part", F.lower(F.hex("digest")).alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        ways = paths(self.over, top, "sources").select(F.col("source_part").alias("part"), "path", F.lower(F.hex("digest")).alias("subroot"), "root")
        return paths(self.tables, stored(ways, "source-proofs"), "leaves")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.concat(step.left, acc, step.right), 256))


def manifest(rows: DataFrame) -> Manifest:
    """The trees over (part, doc_id, digest, ...), ``part`` not null; a part's rows go by doc_id, ties by digest."""
    tables = levels(numbered(rows, "part", ["doc_id", "digest"], "leaves"), "leaves")
    subroots = roots(tables).select(F.lit("").alias("part"), F.col("part").alias("source_part"), "digest")
    return Manifest(tables, levels(numbered(subroots, "part", ["source_part"], "sources"), "sources"))


def tampered_ids(doc_id: Column) -> Column:
    """Whether 5 divides the unsigned crc32 of the decimal id; no for a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    Leaves hash doc_id, source, lang, n_chars and text; a source's rows go by doc_id, nulls first, then by leaf, so
    that rows equal throughout are leaves side by side. Sources go by UTF-8 bytes, the null one first and apart from the empty
    one. Rows whose id is ``tampered_ids`` are folded with the leaf of the lower-cased text, others with their own. No rows
    give none; other columns aren't read.
    """
    meta = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(tampered_ids(F.col("doc_id")), leaf_hash(*meta, F.translate("text", UPPER, LOWER)))
    part = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = docs.select(part.alias("part"), "doc_id", F.unhex(leaf_hash(*meta, F.col("text"))).alias("digest"), F.unhex(changed).alias("changed"))
    found = manifest(stored(leaves, "leaf-hashes")).proofs().withColumn("leaf", F.lower(F.hex("digest")))
    told = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), ""), 256)
    start = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    out = found.select("doc_id", "leaf", "subroot", "root", told.alias("proof_sha256"), fold(start, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB SQL for ``verify`` of ``documents``; the CRC is reckoned bit by bit, the trees and folds level by level.
SQL = r"""
WITH RECURSIVE coded AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN NULL ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) % 5 END AS crc_rest,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
  FROM documents
), hashed AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS part, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN coalesce(crc_rest = 0, false) THEN sha256(head || coalesce(octet_length(encode(lowered)) || ':' || lowered, '-')) END AS changed
  FROM coded
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM hashed
), nodes AS (
  SELECT part, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT part, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY part, level, idx // 16, n
), sources AS (
  SELECT part, h, row_number() OVER (ORDER BY encode(part)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), over_nodes AS (
  SELECT 0 AS level, idx, n, h FROM sources
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM over_nodes WHERE n > 1 GROUP BY level, idx // 16, n
), all_nodes AS (
  SELECT 0 AS tree, part, level, idx, n, h FROM nodes UNION ALL SELECT 1, '', level, idx, n, h FROM over_nodes
), shifts AS (
  SELECT range AS level, power(16, range)::BIGINT AS width FROM range(12)
), ways AS (
  SELECT l.part, l.idx AS leaf_idx, 0 AS tree, l.part AS in_part, s.level, l.idx // s.width AS idx FROM leaves l, shifts s
  UNION ALL
  SELECT l.part, l.idx, 1, '', s.level, o.idx // s.width FROM leaves l JOIN sources o USING (part), shifts s
), steps AS (
  SELECT w.part, w.leaf_idx, row_number() OVER (PARTITION BY w.part, w.leaf_idx ORDER BY w.tree, w.level) AS k,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx < w.idx), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx > w.idx), '') AS r
  FROM ways w JOIN all_nodes m ON m.tree = w.tree AND m.part = w.in_part AND m.level = w.level AND m.idx = w.idx AND m.n > 1
  JOIN all_nodes o ON o.tree = w.tree AND o.part = w.in_part AND o.level = w.level AND o.idx // 16 = w.idx // 16
  GROUP BY w.part, w.leaf_idx, w.tree, w.level
), folds AS (
  SELECT part, idx AS leaf_idx, 0 AS k, coalesce(changed, leaf) AS acc FROM leaves
  UNION ALL
  SELECT f.part, f.leaf_idx, f.k + 1, sha256(s.l || f.acc || s.r) FROM folds f JOIN steps s ON s.part = f.part AND s.leaf_idx = f.leaf_idx AND s.k = f.k + 1
), ends AS (
  SELECT part, leaf_idx, arg_max(acc, k) AS folded_root FROM folds GROUP BY part, leaf_idx
), told AS (
  SELECT part, leaf_idx, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM steps GROUP BY part, leaf_idx
)
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM leaves l JOIN sources s USING (part) JOIN ends e ON e.part = l.part AND e.leaf_idx = l.idx LEFT JOIN told p ON p.part = l.part AND p.leaf_idx = l.idx, over_nodes t
WHERE t.n = 1
"""
