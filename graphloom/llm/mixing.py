"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. Spark functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
GOLDEN = (math.sqrt(5) - 1) / 2
#: Up to so many slots their product with the step is within a long; beyond, points are reckoned in decimals.
LONG_SLOTS = 2**31
#: The line [0, slots) is cut into so many cells, by which slots meet sources in an equi-join.
CELLS = 256


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows before each row; ``chunk`` cuts the order into runs.

    Each run is summed, then the runs' sums, so a key's rows never meet in one task.
    """
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_start", F.sum("_sum").over(Window.partitionBy(*keys).orderBy(chunk)) - F.col("_sum")).drop("_sum")
    inside = F.sum(value).over(Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn("_inside", inside).join(starts, [*keys, chunk]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_no, source_size, n_docs, target) from (source, size): ``share`` of all sizes, by weight.

    Sources in order of code points, null last, take the weights in turn. No target is above ``most`` times
    its source's size; the excess goes to the others by weight. With the sources in order of size over
    weight, those at their limit come first, and the level of the others follows from what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("source_no", F.row_number().over(one)).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(limit / F.col("weight"), "source_no")
    every = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - (F.sum(limit).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - limit)
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", left / weight_left).withColumn("own", F.when(F.col("level") * F.col("weight") < limit, F.col("level")))
    target = F.least(limit, F.coalesce(F.max("own").over(every) * F.col("weight"), limit))
    return leveled.select("source", "source_no", "source_size", "n_docs", target.alias("target"))


def _point(slot: Column, step: int, slots: int, long_slots: int) -> Column:
    if slots <= long_slots:
        return (slot * F.lit(step)) % max(1, slots)
    whole = lambda c: c.cast("decimal(19,0)")
    return ((whole(slot) * whole(F.lit(step))) % whole(F.lit(slots))).cast("long")


def placed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 1024, long_slots: int = LONG_SLOTS, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, schedule). rows: doc_id, size, source_no, source_size, target, start of every document.

    schedule: (slot, source_no, start, doc_id, size, from_word, words), the mix in training order.

    Each source's documents are shuffled by MD5 of the id, laid end to end and cut into blocks of
    ``block_words``. A source needs as many slots as blocks reach its target, its blocks coming round again
    where that is above its size. Slot t takes the point t * step mod slots, step being near the golden
    ratio of their number and coprime to it, so that the points run once through the sources' cumulative
    weights and every stretch of the schedule has nearly the target shares. The last slot of a source is
    cut where the target is met.
    """
    key = F.coalesce(F.md5(F.col(id_column).cast("string")), F.lit(""))
    sized = stored(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), n_words(F.col(text_column)).alias("size"), key.alias("_key")), "sizes")
    sources = stored(targets(sized, weights, share, most), "sources")
    n_docs, block = sources.agg(F.sum("n_docs")).first()[0], block_words
    digits = max(1, math.ceil(math.log(math.sqrt(n_docs or 1) + 1, 16)))
    known = small_side(sources.drop("n_docs"))
    own = sized.join(known, sized.source.eqNullSafe(known.source)).select("doc_id", "size", "_key", F.substring("_key", 1, digits).alias("_chunk"), "source_no", "source_size", "target")
    rows = stored(running_sum(own, ["source_no"], ["_key", "doc_id", "size"], "size", "_chunk", "start").drop("_key", "_chunk"), "laid-out")

    blocks = F.ceil(F.col("source_size") / block)
    wanted = F.round("target").cast("long")
    rounds = F.floor(wanted / F.col("source_size"))
    needed = F.when(wanted > 0, rounds * blocks + F.ceil((wanted - rounds * F.col("source_size")) / block)).otherwise(0).cast("long")
    counts = sources.select("source_no", "source_size", wanted.alias("wanted"), blocks.cast("long").alias("blocks"), needed.alias("needed")).where("needed > 0")
    spans = stored(counts.withColumn("to", F.sum("needed").over(Window.orderBy("source_no"))).withColumn("from", F.col("to") - F.col("needed")), "spans")
    slots = spans.agg(F.max("to")).first()[0] or 0
    step = max(1, round(slots * GOLDEN))
    while slots and math.gcd(step, slots) != 1:
        step += 1
    cell = lambda c: F.floor(c * CELLS / max(1, slots)).cast("long")
    spans = small_side(spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to") - 1)))))
    points = docs.sparkSession.range(slots).select(F.col("id").alias("slot"), _point(F.col("id"), step, slots, long_slots).alias("point")).withColumn("_cell", cell(F.col("point")))
    chosen = points.join(spans, "_cell").where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to")))
    chosen = chosen.withColumns({"_chunk": F.floor(F.col("slot") / max(1, math.isqrt(slots))), "_one": F.lit(1).cast("long")})
    ranked = running_sum(chosen, ["source_no"], ["slot"], "_one", "_chunk", "rank")
    number, turn = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    taken = ranked.select("slot", "source_no", number.alias("block"), F.least(F.lit(block), F.col("wanted") - turn * F.col("source_size") - number * block).alias("take"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = rows.where("size > 0").select("source_no", "start", "doc_id", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    until = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    schedule = taken.join(pieces, ["source_no", "block"]).select("slot", "source_no", "start", "doc_id", "size", (begin - F.col("start")).alias("from_word"), (until - begin).alias("words")).where("words > 0")
    return rows, schedule


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots of every document.

    ``taken`` is the words that the schedule takes of it, in ``n_slots`` slots, of which ``first_slot`` is the
    first to be trained on (null if none takes it). A null text has size 0; a null source is a source; documents
    of size 0 take 0, and no rows give none. Rows with equal ids keep their own places, and are as good as each
    other if equal throughout. Columns other than id, text and source play no part.
    """
    rows, schedule = placed(docs, **settings)
    sums = schedule.groupBy("source_no", "start", "doc_id", "size").agg(F.sum("words").alias("_words"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("_slots"))
    got = sums.select(F.col("source_no").alias("_no"), F.col("start").alias("_start"), "_words", "first_slot", "_slots")
    full = rows.where("size > 0").join(got, (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_start")), "left")
    out, filled = ["doc_id", "size", "source_size", "target"], lambda c: F.coalesce(c, F.lit(0)).cast("long")
    none = rows.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    return full.select(*out, filled("_words").alias("taken"), "first_slot", filled("_slots").alias("n_slots")).unionAll(none)


#: DuckDB SQL for ``mix`` of ``documents`` with unique ids: the schedule, slot by slot.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS total FROM per
), leveled AS (
  SELECT *, (1.5::DOUBLE * total::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size::DOUBLE) OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aimed AS (
  SELECT *, least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN level * weight < 2.0::DOUBLE * source_size THEN level END) OVER () * weight, 2.0::DOUBLE * source_size)) AS target FROM leveled
), laid AS (
  SELECT s.doc_id, s.size, a.no, a.source_size, a.target, sum(s.size) OVER (PARTITION BY a.no ORDER BY md5(s.doc_id::VARCHAR), s.doc_id)::BIGINT - s.size AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), needs AS (
  SELECT no, source_size, round(target)::BIGINT AS wanted, (source_size + 1023) // 1024 AS blocks FROM aimed WHERE source_size > 0 AND round(target) > 0
), counted AS (
  SELECT *, (wanted // source_size) * blocks + (wanted % source_size + 1023) // 1024 AS needed FROM needs
), spans AS (
  SELECT *, sum(needed) OVER (ORDER BY no)::BIGINT AS upto FROM counted
), line AS (
  SELECT max(upto) AS slots, greatest(1, round(max(upto) * ((sqrt(5::DOUBLE) - 1) / 2))::BIGINT) AS near FROM spans
), stepped AS (
  SELECT slots, (SELECT min(s) FROM range(near, near + 1000) r(s) WHERE gcd(s, slots) = 1) AS step FROM line
), points AS (
  SELECT slot, slot::HUGEINT * step % slots AS point FROM stepped, range(slots) r(slot)
), ranked AS (
  SELECT p.slot, s.*, row_number() OVER (PARTITION BY s.no ORDER BY p.slot) - 1 AS rank FROM points p JOIN spans s ON p.point >= s.upto - s.needed AND p.point < s.upto
), taken AS (
  SELECT slot, no, rank % blocks AS block, least(1024, wanted - rank // blocks * source_size - rank % blocks * 1024) AS take FROM ranked
), pieces AS (
  SELECT doc_id, no, start, size, unnest(range(start // 1024, (start + size - 1) // 1024 + 1)) AS block FROM laid WHERE size > 0
), met AS (
  SELECT p.doc_id, t.slot, least(p.start + p.size, p.block * 1024 + t.take) - greatest(p.start, p.block * 1024) AS words FROM pieces p JOIN taken t ON p.no = t.no AND p.block = t.block
), sums AS (
  SELECT doc_id, sum(words)::BIGINT AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM met WHERE words > 0 GROUP BY doc_id
)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(s.taken, 0)::BIGINT AS taken, s.first_slot::BIGINT AS first_slot, coalesce(s.n_slots, 0)::BIGINT AS n_slots
FROM laid l LEFT JOIN sums s ON l.doc_id = s.doc_id
"""
