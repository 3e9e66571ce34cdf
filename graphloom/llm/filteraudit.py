"""How filters on documents interact: what each removes, in every order of applying them. Spark functions only.

Each row's failures are one mask of bits; the histogram of masks holds all that any order of the filters needs.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored

BLANKS = " \t\n\x0b\x0c\r"
#: The last letter's filter: a text that a smaller id has, too. The others depend on the text alone.
REPEATED = "E"


def failures(text: Column) -> dict[str, Column]:
    """For each letter whether a text (not null) fails its filter."""
    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row: bit k of the mask is set if the filter of the k-th letter fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(failures(text).values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    own = stored(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask")), "masks")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"))
    # Joined by text and id together, so that a text which a third of the rows share is many keys.
    here = (own.digest == first.digest) & (own.doc_id == first["first"])
    marked = own.join(first, here, "left").select("doc_id", "part", (own.mask + F.when(first["first"].isNull() & F.col("doc_id").isNotNull(), 1 << len(bits)).otherwise(0)).alias("mask"))
    said = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return marked.join(said, "doc_id", "left").select("part", "mask", *filled)


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part (a lang value; null counts as the empty one), each order of the filters and each step, zeros
    included; the counts are of rows. A null text is empty. A text is repeated if a smaller id has the same one
    anywhere; rows of equal ids and texts don't repeat each other, and a row without an id repeats nothing. Of
    several label rows of an id one suffices for a label; ids without labels have none. No rows give no rows;
    other columns aren't read.
    """
    cells = masks(docs, labels).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    placed = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    placed = placed.withColumns({"filter": F.substring(F.col("filter_order"), F.col("step"), F.lit(1)), "earlier": earlier})
    bits = {letter: 1 << k for k, letter in enumerate(letters)}
    bit = F.element_at(F.array(*[F.lit(b) for b in bits.values()]), F.position("filter", F.lit(letters)))
    before = F.lit(0)
    for letter, b in bits.items():
        before = before + F.when(F.contains(F.col("earlier"), F.lit(letter)), b).otherwise(0)
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(before) != 0
    total = lambda where, value="n": F.sum(F.when(where, F.col(value)).otherwise(0))
    steps = placed.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))  # 600 rows a part


#: DuckDB SQL for ``audit`` of ``documents`` and ``labels``.
SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(s.toxic, 0) AS toxic, map {
    'A': len(words) < 100,
    'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > first, false) } AS fails
  FROM texts JOIN firsts USING (text) LEFT JOIN said s USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), counted AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM failed GROUP BY ALL
), steps AS (
  SELECT filter_order, step, filter_order[step] AS filter, string_split(left(filter_order, step - 1), '') AS earlier FROM orders, range(1, 6) r(step)
), judged AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS here, list_contains(list_transform(earlier, lambda x: coalesce(fails[x], false)), true) AS gone,
    NOT list_contains(list_transform(list_filter(map_keys(fails), lambda x: x <> filter), lambda x: fails[x]), true) AS others_pass
  FROM counted, steps
), sums AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND others_pass), 0)::BIGINT AS unique_fails,
    coalesce(sum(n * good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM sums
"""
