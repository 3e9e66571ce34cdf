"""Line deduplication by overlapping windows of three consecutive lines. Spark functions only.

Lines that hold several sentences are cut after each, so that passages within long lines count as well. These
pieces, joined, are the text; they are called lines here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

SPACE = " \t\r\n"
#: A line with its end, or a sentence of it with the blanks after it.
LINE = r"(?s).*?(?:[.!?]+[ \t]+|[\x{3002}\x{FF01}\x{FF1F}]|\n)|.+"


def _lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, least_chars: int = 60) -> DataFrame:
    """(doc_id, row, first, last, h1, h2): every run of ``width`` lines that are not blank.

    ``first`` and ``last`` are line numbers from 0; h1 and h2 are two 64-bit hashes of the trimmed lines. Runs
    of fewer than ``least_chars`` characters count only if they are whole lines, each ended by a line feed but the last.
    """
    trimmed = F.transform(_lines(F.col(text_column)), lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(SPACE)).alias("line"), F.endswith(x, F.lit("\n")).alias("ends")))
    full = F.filter(trimmed, lambda x: x.line != "")
    found = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("row"), full.alias("full")).where(F.size("full") >= width)

    def window(i: Column) -> Column:
        own = [F.col("full")[i + k] for k in range(width)]
        whole, enough = own[0]["ends"], F.length(own[0]["line"])
        for x in own[1:-1]:
            whole = whole & x["ends"]
        for x in own[1:]:
            enough = enough + F.length(x["line"])
        hashes = [F.xxhash64(F.lit(k), *[x["line"] for x in own]).alias(f"h{k}") for k in (1, 2)]
        return F.when((enough >= least_chars) | whole, F.struct(own[0]["at"].alias("first"), own[-1]["at"].alias("last"), *hashes))

    each = F.transform(F.sequence(F.lit(0), F.size("full") - width), window)
    return found.select("doc_id", "row", F.explode(each).alias("w")).where(F.col("w").isNotNull()).select("doc_id", "row", "w.*")


def later(found: DataFrame) -> DataFrame:
    """The windows whose lines occurred before, in order of (doc_id, row, first)."""
    place = F.struct("doc_id", "row", "first")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return found.join(repeated, ["h1", "h2"]).where(place != F.col("origin")).select("doc_id", "row", "first", "last")


def kept_runs(found: DataFrame) -> DataFrame:
    """(doc_id, row, runs, rest): the runs of lines before, between and after the covered ones of each document."""
    own = Window.partitionBy("doc_id", "row").orderBy("first")
    before = F.coalesce(F.lag("last").over(own), F.lit(-1)) + 1
    gaps = found.withColumn("start", before).select("doc_id", "row", "last", F.when(F.col("first") > F.col("start"), F.struct((F.col("start") + 1).alias("start"), (F.col("first") - F.col("start")).alias("n"))).alias("run"))
    return gaps.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("run")).alias("runs"), (F.max("last") + 1).alias("rest"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, least_chars: int = 60, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with the text less its repeated passages, plus ``n_lines`` (line feeds and one) and ``n_removed`` (lines here, cut ones too), longs.

    A passage is any run of ``width`` consecutive lines (see ``windows``), trimmed, blank ones aside; all but
    its first occurrence in order of id (nulls first) and line go, with the blank lines inside. Documents of
    fewer lines stay as they are; a null text stays null with 0 lines; rows repeated
    with the same id and text count as one document; columns named like the two new ones are replaced.
    """
    found = stored(windows(docs, id_column, text_column, width, least_chars), "line-windows")
    gaps = stored(kept_runs(later(found)).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "runs", "rest"), "line-gaps")
    kept = [c for c in docs.columns if c not in (n_lines, n_removed)]
    text = F.col("text")
    # The row travels as one struct, so that no column's name can clash with those used here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text_column], F.lit(0).alias("_")).alias("doc"), F.col(id_column).alias("own_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("own_row"))
    joined = own.join(small_side(gaps), F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_row") == F.col("_row")), "left")
    split = joined.withColumn("lines", F.when(F.col("rest").isNotNull(), _lines(text)))
    tail = F.array(F.struct((F.col("rest") + 1).alias("start"), (F.size("lines") - F.col("rest")).alias("n")))
    left = F.flatten(F.transform(F.concat("runs", tail), lambda r: F.slice("lines", r.start, r.n)))
    split = split.withColumn("left", F.when(F.col("rest").isNotNull(), left))
    count = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    changed = F.col("left").isNotNull()
    return split.select(
        *[F.when(changed, F.array_join("left", "")).otherwise(text).alias(c) if c == text_column else F.col(f"doc.`{c}`").alias(c) for c in kept],
        count.cast("long").alias(n_lines),
        F.when(changed, F.size("lines") - F.size("left")).otherwise(0).cast("long").alias(n_removed),
    )


#: DuckDB SQL for doc_id, text, n_lines and n_removed of ``documents`` with unique ids.
SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:[.!?]+[ \t]+|[\x{3002}\x{FF01}\x{FF1F}]|\n)|.+') AS pieces FROM documents
), lines AS (
  SELECT doc_id, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS pos FROM cut
), trimmed AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(10)) AS line, suffix(line, chr(10)) AS ends FROM lines
), counted AS (
  SELECT *, length(line) AS chars FROM trimmed WHERE line <> ''
), windows AS (
  SELECT doc_id, pos AS first, lead(pos, 2) OVER own AS last, line || chr(10) || lead(line, 1) OVER own || chr(10) || lead(line, 2) OVER own AS passage,
    chars + lead(chars, 1) OVER own + lead(chars, 2) OVER own >= 60 OR ends AND lead(ends, 1) OVER own AS counts
  FROM counted WINDOW own AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, first) AS n FROM windows WHERE last IS NOT NULL AND counts) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later
), kept AS (
  SELECT l.doc_id, string_agg(l.line, '' ORDER BY l.pos) AS text, count(*) AS n
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos WHERE c.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(length(d.text) - length(replace(d.text, chr(10), '')) + 1, 0)::BIGINT AS n_lines, (coalesce(len(d.pieces), 0) - coalesce(k.n, 0))::BIGINT AS n_removed
FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?(?:[.!?]+[ \t]+|[\x{3002}\x{FF01}\x{FF1F}]|\n)|.+') AS pieces FROM documents) d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
