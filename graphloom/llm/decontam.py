"""Benchmark decontamination by template windows. Spark functions only.

A text becomes a row of tokens in which numbers, names and units carry a marker of their type. Windows of
``width`` tokens are hashed in two readings and joined with the benchmark's: word for word, and as a template,
with marked tokens reduced to their marker. What matches as a template counts along one alignment of item and
document, if the values in its slots map one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

#: Private-use characters before a number, a name and a unit. In a text they mark what follows, too.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|l|ml|s|ms|min|h|hr|hours?|minutes?|seconds?|days?|weeks?|months?|years?|kmh|mph|w|kw|kwh|v|hz|gb|mb|tb|kb|dollars?|euros?|cents?|pounds?|miles?|meters?|metres?|percent"
DIGITS = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
TOKEN = rf"{NUMBER}{DIGITS}|{UNIT}[%$€£]|[{NAME}{UNIT}]?[\p{{L}}\p{{M}}\p{{N}}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; a name is any capitalised word, also at the start of a sentence or line."""
    named = F.regexp_replace(text, r"(?<![\p{L}\p{M}\p{N}])(?=\p{Lu})", NAME)
    unit = F.regexp_replace(named, rf"(?i)(\p{{Nd}}) ?{NAME}?(%|(?:{UNITS})(?!\p{{L}}))", rf"$1 {UNIT}$2")
    unit = F.regexp_replace(unit, r"([$€£]) ?(?=\p{Nd})", rf" {UNIT}$1 ")
    numbered = F.regexp_replace(unit, rf"(?<![\p{{L}}\p{{N}}]){DIGITS}", rf"{NUMBER}$0")
    full = F.when(text.rlike(r"\p{Nd}"), numbered).otherwise(named)
    return F.coalesce(F.regexp_extract_all(F.lower(full), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def _slot(token: Column) -> Column:
    return (token >= NUMBER) & (token < chr(ord(UNIT) + 1))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _read(tokens_: Column, template: bool) -> Column:
    """The hash of each token as it is written, or of a slot's type alone."""
    value = lambda t: F.substring(t, 1, 1) if template else F.substring(t, 2, 1 << 30)
    return F.transform(tokens_, lambda t: F.xxhash64(F.when(_slot(t), value(t)).otherwise(t)))


def hashes(tokens_: Column, width: int, template: bool = False) -> Column:
    """The hashes of all windows, by doubling: of 2 tokens, of 4, of ``width``; empty for fewer tokens."""
    if width & (width - 1):
        raise ValueError("the width is a power of two")
    now, step = _read(tokens_, template), 1
    while step < width:
        now = _bound(now, _doubled(step))
        step *= 2
    return now


def _doubled(step: int):
    def of(h: Column) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))

    return of


def _both(tokens_: Column, width: int) -> Column:
    """array<struct<plain, shaped>>: each window in both readings; ``shaped`` is null where no token is a slot."""
    entry = lambda p, t: F.struct(p.alias("plain"), F.when(p != t, t).alias("shaped"))
    return F.zip_with(hashes(tokens_, width), hashes(tokens_, width, template=True), entry)


def _all(tokens_: Column, width: int, lengths: list[int]) -> Column:
    """The hashes of all windows in both readings, and of the runs of these numbers of tokens, in no order that matters."""
    shaped = _bound(hashes(tokens_, width), lambda p: F.concat(p, F.zip_with(p, hashes(tokens_, width, template=True), lambda x, y: F.when(x != y, y))))
    return F.concat(shaped, *[F.transform(_runs(tokens_, n), lambda r: r["plain"]) for n in lengths])


def _runs(tokens_: Column, n: int) -> Column:
    """The same of all runs of any number of tokens, word for word alone."""
    entry = lambda h, i: F.struct(F.xxhash64(F.lit(n), *[h[i + k] for k in range(n)]).alias("plain"), F.lit(None).cast("bigint").alias("shaped"))
    starts = lambda h: F.slice(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(0)))
    return _bound(_read(tokens_, False), lambda h: F.transform(starts(h), lambda i: entry(h, i)))


def items(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, item, tokens): the different items, ``item`` being the text's hash; null texts are none."""
    rows = benchmark.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).distinct()
    return rows.select("item_id", F.xxhash64("text").alias("item"), tokens(F.col("text")).alias("tokens"))


def item_windows(texts: DataFrame, lengths: list[int], width: int = 8, most_slots: int = 6) -> DataFrame:
    """(item, at, hash, template) from (item, tokens).

    Each window word for word, and as a template if at most ``most_slots`` of its tokens are slots: more say
    nothing. An item of fewer than ``width`` tokens is one run, word for word, if its length is among ``lengths``.
    """
    long = texts.select("item", "tokens", F.posexplode(_both(F.col("tokens"), width)).alias("at", "w"))
    slots = F.size(F.filter(F.slice("tokens", F.col("at") + 1, F.lit(width)), _slot))
    found = long.select("item", "at", F.col("w.plain").alias("hash"), F.lit(False).alias("template"))
    found = found.unionAll(long.where(F.col("w.shaped").isNotNull() & (slots <= most_slots)).select("item", "at", "w.shaped", F.lit(True)))
    for n in lengths:
        found = found.unionAll(texts.where(F.size("tokens") == n).select("item", F.lit(0), _runs(F.col("tokens"), n)[0]["plain"], F.lit(False)))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, need: int = 6, most_slots: int = 6, least: int = 4, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(doc_id, row, item_id, n_windows, n_item_windows, n_slots): the documents that hold a benchmark item, or its template.

    A pair counts with ``need`` different windows of the item (all, if it has fewer) found in the document
    word for word, or with that many found along one alignment, as templates or word for word, if there each
    slot value of the item stands for one value of the document and the other way round. Items of ``least``
    to ``width`` - 1 tokens count where they are found whole, word for word; shorter ones name no question.

    ``row`` is the text's hash: rows with equal ids and other texts are judged apart. Null texts have no
    tokens; repeated items count once, items with null ids like others; of different items with one id the
    one with the most windows is reported. No documents or no items give no rows.
    """
    known_items = stored(items(benchmark, item_column, item_text_column), "benchmark-items")
    texts = known_items.select("item", "tokens").dropDuplicates(["item"])
    lengths = [r.n for r in texts.select(F.size("tokens").alias("n")).where((F.col("n") >= least) & (F.col("n") < width)).distinct().orderBy("n").collect()]  # fewer than width
    known = stored(item_windows(texts, lengths, width, most_slots), "benchmark-windows")
    per_item = known.groupBy("item").agg(F.count_distinct("at").cast("int").alias("n_item_windows"))

    hashed = _bound(tokens(F.col(text_column)), lambda t: _all(t, width, lengths))
    # explode_outer: the inner one makes Spark test the array's size below, where it is computed again.
    own = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("row"), F.explode_outer(hashed).alias("hash"))
    hits = stored(own.join(small_side(known, 1_000_000), "hash").drop("hash"), "window-hits")
    pair = ["doc_id", "row", "item"]
    counted = hits.groupBy(*pair).agg(F.size(F.collect_set(F.when(~F.col("template"), F.col("at")))).alias("plain"), F.size(F.collect_set("at")).alias("n_windows"))
    enough = F.least(F.lit(need), F.col("n_item_windows"))
    found = stored(counted.join(small_side(per_item, 1_000_000), "item").where(F.col("n_windows") >= enough), "pairs")
    good = found.where(F.col("plain") >= enough).select(*pair, "n_windows", "n_item_windows", F.lit(0).alias("n_slots"))
    open_ = found.where(F.col("plain") < enough)
    if not open_.isEmpty():
        mapped = _one_to_one(docs, texts, known, open_.select("row", "item", "n_item_windows").distinct(), width, need, text_column)
        good = good.unionAll(open_.drop("n_windows", "plain").join(mapped, ["row", "item"]).select(*pair, "n_windows", "n_item_windows", "n_slots"))
    named = good.join(small_side(known_items.select("item_id", "item")), "item")
    best = named.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("n_windows", "n_item_windows", "n_slots")).alias("best"))
    return best.select("doc_id", "row", "item_id", "best.*")


def _one_to_one(docs: DataFrame, texts: DataFrame, known: DataFrame, open_: DataFrame, width: int, need: int, text_column: str) -> DataFrame:
    """(row, item, n_windows, n_slots): of these pairs those with an alignment of enough windows whose slots map one to one."""
    key, line = ["row", "item"], ["row", "item", "shift"]
    open_ = stored(open_, "open-pairs")
    wanted = small_side(open_.select("row").distinct())
    own = docs.select(F.xxhash64(text_column).alias("row"), F.col(text_column).alias("text")).join(wanted, "row", "left_semi").dropDuplicates(["row"])
    own = stored(own.select("row", tokens(F.col("text")).alias("tokens")), "open-tokens")
    placed = own.select("row", F.posexplode(_both(F.col("tokens"), width)).alias("pos", "w")).select("row", "pos", F.explode(F.array("w.plain", "w.shaped")).alias("hash"))
    hits = placed.join(small_side(known, 1_000_000), "hash")
    met = hits.join(small_side(open_), key).select(*key, "n_item_windows", (F.col("pos") - F.col("at")).alias("shift"), "at").distinct()
    lines = met.groupBy(*line, "n_item_windows").agg(F.count(F.lit(1)).cast("int").alias("n_windows")).where(F.col("n_windows") >= F.least(F.lit(need), F.col("n_item_windows")))
    lines = stored(lines.drop("n_item_windows"), "alignments")
    covered = met.drop("n_item_windows").join(lines, line).select(*line, "n_windows", F.explode(F.sequence(F.col("at"), F.col("at") + width - 1)).alias("at")).distinct()
    valued = lambda df, of, place, name: df.select(of, F.posexplode("tokens").alias(place, name)).where(_slot(F.col(name)))
    theirs = valued(own.join(small_side(lines.select("row").distinct()), "row", "left_semi"), "row", "pos", "theirs")
    both = covered.join(small_side(valued(texts, "item", "at", "ours")), ["item", "at"]).withColumn("pos", F.col("at") + F.col("shift")).join(theirs, ["row", "pos"])
    values = both.groupBy(*line, "n_windows").agg(F.size(F.collect_set("ours")).alias("n_slots"), F.size(F.collect_set("theirs")).alias("b"), F.size(F.collect_set(F.struct("ours", "theirs"))).alias("c"))
    fine = values.where((F.col("n_slots") == F.col("c")) & (F.col("b") == F.col("c")))
    return fine.groupBy(*key).agg(F.max(F.struct("n_windows", "n_slots")).alias("best")).select(*key, "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """``docs`` without the documents that ``leaks`` names; rows of null texts stay."""
    found = leaks(docs, benchmark, id_column=id_column, text_column=text_column, **settings).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    found = small_side(stored(found, "leaked"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_column).alias("own_id"), F.xxhash64(text_column).alias("own_row"))
    return own.join(found, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_row") == F.col("_row")), "left_anti").select("doc.*")
