"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links and MinHash bands find candidates, an exact test decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.simhash import SEED, bits, near, one_of_each, shingles
from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

#: A pair of similarity 0.8 shares none of 24 bands of 4 values with a probability of 3e-6.
BANDS, ROWS = 24, 4
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)
#: Shingles whose values are made at a time.
CHUNK = 2048


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The different hashes of a text's shingles, in order; none for a text without a word."""
    return np.unique(np.array(shingles(text, width), np.uint64))


def bands(hashed: np.ndarray) -> list[int]:
    """The keys of a set's bands, signed; of the empty set none."""
    if not len(hashed):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashed), CHUNK):
        part = (hashed[k : k + CHUNK, None] ^ MASKS) * FACTORS
        least = np.minimum(least, part.min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(text: Column | str, width: int = 5) -> Column:
    """struct<set, fp, bands>: the hash of a text's set of shingles, the set's fingerprint, and its bands."""

    @F.pandas_udf("set long, fp long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, width) for t in texts]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = np.array([bits(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"set": names, "fp": prints, "bands": [bands(s) for s in sets]})

    return of(text)


def alike(a: Column | str, b: Column | str, similarity: float, width: int = 5) -> Column:
    """Whether the shingles of two texts are that similar, by their exact sets."""

    @F.pandas_udf("boolean")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(64)(lambda t: shingle_set(t, width))
        for left, right in batches:
            found = []
            for s, t in zip(left, right):
                x, y = known(s), known(t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                found.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pd.Series(found, dtype=bool)

    return of(a, b)


def changes(text: Column | str, head: Column | str, similarity: float, width: int = 5) -> Column:
    """struct<linked, size, added, gone>: whether a text is that similar to ``head``, the size of head's set, and the shingles of either alone."""

    @F.pandas_udf("linked boolean, size long, added array<long>, gone array<long>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = lru_cache(64)(lambda t: shingle_set(t, width))
        for texts, heads in batches:
            rows = []
            for s, t in zip(texts, heads):
                x, h = known(s), known(t)
                added, gone = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
                common = len(h) - len(gone)
                linked = common >= similarity * (len(h) + len(added)) - 1e-9
                rows.append((linked, len(h), added.view(np.int64).tolist(), gone.view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["linked", "size", "added", "gone"])

    return of(text, head)


def one_of_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = 0.8, width: int = 5, hot: int = 32) -> DataFrame:
    """``docs`` with one row of each group of texts linked by shingles of ``width`` words at ``similarity`` or more.

    The row of the least id stays (nulls last), of these that with the least text hash. Equal sets of shingles
    are one entry. Entries whose fingerprints link are tested (``print_pairs``), and within a band, for what a
    fingerprint's few bits can't reach, all pairs, where over ``hot`` entries share it by way of its head: see ``crowded_links``. Texts without a word are equal; no rows give none; columns keep their names.
    """
    hashed = F.xxhash64(text_column)
    printed = docs.select(F.col(id_column).alias("doc_id"), hashed.alias("_text"), signatures(F.col(text_column), width).alias("s")).select("doc_id", "_text", "s.set", "s.fp", "s.bands")
    printed = stored(printed, "signatures")
    distinct = printed.groupBy("set").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    each = stored(distinct.select("set", F.explode("bands").alias("key")), "bands")
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = stored(each.join(shared, "key"), "band-members")
    few, many = members.where(F.col("n") <= hot), members.where(F.col("n") > hot)
    within = few.select("key", F.col("set").alias("a")).join(few.select("key", F.col("set").alias("b")), "key").where("a < b")
    links = _verified(within.select("a", "b").unionAll(print_pairs(printed.select("set", "fp").distinct())).distinct(), docs, text_column, printed, similarity, width)
    if not many.isEmpty():
        links = crowded_links(links, members, many.select("key", "set"), docs, text_column, printed, similarity, width)
    linked = components(links)
    named = printed.join(linked, printed.set == linked.node, "left").select("doc_id", "_text", F.coalesce("component", "set").alias("component"))
    return one_of_each(docs, named, id_column, text_column)


def print_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ``sets`` (set, fp) whose fingerprints link by the index of ``simhash.near``, a < b.

    A fingerprint that several sets have is looked up once, by its least set, which is paired with the others: n sets
    of near fingerprints make pairs of their heads and n more. The bands pair what is alike to others than to its head.
    """
    heads = stored(sets.groupBy("fp").agg(F.min("set").alias("head")), "print-heads")
    same = sets.join(heads, "fp").where("set != head").select(F.col("head").alias("a"), F.col("set").alias("b"))
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"_{c}"))
    met = near(heads).join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return same.unionAll(met)


def crowded_links(links: DataFrame, members: DataFrame, many: DataFrame, docs: DataFrame, text_column: str, printed: DataFrame, similarity: float, width: int) -> DataFrame:
    """``links`` with enough of those within crowded bands (key, set) to join whatever all pairs there would join.

    A band's head h is the entry whose bands are the most crowded: of copies of a text, that text. Every entry
    is compared with it and keeps what changes, a added and d gone shingles. With c = (1 - s) / (1 + s), entries
    x and y are alike iff |x^y| <= c(|x| + |y|), so if they have at least
    ((1 - c)(a_x + a_y) + (1 + c)(d_x + d_y)) / 2 - c|h| changes in common. Where x isn't alike to h, that is
    at least ((1 - c)a_y + (1 + c)d_y) / 2, and at least ((1 - c)a_x + (1 + c)d_x - 2c|h|) / (1 + c). Of two sets
    in one order that have o members in common, the first |x| - o + 1 and |y| - o + 1 meet: so only entries of
    other groups whose rarest changes meet are tested, and only changes that occur in several groups count.
    """
    score = members.groupBy("set").agg(F.sum("n").alias("score"))
    heads = many.join(score, "set").groupBy("key").agg(F.max_by("set", F.struct("score", "set")).alias("head"))
    pool = stored(many.join(heads, "key").where("set != head").select("head", "set").distinct(), "pool")
    texts = _texts(pool.select("set").unionAll(pool.select("head")), docs, text_column, printed)
    both = pool.join(texts, "set").join(texts.select(F.col("set").alias("head"), F.col("text").alias("_head")), "head")
    compared = stored(both.select("head", "set", changes("text", "_head", similarity, width).alias("c")).select("head", "set", "c.*"), "changes")
    links = stored(links.unionAll(compared.where("linked").select(F.least("head", "set").alias("a"), F.greatest("head", "set").alias("b"))), "head-links")
    group = components(links)
    of = lambda c, name: group.select(F.col("node").alias(c), F.col("component").alias(name))
    grouped = compared.join(of("set", "_g"), "set", "left").join(of("head", "_h"), "head", "left")
    own, heads_ = F.coalesce("_g", "set"), F.coalesce("_h", "head")
    # Of entries alike to the head, or in its group, it is the other that asks.
    grouped = stored(grouped.select("head", "set", own.alias("group"), (~F.col("linked") & (own != heads_)).alias("asks"), "size", "added", "gone"), "grouped-changes")

    c, col = (1 - similarity) / (1 + similarity), F.col
    changed = grouped.select("head", "set", "group", "asks", "size", F.size("added").alias("a"), F.size("gone").alias("d"), F.explode(F.concat("added", "gone")).alias("change"))
    common = changed.groupBy("head", "change").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asked"), F.min("group").alias("g1"), F.max("group").alias("g2")).where("asked AND g1 != g2").select("head", "change", "n")
    entry = Window.partitionBy("head", "set")
    ranked = changed.join(common, ["head", "change"]).withColumns({"at": F.row_number().over(entry.orderBy("n", "change")), "of": F.count(F.lit(1)).over(entry)})
    weight = (1 - c) * col("a") + (1 + c) * col("d")
    first = lambda least: col("at") <= col("of") + 1 - F.greatest(F.lit(1.0), F.ceil(least - 1e-6))
    ranked = stored(ranked.withColumns({"weight": weight, "as_x": col("asks") & first((weight - 2 * c * col("size")) / (1 + c)), "as_y": first(weight / 2)}).where("as_x OR as_y"), "ranked-changes")
    side = lambda k: ranked.where(f"as_{k}").select("head", "change", "size" if k == "x" else F.lit(0).alias("_"), *[col(n).alias(f"{k}_{n}") for n in ("set", "group", "weight", "of")])
    met = side("x").join(side("y"), ["head", "change"]).where(col("x_group") != col("y_group"))
    met = met.where((col("x_weight") + col("y_weight")) / 2 - c * col("size") <= F.least("x_of", "y_of") + 1e-6)
    pairs = stored(met.select(F.least("x_set", "y_set").alias("a"), F.greatest("x_set", "y_set").alias("b")).distinct(), "changed-alike")
    return links if pairs.isEmpty() else links.unionAll(_verified(pairs, docs, text_column, printed, similarity, width))


def _texts(sets: DataFrame, docs: DataFrame, text_column: str, printed: DataFrame) -> DataFrame:
    """(set, text): one text of each of these sets."""
    wanted = stored(printed.join(sets.distinct(), "set").groupBy("set").agg(F.min("_text").alias("_text")), "wanted")
    texts = docs.select(F.xxhash64(text_column).alias("_text"), F.col(text_column).alias("text")).join(small_side(wanted), "_text")
    return stored(texts.dropDuplicates(["set"]).select("set", "text"), "wanted-texts")


def _verified(pairs: DataFrame, docs: DataFrame, text_column: str, printed: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b): those of the pairs of sets that are similar by one text of each."""
    pairs = stored(pairs, "candidates")
    texts = _texts(pairs.select(F.col("a").alias("set")).unionAll(pairs.select("b")), docs, text_column, printed)
    side = lambda c: texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return stored(both.where(alike("text_a", "text_b", similarity, width)).select("a", "b"), "similar-pairs")
