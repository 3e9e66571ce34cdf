"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.plans.checkpoint import stored

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 8192


def shingles(text: str | None, width: int = 3) -> list[int]:
    """XXH64 of each shingle of one text, in order; none if it has no word.

    A-Z are lower-cased, words end at ASCII white space, a text of fewer than ``width`` words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashed, seed = xxhash.xxh64_intdigest, SEED
    return [hashed(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])] or [hashed(joined, seed)]


def bits(values: np.ndarray) -> int:
    """The 64 bits, unsigned, of which each is 1 if it is set in over half of the values; 0 for none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(values), CHUNK):
        part = np.array(values[k : k + CHUNK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text, unsigned; 0 if it has no word.

    A bit is 1 if it is set in over half of the shingles.
    """
    return bits(shingles(text, width))


def fingerprints(text: Column | str, width: int = 3) -> Column:
    """The fingerprints of a text column as signed longs."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _ball(key: Column, bits: int, radius: int) -> Column:
    """All values within ``radius`` (0 or 1) changed bits of a key of so many bits."""
    one = F.array(key)
    return one if not radius else F.concat(one, F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: key.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def near(prints: DataFrame, column: str = "fp", most_bits: int = 3, hot: int = 512) -> DataFrame:
    """(a, b): the pairs of different fingerprints that differ in at most ``most_bits`` (up to 3) bits, a < b.

    The 64 bits are two segments of 32, so a pair differs in at most one bit of one of them: each
    fingerprint is entered in a table under either segment, looks up the ball of radius 1 about its own
    segment, and what is found is verified over all 64 bits. A segment value that over ``hot``
    fingerprints share is split by the other segment in the same way: of its 16-bit parts one differs in
    at most one bit, and of that one's partner a byte does, so that a key never holds more than 2**8
    fingerprints, however they are spread. Nothing is capped or dropped.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("two segments with balls of radius 1 find pairs of at most 3 bits")
    shifts = F.explode(F.array(F.lit(0), F.lit(32)))
    low = F.lit(0xFFFFFFFF).cast("long")
    segment = lambda c, s: F.call_function("shiftrightunsigned", c, s).bitwiseAND(low)
    table = prints.select(F.col(column).alias("fp"), shifts.alias("seg")).select("fp", "seg", segment(F.col("fp"), F.col("seg")).alias("key"))
    probes = table.select(F.col("fp").alias("of"), "seg", F.explode(_ball(F.col("key"), 32, 1)).alias("key"))
    crowded = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("seg", "key")
    verified = lambda x: x.where((F.col("of") < F.col("fp")) & (F.bit_count(F.col("of").bitwiseXOR(F.col("fp"))) <= most_bits)).select(F.col("of").alias("a"), F.col("fp").alias("b"))
    if crowded.isEmpty():
        return verified(probes.join(table, ["seg", "key"])).distinct()
    crowded = stored(crowded, "crowded")
    plain = verified(probes.join(table.join(crowded, ["seg", "key"], "left_anti"), ["seg", "key"]))
    # The other segment's 32 bits: (16-bit part, byte of its partner), the ball about either.
    rest = lambda c: segment(c, F.lit(32) - F.col("seg"))
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(q).alias("byte")) for p in (0, 16) for q in (0, 8)])).alias("cell")
    part = lambda c: F.call_function("shiftright", rest(c), F.col("cell.part")).bitwiseAND(F.lit(0xFFFF).cast("long"))
    byte = lambda c: F.call_function("shiftright", F.call_function("shiftright", rest(c), F.lit(16) - F.col("cell.part")), F.col("cell.byte")).bitwiseAND(F.lit(0xFF).cast("long"))
    fine = table.join(crowded, ["seg", "key"]).select("fp", "seg", "key", cells).select("fp", "seg", "key", "cell", part(F.col("fp")).alias("k1"), byte(F.col("fp")).alias("k2"))
    look = probes.join(crowded, ["seg", "key"]).select("of", "seg", "key", cells)
    look = look.select("of", "seg", "key", "cell", F.explode(_ball(part(F.col("of")), 16, 1)).alias("k1"))
    look = look.select("of", "seg", "key", "cell", "k1", F.explode(_ball(byte(F.col("of")), 8, 1)).alias("k2"))
    return plain.unionAll(verified(look.join(fine, ["seg", "key", "cell", "k1", "k2"]))).distinct()


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, most_bits: int = 3, also: dict[str, Column] | None = None, group: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the least id reachable over links; ``also`` adds columns.

    ``group`` names one more column, a fingerprint that tells components apart also where their least ids are equal.

    Equal fingerprints are linked first, so a group of copies, however large, is one entry in the index.
    A null id takes part with its fingerprint but is never a component's id unless all of the group are
    null; repeated rows come back as often as they came in. No rows give no rows.
    """
    printed = stored(docs.select(F.col(id_column).alias("doc_id"), fingerprints(F.col(text_column), width).alias("fp"), *[c.alias(k) for k, c in (also or {}).items()]), "fingerprints")
    distinct = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = components(near(distinct, "fp", most_bits))
    # A component is named by its least fingerprint; its id is the least of the ids of all its fingerprints.
    named = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    many = named.join(linked.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(many, "component", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), *([F.col("component").alias(group)] if group else []))
    return printed.join(ids, "fp").select("doc_id", "fp", "component_id", *(also or {}), *([group] if group else []))


def one_of_each(docs: DataFrame, named: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The row of ``docs`` of each component of ``named`` (doc_id, _text, component) with the least id, nulls last, and text hash."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_text"))).alias("first"))
    kept = first.select(key("first.doc_id").alias("_key"), F.col("first._text").alias("_text"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key(id_column).alias("_key"), F.xxhash64(text_column).alias("_text"))
    return keyed.join(kept, ["_key", "_text"], "left_semi").dropDuplicates(["_key", "_text"]).select("doc.*")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one whose id is the component's.

    Rows without a word share fingerprint zero and so count as copies. Where several rows of a group have
    that id, the one with the least text hash stays. A null id is kept only in a group without other ids.
    """
    named = groups(docs, id_column, text_column, also={"_text": F.xxhash64(text_column)}, group="component")
    return one_of_each(docs, named, id_column, text_column)
