"""Removal of every byte that a string of ``width`` bytes covers which starts earlier too, by a hash-compared suffix sort.

Any two equal strings of ``width`` bytes hold the same anchor: of their grams of ``gram`` bytes the one of least
hash, the leftmost of equal ones. So only anchors are dealt out, by the gram's prefix polynomial hash; those met once are
done with. Anchors with equal surroundings are one class, whose first stands for it. Where a gram has several
classes, the suffixes from the anchor, and the reversed ones before it, are sorted: a merge sort that compares two suffixes
by their common extension, found in prefix hashes by binary search. Runs of long extensions on both sides are equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.merkle import numbered
from graphloom.plans.checkpoint import cut, stored

WIDTH, GRAM = 100, 32
#: Bytes that are worked on at once; what is longer is taken in overlapping pieces.
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
#: One anchor in so many is counted to learn which grams are too common for one task.
SAMPLE = 64
#: Anchors of one task.
SHARE = 500_000
COVERED, OPEN, COMMON = 0, 1, 2
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 20) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose every bit depends on all bits of ``h``."""
    m = h ^ (h >> np.uint64(32))
    m = m * _MIX
    m ^= m >> np.uint64(32)
    return m * _MIX


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Anchors:
    """Finds anchors in buffers of texts laid end to end."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM):
        self.width, self.gram = width, gram
        n = PIECE + width
        self.up, self.down = powers(n), powers(n, pow(BASE, -1, 1 << 64))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, gram hashes) of the anchors of all windows that lie within a text."""
        inside = np.ones(max(0, len(data) - self.width + 1), bool)
        for s, e in zip(np.maximum(starts, ends - self.width + 1).tolist(), ends.tolist()):
            inside[s:e] = False
        reach = self.width - self.gram + 1
        places, hashes = [], []
        for s in range(0, len(inside), PIECE):
            x = data[s : s + PIECE + self.width - 1]
            prefix = np.zeros(len(x) + 1, np.uint64)
            np.cumsum((x + np.uint64(1)) * self.up[: len(x)], out=prefix[1:])
            h = (prefix[self.gram :] - prefix[: -self.gram]) * self.down[: len(x) - self.gram + 1]
            least, n = (mixed(h) & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
            while n * 2 <= reach:
                least, n = np.minimum(least[:-n], least[n:]), n * 2
            if n < reach:
                least = np.minimum(least[: len(least) - (reach - n)], least[reach - n :])
            at = (least & _PLACE).astype(np.int64)[inside[s : s + len(least)]]
            if len(at):
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                places.append(at + s)
                hashes.append(h[at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place, first = np.unique(np.concatenate(places), return_index=True)
        return place, np.concatenate(hashes)[first]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow column of binary values without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def later_ones(hashes: np.ndarray, contexts: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether an anchor of the same gram and context comes before, in order of document and place."""
    key = mixed(hashes) ^ contexts
    order = np.argsort(key)
    same = np.concatenate([[False], key[order[1:]] == key[order[:-1]]])
    among = order[same | np.concatenate([same[1:], [False]])]
    among = among[np.lexsort((places[among], docs[among], contexts[among], hashes[among]))]
    later = np.zeros(len(key), bool)
    later[among[1:]] = (hashes[among[1:]] == hashes[among[:-1]]) & (contexts[among[1:]] == contexts[among[:-1]])
    return later


ANCHOR = pa.schema([("hash", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("place", pa.int32())])


def anchors(texts: DataFrame, width: int, gram: int, common: list[int], sample: int = 1) -> DataFrame:
    """(hash, context, doc, place) of the anchors of (doc, bytes), one of ``sample``.

    Those that have an equal one earlier in the same batch come with a null hash; for the grams in ``common``
    the place is given as its complement.
    """
    known = np.sort(np.array(common, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, left = Anchors(width, gram), width - gram
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            place, gram_hash = finder.find(data, offsets[:-1], offsets[1:])
            if not len(place):
                continue
            text = np.searchsorted(offsets, place, side="right") - 1
            low, high = np.maximum(offsets[text], place - left), np.minimum(offsets[text + 1], place + width)
            view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
            context = np.array([digest(view[a:b], n) for a, b, n in zip(low.tolist(), high.tolist(), (place - low).tolist())], np.uint64)
            docs, place = own[text].astype(np.int64), (place - offsets[text]).astype(np.int32)
            later = later_ones(gram_hash, context, docs, place)
            hashes, contexts = gram_hash.view(np.int64), np.where(later, np.int64(0), context.view(np.int64))
            place = np.where(np.isin(hashes, known) & ~later, ~place, place).astype(np.int32) if len(known) else place
            keep = (mixed(context ^ gram_hash ^ docs.view(np.uint64)) % np.uint64(sample) == 0) & ~later if sample > 1 else np.ones(len(docs), bool)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep], mask=later[keep]), pa.array(contexts[keep]), pa.array(docs[keep]), pa.array(place[keep])], schema=ANCHOR)

    return texts.mapInArrow(run, "hash long, context long, doc long, place int")


FOUND = pa.schema([("kind", pa.int8()), ("hash", pa.int64()), ("doc", pa.int64()), ("place", pa.int32())])


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, hash, doc, place) from the anchors of whole grams, or of whole classes of common grams.

    COVERED: an earlier anchor has the same surroundings. OPEN: the first of its class, one of several of the gram.
    COMMON: the first of its class of a common gram.
    """

    def out(kind: int, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), kind, np.int8)), pa.array(hashes), pa.array(docs), pa.array(places.astype(np.int32))], schema=FOUND)

    kept: list[list[np.ndarray]] = []
    for batch in batches:
        gone = np.asarray(batch.column(0).is_null())
        docs, places = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        if gone.any():
            yield out(COVERED, np.zeros(int(gone.sum()), np.int64), docs[gone], places[gone])
        here = ~gone
        hashes = batch.column(0).fill_null(0).to_numpy()
        kept.append([hashes[here], batch.column(1).to_numpy()[here], docs[here], places[here]])
    if not sum(len(k[0]) for k in kept):
        return
    hashes, contexts, docs, places = (np.concatenate(x) for x in zip(*kept))
    kept.clear()
    often = places < 0
    order = np.argsort(hashes)
    same = np.concatenate([[False], hashes[order[1:]] == hashes[order[:-1]]])
    order = order[same | np.concatenate([same[1:], [False]]) | often[order]]
    if not len(order):
        return
    order = order[np.lexsort((np.where(often, ~places, places)[order], docs[order], contexts[order], hashes[order]))]
    h, c, d, often = hashes[order], contexts[order], docs[order], often[order]
    p = np.where(often, ~places[order], places[order])
    new_hash = np.concatenate([[True], h[1:] != h[:-1]])
    new_class = new_hash | np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(new_hash) - 1
    several = np.bincount(group[new_class])[group] > 1
    for kind, which in ((COVERED, ~new_class), (OPEN, new_class & several & ~often), (COMMON, new_class & often)):
        if which.any():
            yield out(kind, h[which] if kind else np.zeros(int(which.sum()), np.int64), d[which], p[which])


class Suffixes:
    """Strings of at most ``most`` bytes, and the length of the common extension of any two, by their prefix hashes."""

    def __init__(self, rows: list[bytes], most: int):
        self.n = np.array([min(len(r), most) for r in rows], np.int64)
        flat = np.frombuffer(b"".join(r[:most].ljust(most, b"\0") for r in rows), np.uint8).reshape(len(rows), most)
        # Past its end a string has the code 0, which no byte has.
        self.codes = np.where(np.arange(most) < self.n[:, None], flat.astype(np.int16) + 1, 0)
        self.width = most + 1
        self.prefix = np.zeros((len(rows), most + 1), np.uint64)
        np.cumsum(self.codes.astype(np.uint64) * powers(most), axis=1, out=self.prefix[:, 1:])
        self.flat = self.prefix.ravel()

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.minimum(self.n[x], self.n[y])
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            equal = self.flat[x * self.width + middle] == self.flat[y * self.width + middle]
            low, high = np.where(equal & open_, middle, low), np.where(equal | ~open_, high, middle - 1)
        return low

    def order(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Below, at or above 0 as x sorts before, with or after y."""
        at = self.common(x, y)
        code = lambda z: np.where(at < self.n[z], self.codes[z, np.minimum(at, self.codes.shape[1] - 1)], 0)
        return code(x).astype(np.int64) - code(y)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, extension): the strings sorted within each group (ascending numbers), and what each shares with the one before (-1 at a group's first)."""
        n = len(group)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, n))
        base, size = np.repeat(first, size), np.repeat(size, size)
        order, own = np.arange(n), np.arange(n) - base
        run = 1
        while (size > run).any():
            block = own // run
            begin = (block ^ 1) * run
            moved = np.flatnonzero((size > run) & (begin < size))
            right = (block[moved] & 1).astype(bool)
            low, high = np.zeros(len(moved), np.int64), np.minimum(run, size[moved] - begin[moved])
            other = base[moved] + begin[moved]
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                sign = self.order(order[other[open_] + middle], order[moved[open_]])
                before = np.where(right[open_], sign <= 0, sign < 0)
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
            target = np.arange(n)
            target[moved] = base[moved] + (block[moved] >> 1) * 2 * run + own[moved] - block[moved] * run + low
            merged = np.empty_like(order)
            merged[target] = order
            order, run = merged, run * 2
        shared = np.full(n, -1)
        inner = np.flatnonzero(own > 0)
        shared[inner] = self.common(order[inner], order[inner - 1])
        return order, shared

    def verified(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sort``, held against the bytes; sorted by the bytes instead should two hashes have been equal by chance."""
        order, shared = self.sort(group)
        if not self._holds(order, shared, group):
            order = np.lexsort([*self.codes.T[::-1], group])
            shared = np.where(np.concatenate([[True], group[1:] != group[:-1]]), -1, self._extension(order))
        return order, shared

    def _extension(self, order: np.ndarray) -> np.ndarray:
        a, b = self.codes[order[1:]], self.codes[order[:-1]]
        differs = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
        least = np.minimum(self.n[order[1:]], self.n[order[:-1]])
        return np.concatenate([[-1], np.minimum(differs.argmax(axis=1), least)])

    def _holds(self, order: np.ndarray, shared: np.ndarray, group: np.ndarray) -> bool:
        inner = np.flatnonzero(shared >= 0)
        if (group[order] != group).any() or (self._extension(order)[inner] != shared[inner]).any():
            return False
        x, y, at = order[inner - 1], order[inner], np.minimum(shared[inner], self.codes.shape[1] - 1)
        ended = shared[inner] >= self.codes.shape[1]
        return bool((ended | (self.codes[x, at] <= self.codes[y, at])).all())


def covered(group: np.ndarray, docs: np.ndarray, places: np.ndarray, before: list[bytes], after: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(widest, least) bytes before its anchor at which a string of ``width`` starts that an earlier row of the group has; -1 where none does.

    ``before`` has the reversed bytes before each anchor, ``after`` those from it on.
    """
    reach = width - gram
    left, right = Suffixes(before, reach), Suffixes(after, width)
    (left_order, left_shared), (right_order, right_shared) = left.verified(group), right.verified(group)
    in_order = np.lexsort((places, docs, group))
    widest, least = np.full(len(group), -1), np.full(len(group), -1)
    for back in range(reach + 1):
        run = []
        for order, shared, need in ((left_order, left_shared, back), (right_order, right_shared, width - back)):
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(shared < need)
            run.append(number)
        valid = in_order[(left.n[in_order] >= back) & (right.n[in_order] >= width - back)]
        pair = run[0][valid] * (len(group) + 1) + run[1][valid]
        first = np.zeros(len(valid), bool)
        first[np.unique(pair, return_index=True)[1]] = True
        later = valid[~first]
        widest[later] = back
        least[later] = np.where(least[later] < 0, back, least[later])
    return widest, least


SPAN = "doc long, first int, last int"
SPANS = pa.schema([("doc", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def sorted_groups(width: int, gram: int, block: int = 20_000):
    """A function for mapInArrow: the spans (doc, first, last) that whole groups of (hash, doc, place, before, context) show to be covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        hashes = rows.column("hash").to_numpy()
        by_hash = np.argsort(hashes, kind="stable")
        hashes = hashes[by_hash]
        cuts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        begin = 0
        while begin < len(hashes):
            k = np.searchsorted(cuts, begin + block, side="right") - 1
            end = int(cuts[k]) if cuts[k] > begin else (int(cuts[k + 1]) if k + 1 < len(cuts) else len(hashes))
            end = len(hashes) if begin + block >= len(hashes) else end
            part = rows.take(pa.array(by_hash[begin:end]))
            docs, places, n = (part.column(c).to_numpy() for c in ("doc", "place", "before"))
            texts = part.column("context").to_pylist()
            group = np.cumsum(np.concatenate([[True], hashes[begin + 1 : end] != hashes[begin : end - 1]]))
            widest, least = covered(group, docs, places, [t[:k][::-1] for t, k in zip(texts, n)], [t[k:] for t, k in zip(texts, n)], width, gram)
            met = widest >= 0
            yield pa.RecordBatch.from_arrays([pa.array(docs[met]), pa.array((places - widest)[met].astype(np.int32)), pa.array((places - least + width)[met].astype(np.int32))], schema=SPANS)
            begin = end

    return run


def surroundings(texts: DataFrame, asked: DataFrame, width: int, gram: int) -> DataFrame:
    """(kind, hash, doc, place, before, context) of anchors (kind, hash, doc, place): the bytes around, of which ``before`` lie before the anchor."""
    per = asked.groupBy("doc").agg(F.collect_list(F.struct("kind", "hash", "place")).alias("asked"))
    place, left = F.col("a.place"), width - gram
    before = F.least(place, F.lit(left))
    met = texts.join(per, "doc").select("doc", "bytes", F.explode("asked").alias("a"))
    return met.select("a.kind", "a.hash", "doc", "a.place", before.alias("before"), F.substring(F.col("bytes"), place - before + 1, before + width).alias("context"))


def common_spans(around: DataFrame, width: int, gram: int) -> DataFrame:
    """As ``sorted_groups``, for grams of any number of classes: the strings themselves are grouped, so that equal ones meet first in their own tasks."""
    after = F.length("context") - F.col("before")
    backs = F.sequence(F.greatest(F.lit(0), width - after), F.least(F.col("before"), F.lit(width - gram)))
    each = around.select("doc", "place", "before", "context", F.explode(backs).alias("back"))
    each = each.select("doc", "place", "back", (F.col("place") - F.col("back")).alias("start"), F.substring(F.col("context"), F.col("before") - F.col("back") + 1, F.lit(width)).alias("string"))
    # Stored, so that the join deals both sides itself and can split a string that very many have.
    firsts = stored(each.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-strings")
    later = each.join(firsts, "string").where(F.struct("doc", "start") != F.col("origin"))  # a string may have several anchors
    return later.groupBy("doc", "place").agg(F.max("back").alias("w"), F.min("back").alias("l")).select("doc", (F.col("place") - F.col("w")).cast("int").alias("first"), (F.col("place") - F.col("l") + width).cast("int").alias("last"))


def covered_spans(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, least_common: int = SAMPLE) -> DataFrame:
    """(doc, first, last): spans of bytes, possibly overlapping or past the text's end, whose union is all that is covered.

    ``texts`` is (doc, bytes), doc distinct and in order. A gram with ``least_common`` sampled anchors, and an
    eighth of a task's share, is dealt out by class; that changes the route of its rows, not the result.
    """
    sampled = cut(anchors(texts, width, gram, [], SAMPLE).groupBy("hash").agg(F.count(F.lit(1)).alias("n")))
    total = sampled.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * SAMPLE // SHARE))
    often = max(least_common, total // (8 * tasks))
    common = [r.hash for r in sampled.where(F.col("n") >= often).collect()]  # at most 8 a task
    dealt = F.when(F.col("hash").isNull(), F.xxhash64("doc", "place")).when(F.col("place") < 0, F.xxhash64("hash", "context")).otherwise(F.col("hash"))
    found = stored(anchors(texts, width, gram, common).repartition(tasks, dealt).mapInArrow(classes, "kind byte, hash long, doc long, place int"), "anchors")
    around = surroundings(texts, found.where(F.col("kind") != COVERED), width, gram)
    if common:
        around = stored(around, "surroundings")
    groups = around.where(F.col("kind") == OPEN).select("hash", "doc", "place", "before", "context").repartition(tasks, "hash")
    spans = groups.mapInArrow(sorted_groups(width, gram), SPAN)
    if common:
        spans = spans.unionAll(common_spans(around.where(F.col("kind") == COMMON), width, gram))
    whole = found.where(F.col("kind") == COVERED)
    return spans.unionAll(whole.select("doc", F.greatest(F.col("place") - (width - gram), F.lit(0)).alias("first"), (F.col("place") + width).alias("last")))


KEPT = "doc long, n_bytes long, spans array<struct<first:int,last:int>>, kept binary"


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n_bytes, spans, kept) from (doc, bytes, spans): the spans cut to the text and united, and the bytes outside of them."""
    kinds = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        data, n = np.ascontiguousarray(data), np.diff(offsets)
        lists = batch.column(2)
        count = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        items = lists.flatten()
        text = np.repeat(np.arange(len(n)), count)
        base = offsets[:-1] + np.arange(len(n))  # one apart, so that spans of two texts never touch
        first = items.field(0).to_numpy().astype(np.int64) + base[text]
        last = np.minimum(items.field(1).to_numpy().astype(np.int64), n[text]) + base[text]
        order = np.argsort(first)
        first, last, text = first[order], np.maximum.accumulate(last[order]) if len(order) else last, text[order]
        new = np.concatenate([[True], first[1:] > last[:-1]]) if len(first) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        own, low, high = text[at], first[at], last[np.append(at[1:] - 1, len(last) - 1)] if len(at) else at
        low, high = low - base[own], high - base[own]
        spans = np.bincount(own, minlength=len(n)) if len(own) else np.zeros(len(n), np.int64)
        mask = np.zeros(len(data) + 1, np.int8)
        np.add.at(mask, low + offsets[own], 1)
        np.add.at(mask, high + offsets[own], -1)
        stays = np.cumsum(mask[:-1], dtype=np.int8) == 0
        sizes = n - np.bincount(own, weights=high - low, minlength=len(n)).astype(np.int64) if len(own) else n
        kept = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(data[stays])])
        runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(spans)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], fields=list(kinds)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), runs, kept], names=["doc", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, **settings) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs: first byte and the one past the last) and kept (the other bytes, binary) of every row.

    A byte goes if a string of ``width`` bytes covers it that starts earlier too: in a row of a smaller doc_id, or before in
    the same text; strings may overlap. A null text is empty; texts below ``width`` bytes stay whole. Ids that repeat or
    are null are allowed: nulls come first, rows of equal ids go by a hash of the text, and rows equal in both are one document, given as often as it
    occurs. No rows give none; other columns aren't read.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("bytes"))
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull())
    if unclear.isEmpty():
        texts, names = own.select(F.col("doc_id").cast("long").alias("doc"), "bytes"), None
    else:
        pairs = numbered(own.select(F.lit(0).alias("part"), "doc_id", F.xxhash64("bytes").alias("row")).distinct(), "part", ["doc_id", "row"], "documents").select("idx", F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
        keyed = own.join(pairs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("bytes") == F.col("_row")))
        names = stored(keyed.select("doc_id", F.col("idx").alias("doc"), "bytes"), "numbered-texts")
        texts, names = names.select("doc", "bytes").dropDuplicates(["doc"]), names.select("doc_id", "doc")
    spans = covered_spans(texts, width, gram, **settings).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    result = texts.join(spans, "doc", "left").select("doc", "bytes", "spans").mapInArrow(_without, KEPT)
    result = result.withColumnRenamed("doc", "doc_id") if names is None else names.join(result, "doc").drop("doc")
    return result.select("doc_id", "n_bytes", "spans", "kept")


#: DuckDB SQL for the digest of ``dedup`` of ``documents`` with unique ids: every string of 100 bytes, in hexadecimal.
SQL = r"""
WITH coded AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS code, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, n - 98)) AS pos FROM coded WHERE n >= 100
), strings AS (
  SELECT p.doc_id, pos, substr(code, 2 * pos - 1, 200) AS s FROM places p JOIN coded USING (doc_id)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM strings) WHERE k > 1
), edges AS (
  SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, true) AS opens FROM later
), runs AS (
  SELECT doc_id, min(pos) AS first, max(pos) + 100 AS last FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 1) AS since FROM runs
), kept AS (
  SELECT g.doc_id, string_agg(substr(code, 2 * since - 1, 2 * (first - since)), '' ORDER BY first) AS head, max(last) AS last, count(*) AS n_spans, sum(last - first) AS n_removed
  FROM gaps g JOIN coded USING (doc_id) GROUP BY g.doc_id
)
SELECT c.doc_id, c.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(code, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM coded c LEFT JOIN kept k ON k.doc_id = c.doc_id
"""
