"""Language ID by prediction by partial matching: byte context trees of orders 0 to 3 for each language.

A tree's frozen counts give each byte a probability: that of its count in the longest context seen, or that
context's escape probability times the shorter context's, without the bytes already excluded. The code
length of a text under a language is the sum of its bytes' minus log2; the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.sampling import first_by_hash
from graphloom.plans.sizes import small_side

LETTER = regex.compile(r"\p{L}")
#: Bytes scored at a time.
PIECE = 1 << 18
#: Entries of the table of code lengths, all languages together: beyond them the contexts of order 3 met least
#: have the code lengths of order 2.
MOST_ENTRIES = 48_000_000


def _folded() -> np.ndarray:
    """Letters to lower case, digits to 0, other ASCII to a space."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isalpha() else 48 if c.isdigit() else 32
    return table


FOLDED = _folded()


@dataclass
class Trees:
    """The languages' context trees, as a table of code lengths by context and symbol."""

    languages: list[str]
    symbol: np.ndarray  # byte to symbol
    state: np.ndarray  # three symbols to the longest context kept
    bits: np.ndarray  # (context * symbols + symbol, language)

    @property
    def symbols(self) -> int:
        return round(len(self.state) ** (1 / 3)) if len(self.state) else 0

    def lengths(self, text: str) -> tuple[np.ndarray, int]:
        """Code length in bits under each language, and the number of bytes."""
        raw = np.frombuffer(("   " + text).encode("utf-8", "replace"), np.uint8)
        a, total = self.symbols, np.zeros(len(self.languages))
        for k in range(3, len(raw), PIECE):
            s = self.symbol[raw[k - 3 : k + PIECE]].astype(np.int64)
            contexts = self.state[(s[:-3] * a + s[1:-2]) * a + s[2:-1]].astype(np.int64)
            total += self.bits[contexts * a + s[3:]].sum(axis=0, dtype=np.float64)
        return total, len(raw) - 3

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, bits a byte); und with score 0 for a text without a letter.

        The score is the language's share of probability, on the evidence of 64 bytes at most.
        """
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, 0.0
        bits, n = self.lengths(text)
        best = int(bits.argmin())
        shares = np.exp2((bits[best] - bits) * min(1.0, 64 / n))
        return self.languages[best], float(1 / shares.sum()), float(bits[best] / n)


def _refined(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Rows of probabilities from rows of counts and the shorter contexts' probabilities (escape method C)."""
    seen = counts > 0
    n, kinds = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
    rest = np.where(seen, 0.0, shorter)
    left = rest.sum(axis=1, keepdims=True)
    escaped = np.where(left > 1e-12, kinds, 0)
    known = np.where(seen, counts, 0) / np.maximum(n + escaped, 1)
    return np.where(n > 0, known + rest / np.maximum(left, 1e-12) * escaped / np.maximum(n + escaped, 1), shorter)


def fit(samples: dict[str, list[str]]) -> Trees:
    """The trees of each language's texts."""
    languages = sorted(samples)
    folded = {k: [FOLDED[np.frombuffer(("   " + t).encode("utf-8", "replace"), np.uint8)] for t in samples[k]] for k in languages}
    used = np.zeros(256, bool)
    used[[32, 48, *range(97, 123)]] = True
    for parts in folded.values():
        for p in parts:
            used[p] = True
    a = int(used.sum()) + 1  # the last symbol stands for all bytes not met
    place = np.full(256, a - 1, np.int64)
    place[used] = np.arange(a - 1)
    if not languages:
        return Trees([], place[FOLDED], np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    grams = {k: (np.concatenate([((p[:-3] * a + p[1:-2]) * a + p[2:-1]) * a + p[3:] for p in (place[q] for q in parts)] or [np.zeros(0, np.int64)])) for k, parts in folded.items()}
    contexts, met = np.unique(np.concatenate([g // a for g in grams.values()]), return_counts=True)
    most = max(1000, MOST_ENTRIES // (a * len(languages)) - a * a)
    contexts = np.sort(contexts[np.argsort(-met, kind="stable")[:most]])
    state = np.tile(np.arange(a * a, dtype=np.int32), a)
    state[contexts] = a * a + np.arange(len(contexts), dtype=np.int32)
    bits = np.empty(((a * a + len(contexts)) * a, len(languages)), np.float32)
    for i, k in enumerate(languages):
        g = grams[k]
        rows = lambda width: np.bincount(g % a ** (width + 1), minlength=a ** (width + 1)).reshape(-1, a).astype(float)  # noqa: B023, E731
        p0 = _refined(rows(0), np.full((1, a), 1 / a))
        p1 = _refined(rows(1), np.repeat(p0, a, axis=0))
        p2 = _refined(rows(2), np.tile(p1, (a, 1)))
        full, n = np.unique(g, return_counts=True)
        at = np.searchsorted(contexts, full // a)
        kept = (at < len(contexts)) & (contexts[np.minimum(at, len(contexts) - 1)] == full // a)
        c3 = np.zeros((len(contexts), a))
        c3[at[kept], (full % a)[kept]] = n[kept]
        p3 = _refined(c3, p2[contexts % (a * a)])
        bits[:, i] = -np.log2(np.maximum(np.concatenate([p2, p3]), 1e-9)).ravel()
    return Trees(languages, place[FOLDED], state, bits)


def sample(docs: DataFrame, most_bytes: int = 400_000, longest: int = 20_000, most_languages: int = 200) -> dict[str, list[str]]:
    """At most ``most_bytes`` of text of each language, from rows of (doc_id, text, lang) with a language.

    Whole texts of at most ``longest`` bytes, in order of the hash of the id, so the same at every run. Of more
    than ``most_languages`` values those with the most rows are learnt (ties: the first in order).
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", F.xxhash64("doc_id", F.octet_length("text")).alias("_hash"), F.least(F.octet_length("text"), F.lit(longest + 1)).alias("_n"))
    labelled = labelled.where(F.col("_n") <= longest)
    learnt = F.broadcast(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc("_rows"), "lang").limit(most_languages).select("lang"))  # at most so many rows
    order = Window.partitionBy("lang").orderBy("_hash")
    first = first_by_hash(labelled.join(learnt, "lang", "left_semi"), "lang", most_bytes // 256)
    kept = first.withColumn("_sum", F.sum("_n").over(order)).where(F.col("_sum") <= most_bytes).select("lang", "_hash").distinct()
    keyed = docs.select("lang", "text", F.xxhash64("doc_id", F.octet_length("text")).alias("_hash"), "doc_id")
    found: dict[str, list[str]] = {}
    for row in keyed.join(small_side(kept), ["lang", "_hash"], "left_semi").where(F.octet_length("text") <= longest).orderBy("lang", "_hash", "doc_id", "text").toLocalIterator():
        found.setdefault(row.lang, []).append(row.text)
    return found


def identified(docs: DataFrame, trees: Trees, text_column: str = "text") -> DataFrame:
    """``docs`` with the struct ``_said`` of lang_pred, score and bits (a byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by MOST_ENTRIES

    @F.pandas_udf("lang_pred string, score double, bits double")
    def say(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "bits"])

    return docs.withColumn("_said", say(F.col(text_column)))


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits of every row of (doc_id, text, lang).

    Learnt from the rows that aren't held out. Without any label, and for null texts and texts without a
    letter, the language is und with score 0. Other columns are not read; repeated rows come back as often.
    """
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    trees = fit(sample(own.where(~F.col("held_out"))))
    return identified(own.select("doc_id", "held_out", "text"), trees).select("doc_id", "held_out", "_said.*")


def usual_bits(samples: dict[str, list[str]]) -> dict[str, float]:
    """The median of the bits a byte of every fourth text of each language, under trees of the others; of four texts or more."""
    trees = fit({k: [t for i, t in enumerate(v) if i % 4] for k, v in samples.items()})
    said = {k: [trees.predict(t) for t in v[::4]] for k, v in samples.items() if len(v) >= 4}
    own = {k: [bits for lang, _, bits in rows if lang == k] for k, rows in said.items()}
    return {k: float(np.median(bits)) for k, bits in own.items() if bits}


def keep_known(docs: DataFrame, most: float = 1.75, slack: float = 64.0) -> DataFrame:
    """``docs`` without those rejected: texts without a letter, and texts that no learnt language explains.

    A text goes if its shortest code is ``slack`` bits above ``most`` times the bits that are usual for its
    language. Learnt as in ``identify``; where no language is learnt, nothing is known and all rows stay. A
    null text has no letter. Repeated rows are judged alike; other columns are kept as they are.
    """
    samples = sample(docs.select("doc_id", "text", "lang").where(~held_out("doc_id")))
    if not samples:
        return docs
    usual = usual_bits(samples)
    said = identified(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"), fit(samples))
    limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in usual.items() for x in (F.lit(k), F.lit(most * v))]), F.col("_said.lang_pred")), F.lit(float("inf"))) if usual else F.lit(float("inf"))
    fits = (F.col("_said.bits") - limit) * F.octet_length("text") <= slack
    return said.where((F.col("_said.lang_pred") != "und") & fits).select("doc.*")
