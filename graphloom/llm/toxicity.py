"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.langid import held_out
from graphloom.llm.sampling import first_by_hash
from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

#: A word, in Spark's expressions and in Python's.
WORD_SQL = r"[\p{L}\p{M}]+"
WORD = regex.compile(WORD_SQL)
#: A longer word that isn't scored itself is scored by its first so many letters, written with a star.
STEM = 7
#: Passages of E-values up to this are significant.
SIGNIFICANT = 1e-2


@dataclass
class Model:
    """Token scores in nats, the drift of all other tokens, and the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    scale: float = 1.0  # lambda of the extreme-value law, fitted to clean texts
    size: float = 0.1  # its K, too
    weights: tuple[float, float] = (0.0, 1.0)  # of 1 and of the evidence

    def passages(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        """All maximal scoring passages (score, first word, last word), and the number of words.

        One pass over the scored tokens; a run of others lowers the sum by its length. Each new token joins
        the passages before it for as long as that makes a higher sum (Ruzzo and Tompa). A passage is linked to the
        last before it that begins at a lower sum; a search goes by links, which later ones pass over, so all
        searches together take as many steps as there are tokens.
        """
        words = WORD.findall((text or "").lower())
        get = self.scores.get
        scores = [get(w) or (len(w) > STEM and get(w[:STEM] + "*")) or None for w in words]
        stack: list[tuple[float, float, int, int, int]] = []  # (sum before, sum after, first, last, link)
        total, last = 0.0, -1
        for at, s in enumerate(scores):
            if s is None:
                continue
            before = total + self.other * (at - last - 1)
            total, last = before + s, at
            if s <= 0:
                continue
            first, k = at, len(stack) - 1
            while True:
                while k >= 0 and stack[k][0] >= before:
                    k = stack[k][4]
                if k < 0 or stack[k][1] >= total:
                    stack.append((before, total, first, at, k))
                    break
                before, _, first, _, link = stack[k]
                del stack[k:]
                k = link
        return [(r - b, i, j) for b, r, i, j, _ in stack], len(words)

    def evidence(self, text: str | None) -> tuple[float, int, float]:
        """(minus log10 of the E-value of all significant passages together, their number, the best's score).

        A passage of score S in n words is met by chance K n exp(-lambda S) times.
        """
        found, n = self.passages(text)
        if not found:
            return 0.0, 0, 0.0
        logs = [math.log10(max(self.size * n, 1e-9)) - self.scale * s / math.log(10) for s, _, _ in found]
        good = [x for x in logs if x <= math.log10(SIGNIFICANT)]
        return -(sum(good) if good else min(0.0, min(logs))), len(good), max(s for s, _, _ in found)

    def best(self, text: str | None) -> tuple[float, int]:
        """The score of the best passage, 0 if there is none, and the number of words."""
        found, n = self.passages(text)
        return max((s for s, _, _ in found), default=0.0), n

    def score(self, evidence: float) -> float:
        a, b = self.weights
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * math.log1p(max(0.0, evidence))))))


def _counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of either label that hold the word or stem."""
    listed = docs.select("toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), F.lit(0))).alias("words"))
    stems = F.transform(F.filter("words", lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    words = listed.select("toxic", F.explode(F.array_distinct(F.concat("words", stems))).alias("word"))
    return words.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))


def learn_scores(docs: DataFrame, prior: float = 1.0, least_z: float = 3.5) -> dict[str, float]:
    """Log-odds of words and stems under Dirichlet priors, from (text, toxic).

    The counts of either label, of documents that hold the word, have a Dirichlet prior over the vocabulary, of
    ``prior`` times the label's share a word. Log-odds of either sign count that are ``least_z`` standard errors
    from 0; of all other words nothing is known, and they have the model's drift. The sample bounds their number.
    """
    counts = stored(_counts(docs), "word-counts")
    n = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not n.t or not n.c:
        return {}
    share = n.t / (n.t + n.c)
    rate = lambda y, k: F.log((F.col(y) + prior * k) / F.lit(k))
    # Under no difference the toxic documents with the word are binomial: the standard error of that.
    met = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - met * share) / F.sqrt(met * share * (1 - share) + 0.25)
    rows = counts.select("word", (rate("toxic", share) - rate("clean", 1 - share)).alias("delta"), z.alias("z")).where(F.abs("z") >= least_z).collect()  # bounded by the sample
    return {r.word: float(r.delta) for r in rows}


def extreme_law(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of P(best passage of n words <= x) = exp(-K n exp(-lambda x)), likeliest for clean texts.

    Texts without a passage have a best of 0. With too few passages to tell, 1 and 0.1.
    """
    some = best > 0
    s, n, none = best[some], words[some], words[~some].sum()
    if len(s) < 5 or s.max() <= s.min():
        return 1.0, 0.1
    size = lambda x: len(s) / ((n * np.exp(-x * s)).sum() + none)
    slope = lambda x: len(s) / x - s.sum() + size(x) * (n * s * np.exp(-x * s)).sum()
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, float(size(low))


def learn(labelled: DataFrame, sample_rows: int = 20_000) -> Model:
    """The model of (doc_id, text, toxic): three quarters of the sample give the words, one the calibration.

    The sample is at most ``sample_rows`` rows of each label in order of the hash of the id. The clean texts of
    the last quarter give the extreme-value law, all of it the weight of the evidence.
    """
    hashed = labelled.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic", F.xxhash64("doc_id").alias("_hash"))
    kept = first_by_hash(hashed, "toxic", sample_rows).select("doc_id").distinct()
    rows = labelled.where(F.col("toxic").isin(0, 1)).join(small_side(kept), "doc_id", "left_semi")
    rows = stored(rows.select("text", "toxic", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)) == 0).alias("later")), "labelled-sample")
    model = Model(learn_scores(rows.where(~F.col("later"))))
    later = rows.where("later")
    seen = bests(later, model).select("toxic", "_best.best", "_best.words").toPandas()  # bounded by sample_rows
    clean = seen[seen.toxic == 0]
    model.scale, model.size = extreme_law(clean.best.to_numpy(float), clean.words.to_numpy(float))
    seen = scored(later, model).select("toxic", "_found.evidence").toPandas()  # bounded by sample_rows
    model.weights = _logistic(np.log1p(seen.evidence.to_numpy(float)), seen.toxic.to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Weights of 1 and x >= 0, x's not below 0, by Newton steps; the prior alone where a label is missing."""
    if not len(y):
        return -2.0, 1.0
    rows = np.stack([np.ones(len(x)), x], axis=1)
    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])
    if 0 < y.sum() < len(y):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + ridge * np.eye(2), rows.T @ (y - p) - ridge * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
    return float(w[0]), max(0.0, float(w[1]))


def bests(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the struct ``_best`` of the best passage's score and the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("best double, words long")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.best(t) for t in texts], columns=["best", "words"])

    return docs.withColumn("_best", find(F.col("text")))


def scored(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with the struct ``_found`` of score, evidence and number of passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("score double, evidence double, n_passages int")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            rows = [own.evidence(t) for t in texts]
            yield pd.DataFrame([(own.score(e), e, n) for e, n, _ in rows], columns=["score", "evidence", "n_passages"])

    return docs.withColumn("_found", find(F.col(text_column)))


def passages(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with ``passages``: score, first and last word (numbered from 0) and E-value of each significant one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("array<struct<score:double,first:int,last:int,e_value:double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            out = []
            for t in texts:
                found, n = own.passages(t)
                rows = [(s, i, j, own.size * n * math.exp(-min(700.0, own.scale * s))) for s, i, j in found]
                out.append([dict(zip(("score", "first", "last", "e_value"), r)) for r in rows if r[3] <= SIGNIFICANT])
            yield pd.Series(out)

    return docs.withColumn("passages", find(F.col(text_column)))


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages (significant ones) of every row of ``docs``.

    Learnt from the labels of ids that aren't held out. Null and empty texts have no passage and the score of
    that; a label that is null or repeated with another value counts for nothing. Without labels of both
    kinds no word is scored. Other columns are not read; repeated rows come back as often.
    """
    own = docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id"))
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    model = learn(own.where(~F.col("held_out")).join(one, "doc_id").select("doc_id", "text", "toxic"))
    found = scored(own, model)
    return found.select("doc_id", "held_out", "_found.score", (F.col("_found.score") >= threshold).cast("int").alias("predicted"), "_found.n_passages")
