"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

#: Rows among which the k-th best bounds what is near from below; pairs scored at once; a share of the norms' product beyond rounding.
FLOOR_ROWS, PAIRS, SLACK = 2048, 65_536, 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, with all components finite and one not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of ``rows``, by Lloyd's rounds from a sample of them."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(rows)))
    centres = rows[rng.choice(len(rows), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        nearest = assign(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        n = np.bincount(nearest, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[rng.choice(len(rows), k)])
    return centres


def assign(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    norms = (centres * centres).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * (rows[i : i + 4096] @ centres.T), axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Quantiser:
    """Coarse centroids, and for each part of the residual a codebook."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, rows: np.ndarray, cells: int, parts: int, codes: int = 256) -> Quantiser:
        coarse = k_means(rows, cells)
        rest = rows - coarse[assign(rows, coarse)]
        cuts = np.linspace(0, rows.shape[1], min(parts, rows.shape[1]) + 1).astype(int).tolist()
        return cls(coarse, [k_means(rest[:, a:b], codes, 8) for a, b in zip(cuts, cuts[1:])], cuts)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the codes of its residual."""
        cells = assign(rows, self.coarse)
        rest = rows - self.coarse[cells]
        return cells, np.stack([assign(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes of rows of these cells stand for; inner products with it are the estimates."""
        return self.coarse[cells] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def search(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    sample_rows: int = 20_000,
    most_cells: int = 2048,
    parts: int = 16,
    probe_share: float = 0.55,
    least_probed: int = 1500,
    rerank: int = 100,
    chunk_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every``, its k nearest among all other rows found.

    The quantiser is fitted on at most ``sample_rows`` rows in order of the hash of the id; all rows are
    indexed. A query probes cells by the inner product with their centroids until they hold ``probe_share``
    of all rows, and ``least_probed`` rows at least; and beyond these every cell whose radius leaves room for
    one of the k nearest. Small cells share a bin and large ones are cut over several, of some ``chunk_rows``
    rows each, which meet the queries in blocks, so no task holds more. The ``rerank`` best estimates of each
    bin, of equal ones those of the smaller ids, are scored exactly there, and then all rows whose estimate is
    no farther below the k-th of these than their code is off. By Cauchy and Schwarz neither bound loses a
    nearest row, whatever the vectors; where they are without clusters, the bounds admit most cells.

    Vectors null, zero, or with a null or non-finite component, and rows with a null id take no part. Vectors
    of different lengths have no inner product: each length, of which there are few, has an index of its own.
    Rows that repeat an id are rows like others: each is a candidate of all but itself, and each asks, so
    that a repeated query's ranks come back once for each of its rows. No rows give none. Ties go to the
    smaller id.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    good = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    # The written number tells rows of one id apart.
    good = stored(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    settings = {"k": k, "every": every, "sample_rows": sample_rows, "most_cells": most_cells, "parts": parts, "probe_share": probe_share, "least_probed": least_probed, "rerank": rerank, "chunk_rows": chunk_rows}
    found = [_search(good.where(F.size("vector") == r.size), r.n, **settings) for r in good.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()]  # one row a length
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _search(good: DataFrame, n: int, k: int, every: int, sample_rows: int, most_cells: int, parts: int, probe_share: float, least_probed: int, rerank: int, chunk_rows: int) -> DataFrame:
    """``search`` among ``n`` rows (vec_id, vector, row) of vectors of one length."""
    spark = good.sparkSession
    fitted = _matrix(good.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).select("vector").toPandas().vector)  # bounded by sample_rows
    cells = max(1, min(most_cells, round(2 * n**0.5), len(fitted) // 8))
    quantiser = spark.sparkContext.broadcast(Quantiser.fit(fitted, cells, parts))
    some = spark.sparkContext.broadcast(fitted[:FLOOR_ROWS])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                own = _matrix(rows.vector)
                cell, codes = quantiser.value.encode(own)
                off = np.linalg.norm(own - quantiser.value.decode(cell, codes), axis=1)
                far = np.linalg.norm(own - quantiser.value.coarse[cell], axis=1)
                yield rows.assign(cell=cell.astype("int32"), codes=[c.tobytes() for c in codes], off=off, far=far)

    index = stored(good.mapInPandas(encode, "vec_id long, vector array<double>, row long, cell int, codes binary, off double, far double"), "index")
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas()  # one row a cell
    counts, radius = np.zeros(cells, np.int64), np.zeros(cells)
    counts[sizes.cell], radius[sizes.cell] = sizes.n, sizes.far
    first, pieces = _bins(counts, chunk_rows)
    wanted = min(n, max(round(probe_share * n), least_probed))

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse = quantiser.value.coarse
        reach = np.linalg.norm(coarse, axis=1) + radius
        for rows in batches:
            if not len(rows):
                continue
            asking = _matrix(rows.vector)
            centred, long = asking @ coarse.T, np.linalg.norm(asking, axis=1)
            # The k-th nearest is no worse than that of some rows, the query itself left out.
            floors = np.full(len(rows), -np.inf)
            if len(some.value) > k:
                floors = -np.partition(-(asking @ some.value.T), k, axis=1)[:, k] - SLACK * long * reach.max()
            room = ~(centred + long[:, None] * radius * (1 + SLACK) < floors[:, None])
            order = np.argsort(-centred, axis=1, kind="stable")
            for qid, row, vector, own, floor, able in zip(rows.vec_id, rows.row, rows.vector, order, floors, room):
                first_ones = int((np.cumsum(counts[own]) < wanted).sum()) + 1
                probed = np.concatenate([own[:first_ones], own[first_ones:][able[own[first_ones:]]]])
                probed = probed[counts[probed] > 0]
                spread = np.repeat(probed, pieces[probed])
                bins = first[spread] + np.concatenate([np.arange(p) for p in pieces[probed]])
                by_bin = np.argsort(bins, kind="stable")
                names, starts = np.unique(bins[by_bin], return_index=True)
                yield pd.DataFrame({"query_id": qid, "query_row": row, "query": [vector] * len(names), "floor": floor, "bin": names, "probed": np.split(spread[by_bin].astype("int32"), starts[1:])})

    per_block = 8192
    blocks = max(1, -(-n // (every * per_block)))
    asked = good.where(F.col("vec_id") % every == 0).mapInPandas(probes, "query_id long, query_row long, query array<double>, floor double, bin long, probed array<int>")
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "query_row"), F.lit(blocks)).cast("int"))
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    held = index.withColumn("bin", at(first) + F.pmod(F.xxhash64(F.lit(5), "row"), at(pieces))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "query_row": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        rows = rows.sort_values(["vec_id", "row"], ignore_index=True)  # equal estimates are taken in this order
        own, ids, numbers, own_cells = _matrix(rows.vector), rows.vec_id.to_numpy(), rows.row.to_numpy(), rows.cell.to_numpy()
        coded = quantiser.value.decode(own_cells, np.frombuffer(b"".join(rows.codes), np.uint8).reshape(len(rows), -1))
        off, reach = rows.off.to_numpy(), np.linalg.norm(own, axis=1).max()
        found, most = [], min(rerank, len(rows))
        for i in range(0, len(queries), 128):
            part = queries.iloc[i : i + 128]
            block, qid, qrow = _matrix(part["query"]), part.query_id.to_numpy(), part.query_row.to_numpy()
            open_ = np.zeros((len(qid), cells), bool)
            for j, probed in enumerate(part.probed):
                open_[j, probed] = True
            allowed = open_[:, own_cells] & (numbers[None, :] != qrow[:, None])
            guess, slack = np.where(allowed, block @ coded.T, -np.inf), SLACK * np.linalg.norm(block, axis=1) * reach
            floor = part.floor.to_numpy()
            if most > k:
                best = _first(guess, most)
                first_scores = np.where(np.take_along_axis(allowed, best, 1), np.einsum("qd,qmd->qm", block, own[best]), -np.inf)
                floor = np.fmax(floor, -np.partition(-first_scores, k - 1, axis=1)[:, k - 1] - slack)
            near_by = allowed & ~(guess + np.linalg.norm(block, axis=1)[:, None] * off < (floor - slack)[:, None])
            if np.count_nonzero(near_by) > near_by.size // 8:
                # So many pairs are multiplied at once; what remains is scored again, as equal vectors must have equal scores.
                rough = np.where(near_by, block @ own.T, -np.inf)
                if rough.shape[1] > k:
                    near_by &= ~(rough < (-np.partition(-rough, k - 1, axis=1)[:, k - 1] - 2 * slack)[:, None])
            at, of = np.nonzero(near_by)
            exact = np.concatenate([np.einsum("pd,pd->p", block[at[p : p + PAIRS]], own[of[p : p + PAIRS]]) for p in range(0, len(at), PAIRS)] or [np.zeros(0)])
            sorted_ = np.lexsort((ids[of], -exact, at))
            at, of, exact = at[sorted_], of[sorted_], exact[sorted_]
            top = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append(pd.DataFrame({"query_id": qid[at[top]], "query_row": qrow[at[top]], "vec_id": ids[of[top]], "score": exact[top]}))
        return pd.concat(found)

    keys = ["bin", "block"]
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first(guess: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` greatest values of each row, of equal ones the first."""
    cut = np.partition(guess, guess.shape[1] - most, axis=1)[:, [guess.shape[1] - most]]
    above, level = guess > cut, guess == cut
    missing = most - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level & (level.cumsum(axis=1) <= missing))[1].reshape(len(guess), most)


def _bins(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first bin and the number of bins it is cut over; small cells follow each other in one."""
    first, pieces = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // rows))
    bin_, filled = 0, 0
    for c, n in enumerate(counts):
        if filled and filled + n > rows:
            bin_, filled = bin_ + 1, 0
        first[c] = bin_
        if pieces[c] > 1:
            bin_, filled = bin_ + int(pieces[c]), 0
        else:
            filled += int(n)
    return first, pieces
