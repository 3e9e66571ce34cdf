"""Sets with undo and redo, resolved from their logs for many users at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOREVER = 2**62
#: Rows that are handed on at a time.
MOST_ROWS = 10_000


class _Set:
    """One user's set, and the changes that lead to it; those above ``depth`` are undone."""

    def __init__(self):
        self.since: dict = {}
        self.stack: list[tuple[str, list]] = []
        self.depth = 0

    def _apply(self, adds: bool, ids: list, at: int) -> list[tuple]:
        """Periods (id, first, last) that end."""
        if adds:
            self.since.update((i, at) for i in ids)
            return []
        return [(i, self.since.pop(i), at) for i in ids]

    def take(self, op: str, key, at: int) -> list[tuple]:
        if op == "undo":
            if not self.depth:
                return []
            self.depth -= 1
            kind, ids = self.stack[self.depth]
            return self._apply(kind != "hide", ids, at)
        if op == "redo":
            if self.depth == len(self.stack):
                return []
            kind, ids = self.stack[self.depth]
            self.depth += 1
            return self._apply(kind == "hide", ids, at)
        ids = list(self.since) if op == "clear" else [key]
        if not ids or (op == "hide") == (ids[0] in self.since):
            return []  # nothing changes: no version
        del self.stack[self.depth :]
        self.stack.append((op, ids))
        self.depth += 1
        return self._apply(op == "hide", ids, at)


def _read(log: DataFrame, points: DataFrame | None, out: str, turn) -> DataFrame:
    """What ``turn`` makes of each user's rows, read as a stream: the changes of ``log`` and, after those of their seq, ``points``."""
    dealt = log.select("user", "seq", "op", "id").where(F.col("op").isin("hide", "show", "clear", "undo", "redo")).withColumn("at", F.lit(False))
    if points is not None:
        # Any id does for a point, but no null, which would turn whole numbers of a batch into floats.
        unused = F.coalesce(F.lit("0").try_cast(dict(log.dtypes)["id"]), F.lit(None)).alias("id")
        dealt = dealt.unionByName(points.select("user", "seq", F.lit(None).cast("string").alias("op"), unused, F.lit(True).alias("at")))
    dealt = dealt.dropna(subset=["user", "seq"]).repartition("user").sortWithinPartitions("user", "seq", "at", "op", "id")
    columns = [part.split()[0] for part in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, now, last = None, _Set(), None
        for batch in batches:
            rows = []
            for u, seq, at, op, i in zip(batch["user"].tolist(), batch["seq"].tolist(), batch["at"].tolist(), batch["op"], batch["id"].tolist()):
                if u != user:
                    rows += turn(user, now, None, None, None)
                    user, now, last = u, _Set(), None
                if not at:
                    rows += turn(user, now, seq, op, i)
                elif seq != last:
                    rows += turn(user, now, seq, None, None)
                    last = seq
                if len(rows) >= MOST_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame(turn(user, now, None, None, None), columns=columns)

    return dealt.mapInPandas(run, out)


def periods(log: DataFrame) -> DataFrame:
    """(user, id, first, last): when each id is in its user's set, first <= seq < last; last is ``FOREVER`` for those still there.

    ``log`` has (user, seq, op, id), op being hide, show, clear, undo or redo, in order of seq (ties: op, id). A change
    that changes nothing is no version. A new one drops those that were undone; undo and redo with nothing to
    do are without effect. Rows without a user or seq count for nothing, nor do other ops.

    Logs are dealt by user, sorted and read as a stream: a task holds a user's changes that can still be
    undone or redone, never its whole log.
    """
    kinds = dict(log.dtypes)

    def turn(user, now: _Set, seq, op, i) -> list[tuple]:
        if seq is None:
            return [(user, key, since, FOREVER) for key, since in now.since.items()]
        return [(user, *p) for p in now.take(op, i, seq) if p[1] < p[2]]

    return _read(log, None, f"user {kinds['user']}, id {kinds['id']}, first long, last long", turn)


def states_at(log: DataFrame, points: DataFrame) -> DataFrame:
    """(user, seq, id): the ids in each user's set at each of ``points`` (user, seq), the change of that seq included.

    Points are read with the log and get what is in the set when the stream is there: each is dealt once, wherever it is.
    """
    kinds = dict(log.dtypes)

    def turn(user, now: _Set, seq, op, i) -> list[tuple]:
        if seq is None:
            return []
        if op is not None:
            now.take(op, i, seq)
            return []
        return [(user, seq, key) for key in now.since]

    return _read(log, points.select("user", "seq"), f"user {kinds['user']}, seq {dict(points.dtypes)['seq']}, id {kinds['id']}", turn)
