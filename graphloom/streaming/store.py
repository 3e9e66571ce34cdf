"""Incremental joins over a growing stream of (addr, value) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.absint import joined


def grow(updates: DataFrame, store: str, news: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new in a stream of updates to the Parquet table ``store``, and to ``news`` with the batch's number.

    A batch that is run again finds its own pairs in ``store`` and overwrites its part of ``news``.
    """

    def batch(delta: DataFrame, number: int) -> None:
        spark = delta.sparkSession
        try:
            known = spark.read.schema(delta.schema).parquet(store)
        except Exception as error:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = spark.createDataFrame([], delta.schema)
        new = joined(known, delta)[1].persist()
        new.write.mode("overwrite").parquet(f"{news}/batch={number}")
        new.write.mode("append").parquet(store)
        new.unpersist()

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
