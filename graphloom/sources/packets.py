"""Record sets: a folder with a Parquet table for each type, and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.model import SCHEMAS, shape

FORMAT = {"format": "graphloom-records", "version": 1}


class WrongFormat(ValueError):
    """A folder that is no record set, or a table of another schema."""


def _shape(schema) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Each table under its name; the manifest comes last, so a folder with one is whole."""
    for name, df in tables.items():
        if name in SCHEMAS and _shape(df.schema) != shape(name):
            raise WrongFormat(f"{name} has {_shape(df.schema)}")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    some = next(iter(tables.values()))
    line = json.dumps(FORMAT | {"tables": {name: _shape(df.schema) for name, df in tables.items()}})
    some.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest_")


def read(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """The tables of one or more record sets, those of one name after each other; checks manifests and schemas."""
    found: dict[str, DataFrame] = {}
    for path in paths:
        row = spark.read.text(f"{path}/_manifest_").first()
        head = json.loads(row.value) if row else {}
        if {k: head.get(k) for k in FORMAT} != FORMAT:
            raise WrongFormat(path)
        for name, own in head["tables"].items():
            df = spark.read.parquet(f"{path}/{name}")
            if _shape(df.schema) != [tuple(x) for x in own] or name in SCHEMAS and _shape(df.schema) != shape(name):
                raise WrongFormat(f"{path}/{name} has {_shape(df.schema)}")
            found[name] = found[name].unionByName(df) if name in found else df
    return found


def lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(line): states, edges and tags in words, for people."""
    out = []
    if "state" in tables:
        out.append(tables["state"].select(F.concat(F.lit("node-"), F.col("id").cast("string"), F.lit(" "), F.concat_ws(" ", "kind", "method", F.col("stmt_index").cast("string"), "stmt_text", "fp", "kont")).alias("line")))
    if "state_edge" in tables:
        out.append(tables["state_edge"].select(F.format_string("edge-%d %d -> %d", "id", "src", "dst").alias("line")))
    if "node_tag" in tables:
        out.append(tables["node_tag"].select(F.format_string("tag-%d node-%d %s", "id", "node", "tag").alias("line")))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def dot(edges: DataFrame, src: str = "src", dst: str = "dst", label: str | None = None) -> DataFrame:
    """(line): the edges' lines of a DOT graph, escaped; ``write.text`` makes a file of them between ``digraph {`` and ``}``."""
    from graphloom.functions.names import dot_text

    quoted = lambda c: F.concat(F.lit('"'), dot_text(F.col(c).cast("string")), F.lit('"'))
    tail = F.concat(F.lit(" [label="), quoted(label), F.lit("];")) if label else F.lit(";")
    return edges.select(F.concat(F.lit("  "), quoted(src), F.lit(" -> "), quoted(dst), tail).alias("line"))
