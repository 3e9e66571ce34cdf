"""Text sources: heap snapshots, library prefixes, include and exclude rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.names import pairs

#: Tag of a snapshot line, the table it goes to, and its keys.
TAGS = {
    "static field": ("snap_static_field", {"class": "string", "field": "string", "type": "string", "value": "string"}),
    "instance field": ("snap_instance_field", {"object": "long", "class": "string", "field": "string", "type": "string", "value": "string"}),
    "array element": ("snap_array_element", {"array": "long", "type": "string", "index": "int", "element": "string"}),
}


def snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a heap snapshot's lines ``tag: k=v<TAB>k=v``; other tags are ignored, ``<null>`` is null."""
    rows = spark.read.text(path).select(F.regexp_extract("value", "^([^:]*): ?(.*)$", 1).alias("tag"), pairs(F.regexp_extract("value", "^([^:]*): ?(.*)$", 2)).alias("kv"))
    return {name: rows.where(F.col("tag") == tag).select(*[F.col("kv")[k].cast(t).alias(k) for k, t in keys.items()]) for tag, (name, keys) in TAGS.items()}


def library_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(prefix) of a file's lines, but for blank ones and those with # first."""
    return spark.read.text(path).select(F.trim("value").alias("prefix")).where((F.col("prefix") != "") & ~F.startswith("prefix", F.lit("#")))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(ord, include, pattern) of a file's lines ``+regex`` and ``-regex``; others are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))
    return lines.where(F.substring("value", 1, 1).isin("+", "-")).select("ord", (F.substring("value", 1, 1) == "+").alias("include"), F.expr("substring(value, 2)").alias("pattern"))


def matches_prefix(classes: DataFrame, prefixes: DataFrame, name: str = "name") -> DataFrame:
    """``classes`` with is_library: whether one of the prefixes begins the name, by an equi-join over the name's own prefixes."""
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda n: F.substring(F.col(name), F.lit(1), n))
    out = classes.select(name).distinct().select(name, F.explode(starts).alias("prefix"))
    hit = out.join(prefixes.distinct(), "prefix", "left_semi").select(name).distinct().withColumn("is_library", F.lit(True))
    return classes.join(hit, name, "left").withColumn("is_library", F.coalesce("is_library", F.lit(False)))


def numbered(lines: DataFrame, key: str, order: str) -> DataFrame:
    """``lines`` with ``seq``, their number from 0 within the key."""
    return lines.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
