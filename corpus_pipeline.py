"""From documents to a training mix: five stages, each a table of Parquet to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, langid, linededup, mixing, similar
from graphloom.plans.checkpoint import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learnt language explains: texts without a letter (null ones too) and those far above its usual code length go.

    Without any labelled row all stay. Repeated rows are judged alike; no rows give none; further columns stay.
    """
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that occurred before; those of which nothing is left go. n_chars, if there, follows the text.

    Null texts stay as they are; rows repeated with id and text count as one document, and stay. No column's
    name can clash: the counts take names that are not in use.
    """
    free = lambda name: next(n for k in range(len(docs.columns) + 1) if (n := f"_{name}{k}") not in docs.columns)
    total, removed = free("lines"), free("removed")
    found = linededup.dedup_lines(docs, n_lines=total, n_removed=removed)
    kept = found.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 and more), that of the least id.

    Null ids go where the group has another; texts without a word, null ones too, are one group; repeated rows
    are one document; no rows give none; further columns stay.
    """
    return similar.one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or as a template.

    Null texts and, without items, all rows stay; repeated rows are judged alike; further columns stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots: where and how much the mix takes of each document.

    A null text has size 0, a null source is a source; rows of equal ids keep their own places.
    """
    return mixing.mix(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; every stage is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Signatures and context trees have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
