"""A corpus pipeline over documents: language ID, exact dedup, n-gram Jaccard join, substring dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curata.llm import exact_dedup, jaccard_join, language_id, packing, substring_dedup
from curata.llm.scratch import JOIN_SETTINGS, Scratch, small_batches, sorted_joins
from curata.llm.tables import read, tokenizer_path
from curata.plans.scratch import consumed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be predicted go; the others stay, with the prediction where lang is null.

    Executors keep Python workers from stage to stage, so batches are small from the first stage on; the driver's memory is that
    of all stages too, so from here on no table is broadcast for being small.
    """
    small_batches(spark)
    sorted_joins(spark)
    return language_id.keep_identified(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return jaccard_join.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents left without words go."""
    return substring_dedup.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("language", language), ("exact_dedup", copies), ("jaccard_join", near_copies), ("substring_dedup", passages), ("packing", pack)]

#: SQL can't express the first stage's automata or the last one's tokenizer; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written and read again in the cluster's shared folder.

    What a stage has read, and the tables that its operator has made, go once its result is written. The session's settings for
    joins are then as they were; the last stage, which is computed later, has none.
    """
    work = Scratch(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    joins = {name: spark.conf.getAll.get(name) for name in JOIN_SETTINGS}
    try:
        for name, stage in STAGES[:-1]:
            with consumed():
                docs = work.table(stage(spark, docs, sf_dir), name)
            if before:
                work.drop(before)
            before = name
    finally:
        for name, value in joins.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return STAGES[-1][1](spark, docs, sf_dir)
