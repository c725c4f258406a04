"""The corpus pipeline: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, language_id, mixing, quality_rules, simhash
from corpusloom.session import Scratch, note, ship, table

RANKS = "byte_bpe_50k.tiktoken"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders of the stage that was called last, by application.
_last: dict[str, tuple[str, list[Scratch]]] = {}


def stage(f: Stage) -> Stage:
    """A stage that gives back the scratch tables of the one before it.

    A stage's result is written and read again before the next one is called, so the tables that it was made of are read no more; they are
    left where they lie if the documents of the next stage still read them.
    """

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        name, held = _last.pop(spark.sparkContext.applicationId, ("", []))
        if held and name != f.__name__:
            read = docs.inputFiles()
            for scratch in held:
                if not any(os.path.basename(scratch.root) in at for at in read):
                    scratch.drop()
            held = []
        with note() as made:
            out = f(spark, docs, sf_dir)
        _last[spark.sparkContext.applicationId] = f.__name__, [*held, *made]
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base test and whose votes make a good one likelier than not. See quality_rules.good_documents."""
    return quality_rules.good_documents(docs)


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told. See language_id.identified_documents."""
    return language_id.identified_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. See simhash.unique_documents."""
    return simhash.unique_documents(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each source up to its target, repeated where that is larger than the source. See mixing.mixed_documents."""
    return mixing.mixed_documents(docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of the documents' token ids and of what these decode to. See bpe.digests."""
    return bpe.digests(docs, public_tokenizers.path(RANKS))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Byte-pair encoding is beyond SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, made_by in STAGES:
        docs = scratch.keep(made_by(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
