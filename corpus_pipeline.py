"""The corpus pipeline: stages that each call one operator of ``sonara.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last one
returns the packed pieces.  ``run`` writes each stage's rows to the shared folder and hands the next one what was written.

In every stage null, empty and wordless texts and rows without an id stay; rows of one id are judged each by its own text
in ``toxicity`` and by what their id is linked with or contaminated by in the others; an empty table gives an empty one;
further columns come back unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonara.llm import debruijn, mil_toxicity, ngram_join, packing, tiling
from sonara.llm.common import Scratch, table
from sonara.llm.tokens import vocabulary_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores reaches 0.3 go."""
    return mil_toxicity.drop_toxic(docs, mil_toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays (each of its texts, if several rows have it)."""
    return ngram_join.keep_one_per_component(docs, n=5, percent=75)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 35-word sequences that start elsewhere too go; every document stays, if need be with an empty text."""
    return debruijn.remove_repeats(docs, span=35).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more with tiles go."""
    return tiling.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into sequences of 4096."""
    return packing.pack(docs, vocabulary_path(), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_substrings),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packed),
]

#: Trained scores and token ids cannot be had from SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "corpus-pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
