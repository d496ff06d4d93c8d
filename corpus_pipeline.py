"""The training-data pipeline: documents in, token counts of the mixed corpus out.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.llm import bpe, cube, gam, lines, nearcopies
from civicpulse.llm.common import Store, table
from civicpulse.llm.queries import LINE_WORDS, RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects (score below 0.3) go."""
    return gam.passing(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of three lines or more, and of single lines of eight words or
    more, go; ``n_chars`` follows the text."""
    cut = lines.deduplicated(docs, run=3, words=LINE_WORDS, counts=False)
    return cut.withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: what SimHash and bands of minima find is compared by the
    Jaccard similarity of five-word shingles, 0.8 or more."""
    return nearcopies.representatives(docs, shingle=5, least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are taken not at all, once or twice."""
    return cube.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokenize", tokenize)]
#: Learnt scores and drawn samples are not expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store.put(docs)
    return docs
