"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but
the last return the columns of ``documents``. Rows with null ids or texts and repeated rows go
through like any others, as the operators' docstrings say; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.llm import decontaminate, linededup, packing, quality, simhash
from loamlog.llm.common import forget, in_fold, read_table, stored
from loamlog.session import configure

#: Stages that score, sample and seat cannot be stated in SQL; tests/llm/test_pipeline.py
#: compares every stage with a plain version.
ORACLE_SQL = None
LEAST_QUALITY = 0.3


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote at least 0.3 for good; learned as in op2's query."""
    model = quality.fit_sample(
        docs, read_table(spark, sf_dir, "labels"), lambda doc_id: ~in_fold(doc_id, 5)
    )
    scored = quality.score_documents(docs, model)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated windows; ``n_chars`` follows the text."""
    shorter = linededup.dedup_lines(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.col("n_removed") > 0, n_chars).otherwise(F.col("n_chars"))
    return shorter.withColumn("n_chars", changed).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: four-word shingles, at most four bits apart."""
    return simhash.first_of_each_group(docs, words=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    checked = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return checked.where("n_hit = 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids, the ids with them."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage kept is a table for the next."""
    docs = read_table(configure(spark), sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
