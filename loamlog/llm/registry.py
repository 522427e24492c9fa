"""Queries of the operators: each applies one to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.llm import (
    covertree,
    decontaminate,
    hardnegatives,
    hpylm,
    htmltext,
    idfiles,
    linededup,
    packing,
    periodic,
    quality,
    sharding,
    simhash,
    urlfilter,
)
from loamlog.llm.common import in_fold, read_table
from loamlog.session import configure, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    _QUERIES[run.__name__] = configured
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@_query
def op4_decontamination(spark, sf_dir):
    """Hit words and occurring items of every document."""
    checked = decontaminate.decontaminate(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return checked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query
def op9_simhash(spark, sf_dir):
    """Fingerprint and group of every document: four-word shingles, four bits."""
    documents = read_table(spark, sf_dir, "documents")
    return simhash.near_duplicates(documents, words=4, radius=4, columns=["doc_id"])


@_query
def op5_line_dedup(spark, sf_dir):
    """Every document without the lines of windows that occurred before."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(documents)


URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@_query
def op6_url_filter(spark, sf_dir):
    """Verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, rules).drop("url")


@_query
def op8_cover_tree(spark, sf_dir):
    """Links and group of every vector at cosine 0.93 within its label."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return covertree.near_vectors(vectors, cosine=0.93).drop("embedding", "label")


@_query
def op10_sharding(spark, sf_dir):
    """Shard and slot of every document, sixteen shards, counts at most one apart."""
    placed = sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.drop("group").withColumn("grown_shard", F.lit(None).cast("int"))


def _learnable(doc_id):
    return ~in_fold(doc_id, 5)


@_query
def op2_quality(spark, sf_dir):
    """Quality score of every document, learned from the labels outside the held-out fold."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_sample(documents, read_table(spark, sf_dir, "labels"), _learnable)
    return quality.score_documents(documents, model).select(
        "doc_id",
        in_fold(F.col("doc_id"), 5).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@_query
def op3_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 1024 ids."""
    documents = read_table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(documents, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query
def op7_id_files(spark, sf_dir):
    """Ids of all documents, written as bit-packed files and read back."""
    path = scratch_path(spark, "ids")
    documents = read_table(spark, sf_dir, "documents")
    idfiles.write_ids(documents, path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    found = idfiles.documents_of(idfiles.read_blocks(spark, path))
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query
def op1_hpylm(spark, sf_dir):
    """Base and model scores of every document, a tenth of them held out."""
    documents = read_table(spark, sf_dir, "documents")
    return hpylm.score_documents(documents, in_fold(F.col("doc_id"), 10))


@_query
def op11_hard_negatives(spark, sf_dir):
    """Five negatives for each of the five positives of every hundredth vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return hardnegatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)


def _planted(doc_id, text):
    """A tenth of the texts, from some word on, made of copies of the words that stand there."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(copies, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


@_query
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of every text, a tenth of them made periodic."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    documents = documents.withColumn("text", _planted(F.col("doc_id"), F.col("text")))
    return periodic.collapse_runs(documents).select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2("runs", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_html_text(spark, sf_dir):
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract_text(pages)
