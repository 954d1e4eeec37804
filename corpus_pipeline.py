"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docharbor.llm import decontam, langid, line_dedup, simhash, sp_codec
from docharbor.llm.common import read, written

MODEL = "piece_bpe_32k.model"
#: A text is rejected if it has no letters or if no language has this posterior.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the labelled documents; null and letterless texts go. Learns from lang and text of all docs."""
    model = langid.fit(docs, public_tokenizers.path(MODEL))
    own = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score")}  # columns of docs with the names of the verdict
    judged = langid.identify(docs.withColumnsRenamed(own), model)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that an earlier line repeats (n_chars follows the text)."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    groups = simhash.near_groups(docs)
    return docs.join(groups.where("doc_id != group_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, edited or not, of a benchmark item."""
    leaks = decontam.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_pieces and round_trip of each document."""
    return sp_codec.encode(docs, public_tokenizers.path(MODEL)).select("doc_id", "source", "lang", "ids", "n_pieces", "round_trip")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("encode", encode)]

#: SQL has no segmentation-marginalised likelihood, Smith-Waterman alignment or subword encoding: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
