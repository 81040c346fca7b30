"""Documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyra.llm.common import discard, materialize
from papyra.llm.decontaminate import drop_leaks
from papyra.llm.jaccard_join import drop_similar
from papyra.llm.language_id import keep_identified
from papyra.llm.line_dedup import dedup_lines
from papyra.llm.pieces import encode_pieces

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and blank ones too), and those whose calibrated confidence is under one half, go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words and more go, and documents of which nothing is left; null and blank texts stay as they are."""
    return dedup_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document stays, with rows that repeat it; texts without words stay."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and blank texts stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row; null ids for a null text."""
    return encode_pieces(docs, MODEL_FILE)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL can express neither the trained classifier nor the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if isinstance(getattr(last, "papyra_path", None), str):
            discard(last)  # nothing reads the stage before any more
    return STAGES[-1][1](spark, docs, sf_dir)
