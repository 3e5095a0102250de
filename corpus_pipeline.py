"""A corpus pipeline: from raw documents to token ids.

Each stage takes the documents that the stage before it kept and applies one
operator to all of them; all but the last return the columns of ``documents``.
In every stage empty tables give empty results, very long texts are taken whole,
nulls in other columns don't matter, and columns besides those of ``documents``
pass through unchanged, whatever their names (the last stage leaves them out).
"""

from __future__ import annotations

import atexit
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelark.llm import decontamination, line_dedup, quality_rules, sentencepiece_codec, simhash
from pipelark.llm.session import ready
from pipelark.sources import files

#: No SQL expresses weak supervision, SimHash components, tiling or token ids.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows stay or go together."""
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id has; ``n_chars`` follows the text.

    Null texts stay null; a document that loses all lines has an empty text.
    Null ids come last, and rows that repeat an id and text fare alike.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    shorter = line_dedup.line_dedup(docs.toDF(*at.values()), at["doc_id"], at["text"])
    length = F.length(at["text"]).cast(docs.schema["n_chars"].dataType)
    return shorter.withColumn(at["n_chars"], length).select(*at.values()).toDF(*at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id (null ids last).

    Rows that repeat an id and text are one document.  Null texts, empty texts
    and those without words are near-duplicates of each other.
    """
    return simhash.near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts, and those of an empty benchmark, all stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the text that the ids give back; null and empty texts have none and an empty text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select("doc_id", "lang", "source", "n_chars", F.col("text").alias("whole_text"))
    found = sentencepiece_codec.encode(docs, path, text="whole_text", decoded="text", keep_text=False)
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between them the rows are written to the checkpoint folder and read again.

    What a stage has read is removed when its own rows are written, and what the
    last one reads when Python ends, as the result may be asked for until then.
    """
    folder = f"{ready(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    atexit.register(files.remove, spark, folder)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number:
                files.remove(spark, f"{folder}/{number - 1}")
    return docs
