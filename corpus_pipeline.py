"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that is
written as Parquet in the folder the cluster shares and read again for the next. All but the last return the columns of
documents. Documents may have further columns, of any names, which go along. In every stage a null text counts as empty,
texts of any length are read whole, repeated rows and null ids are allowed, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.decontaminate import drop_leaks
from voxmere.llm.lines import dedup_lines
from voxmere.llm.pieces import round_trip
from voxmere.llm.quality import filter_quality
from voxmere.llm.simhash import keep_one
from voxmere.llm.text import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior of the weighted rules reject go: null and empty texts do."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that an earlier document has go from the later one, with what is aligned around them,
    and with its last word the document. Earlier is a smaller id; equal rows lose the same lines."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text, with what decoding them gives; older columns of these names go."""
    made = ("n_tokens", "ids", "decoded_sha256", "round_trip")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns if c not in ("text", "n_chars", *made))).alias("row"), "text")
    return round_trip(rows, public_tokenizers.path("piece_bpe_32k.model"), "row").select("row.*", *made)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: Patience alignment and latent search are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
