"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each group linked by shingle similarity, the document with the least id stays.
3. repeats: bytes covered by repeated strings go from the texts.
4. packing: what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roamer.llm.common import shared_folder, table
from roamer.llm.jaccard import keep_one
from roamer.llm.packing import pack_documents
from roamer.llm.quality import filter_documents
from roamer.llm.repeats import remove_repeats
from roamer.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates),
          ("suffix_array_dedup", repeats), ("best_fit_packing", packing)]

#: Token ids are not for SQL to find; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
