"""A training corpus from documents; each stage calls one of the library's operators.

1. quality rules: rejected documents go;
2. line dedup: repeated lines go, and documents of which only short lines are left;
3. near duplicates: one document of each group stays, that of the smallest id;
4. benchmark decontamination: documents with a benchmark window go;
5. byte-level BPE: the ids of what is left, with digests of ids and decoded bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, decontaminate, lines, neardup, quality
from tallyloom.llm._util import MADE, settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs, drop_empty=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return bpe.digests(decoded, ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Suffix arrays, sketches and BPE are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next, then the tables it made on the way are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(MADE.paths)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else settled(docs, since), sf_dir)
    return docs
