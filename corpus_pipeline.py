"""A corpus pipeline of four operators; counts as part of ``quantloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm._store import Scratch
from quantloom.llm.bpe import encode_decode
from quantloom.llm.decontaminate import decontam_stage
from quantloom.llm.minhash import dedup_stage
from quantloom.llm.quality import quality_stage


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return encode_decode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontam_stage),
    ("bpe encoding and decoding", encode_stage),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
