"""The corpus pipeline: language ID, line dedup, near-copy join, PII surrogates, packing. Each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkora.llm.common import scratch_dir
from linkora.llm.lang_id import stage_language_id
from linkora.llm.line_dedup import stage_line_dedup
from linkora.llm.ngram_join import stage_one_per_component
from linkora.llm.packing import stage_packing
from linkora.llm.pii import stage_pii

STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("ngram_jaccard_join", stage_one_per_component),
    ("pii_surrogates", stage_pii),
    ("retrieval_packing", stage_packing),
]

# A learned language model and BM25 packing have no SQL counterpart; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
