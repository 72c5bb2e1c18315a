"""Corpus pipeline: from the table documents to packed training sequences.

Each stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import ensure_checkpoint_dir, table
from millrace.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL has no language model and no tokenizer; the tests hold run() against the stages' own brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents; stages are written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    place = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
