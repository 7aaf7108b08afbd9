"""A training corpus from raw documents: quality rules, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, written as Parquet
and read again.  All but the last return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from massif.llm import queries as q
from massif.llm.common import remove, share_code, shared_dir, table

STAGES = [
    ("quality rules", q.stage_quality),
    ("language id", q.stage_language),
    ("simhash near-dedup", q.stage_near_duplicates),
    ("benchmark decontamination", q.stage_decontamination),
    ("packing", q.stage_packing),
]
#: Fingerprints, the language model and the tokenizer aren't expressible in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each returns is kept in the cluster's shared folder until the next has read it."""
    share_code(spark)
    folder, docs = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
