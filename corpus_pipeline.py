"""The corpus pipeline: stages over ``documents``, each on what the one before kept.

Order: documents predicted toxic go; lines met before (or within one word of one) go, and with
them documents that lose every line; of near duplicates one stays; documents that
hold benchmark passages go; the rest are encoded into pieces and decoded.  Each stage's
result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentable.llm import decontam, line_dedup, near_dedup, pieces, toxicity
from sentable.llm.common import cut, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontam.stage),
    ("sentencepiece", pieces.stage),
]

# A trained classifier and a Viterbi segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
