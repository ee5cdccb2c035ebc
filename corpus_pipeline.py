"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Language identification, line deduplication, one document of each group of near copies, sources mixed
to their weights, best-fit packing into sequences. Counted as part of sessionlake.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm.common import query, stored
from sessionlake.llm.langid import stage_language_id
from sessionlake.llm.linededup import stage_line_dedup
from sessionlake.llm.mixing import stage_mix
from sessionlake.llm.ngramjoin import stage_near_copies
from sessionlake.llm.packing import stage_pack

STAGES = [
    ("language_id", query(stage_language_id)),
    ("line_dedup", query(stage_line_dedup)),
    ("ngram_jaccard", query(stage_near_copies)),
    ("source_mix", query(stage_mix)),
    ("best_fit_packing", query(stage_pack)),
]

#: No SQL: naive Bayes, tokenizers and hash rounding are beyond it. tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
