"""The corpus pipeline: five stages over documents, each written and read again between stages.

Part of the corpus package (``emberlog.llm``); removed together with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import common, langid, packing, quality, simhash, suffixdedup

#: (name, function): each takes (spark, docs, sf_dir) and returns a DataFrame
STAGES = [
    ("quality rules", quality.stage),
    ("language id", langid.stage),
    ("simhash near-dedup", simhash.stage),
    ("suffix-array dedup", suffixdedup.stage),
    ("best-fit packing", packing.stage),
]

#: SQL can't say the learned and hashed stages; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared scratch folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
