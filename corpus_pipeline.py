"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, and others that docs has, whatever their names.

Defined cases, in every stage: rows that share a doc_id, or have none, are documents of their own; of rows that are equal in
all columns near-dedup and mixing keep one; null and empty texts fail the quality rules, and pass the other stages as
texts without words; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, decontamination, mixing, neardup, quality, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Rows without doc_id, or with one that several rows have, are documents
    of their own, which go only as near copies; of equal rows one stays. Links are op6's, at a similarity of 0.85 (see README)."""
    named = common.identified(docs)
    rows = named.select(F.col("own").alias("doc_id"), "d.text")
    gone = neardup.near_duplicates(rows).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped id")).distinct()
    return named.join(gone, F.col("own") == F.col("dropped id"), "left_anti").select("d.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; of rows that share a doc_id, or have none, those whose own text leaks go."""
    leaks = decontamination.leaked(docs, common.table(spark, sf_dir, "benchmark"))
    leaking = common.saved(leaks.select(F.col("doc_id").alias("leaking id"), F.col("row").alias("leaking row")).distinct(), "leaking")
    same = docs["doc_id"].eqNullSafe(leaking["leaking id"]) & (F.xxhash64(docs["text"]) == leaking["leaking row"])
    return docs.join(leaking, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: see `quern.llm.mixing.resampled`."""
    return mixing.resampled(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files; returns what reading them back gives for each document."""
    return tokens.tokenized(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", token_output),
]

#: SQL can express neither shingle components nor tiling, permutations or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scope() as keep:  # a stage's own tables go with it
            docs = keep(common.saved(stage(spark, docs, sf_dir), name))
        common.dropped(before)  # where it is a stage's own table
    return STAGES[-1][1](spark, docs, sf_dir)
